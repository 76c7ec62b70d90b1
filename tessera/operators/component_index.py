"""Connected components kept up by changes: edges come and go, and only the components that they touch are found anew.

Three stores: edges by node (each edge at both ends), the component of each node by node, and the nodes of each component by
component. A change reads the components of its edges' ends, their nodes and these nodes' edges, finds the components
among them, and replaces their rows. A component is named by its smallest node, as in a full run; nodes
without edges have none. The labels are published last and name the versions of the other two that belong to them,
so a change that fails in between never shows. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.graph import connected_components, saved, scratch
from tessera.sources.store import BucketStore


class ComponentIndex:
    def __init__(self, spark: SparkSession, folder: str, node_type: str = "bigint", buckets: int = 64):
        store = lambda name, ddl, key: BucketStore(spark, f"{folder}/{name}", StructType.fromDDL(ddl), [key], buckets)
        self.edges = store("edges", f"x {node_type}, y {node_type}", "x")
        self.labels = store("labels", f"node {node_type}, component {node_type}", "node")
        self.members = store("members", f"component {node_type}, node {node_type}", "component")

    def components(self) -> DataFrame:
        """(node, component) of all nodes that have edges."""
        return self.labels.read()

    def change(self, added: DataFrame, removed: DataFrame | None = None, a: str = "a", b: str = "b") -> dict[str, int]:
        """Takes removed edges away, then adds others; counts tell how many nodes' components were found anew, and the buckets read.

        Edges are undirected and either there or not: adding one again, or removing one that is not there, changes nothing;
        self-edges and edges with a null end are left out. An edge that is both removed and added is there afterwards.
        """
        with scratch(self.labels.spark):
            return self._change(added, removed, a, b)

    def _change(self, added: DataFrame, removed: DataFrame | None, a: str, b: str) -> dict[str, int]:
        now = self.labels.version()
        versions = {name: now.marks.get(name, -1) for name in ("edges", "members")}
        self.edges.rollback(versions["edges"])
        self.members.rollback(versions["members"])

        def both(df: DataFrame, gone: bool) -> DataFrame:
            one = df.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
            return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("gone", F.lit(gone))

        changes = both(added, False)
        if removed is not None:
            changes = changes.unionByName(both(removed, True))
        changes = saved(changes.groupBy("x", "y").agg(F.bool_and("gone").alias("gone")), "edge-changes")
        ends = changes.select(F.col("x").alias("node")).distinct()
        own = self.labels.touched(ends)
        labelled = self.labels.read(own, now).join(ends, "node", "left_semi")
        hit = saved(labelled.select("component").distinct(), "hit-components")
        of_hit = self.members.touched(hit)
        known = self.members.read(of_hit, self.members.version(versions["members"])).join(hit, "component", "left_semi")
        nodes = saved(known.select("node").unionByName(ends).distinct(), "hit-nodes")
        places = self.edges.touched(nodes.select(F.col("node").alias("x")))
        around = self.edges.read(places, self.edges.version(versions["edges"])).join(nodes.select(F.col("node").alias("x")), "x", "left_semi")
        fresh = around.join(changes.select("x", "y"), ["x", "y"], "left_anti").unionByName(changes.where("NOT gone").select("x", "y"))
        fresh = saved(fresh, "fresh-edges")
        found = saved(connected_components(fresh.where("x < y"), "x", "y"), "fresh-components")

        # Rows of nodes and components that were touched go; the fresh ones take their place. Other rows of the buckets stay.
        by_x = nodes.select(F.col("node").alias("x"))
        edges = self.edges.change(by_x, lambda old: old.join(by_x, "x", "left_anti").unionByName(fresh))
        gone = hit.unionByName(found.select("component")).distinct()
        members = self.members.change(gone, lambda old: old.join(gone, "component", "left_anti").unionByName(found.select("component", "node")))
        marks = {"edges": edges.version, "members": members.version}
        self.labels.change(nodes, lambda old: old.join(nodes, "node", "left_anti").unionByName(found), marks=marks)
        return {"nodes": nodes.count(), "components_before": hit.count(), "edge_buckets": len(places), "label_buckets": len(own)}
