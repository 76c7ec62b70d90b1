"""Duplicate groups: connected components, representatives, first actions, signatures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.verify import merkle


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a local session may do without, a cluster's may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Erases the tables that saved() wrote within it, for work whose result is stored by then. One driver thread at a time."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends, and a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an undirected edge with the smallest node of its component.

    Rounds of pointing each node at the least label around it and then at that label's own label, so that chains shorten
    by doubling. Each round is saved; the driver reads one count a round.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = saved(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = saved(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("seen")), "y").groupBy("x").agg(F.min("seen").alias("seen"))
        pulled = labels.join(around, "x").select("x", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jumped = pulled.join(labels.select(F.col("x").alias("label"), F.col("label").alias("root")), "label").select("x", "old", F.least("label", "root").alias("label"))
        jumped = saved(jumped, "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("x", "label")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))


def representatives(members: DataFrame, group: str, id_col: str, is_library: Column, byte_identical: Column) -> DataFrame:
    """One representative per group: library members first, then those with a byte-identical edge, then the lowest id."""
    rank = F.struct((~is_library).cast("int"), (~byte_identical).cast("int"), F.col(id_col))
    return members.groupBy(group).agg(F.min_by(id_col, rank).alias("representative"), F.count("*").alias("members"))


def initial_action(is_library: Column, manual_review: Column, group_has_library: Column, is_representative: Column) -> Column:
    keep = is_library | manual_review | (~group_has_library & is_representative)
    return F.when(keep, "keep").otherwise("exclude")


def member_signature(members: DataFrame, group: str, source: Column, id_col: str, depth: int | None = None) -> DataFrame:
    """A digest of each group's exact member set, independent of order; equal signatures mean equal sets."""
    found = merkle(members.select(group, source.alias("__s"), id_col).distinct(), [group], F.concat_ws(":", "__s", F.col(id_col).cast("string")), depth)
    return found.select(group, F.col("hash").alias("signature"), F.col("rows").alias("members"))


def reconcile_groups(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Which groups stay, go and come, by signature: (signature, stored_id, fresh_id, action)."""
    s = stored.select("signature", F.col("group_id").alias("stored_id"))
    f = fresh.select("signature", F.col("group_id").alias("fresh_id"))
    action = F.when(F.col("stored_id").isNull(), "insert").when(F.col("fresh_id").isNull(), "delete").otherwise("keep")
    return s.join(f, "signature", "full_outer").select("signature", "stored_id", "fresh_id", action.alias("action"))


def reconciled_review(stored: DataFrame, stored_members: DataFrame, fresh: DataFrame, fresh_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) after groups were found anew: what was submitted and what a user decided is kept.

    stored (group_id, state, manual) and stored_members (group_id, source, image, action, decided_by: user or automatic);
    fresh (group_id, manual, representative) and fresh_members (group_id, source, image, initial). All ids are text.

    A fresh group with exactly a stored one's members takes its id, and its state: resolved if it needs no manual review,
    pending if only now it does, else as it was; its automatic actions are renewed. Other stored groups go. A new group is
    pending or resolved; members that a user decided about elsewhere keep that decision, and if nothing in it is
    kept then, its representative is, automatically.
    """
    named = lambda df, name: member_signature(df, "group_id", F.col("source"), "image").select("signature", F.col("group_id").alias(name))
    known = named(fresh_members, "fresh_id").join(named(stored_members, "stored_id"), "signature", "left").select("fresh_id", "stored_id")
    known = saved(known, "reconciled-ids")
    was = stored.select(F.col("group_id").alias("stored_id"), F.col("state").alias("old_state"), F.col("manual").alias("old_manual"))
    groups = fresh.withColumnRenamed("group_id", "fresh_id").join(known, "fresh_id").join(was, "stored_id", "left")
    state = F.when(~F.col("manual"), "resolved").when(F.coalesce("old_manual", F.lit(False)), F.col("old_state")).otherwise("pending")
    new_id = F.coalesce("stored_id", F.concat(F.lit("new:"), "fresh_id"))
    groups = saved(groups.select("fresh_id", "stored_id", new_id.alias("group_id"), state.alias("state"), "manual", "representative"), "reconciled-groups")

    old = stored_members.groupBy("source", "image").agg(F.max_by(F.struct("group_id", "action", "decided_by"), "group_id").alias("was"))
    rows = fresh_members.withColumnRenamed("group_id", "fresh_id").join(groups, "fresh_id").join(old, ["source", "image"], "left")
    # In a group that stays the decision is its own; in a new one only a user's counts, wherever it was made.
    user = F.coalesce(F.col("was.decided_by") == "user", F.lit(False))
    rows = rows.withColumn("action", F.when(user, F.col("was.action")).otherwise(F.col("initial"))).withColumn("decided_by", F.when(user, "user").otherwise("automatic"))
    empty = rows.where("stored_id IS NULL").groupBy("fresh_id").agg(F.bool_or(F.col("action") == "keep").alias("keeps")).where("NOT keeps").select("fresh_id", F.lit(True).alias("forced"))
    rows = rows.join(empty, "fresh_id", "left")
    forced = F.coalesce(F.col("forced") & (F.col("image") == F.col("representative")), F.lit(False))
    members = rows.select("group_id", "source", "image", F.when(forced, "keep").otherwise(F.col("action")).alias("action"), F.when(forced, "automatic").otherwise(F.col("decided_by")).alias("decided_by"))
    return groups.select("group_id", "state", "manual"), members


def strongest_evidence(edges: DataFrame, group: str, match_type: str, priority: Column, confidence: str) -> DataFrame:
    return edges.groupBy(group).agg(F.min_by(match_type, priority).alias("strongest"), F.max(confidence).alias("confidence"))
