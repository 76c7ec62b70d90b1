"""Dataset manifest: a persistent Merkle tree per group of rows, kept in aligned blocks, with one version per changed leaf.

A row's leaf is a digest over its fields. Per group (language), leaves stand in the order of their ids; at each level
every two consecutive nodes become their digest (a last one alone the digest of itself) until one is left, the group's
subroot. The subroots, in the order of their groups, are the leaves of one more such tree, whose root names the dataset.

The tree is stored in tiers of aligned blocks: 2^BITS consecutive leaves lie in one task with all nodes above them up to
their block's root; block roots are the leaves of the next tier. A changed leaf makes a version of the tree: it copies the
ancestors of that leaf within its block and shares all other nodes; the copied block root then goes on through the tiers
above, one node a level. Versions there are distributed by a join with the path of their block, so no task holds
the versions of a group. Positions come from one exchange by range over narrow rows (id and digests) and counts per
partition; texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import erase, joined, written

#: Levels of a tier, unless the caller says otherwise: a block has at most 2^BITS leaves.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field as it enters a leaf: '-' for null, else its length in UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _numbered(batches: Iterator) -> Iterator:
    """Adds each row's number within its tree, as far as this partition goes; rows come sorted by tree."""
    import pyarrow as pa

    last, at = object(), 0
    for batch in batches:
        found = []
        for tree in batch.column("tree").to_pylist():
            last, at = tree, at + 1 if tree == last else 0
            found.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "at"])


def placed(nodes: DataFrame, order: Sequence[str], log: dict) -> DataFrame:
    """nodes with pos, their place in their tree in the given order, and n, the tree's size. Equal rows take any order."""
    # The salt lets equal rows, of which there may be many, part at a partition's border.
    salted = nodes.withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order, "salt").drop("salt")
    ranged = ranged.withColumn("part", F.spark_partition_id())
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = written(ranged.mapInArrow(_numbered, f"{held}, at long"), "merkle-placed", log)
    counts = local.groupBy("part", "tree").agg(F.count("*").alias("k"))
    by_tree = Window.partitionBy("tree")
    starts = written(
        counts.select("part", "tree", (F.sum("k").over(by_tree.orderBy("part")) - F.col("k")).alias("start"), F.sum("k").over(by_tree).alias("n")),
        "merkle-starts", log,
    )
    return joined(local, starts, ["part", "tree"]).withColumn("pos", F.col("start") + F.col("at")).drop("part", "at", "start")


def _blocks(bits: int):
    def block(table):
        """One block's rows with their siblings within it, its root, and their copied path, which starts at their changed leaf if they have one."""
        import pyarrow as pa

        table = table.sort_by("pos")
        leaves, changed = table["digest"].to_pylist(), table["changed"].to_pylist()
        height = min(bits, (table["n"][0].as_py() - 1).bit_length())
        levels = [leaves]
        for _ in range(height):
            below = levels[-1]
            levels.append([digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
        siblings, copied = [], []
        for k, leaf in enumerate(leaves):
            around, path = [], [changed[k] or leaf]
            for level, nodes in enumerate(levels[:height]):
                own = k >> level
                other = nodes[own ^ 1] if own ^ 1 < len(nodes) else ""
                around.append((("L" if own & 1 else "R") + other) if other else "")
                path.append(digest(other, path[-1]) if own & 1 else digest(path[-1], other))
            siblings.append(around)
            copied.append(path)
        texts = pa.list_(pa.string())
        added = {"siblings": pa.array(siblings, texts), "copied": pa.array(copied, texts), "block_root": pa.array([levels[-1][0]] * len(leaves), pa.string())}
        for name, values in added.items():
            table = table.append_column(name, values)
        return table

    return block


def _tier(nodes: DataFrame, name: str, log: dict, bits: int) -> DataFrame:
    """nodes (tree, pos, n, digest, changed, others) with siblings, copied and block_root of their block, as a table."""
    nodes = nodes.withColumn("block", F.shiftright("pos", bits))
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return written(nodes.groupBy("tree", "block").applyInArrow(_blocks(bits), f"{held}, siblings array<string>, copied array<string>, block_root string"), name, log)


def paths(nodes: DataFrame, log: dict, bits: int = BITS) -> DataFrame:
    """(tree, pos, siblings, root): each node's siblings from its own level to the root of its tree, tier by tier."""
    tier = _tier(nodes.select("tree", "pos", "n", "digest", F.lit(None).cast("string").alias("changed")), "merkle-upper", log, bits)
    if tier.where(f"n > {1 << bits}").isEmpty():
        return tier.select("tree", "pos", "siblings", F.col("block_root").alias("root"))
    above = paths(_roots(tier, bits), log, bits).select("tree", F.col("pos").alias("block"), F.col("siblings").alias("more"), "root")
    return joined(tier, above, ["tree", "block"]).select("tree", "pos", F.concat("siblings", "more").alias("siblings"), "root")


def _roots(tier: DataFrame, bits: int) -> DataFrame:
    """The roots of a tier's blocks as the leaves of the next."""
    size = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
    return tier.where(F.col("pos") == F.shiftleft("block", bits)).select("tree", F.col("block").alias("pos"), size.alias("n"), F.col("block_root").alias("digest"))


def _copied_above(copied: Column, siblings: Column) -> Column:
    """A version's nodes, continued from its copied block root through the siblings of the tiers above."""
    other = lambda s: F.substring(s, 2, 64)
    parent = lambda h, s: F.sha2(F.when(s.startswith("L"), F.concat(other(s), h)).otherwise(F.concat(h, other(s))).cast("binary"), 256)
    return F.aggregate(siblings, copied, lambda path, s: F.concat(path, F.array(parent(F.element_at(path, -1), s))))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", changes: Mapping[str, Column] | None = None, where: Column | None = None, bits: int = BITS
) -> DataFrame:
    """One row per row of docs: order and group column, pos, n, leaf, siblings, subroot, root, changed, copied.

    siblings go from the leaf's level to the root, each 'L' or 'R' (the side it stands on) and a digest, or '' where a
    node is alone. changes and where make versions: rows where `where` holds take these values for these fields,
    and changed is the leaf that they then have; copied is the version's own nodes, from that leaf to its root, all others
    being shared with the manifest's tree. Rows without a change have changed null and recompute the tree's own path.

    Null fields, groups and ids are values (groups and ids that are null come first); a null condition makes no version.
    Rows with equal ids stand in the order of their leaves, repeated rows are leaves of their own. An empty table has
    no rows and no root. Other columns are not read.
    """
    spark, log = docs.sparkSession, {}
    changed = F.lit(None).cast("string")
    if changes:
        changed = F.when(where, leaf_of([changes.get(f, F.col(f)) for f in fields]))
    leaves = docs.select(F.col(group).alias("tree"), F.col(order).alias("id"), leaf_of([F.col(f) for f in fields]).alias("digest"), changed.alias("changed"))
    leaves = written(leaves, "merkle-leaves", log)
    tier = _tier(placed(leaves, ["id", "digest"], log), "merkle-blocks", log, bits)
    erase(spark, log, "merkle-leaves", "merkle-placed", "merkle-starts")
    above = written(paths(_roots(tier, bits), log, bits).select("tree", F.col("pos").alias("block"), "siblings", F.col("root").alias("subroot")), "merkle-paths", log)
    subroots = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    tops = placed(subroots, ["name"], log)
    tops = tops.join(paths(tops, log, bits).select("pos", F.col("siblings").alias("last"), "root"), "pos").select(F.col("name").alias("tree"), "last", "root")
    above = joined(above, tops, ["tree"]).select("tree", "block", F.concat("siblings", "last").alias("more"), "subroot", "root")
    above = written(above, "merkle-above", log)
    erase(spark, log, "merkle-paths", "merkle-upper", "merkle-placed", "merkle-starts")
    return joined(tier, above, ["tree", "block"]).select(
        F.col("id").alias(order),
        F.col("tree").alias(group),
        "pos",
        "n",
        F.col("digest").alias("leaf"),
        F.concat("siblings", "more").alias("siblings"),
        "subroot",
        "root",
        "changed",
        _copied_above(F.col("copied"), F.col("more")).alias("copied"),
    )


def proof(siblings: Column) -> Column:
    """The digest of a path's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def version_nodes(made: DataFrame, order: str = "doc_id", group: str = "lang") -> DataFrame:
    """(group, order, pos, level, index, digest): the nodes that each version of a manifest has of its own, its leaf at level 0.

    A version reads a node here if its index at that level is pos shifted right by the level, else in the manifest's tree.
    Levels above the subroot's index the tree of groups and have index null.
    """
    height = F.expr("CASE WHEN n <= 1 THEN 0 ELSE char_length(conv(CAST(n - 1 AS STRING), 10, 2)) END")
    nodes = made.where("changed IS NOT NULL").select(group, order, "pos", height.alias("__h"), F.posexplode("copied").alias("level", "digest"))
    return nodes.select(group, order, "pos", "level", F.expr("CASE WHEN level <= __h THEN shiftright(pos, level) END").alias("index"), "digest")
