"""Exact dedup by a tree-merge of digest runs.

Every input partition is a run of (digest, best id, count), sorted by digest. Rounds merge fan_in neighbouring runs
into one: run r of a round goes to run r // fan_in of the next, as in a binomial tree with fan_in children. A round
is one exchange, over (digest, run), and one merge behind it. Every task sends its run on in the run's order, so what
arrives is a row of sorted pieces; Spark's sort there is a natural merge sort, which finds these pieces and merges them in
passes, and nothing sorts a run again before it is sent. A walk through the merged order then makes neighbours that
agree on the digest, on a second, unrelated digest and on the byte length one entry with the smallest (or largest) id, so
no id ever stands for a text that it was not verified against. The first round joins two runs at a time: a digest that
a third of all rows share comes to a task from two partitions there, and as one entry a run in all later rounds. Entries are
narrow (about 60 bytes), and texts are read once and never shuffled.

A round costs what one aggregate over all entries costs, and there are log(partitions) / log(fan_in) of them: one
plain aggregate would be cheaper wherever the digests fit its one exchange, as here; the tree bounds how many sources any
task hears from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fitted, text_or_empty, whole_row, written

ENTRY = ["digest", "verify", "n_bytes"]
FAN_IN = 8


def digest_runs(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, digest, verify, n_bytes, run) per row, each run sorted by digest."""
    norm = docs.select(F.col(id_col).alias("id"), text.alias("norm"))
    return norm.select(
        "id",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.xxhash64("norm").alias("verify"),
        F.octet_length("norm").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
    ).sortWithinPartitions(*ENTRY)


def merge_round(runs: DataFrame, best, fan_in: int) -> DataFrame:
    """Every fan_in neighbouring runs as one: entries in the order of ENTRY, one each.

    The extreme of a struct is found by sort aggregation, which walks rows in key order. Dealing the rows out by the
    grouping's own keys puts both of its steps behind the exchange.
    """
    to = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    held = runs.select(*ENTRY, to, F.struct("keep_id").alias("best"), "group_size")
    merged = held.repartition(*ENTRY, "run").sortWithinPartitions(*ENTRY, "run").groupBy(*ENTRY, "run").agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
    return merged.select(*ENTRY, "run", F.col("best.keep_id").alias("keep_id"), "group_size")


def merge_runs(runs: DataFrame, keep: str, fan_in: int) -> DataFrame:
    """One entry per verified digest: keep_id and group_size, after rounds of merging until one run is left."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    last = runs.agg(F.max("run")).first()[0]
    n_runs = 0 if last is None else last + 1
    # Null ids lose to any other: a struct of null is the least of all, so it is left out where the smallest wins.
    merged = runs.select("run", *ENTRY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    best = F.max if keep == "max" else lambda c: F.min(F.when(F.col(c)["keep_id"].isNotNull(), F.col(c)))
    step = 2
    while True:
        merged = merge_round(merged, best, step)
        n_runs, step = -(-n_runs // step), fan_in
        if n_runs <= 1:
            return merged.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of rows with the same text
    and the same id (repeated rows) each is reported with kept true, since the id decides; dedup() keeps one of them.
    Null ids lose to any other id; a group of null ids only has keep_id null and kept true for all its rows.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    runs = written(digest_runs(docs, id_col, ascii_lower(text_or_empty(text_col))), "digest-runs")
    groups = merge_runs(runs, keep, fan_in).where("group_size > 1")
    groups = written(groups, "digest-groups")
    # At most n_rows / hot_from digests can have hot_from rows or more, so the broadcast has at most 10,000 rows.
    hot_from = max(1000, runs.count() // 10_000)
    hot = groups.where(F.col("group_size") >= hot_from).select(*ENTRY, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rows = runs.join(F.broadcast(hot), ENTRY, "left")
    cold = groups.where(F.col("group_size") < hot_from)
    alone = rows.where("hot_size IS NULL").join(cold, ENTRY, "left").drop("hot_id", "hot_size")
    found = alone.unionByName(
        rows.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    )
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one row per distinct text.

    Dropped rows are known by id and digest, which tells rows of other texts apart where an id is repeated; of repeated
    rows of one text one stays. Up to 1,000,000 dropped rows are broadcast, so texts stay where they are; beyond that
    the anti-join shuffles.
    """
    marks = exact_dedup(docs, id_col, text_col, keep, fan_in).select(F.col(id_col).alias("lost_id"), F.col("text_sha256").alias("lost_sha"), "kept")
    lost = written(marks.groupBy("lost_id", "lost_sha").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("NOT kept OR copies > 1"), "dedup-lost")
    sha = F.sha2(ascii_lower(text_or_empty(text_col)).cast("binary"), 256)
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), sha.alias("sha"))
    same = [F.col("id").eqNullSafe(F.col("lost_id")), F.col("sha") == F.col("lost_sha")]
    single = rows.join(fitted(lost.select("lost_id", "lost_sha"), 1_000_000), same, "left_anti")
    again = lost.where("kept").select("lost_id", "lost_sha")
    if not again.isEmpty():
        first = rows.join(fitted(again, 1_000_000), same, "left_semi").dropDuplicates(["sha"])
        single = single.unionByName(first)
    return single.select("__row.*")
