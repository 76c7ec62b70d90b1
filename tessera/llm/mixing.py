"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of all words by weight, stopped at cap times what it has, with the excess dealt
again by weight. Every document of a source has the same whole copies, certain, as many as fit the target; the words
left open are sampled. A document's inclusion probability p is in proportion to its importance, where that gives 1 or
more it has one more certain copy, and the scale is set so that the expected words are those left open. Pareto
sampling ranks documents by (u / (1 - u)) / (p / (1 - p)) with u uniform and fixed by the id, and takes them in rank
order until the open words are filled: a sample of fixed size in words with unequal inclusion probabilities. One
move per source, the best fit for the gap that is left, completes the sample.

Importance is by default that of the length class: 1 below 256 words, doubling with every factor of 4, so that long
documents, which fill long contexts, are likelier to be taken. Importances are rounded to powers of two, so a source
has a fixed number of classes, and their totals are all that the scale needs.

The order within a source is found without sorting it in one place: ranks are mapped to (0, 1) and counted in bins
per source, the bin where the running total passes the target is found from the counts, and only rows of that bin
are ordered. The decision is then a comparison with its source's cut, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, joined, text_or_empty, uniform, whole_row, written


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def length_class(size: Column) -> Column:
    """Importance by length: 1, 2, 4 or 8, from 0, 256, 1,024 and 4,096 words on."""
    return F.when(size < 256, 1.0).when(size < 1024, 2.0).when(size < 4096, 4.0).otherwise(8.0)


def power_of_two(importance: Column) -> Column:
    """The nearest power of two from 2^-20 to 2^20; 0 for none and below."""
    nearest = F.pow(F.lit(2.0), F.least(F.lit(20.0), F.greatest(F.lit(-20.0), F.floor(F.log2(importance) + 0.5).cast("double"))))
    return F.when(importance > 0, nearest).otherwise(0.0)


def scales(classes: DataFrame) -> DataFrame:
    """(source, importance, words, open) -> per source scale: p is least(1, scale * importance), and the expected words are open.

    From the highest importance down, a class is certain if the words that the classes above it leave would give it a
    probability of 1 or more; the first class that is not sets the scale for the rest. Sources without open words, or
    all of whose classes are certain, have none.
    """
    w = Window.partitionBy("source").orderBy(F.desc("importance"))
    above = F.sum("words").over(w) - F.col("words")
    rest = F.sum(F.col("words") * F.col("importance")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scale = F.when(rest > 0, (F.col("open") - above) / rest)
    rows = classes.withColumn("scale", scale).where("scale * importance < 1")
    return rows.groupBy("source").agg(F.max_by("scale", "importance").alias("scale"))


def ordinal(names: DataFrame, col: str) -> DataFrame:
    """names (one row per value) with its place from 0 in code-point order, null last, without one task seeing all.

    Ranges of values are ordered apart, and the counts of earlier ranges are added; there are as many counts as
    ranges.
    """
    ranged = names.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ordinal")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    w = Window.partitionBy("__range").orderBy(F.col(col).asc_nulls_last())
    return ranged.join(F.broadcast(before), "__range").select(
        *names.columns, (F.col("before") + F.row_number().over(w) - 1).alias("place")
    )


def targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """totals (source, source_size) with target added: shares by weight, none above cap times its size.

    Each round stops the sources above their limit and deals the rest again; it reads two sums of the written table,
    so any number of sources will do. Sources of size 0 have target 0.
    """
    rows = written(
        ordinal(totals, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))),
        "mix-sources",
    )
    size, weight, limit = F.col("source_size"), F.col("weight"), F.col("source_size") * float(cap)
    goal = rows.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    stopped = -1
    while True:
        full = limit <= weight * share
        n, open_weight, held = rows.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0)), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0))
        ).first()
        if n == stopped or open_weight == 0:
            break
        stopped, share = n, (goal - held) / open_weight
    target = F.when(limit <= weight * share, limit).otherwise(weight * share)
    return rows.select("source", "source_size", "weight", F.when(size == 0, 0.0).otherwise(target).alias("target"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    cap: int = 3,
    importance: Column | None = None,
    seed: int = 17,
    bins: int = 4096,
    carry: list[str] | None = None,
) -> DataFrame:
    """carry's columns of docs (default all) in __row, with size, source_size, target, copies and taken.

    Size: words of the text, 0 for null. copies: how often the mix repeats the document whole; taken: copies * size,
    never above cap (a whole number) times the size. importance, a column of docs (default: the length class), makes
    inclusion within a source unequal; null, zero and negative importance leave a document to the certain copies, and
    a source that has nothing else falls short of its target. Rows that repeat one id have one rank and, at one
    length, are taken or left together; null ids count as one id. Null source is a source, last in order. An empty
    table gives an empty result. Reruns agree, since the random numbers are fixed by id and seed. Columns named in
    carry are written to the shared folder with the sizes, and texts are then read once; without carry, twice.
    """
    if cap != int(cap):
        raise ValueError("cap counts whole copies")
    size = n_words(text_or_empty(text_col))
    base = docs.select(
        whole_row(docs, carry),
        size.alias("size"),
        F.col(source_col).alias("source"),
        uniform(F.col(id_col), seed=seed).alias("u"),
        power_of_two(F.coalesce(importance.cast("double"), F.lit(0.0)) if importance is not None else length_class(size)).alias("importance"),
    )
    narrow = written(base if carry else base.drop("__row"), "mix-sizes")
    if carry:
        base = narrow
    classes = written(narrow.groupBy("source", "importance").agg(F.sum("size").alias("words")), "mix-classes")
    totals = written(classes.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-totals")
    goals = targets(totals, weights, cap).withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = written(goals.withColumn("open", F.col("target") - F.col("certain") * F.col("source_size")), "mix-goals")
    scale = written(scales(joined(classes, goals.select("source", "open"), ["source"])), "mix-scales")
    goals = written(joined(goals, scale, ["source"]), "mix-targets")

    def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
        """Adds whole (certain copies), p (inclusion probability) and v, the Pareto rank mapped to (0, 1)."""
        out = joined(rows, sources, ["source"]).withColumn(
            "p", F.when((F.col("open") > 0) & (F.col("importance") > 0), F.coalesce(F.col("scale") * F.col("importance"), F.lit(1.0))).otherwise(0.0)
        )
        out = out.withColumns({"whole": F.col("certain") + (F.col("p") >= 1).cast("long"), "p": F.when(F.col("p") < 1, F.col("p")).otherwise(0.0)})
        odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        return out.withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))

    order = ranked(narrow, goals).withColumn("bin", F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)))
    order = written(order.select("source", "size", "v", "bin", "p", "whole", "target"), "mix-order")
    # Words left open by the certain copies, and the bin in which the running total passes them.
    binned = order.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target")
    )
    w = Window.partitionBy("source")
    upto = F.sum("words").over(w.orderBy("bin"))
    cuts = binned.withColumns({"open": F.col("target") - F.sum("certain").over(w), "upto": upto}).where("upto > open")
    cuts = cuts.groupBy("source").agg(F.min_by(F.struct("bin", F.col("open"), (F.col("upto") - F.col("words")).alias("before")), "bin").alias("c"))
    cuts = written(cuts.select("source", F.col("c.bin").alias("cut_bin"), F.col("c.open").alias("open"), F.col("c.before").alias("before")), "mix-cuts")
    # Order inside the cut bins only: the first rank whose running total passes what is open.
    inside = joined(order.where("p > 0"), cuts, ["source"], "inner").where("bin = cut_bin")
    by_rank = inside.groupBy("source", "v").agg(F.sum("size").alias("words"), F.max("open").alias("open"), F.max("before").alias("before"))
    run = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("v"))
    edge = by_rank.withColumn("run", run).where("run > open").groupBy("source").agg(
        F.min_by(F.struct("v", "words", (F.col("open") - F.col("run") + F.col("words")).alias("gap")), "v").alias("e")
    )
    edge = written(edge.select("source", F.col("e.v").alias("cut_v"), F.col("e.words").alias("cut_words"), F.col("e.gap").alias("gap")), "mix-edge")
    # One move that brings the total nearest: add a document from beyond the cut, or take the one at the cut and leave
    # out one before it.
    near = joined(order.where("p > 0"), edge, ["source"], "inner")
    near = near.groupBy("source", "v").agg(F.sum("size").alias("words"), *[F.max(c).alias(c) for c in ("cut_v", "cut_words", "gap")])
    miss = F.abs(F.col("gap") - F.when(F.col("v") >= F.col("cut_v"), F.col("words")).otherwise(F.col("cut_words") - F.col("words")))
    fit = near.withColumn("miss", miss).where("miss < gap").groupBy("source").agg(F.min_by(F.struct("v", "cut_v"), F.struct("miss", "v")).alias("m"))
    fit = fit.select(
        "source",
        F.greatest("m.v", "m.cut_v").alias("fill_v"),
        F.when(F.col("m.v") < F.col("m.cut_v"), F.col("m.v")).alias("drop_v"),
    )
    plan = written(joined(joined(goals, edge.select("source", "cut_v"), ["source"]), written(fit, "mix-fit"), ["source"]), "mix-plan")
    done = ranked(base, plan)
    is_at = lambda c: F.coalesce(F.col("v") == F.col(c), F.lit(False))
    inside = F.col("cut_v").isNull() | (F.col("v") < F.col("cut_v"))
    extra = F.when(F.col("p") > 0, ((inside | is_at("fill_v")) & ~is_at("drop_v")).cast("long")).otherwise(0)
    done = done.withColumn("copies", F.coalesce(F.col("whole").cast("long") + extra, F.lit(0).cast("long")))
    return done.select("__row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' own columns, each document once per copy.

    Texts without words have size 0 and fill nothing: they come as often as the certain copies say, or not at all. Nulls
    and repeated rows are as in mixed(); an empty table gives an empty mix.
    """
    return mixed(docs, **options).where("copies > 0").select("__row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")
