"""Covered albums: an album whose every image has a byte-identical partner of its own in a larger or equal album."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import saved
from tessera.operators.matching import maximum_matching


def covered_albums(edges: DataFrame, images: DataFrame, image_id: str, album: str) -> DataFrame:
    """(album) of those covered by another: byte-identical cross edges (a, b) over images (image_id, album).

    An album covers another of at most its size if a matching of their edges reaches every image of the other. Only pairs
    in which every image of the smaller has an edge are matched, all in one run. Of two albums that cover each other the
    one with the lower name stays.
    """
    a = images.select(F.col(image_id).alias("a"), F.col(album).alias("in_a"))
    b = images.select(F.col(image_id).alias("b"), F.col(album).alias("in_b"))
    pairs = edges.select("a", "b").join(a, "a").join(b, "b").where("in_a <> in_b")
    low = F.col("in_a") < F.col("in_b")
    pairs = pairs.select(
        F.struct(F.least("in_a", "in_b").alias("a"), F.greatest("in_a", "in_b").alias("b")).alias("graph"),
        F.when(low, F.col("a")).otherwise(F.col("b")).alias("left"),
        F.when(low, F.col("b")).otherwise(F.col("a")).alias("right"),
    ).distinct()
    pairs = saved(pairs, "album-edges")
    sizes = images.groupBy(album).agg(F.count("*").alias("n"))
    size = lambda side: sizes.select(F.col(album).alias(f"name_{side}"), F.col("n").alias(f"n_{side}"))
    sized = lambda df: df.join(size("a"), F.col("graph.a") == F.col("name_a")).join(size("b"), F.col("graph.b") == F.col("name_b"))
    # Images with edges are counted exactly, in two steps that combine before they shuffle.
    with_edges = lambda side: pairs.select("graph", side).distinct().groupBy("graph").agg(F.count("*").alias(f"of_{side}"))
    likely = sized(with_edges("left").join(with_edges("right"), "graph"))
    likely = likely.where("(of_right = n_b AND n_a >= n_b AND of_left >= n_b) OR (of_left = n_a AND n_b >= n_a AND of_right >= n_a)").select("graph")
    matched = maximum_matching(pairs.join(likely, "graph", "left_semi")).groupBy("graph").agg(F.count("*").alias("matched"))
    b_goes = (F.col("matched") == F.col("n_b")) & (F.col("n_a") >= F.col("n_b"))
    a_goes = (F.col("matched") == F.col("n_a")) & (F.col("n_b") >= F.col("n_a")) & ~b_goes
    lost = F.when(b_goes, F.col("name_b")).when(a_goes, F.col("name_a"))
    return sized(matched).select(lost.alias(album)).where(F.col(album).isNotNull()).distinct()


def covered_by_content(images: DataFrame, album: str, key: str) -> DataFrame:
    """(album) of those whose images' keys another album has at least as often, where all equal keys count as matches.

    The matching's size is then the sum over keys of the lesser count. Candidates come from each album's rarest key,
    which any album that covers it has to hold, so albums that share a common key only are never paired.
    """
    counts = images.groupBy(album, key).agg(F.count("*").alias("n"))
    spread = counts.groupBy(key).agg(F.count("*").alias("albums"))
    known = counts.join(spread, key)
    rarest = known.groupBy(album).agg(F.min_by(F.struct(F.col(key).alias("key"), F.col("n")), F.struct("albums", key)).alias("r"), F.sum("n").alias("size"))
    rarest = rarest.select(F.col(album).alias("b"), F.col("r.key").alias("key"), F.col("r.n").alias("n_b"), F.col("size").alias("size_b"))
    held = counts.select(F.col(album).alias("a"), F.col(key).alias("key"), F.col("n").alias("n_a"))
    pairs = rarest.join(held, "key").where("a <> b AND n_a >= n_b").select("a", "b", "size_b")
    of_b = counts.select(F.col(album).alias("b"), F.col(key).alias("key"), F.col("n").alias("n_b"))
    matched = pairs.join(of_b, "b").join(held, ["a", "key"]).groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("m"), F.max("size_b").alias("size_b"))
    covers = matched.where("m = size_b").select("a", "b")
    back = covers.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("mutual"))
    lost = covers.join(back, ["a", "b"], "left").where("mutual IS NULL OR a < b")
    return lost.select(F.col("b").alias(album)).distinct()
