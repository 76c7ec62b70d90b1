"""Quality rules with thresholds learned from mergeable quantile sketches per language and source.

Each metric of a document falls in a logarithmic bucket (relative width ACCURACY); a sketch is the counts of a
group's buckets. Counts add up, so map tasks combine them before the shuffle, a group that a third of all rows
belong to sends one row per bucket and task, and the result does not depend on the order of merging. A group's
quartiles are drawn towards those of its language, and these towards the corpus's, the more the fewer documents the
group has, and give its fences, in bucket numbers: q25 - reach * spread and q75 + reach * spread, where spread is
q75 - q25 and the bucket's own width. So a source of long words or of much punctuation has limits of its own. The
fences join back on (language, source).

The metrics vary in ordinary text, so that their spread says something:

  word_length   code points a word; rejected outside both fences
  other_share   code points in words that are no letters or digits, over all, both plus EVENTS; a document is rejected whose
                symbols alone, #*$%&|<>, exceed the upper fence: more symbols than its kind has of all such characters
  repetition    1 - log(distinct words) / log(words), rejected above the upper fence
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import GAP, joined, text_or_empty, whole_row, written

ACCURACY = 0.005
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Characters that other_share counts beside the document's own, so that one more or less in a short text says little.
EVENTS = 5
#: The least repetition that is told apart: documents without a repeated word have none at all.
LEAST_REPETITION = 0.001
#: Interquartile ranges between a quartile and its fence.
REACH = {"word_length": 4.0, "other_share": 2.0, "repetition": 3.0}
#: Documents of a group that weigh as much as its language, and of a language that weigh as much as the corpus.
PULL = 100
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_other added.

    Whole texts, one row at a time; null text has no words. Clashing column names of docs are replaced.
    """
    text = text_or_empty(text_col)
    rows = docs.withColumn("__t", text).withColumns(
        {
            "__w": F.expr(rf"filter(split(__t, r'{GAP}'), w -> w != '')"),
            "__l": F.expr(r"filter(split(__t, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"),
        }
    )
    rows = rows.withColumn(
        "__h",
        F.expr("CASE WHEN size(__w) > 3 THEN transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) END"),
    )
    # Positions of windows that occur twice or more: neighbours in the order of (hash, position) with one hash.
    rows = rows.withColumn(
        "__s",
        F.expr(
            "CASE WHEN size(__h) > size(array_distinct(__h))"
            " THEN sort_array(transform(__h, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    rows = rows.withColumn(
        "__p",
        F.expr(
            "sort_array(transform(filter(transform(__s, (x, k) -> struct(x.i AS i,"
            " (k > 0 AND __s[k - 1].h = x.h) OR (k < size(__s) - 1 AND __s[k + 1].h = x.h) AS again)), x -> x.again), x -> x.i))"
        ),
    )
    # Words under those windows: each adds 3, less what it shares with the next.
    covered = F.expr(
        "CASE WHEN __p IS NULL OR size(__p) = 0 THEN 0L ELSE"
        " aggregate(sequence(0, size(__p) - 1), 0L, (a, k) -> a + CASE WHEN k = size(__p) - 1 THEN 3 ELSE least(3, __p[k + 1] - __p[k]) END) END"
    )
    return rows.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.char_length("__t") - F.char_length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long"),
            "n_distinct": F.size(F.array_distinct("__w")).cast("long"),
            "n_other": F.char_length(F.regexp_replace("__t", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long"),
            "n_dup_lines": F.expr("size(__l) - size(array_distinct(__l))").cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("__t", "__w", "__l", "__h", "__s", "__p")


def bucket(value) -> Column:
    return F.ceil(F.log(value) / math.log(_GAMMA)).cast("int")


def metrics() -> dict[str, Column]:
    """Buckets of the metrics; they mean something from a few words on."""
    words = F.greatest("n_words", F.lit(2))
    repetition = 1 - F.log(F.greatest("n_distinct", F.lit(1))) / F.log(words)
    return {
        "word_length": bucket(F.col("word_chars") / words),
        "other_share": bucket((F.col("n_other") + EVENTS) / (F.col("word_chars") + EVENTS)),
        "repetition": bucket(F.greatest(repetition, F.lit(LEAST_REPETITION))),
    }


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Bucket counts per (lang, source, metric), of rows that pass the fixed base rules."""
    long = measured.where("NOT base_failed").select(
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("bucket")) for m, v in metrics().items()])).alias("m"),
    )
    return long.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """n, q25 and q75 (bucket numbers) of each merged sketch; a sketch has few buckets whatever it counts."""
    w = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bucket"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def fences(counts: DataFrame, reach: dict[str, float], pull: int) -> DataFrame:
    """One row per (lang, source): low_<metric> and high_<metric> for each metric, in bucket numbers."""
    own = quartiles(counts, ["lang", "source"])
    by_lang = quartiles(counts.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    whole = quartiles(counts.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [])
    renamed = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("n", "q25", "q75")})
    all_of = renamed(own, "s_").join(
        renamed(by_lang, "l_").withColumnsRenamed({"lang": "l_lang", "metric": "l_metric"}),
        F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")),
    )
    all_of = all_of.join(F.broadcast(renamed(whole, "w_")), "metric")  # one row per metric

    def drawn(q: str) -> Column:
        lang = (F.col("l_n") * F.col("l_" + q) + pull * F.col("w_" + q)) / (F.col("l_n") + pull)
        return (F.col("s_n") * F.col("s_" + q) + pull * lang) / (F.col("s_n") + pull)

    far = F.create_map(*[F.lit(x) for kv in reach.items() for x in kv])[F.col("metric")]
    spread = far * (F.col("q75") - F.col("q25") + 1)
    limits = all_of.select("lang", "source", "metric", drawn("q25").alias("q25"), drawn("q75").alias("q75"))
    limits = limits.select("lang", "source", "metric", (F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return limits.groupBy("lang", "source").agg(*[of(m, c) for m in reach for c in ("low", "high")])


def outside() -> Column:
    """Whether a row with measures and fences is rejected by one of them."""
    of = metrics()
    return F.coalesce(
        (of["word_length"] < F.col("low_word_length"))
        | (of["word_length"] > F.col("high_word_length"))
        | ((F.col("n_symbols") > 0) & (bucket(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))) > F.col("high_other_share")))
        | (of["repetition"] > F.col("high_repetition")),
        F.lit(False),
    )


def judged(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    reach: dict[str, float] | None = None,
    pull: int = PULL,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns named in carry (default: all of docs) with the measures, base_failed, the limits, and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed
    and no metric beyond its group's fence. Null text has no words and fails; null lang or source is a group of its
    own. Measures are computed in one scan and written to the shared folder, so texts are not scanned twice.
    """
    # Carried columns travel in a struct: none can clash with the measures, whatever its name.
    rows = docs.select(
        whole_row(docs, carry),
        F.col(text_col).alias("__text"),
        F.col(lang_col).alias("__lang"),
        F.col(source_col).alias("__source"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measures(rows, "__text").drop("__text").withColumn("base_failed", base)
    measured = written(measured, "quality-measures")
    limits = written(fences(sketches(measured, "__lang", "__source"), REACH | (reach or {}), pull), "quality-limits")
    out = joined(measured, limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), ["__lang", "__source"])
    return out.withColumn("kept", ~F.col("base_failed") & ~outside())


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns; rows of null or empty text go, repeats are judged alike."""
    return judged(docs, **options).where("kept").select("__row.*")
