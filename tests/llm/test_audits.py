"""Manifest, decontamination and divergence: whole tables and odd rows against plain Python."""

from __future__ import annotations

import hashlib
import os
import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import contamination, divergence, merkle
from tessera.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that these operators use inside, as columns of the input.
CLASHING = ["id", "tree", "pos", "n", "leaf", "sha", "hits", "items", "item", "term", "key", "docs", "counts", "bin", "block", "changed", "copied", "__tree", "__id", "rank"]


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["source"], t["lang"], t["n_chars"], t["text"]))


@pytest.fixture(scope="module")
def items():
    t = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    return list(zip(t["item_id"], t["text"]))


@pytest.fixture(scope="module")
def odd(spark):
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", None), (3, "Same Text here", None, None, 14), (4, "same text HERE", "en", "a", 2**63 - 1), (4, "same text HERE", "en", "a", 2**63 - 1),
        (None, "no id at all", "en", "b", 12), (5, long, "en", "b", len(long)), (6, "one", "de", None, 3), (8, "Été ퟿ \U0001f600x " * 30, "fr", "b", None), (9, "w" * 600_000, "", "", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def test_op11(spark, docs):
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in Q.op11_merkle_manifest(spark, SF).collect()}
    assert got == brute.merkle(docs)
    assert {v[5] for v in got.values()} == {True, False}


def _manifest(df, **options):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(df, changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=chosen, **options)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_tiers_give_one_tree(spark, bits):
    """Blocks of 2 to 1,024 leaves, over up to seven tiers, make the same tree, for sizes around powers of two."""
    rows = [(k, f"text {k}", lang, "s", k) for n, lang in ((1, None), (2, "a"), (3, "b"), (64, "c"), (65, "d"), (7, "é"), (8, "z")) for k in range(1000 * n, 1000 * n + n)]
    random.Random(3).shuffle(rows)
    got = _manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), bits=bits)
    folded = F.element_at("copied", -1)
    found = {r[0]: tuple(r[1:]) for r in got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("siblings")), folded, folded == F.col("root")).collect()}
    assert found == brute.merkle([(i, s, x, n, t) for i, t, x, s, n in rows])


def test_versions_share_all_nodes_off_their_path(spark):
    rows = [(k, f"text {k}", "en", "s", k) for k in range(37)]
    made = _manifest(spark.createDataFrame(rows, SCHEMA), bits=2)
    nodes = {}
    for r in merkle.version_nodes(made).collect():
        nodes.setdefault(r.doc_id, {})[(r.level, r["index"])] = r.digest
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaves = [r.leaf for r in made.orderBy("pos").collect()]
    assert nodes
    for k, own in nodes.items():
        level, base, tree, at = 0, leaves, [own[(0, k)] if j == k else x for j, x in enumerate(leaves)], k
        while len(tree) > 1:
            level, at = level + 1, at >> 1
            tree, base = [h(*tree[j : j + 2]) for j in range(0, len(tree), 2)], [h(*base[j : j + 2]) for j in range(0, len(base), 2)]
            assert [j for j in range(len(tree)) if tree[j] != base[j]] == [at]  # one node a level differs, and it is the version's own
            assert tree[at] == own[(level, at)]
        assert len(own) == level + 1


def test_manifest_of_odd_rows(odd):
    got = _manifest(odd).collect()
    assert len(got) == 10 and len({r.root for r in got}) == 1
    assert [r.n for r in got if r.lang == "en"] == [6] * 6
    order = [r.doc_id for r in sorted((r for r in got if r.lang == "en"), key=lambda r: r.pos)]
    assert order == [None, 1, 2, 4, 4, 5]
    distinct = [r for r in odd.select("doc_id", "source", "lang", "n_chars", "text").distinct().collect()]
    leaf = {r[0]: v[0] for r, v in zip(distinct, [brute.merkle([tuple(r)])[r[0]] for r in distinct])}
    assert all(r.leaf == leaf[r.doc_id] for r in got)
    assert _manifest(odd.where("false")).count() == 0
    plain = merkle.manifest(odd)
    assert plain.where("changed IS NOT NULL OR element_at(copied, -1) <> root").count() == 0


def test_many_equal_rows_part_at_borders(spark):
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = merkle.manifest(df, bits=5)
    assert got.agg(F.countDistinct("pos"), F.max("pos"), F.countDistinct("root")).first()[:] == (5000, 4999, 1)


def _leaks(df):
    return {r.doc_id: (r.n_words, {k for h in r.hits for k in range(h.first, h.last + 1)}, r["items"]) for r in df.collect()}


def test_op12(spark, docs, items):
    want = brute.leaks([(i, t) for i, _, _, _, t in docs], items)
    for r in Q.op12_decontamination(spark, SF).collect():
        n, hit, own = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit))


@pytest.fixture(scope="module")
def leaky():
    """Texts over a small vocabulary, so that windows occur, repeat, overlap and share words; items short and long."""
    rng = random.Random(5)
    words = ["ab", "AB", "c", "D", "été", "x9", "\U0001f600", "the"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\x00", "-\n"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 3, 40, 200]))) for k in range(60)]
    items = [(k, text(rng.choice([1, 3, 5, 12, 30]))) for k in range(12)] + [(50, None), (51, "..."), (1, "c c c"), (52, "nowhere in these texts at all")]
    docs += [(100 + k, f"start {items[9][1]} end {items[4][1]}") for k in range(5)] + [(200, items[8][1]), (201, "c " * 3000), (202, None)]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "block_bytes"), [(8 << 20, 16 << 20), (300, 16 << 20), (8 << 20, 60)])
@pytest.mark.parametrize("window", [4, 10])
def test_leaks_in_shards_and_blocks(spark, leaky, shard_bytes, block_bytes, window):
    docs, items = leaky
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _leaks(contamination.contaminated(d, b, window=window, shard_bytes=shard_bytes, block_bytes=block_bytes)) == brute.leaks(docs, items, window)


def test_longest_matches(spark, leaky):
    docs, items = leaky
    docs = [d for d in docs if d[0] != 201]
    items = [i for i in items if i[0] != 1]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {str(k): v for k, v in brute.longest([(i, t or "") for i, t in docs], items).items()}
    for shard_bytes in (8 << 20, 300):
        got = {r["item"]: (r.item_word, r.words, r.doc_id, r.word) for r in contamination.longest_matches(d, b, shard_bytes=shard_bytes).collect()}
        assert got == want


def test_hashes_never_decide_alone():
    """A word that has a test word's number but other bytes ends the match."""
    probes = contamination.Probes([("1", b"aa bb cc")], 3)
    text = b"aa bb cc aa bb dd aa bb cc"
    words = contamination.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    fooled = probes.numbers

    def numbers(w):
        found = fooled(w)
        found[5] = found[2]
        return found

    probes.numbers = numbers
    shard = contamination.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]), probes)
    assert shard.documents() == [(9, [(0, 2), (6, 8)], ["1"])]
    assert len(words.start) == 9


def test_decontaminate(spark, odd, leaky):
    docs, items = leaky
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i for i, (_, hit, _) in brute.leaks(docs, items).items() if not hit}
    kept = contamination.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == want
    some = spark.createDataFrame([(None, "same TEXT"), (7, "gamma; delta alpha")], "item_id long, text string")
    found = contamination.contaminated(odd, some)
    assert found.count() == 10 and sorted(((r.doc_id, r["items"]) for r in found.where("size(items) > 0").collect())) == [(3, ["null"]), (4, ["null"]), (4, ["null"]), (5, ["7"])]
    assert contamination.decontaminate(odd, some).columns == odd.columns and contamination.decontaminate(odd, some).count() == 6
    none = some.where("false")
    assert contamination.contaminated(odd, none).where("size(hits) > 0").count() == 0
    assert contamination.contaminated(odd.where("false"), some).count() == contamination.longest_matches(odd.where("false"), some).count() == 0


def _rows(df):
    return {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()}


def test_op13(spark, docs):
    got = Q.op13_source_divergence(spark, SF)
    assert _rows(got) == brute.divergence([(lang, s, t) for _, s, lang, _, t in docs])
    assert got.count() == len(_rows(got))


@pytest.mark.parametrize("most_entries", [7, 100, divergence.MOST_ENTRIES])
def test_stripes_spill_and_merge(spark, most_entries):
    """However often tables spill, sums and ranks are the same; many ties, terms of one source, and terms of no kept kind."""
    rng = random.Random(9)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), " ".join(rng.choice(["Un", "to", "Öl", "x1y", "zz"]) * rng.choice([1, 2]) for _ in range(rng.randrange(9)))) for _ in range(300)]
    rows += [("xx", "only", "alone"), ("xx", "other", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert _rows(divergence.divergences(df, most_entries=most_entries)) == brute.divergence(rows)
    assert _rows(divergence.divergences(df, least_docs=1, top=2, most_entries=most_entries)) == brute.divergence(rows, 1, 2)


def test_divergence_of_odd_rows(odd):
    rows = [(r.lang, r.source, r.text) for r in odd.select("lang", "source", "text").collect()]
    assert _rows(divergence.divergences(odd, least_docs=1)) == brute.divergence(rows, 1)
    assert _rows(divergence.divergences(odd)) == brute.divergence(rows)
    assert divergence.divergences(odd.where("false")).count() == 0


def test_chances_of_great_counts():
    """Beyond 64 bits the same integers as below."""
    counts = np.array([0, 5, 10**10, 4 * 10**17])
    want = [1 + 10**9 * (int(c) + 2) // (10**18 + 2 * 1000) for c in counts]
    assert divergence._chances(counts, 10**18, 1000).tolist() == want
    p, q = np.array([1, 10**9 + 1]), np.array([10**9 + 1, 1])
    assert divergence._apart(p, q).tolist() == [10**18 // (10**9 + 2)] * 2
