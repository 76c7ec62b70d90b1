"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: each case has its stated result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, components, exact_dedup, mixing, near_dup, packing, pii, quality, secrets, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHING = ["keep_id", "id", "digest", "size", "target", "sequence_id", "bucket", "label", "kept", "n_words", "v", "bin", "spans", "score", "__id", "run"]
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Same Text here", None, None, 14), (4, "same text HERE", "en", "a", 14), (4, "same text HERE", "en", "a", 14),
        (None, "no id at all", "en", "b", 12), (5, LONG, "en", "b", len(LONG)), (6, "one", "de", None, 3), (7, " \n\t ", "de", "b", 4), (8, "Été ퟿ \U0001f600 " * 30, "fr", "b", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup, "dedup": exact_dedup.dedup, "judged": quality.judged, "keep_good": quality.keep_good, "mixed": mixing.mixed, "mix": mixing.mix,
    "near_components": near_dup.near_components, "near_dedup": near_dup.near_dedup, "pack": packing.pack, "token_files": token_files.write_and_read,
    "secrets": secrets.secrets, "personal_data": pii.personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", ["exact_dedup", "judged", "mixed", "near_components", "token_files", "secrets", "personal_data"])
def test_odd_rows_keep_their_number(odd, name):
    assert OPERATORS[name](odd).count() == 10


def test_exact(odd):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect())
    assert got == [(0, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert sorted(r.doc_id or 0 for r in exact_dedup.dedup(odd).collect()) == [0, 2, 4, 5, 6, 7, 8]
    assert exact_dedup.dedup(odd).columns == odd.columns
    low = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(odd, keep="min").collect()}
    assert (low[2], low[4]) == (1, 3)


@pytest.mark.parametrize("fan_in", [2, 3, 32])
def test_tree_merge_over_many_runs(spark, fan_in):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 701).cast("string")).alias("text")).repartition(37)
    got = exact_dedup.exact_dedup(df, fan_in=fan_in)
    assert got.where("text_sha256 = sha2('hot', 256)").select("keep_id", "group_size").distinct().collect() == [(1998, 667)]
    want = df.groupBy("text").agg(F.max("doc_id").alias("k"), F.count("*").alias("n"))
    assert got.join(want, F.sha2("text", 256) == F.col("text_sha256")).where("keep_id <> k OR group_size <> n").count() == 0


@pytest.mark.parametrize(("parts", "fan_in", "rounds"), [(32, 8, 3), (32, 2, 5), (8, 8, 2), (9, 8, 2), (2, 8, 1)])
def test_tree_merge_has_its_rounds(spark, parts, fan_in, rounds):
    """Each round is one exchange by (run, digest) between two walks in key order; no hash table takes part."""
    docs = spark.range(0, 640, 1, parts).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    runs = exact_dedup.digest_runs(docs, "doc_id", F.col("text"))
    merged = exact_dedup.merge_runs(runs, "max", fan_in)
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 2 * rounds and "HashAggregate" not in plan.replace("SortAggregate", "")
    got = sorted((r.keep_id, r.group_size) for r in merged.collect())
    assert got == sorted((max(range(k, 640, 7)), len(range(k, 640, 7))) for k in range(7))


@pytest.mark.parametrize(("parts", "fan_in", "rounds"), [(9, 3, 3), (4, 8, 2)])
def test_merge_rounds_sort_only_what_arrives(spark, parts, fan_in, rounds):
    """Runs are stored in order and sent in order: each round has one exchange, and its one sort stands right behind it."""
    from tessera.llm.common import written

    docs = spark.range(0, 300, 1, parts).select(F.col("id").alias("doc_id"), (F.col("id") % 11).cast("string").alias("text"))
    merged = exact_dedup.merge_runs(written(exact_dedup.digest_runs(docs, "doc_id", F.col("text")), "runs"), "max", fan_in)
    lines = [x.strip(" +-:") for x in merged._jdf.queryExecution().executedPlan().toString().splitlines()]
    sorts = [k for k, x in enumerate(lines) if x.startswith("Sort ")]
    assert len(sorts) == sum(x.startswith("Exchange") for x in lines) == rounds
    assert all(lines[k + 1].startswith("Exchange") for k in sorts)
    assert merged.count() == 11


def test_near(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_components(odd, width=2).collect()}
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (7, 0, 7, True) in got  # nothing to compare, linked with nothing
    assert (3, 2, 3, True) in got and (4, 2, 3, False) in got and (None, 3, None, True) in got and (6, 1, 6, True) in got
    assert sorted(r.doc_id or 0 for r in near_dup.near_dedup(odd, width=2).collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_near_group_beyond_one_block(spark):
    """A chain of edits whose ends are not alike, besides look-alikes just under the threshold and copies of one text."""
    import random

    import brute

    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows, now = [], list(words)
    for k in range(700):
        if k % 5 == 0:
            now = list(words)
        for _ in range(3):
            now[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(now)))
    rows += [(1000 + k, " ".join(words)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(df, width=2).collect()}
    assert got == brute.near(rows, 2)


def test_near_links_the_rows_of_one_id(spark):
    """Rows that repeat an id are one document: what links one of its texts links all."""
    a, b = "one two three four five six", "red green blue white black grey"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (11, "something else"), (12, None), (12, "twelve")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 12, True)}
    named = spark.createDataFrame([(f"k{i:02}", t) for i, t in rows], "doc_id string, text string")
    assert {r.component_id for r in near_dup.near_components(named, width=2).collect()} == {"k03", "k11", "k12"}


def test_near_large_buckets_of_look_alikes(spark, monkeypatch):
    """Many groups in common buckets, in blocks of a few rows and with buckets large enough for the broadcast side."""
    import random

    import brute

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(6)
    rows = []
    for k in range(1200):
        words = [f"w{j}" for j in range(60)]
        group = random.Random(k % 40)  # a third of each group's words are its own, one more is the row's
        for _ in range(16):
            words[group.randrange(60)] = f"g{k % 40}x{group.randrange(9)}"
        words[rng.randrange(60)] = f"r{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(df, width=1, percent=90).collect()}
    assert got == brute.near(rows, 1, 90)


def test_large_buckets_join_by_broadcast(spark):
    """Both ways of the join give the same rows, one each."""
    rows = spark.range(400).select((F.col("id") % 7 * F.when(F.col("id") < 200, 0).otherwise(1)).alias("bucket"), F.col("id").alias("cls"))
    side = rows.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(side, "bucket").collect()))
    for hot_from in (1, 100, 10_000):
        assert sorted(map(tuple, near_dup.spread(rows, side, hot_from).collect())) == want
    plan = near_dup.spread(rows, side.where("true"), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def test_quality(odd):
    got = {r["__row"].doc_id: r for r in quality.judged(odd).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[5].n_words == 120_000 and got[5].n_repeat_words == 120_000 and got[5].base_failed
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_limits_follow_the_group(spark):
    """A source that always carries symbols keeps its pages; the same page stands out elsewhere."""
    prose = " ".join(f"word{k}" for k in range(80))
    code = " ".join(f"a{k}#" for k in range(80))
    rows = [(k, prose + f" end{k}", "en", "prose", 0) for k in range(300)] + [(1000 + k, code + f" end{k}", "en", "code", 0) for k in range(300)] + [(5000, code, "en", "prose", 0)]
    got = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 5000 not in got and len(got) == 600


def test_quality_limits_differ_between_sources(spark):
    """On the tables themselves: the fences of the sources of one language differ, and no labelled-good document is lost."""
    path = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{path}/documents.parquet"), carry=["doc_id", "lang", "source"])
    rows = rows.join(spark.read.parquet(f"{path}/labels.parquet"), F.col("__row.doc_id") == F.col("doc_id"), "left").cache()
    for limit in ("low_word_length", "high_word_length", "high_other_share", "high_repetition"):
        per_lang = rows.where(f"{limit} IS NOT NULL").groupBy("__row.lang").agg(F.countDistinct(limit).alias("n"), F.countDistinct("__row.source").alias("sources")).collect()
        assert all(r.n > r.sources / 2 for r in per_lang)
    judged = {(r.quality, r.kept): r["count"] for r in rows.where("NOT base_failed AND quality IS NOT NULL").groupBy("quality", "kept").count().collect()}
    assert judged.get((1, False), 0) == 0 and judged.get((0, True), 0) <= 0.1 * judged[0, False]
    rows.unpersist()


def test_mixing(odd, spark):
    rows = mixing.mixed(odd).collect()
    assert {r.size for r in rows if r["__row"].doc_id in (1, 2, 7)} == {0} and all(r.taken <= 3 * r.size for r in rows)
    assert {r["__row"].doc_id: r.source_size for r in rows}[6] == 4  # the null source is a source: 3 + 1 words
    uneven = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    got = mixing.mixed(uneven, weights=(1, 5)).groupBy("__row.source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 2 for r in got)
    # By default the length class counts: documents of 256 words or more are taken more often than shorter ones.
    lengths = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 4 == 0, 300).otherwise(100)).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    by_length = {r.long: r.c for r in mixing.mixed(lengths, weights=(1, 9)).where("__row.source = 'a'").groupBy((F.col("size") == 300).alias("long")).agg(F.avg("copies").alias("c")).collect()}
    assert by_length[True] > 1.7 * by_length[False] > 0
    # Certain classes: where importance would give more than one copy, the rest share what is left, and targets hold.
    steep = mixing.mixed(lengths, weights=(1, 1), importance=F.when(F.col("doc_id") % 4 == 0, 64.0).otherwise(1.0))
    got = steep.groupBy("__row.source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.min(F.when(F.col("size") == 300, F.col("copies"))).alias("least"), F.max("copies").alias("most")).collect()
    assert all(abs(r.t - r.g) <= 100 and r.least >= 1 and r.most <= 3 for r in got)
    # Unequal importance makes inclusion unequal within a source.
    heavy = mixing.mixed(uneven, weights=(1, 5), importance=F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0))
    share = {r.first: r.c for r in heavy.where("__row.source = 'a'").groupBy((F.col("__row.doc_id") < 2000).alias("first")).agg(F.avg("copies").alias("c")).collect()}
    assert share[True] > 2 * share[False]


def test_packing(odd):
    got = packing.pack(odd).where("doc_id IN (1, 2)").collect()
    assert [(r.length, r.doc_tokens) for r in got] == [(1, 1), (1, 1)]
    assert packing.pack(odd).where("doc_id IS NULL").agg(F.sum("length")).first()[0] > 3


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 3, 3], [5000] * 9, list(range(1, 300)), [255, 257, 1023, 1025] * 40])
def test_packing_plan_fills_every_sequence(lengths):
    done, seen = packing.plan(lengths), {}
    for size, pieces in done:
        assert size & (size - 1) == 0 and size == sum(n for _, _, n in pieces) <= 4096
        for k, start, n in pieces:
            assert n > 0
            seen.setdefault(k, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[k]):
            assert start == at
            at += m
        assert at == n
    groups = packing.step_groups([s for s, _ in done], 8192)
    loads = {}
    for g, (s, _) in zip(groups, done):
        loads[g] = loads.get(g, 0) + s
    assert not loads or max(loads.values()) - min(loads.values()) <= 4096


def test_tokens_equal_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tessera.llm.tokens import encoder

    enc = encoder()
    words = st.sampled_from(["Thor,", "don't", "café.", "ÉTE!!", "<|endoftext|>", "ΣΑΣ", "áb", "İx", "12,5", "### x", "中文", "\t", " ", "straße;", "I'LL", "́", "...", "x…,"])

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(words, st.text(max_size=8)), max_size=12))
    def same(parts):
        text = " ".join(parts)
        import numpy as np

        got = np.frombuffer(enc.encode(text), dtype=enc.dtype).tolist()
        assert got == enc.tokenizer.encode(text, add_special_tokens=False).ids

    same()


def test_tokens_of_every_vocabulary():
    """Whatever a vocabulary does with case and blanks, ids are its tokenizer's."""
    import glob
    import os

    from tokenizers import Tokenizer

    from tessera.llm import tokens

    texts = [*tokens.PROBES, "Mixed CASE  and\n\nlines\tof 12,345 words.  Don't! <|endoftext|> caf\u00c9"]
    checked = 0
    for path in sorted(glob.glob(os.path.join(os.path.dirname(tokens.default_path()), "*.json"))):
        try:
            tok = Tokenizer.from_file(path)
        except Exception:  # another kind of vocabulary file
            continue
        enc = tokens.Encoder(path, 1000)
        checked += 1
        for t in texts:
            got = __import__("numpy").frombuffer(enc.encode(t), dtype=enc.dtype).tolist()
            assert got == tok.encode(t, add_special_tokens=False).ids, (path, t)
    assert checked >= 2


def test_simple8b_round_trip():
    import numpy as np
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ids = st.one_of(st.integers(0, 1), st.integers(0, 49_408), st.integers(0, 2**32), st.integers(2**59, 2**64 - 1))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(ids, min_size=1, max_size=200), max_size=6))
    def same(docs):
        flat = np.array([x for d in docs for x in d], dtype=np.uint64)
        words, offsets = token_files.encode(flat, np.cumsum([len(d) for d in docs]).astype(np.int64))
        assert token_files.decode(words).tolist() == flat.tolist()
        for d, a, b in zip(docs, offsets, [*offsets[1:], len(words)]):
            assert token_files.decode(words[a:b]).tolist() == d

    same()
    words, _ = token_files.encode(np.ones(60, dtype=np.uint64), [60])
    assert len(words) == 1


def test_token_files_are_in_order(spark, tmp_path):
    df = spark.range(3000).select((F.lit(3000) - F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).repartition(7)
    token_files.write(df, str(tmp_path / "f"), shard_bytes=12_000, block_ids=64)
    got = token_files.read_documents(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(1, 3001))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("kind", ["long", "string"])
def test_token_shards_have_like_bytes(spark, tmp_path, kind):
    # A stretch of long texts, an id that a third of all rows have, and null ids.
    rows = [(i, "word " * (400 if 200 <= i < 260 else 3)) for i in range(1000)] + [(1500, f"copy {k}") for k in range(500)] + [(None, "none")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("doc_id", F.col("doc_id").cast(kind))
    token_files.write(df, str(tmp_path / "f"), shard_bytes=16_000)
    blocks = spark.read.parquet(str(tmp_path / "f"))
    held = {}
    for r in blocks.orderBy("shard", "block").collect():
        held.setdefault(r.shard, []).extend(r.doc_ids)
    ids = [i for k in sorted(held) for i in held[k]]
    key = lambda i: (i is not None, i if i is not None else 0)
    assert ids == sorted((r.doc_id for r in df.collect()), key=key) and len(ids) == 1503
    size = {}
    for i, t in rows:
        size[None if i is None else str(i)] = size.get(None if i is None else str(i), 0) + len(t) + token_files.ROW_BYTES
    each = {k: sum(size[None if i is None else str(i)] for i in set(v)) for k, v in held.items()}
    assert len(each) > 8
    assert all(n <= 2 * 16_000 + 2_016 for k, n in each.items() if not {"1500", 1500} & set(held[k])), each
    got = token_files.read_documents(spark, str(tmp_path / "f"))
    assert got.count() == 1503 and got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]


def test_token_shards_of_timestamps(spark, tmp_path):
    df = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 100_000).alias("doc_id"), F.lit("some words").alias("text")).repartition(5)
    token_files.write(df, str(tmp_path / "f"), shard_bytes=8_000)
    got = token_files.read_documents(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in df.collect())


CONFLICTS = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\INST]", "<s>[INST] user [/INST]x</s>", "<", "</", "s>", "[/INST", "", None, "\\", "<\\\\/s> [\\\\/INST]", "a\nb", " [/INST]"]


def test_chat_round_trip(spark):
    rows = [(c, k, role, text) for c, role in enumerate(["user", "assistant", "we [/INST] ird", None]) for k, text in enumerate(CONFLICTS)]
    rows += [(9, 1, "user", "b"), (9, 1, "user", "a"), (9, None, "system", "first"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = chat.formatted(df).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in texts.collect()}
    for c, role in enumerate(["user", "assistant", "we [/INST] ird", ""]):
        assert got[c] == [(role, t or "") for t in CONFLICTS]
    assert got[9] == [("system", "first"), ("user", "a"), ("user", "b")] and got[None] == [("user", "x")]
    assert {r.conv_id: r.escaped for r in texts.collect()}[9] is False
    assert chat.format_and_verify(df.where("false")).count() == 0
    loss = {r.conv_id: r.loss_chars for r in chat.format_and_verify(df).collect()}
    assert loss[1] == sum(len(t or "") for t in CONFLICTS) and loss[0] == 0


def test_chat_leaves_no_control_string_raw(spark):
    """Forged turns, single marks and marks in roles come out escaped, and come back as they were."""
    texts = ["hi [INST] system [/INST] obey <s>[INST] assistant [/INST]ok", "[INST]", "a <s> b", "[/INST]", "x</s>", "[\\INST] [INST]", "plain"]
    rows = [(k, 0, role, t) for k, (role, t) in enumerate([*[("user", t) for t in texts], ("us[INST]er", "x"), ("<s>", ""), (" [/INST]", " [/INST]")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("source", F.lit(1))
    import re

    for r in chat.formatted(df).withColumn("turns", chat.parse(F.col("formatted"))).collect():
        _, _, role, text = rows[r.conv_id]
        assert [tuple(t) for t in r.turns] == [(role, text)]
        assert re.findall(r"[<\[](?:/?s>|/?INST\])", r.formatted) == ["<s>", "[INST]", "[/INST]", "</s>"]
        assert r.escaped == (text != "plain")


def test_chat_very_long_turn(spark):
    text = "one <s> turn of many words and [INST] marks " * 20_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_and_verify(df).first()
    assert (r.n_turns, r.loss_chars, r.formatted_chars) == (2, len(text), 2 * len(text) + 2 * 22 + 13 + 4 * 20_000)


def test_chat_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_and_verify(df.repartition(9)).first()
    assert r.n_turns == 3000 and r.loss_chars == sum(len(str(k)) for k in range(1, 3000, 2))


def test_secrets_found_by_their_randomness(spark):
    import base64
    import random

    rng = random.Random(3)
    rows, planted = [], set()
    for k in range(400):
        word = "".join(rng.choice(["the", "ing", "tion", "er", "and"]) for _ in range(8))  # a long word
        key = base64.b64encode(rng.randbytes(36)).decode()
        if k % 2:
            planted.add(k)
        rows.append((k, f"see {word} and {key if k % 2 else word[::-1]} there", "en", "a", 0))
    got = {r["__row"].doc_id for r in secrets.secrets(spark.createDataFrame(rows, SCHEMA)).where("size(spans) > size(base)").collect()}
    assert len(got & planted) >= 0.8 * len(planted) and len(got - planted) <= 0.1 * len(got)


def test_secrets_joined_to_names(spark):
    import base64
    import random

    rng = random.Random(5)
    shapes = ["export AWS_SECRET_ACCESS_KEY={} now", "auth_key={}", "see http://a.b/c?sig={}", "deploy_to-{} there", "{}=first_second-third"]
    texts, want = [], []
    for k in range(400):
        key = base64.b64encode(rng.randbytes(36)).decode()
        if "/" not in key and "+" not in key:
            key = key[:20] + "/" + key[21:]
        before, after = shapes[k % 5].split("{}")
        texts.append(before + key + after)
        want.append((len(before), len(before) + len(key)))
    got = {r["__row"].doc_id: r.spans for r in secrets.secrets(spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)).collect()}
    for shape in range(5):
        found = [any(x.s <= want[k][0] and want[k][1] <= x.e for x in got[k]) for k in range(shape, 400, 5)]
        assert sum(found) >= 0.8 * len(found), (shapes[shape], sum(found))
    assert all(a.e <= b.s for spans in got.values() for a, b in zip(spans, spans[1:]))


def test_secrets_of_thin_strata(spark):
    import base64
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "ing", "tion", "er", "and"]) for _ in range(8))
    kinds = [lambda: base64.b32encode(rng.randbytes(32)).decode().rstrip("="), lambda: rng.randbytes(32).hex().upper()]

    def found(texts):
        df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)
        return {r["__row"].doc_id for r in secrets.secrets(df).where("size(spans) > size(base)").collect()}

    def sample(n_keys):
        keys = [f"see {base64.b64encode(rng.randbytes(36)).decode()} there" for _ in range(n_keys)]
        return [f"{kinds[0]()} it is", f"{kinds[0]()} it is", f"{kinds[1]()} it is", *keys, *(f"see {word()} and" for _ in range(60))]

    hits = [found(sample(100)) for _ in range(3)]
    assert sum(len(h & {0, 1, 2}) for h in hits) >= 7, hits  # of 9
    assert all(len(h - set(range(103))) <= 4 for h in hits)
    assert set(secrets.cuts(_candidates(spark, [(304, 0.9)] + [(203, 0.001)] * 30), 0.1, 4.0)) == {304}
    words = _candidates(spark, [(604, k / 200) for k in range(200)] + [(203, 0.03 + k / 500) for k in range(100)])
    assert secrets.cuts(words, 0.1, 4.0).get(203, 1.0) > 0.2


def _candidates(spark, tested):
    return spark.createDataFrame([([(0, 1, stratum, p)],) for stratum, p in tested], "tested array<struct<s:int,e:int,stratum:int,p:double>>")


def test_many_secrets_in_one_text(spark):
    """Base spans, candidates beside and on them, and cut candidates by the thousand: the places are right, and time follows the number."""
    import random
    import string
    import time

    import brute

    def text(n):
        rng = random.Random(n)
        run = lambda k, more="": "".join(rng.choice(string.ascii_letters + string.digits + more) for _ in range(k))
        parts = []
        for k in range(n):
            parts += [f"password = abcdef{k}", run(30, "+/"), f"é {run(24)}=x {run(22)}_{run(21)}+{run(23)}", f"token:{run(30)}", f"{rng.getrandbits(128):032x}"]
        return "\n".join(parts)

    took = {}
    for n in (40, 1500, 3000):
        df = spark.createDataFrame([(1, text(n), "en", "a", 0)], SCHEMA)
        began = time.time()
        found = secrets.secrets(df).collect()[0]
        took[n] = time.time() - began
        assert [(x.s, x.kind, x.e) for x in found.base] == brute.secret_base(text(n))
        spans = sorted((x.s, x.e) for x in found.spans if x.kind == 3)
        assert len(spans) > n and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        base = sorted((x.s, x.e) for x in found.base)
        assert not any(s < e and a < b for (a, b), (s, e) in zip(spans, base) if max(a, s) < min(b, e))
    assert took[3000] < 3.2 * took[1500] + 1


def test_secret_base_cases(spark):
    import brute

    texts = ["secret: token: abcdefgh", "Api_Key='AbC123'", "PASSWORD=short api-key", "AKIAAKIA" + "Z" * 20, "xAKIA" + "1" * 16, "AKIA123", "f" * 24 + "é" + "0" * 30, "token = \"" + "a" * 40 + "\"", "\U0001f600 passwd:  abcdef", "tokentoken=abcdef token=abc=defghi"]
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)
    for r in secrets.secrets(df).collect():
        assert [tuple(x) for x in r.base] == brute.secret_base(texts[r["__row"].doc_id])


def test_pii_base_cases(spark):
    import brute

    texts = [
        "a@b.com_foo@c.org.x", ".@x.y @@ a@b a@b..c d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "x" * 5000 + "@", "1" * 5000,
        "+1 (017) 555-7713 +12 +49-30-123456    5", "\U0001f600 me@host.example.com", "+1+1+1234567890", "9" * 400 + ".1.1.1", "4111111111111111 4111111111111111", "a@b@c.de@f.gh",
    ]
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)
    for r in pii.personal_data(df).collect():
        assert [tuple(x) for x in r.base] == brute.pii_base(texts[r.doc_id]), texts[r.doc_id][:60]


def test_pii_reliabilities_follow_the_data():
    """What EM estimates of the main labeler moves with its votes, in a table where the others tell true from false."""
    good, bad = (1, 1, 1, 1), (2, 2, 2, 2)

    def strict_hits(right):
        counts = {pii.pattern(2, (1, *good), 16): right, pii.pattern(2, (2, *good), 16): 1000 - right, pii.pattern(2, (2, *bad), 16): right, pii.pattern(2, (1, *bad), 16): 1000 - right}
        posterior, table = pii.reliabilities(counts)
        assert min(posterior[c] for c in counts if pii.parts(c)[1][1:] == list(good)) > max(posterior[c] for c in counts if pii.parts(c)[1][1:] == list(bad))
        return table[1, 0, 1]

    sure, fair = strict_hits(990), strict_hits(700)
    assert sure > 0.9 and sure - fair > 0.2


def test_pii_batches_are_bounded(spark):
    """Python gets no more bytes at a time than BATCH_BYTES allows, whatever the rows."""
    from tessera.llm import common

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["b", "n"])

    rows = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    got = common.written(rows.mapInArrow(count, "b long, n long"), "batches").collect()
    assert sum(r.n for r in got) == 120 and max(r.b for r in got) < 1.5 * common.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_pii_labelers_agree_on_looser_shapes(spark):
    rows = [(k, f"please write to bob{k} (at) example (dot) com or call +49 30 {1000000 + k}, and again", "en", "a", 0) for k in range(60)]
    rows += [(100 + k, f"version 1.{k} of page 12345678{k} was printed", "en", "a", 0) for k in range(60)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(len(got[k].spans) == len(got[k].base) + 1 for k in range(60))
    assert all(len(got[100 + k].spans) == 0 for k in range(60))


def test_toxicity(odd, spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for k in range(500):
        words = [rng.choice(["the", "house", "stands", "by", "a", "river", "in", "old", "town"]) for _ in range(rng.randrange(5, 150))]
        bad = k % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), "vile" + rng.choice(["ness", "ly", "st", "ton", "mark", "ish"]))
        rows.append((k, " ".join(words), "en", "a", 0))
        labels.append((k, int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scores(spark.createDataFrame(rows, SCHEMA), known).where("held_out").collect()
    hit = [r.predicted == dict(labels)[r.doc_id] for r in got]
    assert sum(hit) >= 0.97 * len(hit)
    out = toxicity.scores(odd, known.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scores(odd, known.where("false")).count() == 10
    assert toxicity.scores(odd.where("false"), known).count() == 0


def test_toxicity_sample_is_bounded(spark):
    """An id repeated 5,000 times is one training text, and texts stop at the bytes allowed."""
    rows = spark.range(5000).select((F.col("id") * 0 + 8).alias("doc_id"), F.concat(F.lit("same id "), (F.col("id") % 7).cast("string")).alias("text"))
    rows = rows.unionByName(spark.range(9, 60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text")))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(8, 1), (8, 1)], "doc_id long, toxic int"))
    args = (rows, labels, "doc_id", "text", "toxic")
    for most in ((1, 1), (5, 9), (100, 100)):
        texts, y = toxicity.sample(*args, most)
        assert len(texts) == len(y) <= sum(most) and sum(y) <= most[0] and len(y) - sum(y) <= most[1]
    assert texts.count("same id 0") == 1 and not any(t.startswith("same id") and t != "same id 0" for t in texts)
    texts, y = toxicity.sample(*args, (100, 100), most_bytes=2100)
    assert sum(map(len, texts)) <= 2100 and len(texts) >= 4 and 0 < sum(y) < len(y)


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_sample_without_a_giant(spark, toxic):
    """One giant text, the first in the order of the sample and of either label, takes no room of others."""
    ids = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    texts = ids.select("doc_id", F.concat(F.lit("text "), F.repeat(F.lit("word "), 20), F.col("doc_id").cast("string")).alias("text"))
    labels = ids
    first = spark.range(60, 4000).select("id").where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).first()[0]
    giant = spark.createDataFrame([(first, "word " * 2400)], "doc_id long, text string")
    more = labels.unionByName(spark.createDataFrame([(first, toxic)], "doc_id long, toxic int"))
    args = ("doc_id", "text", "toxic", (100, 100), 10_000)
    want = toxicity.sample(texts, labels, *args)
    assert len(want[0]) >= 30 and 0 < sum(want[1]) < len(want[1])
    assert toxicity.sample(texts.unionByName(giant), more, *args) == want


def test_toxicity_held_out_quality(spark):
    """Precision and recall on the rows that training never saw, against the tables' own labels."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.scores(docs.repartition(4), labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    hit, told, true = sum(r.predicted * r.toxic for r in got), sum(r.predicted for r in got), sum(r.toxic for r in got)
    # Some 300 toxic documents to learn from, and one label in twenty is wrong.
    assert true >= 50 and hit >= 0.9 * told and hit >= 0.7 * true


def test_toxicity_reads_long_runs_whole():
    import random

    rng = random.Random(4)
    for letters in ("abcdefghij.(", "中文字符毒性检测的长文本", "กขคงจฉชซ"):
        for n in (21, 22, 29, 45, 5000):
            run = "x" + "".join(rng.choice(letters) for _ in range(n - 2)) + "y"
            words = toxicity.split(f"so {run} ends")
            assert words[0] == b"so" and words[-1] == b"ends" and all(len(toxicity.bare(w)) <= 20 for w in words)
            seen = set(toxicity.parts([toxicity.bare(w) for w in words])[1].ravel().tolist())
            inner = toxicity.parts([run[i : i + 3] for i in range(n - 2)])[1][:, 1]  # of three letters: ^ab abc bc$
            assert set(inner.tolist()) <= seen
    assert toxicity.split("a" * 20 + " (" + "é" * 20 + ")") == [b"a" * 20, ("(" + "é" * 20 + ")").encode()]


def test_toxicity_finds_a_passage_in_unspaced_text():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    text = lambda n: [rng.choice(["the", "house", "stands", "by", "a", "river", "in", "old", "town"]) for _ in range(n)]
    bad = lambda ws: [*ws[: len(ws) // 2], "vile" + rng.choice(["ness", "ly", "ton", "mark"]), *ws[len(ws) // 2 :]]
    docs = [(bad(text(rng.randrange(20, 200))), 1) if k % 4 == 0 else (text(rng.randrange(20, 200)), 0) for k in range(400)]
    frozen = toxicity.train(["_".join(w) for w, _ in docs], [y for _, y in docs])
    fresh = ["_".join(bad(text(300)) if k % 2 else text(300)) for k in range(60)]
    out = next(toxicity._scorer(frozen)(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(fresh)], names=["id", "text"])])))
    got = np.array(out.column(1).to_pylist())
    assert (got[1::2][:, None] > got[::2][None, :]).mean() >= 0.9, got  # chance is one half


def test_network_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    rows, grams = toxicity.parts(["abc", "defgh", "abd", "x"])
    net.p["word"][:] = rng.normal(0, 0.3, net.p["word"].shape)
    net.p["char"][:] = rng.normal(0, 0.3, net.p["char"].shape)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, y = np.array([[0, 1, 2, 3], [2, 1, -1, -1]], dtype=np.int32), np.array([1.0, 0.0])
    mask = ids.T >= 0

    def loss():
        gates = net.gates(net.inputs(rows, grams).astype(np.float64))[np.maximum(ids.T, 0)]
        p = toxicity._sigmoid(net.forward(gates, mask)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    class Still:
        @staticmethod
        def random(n):
            return np.ones(n)

    before = {k: v.copy() for k, v in net.p.items()}
    net._m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    own = (np.ones(toxicity.WORD_ROWS), np.ones(toxicity.CHAR_ROWS))
    net.learn(ids, y, rows, grams, 0.0, own, Still)
    net.p = before
    for name in ("Wf", "Uf", "bb", "Ub", "A", "v", "o", "c"):
        grad = net._m[name][0] / 0.1
        at = tuple(rng.integers(0, s) for s in grad.shape)
        keep, eps = net.p[name][at], 1e-3
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grad[at]) < 2e-4 + 0.02 * abs(grad[at]), name


def test_scoring_equals_the_training_pass():
    import numpy as np

    rng = np.random.default_rng(2)
    net = toxicity.Network(3)
    rows, grams = toxicity.parts([f"word{k}" for k in range(50)])
    net.p["word"][:] = rng.normal(0, 0.3, net.p["word"].shape)
    ids = rng.integers(0, 50, (40, toxicity.WINDOW)).astype(np.int32)
    ids[3, 10:] = -1
    ids[4, :] = -1
    mask = ids.T >= 0
    mask[0] |= ~mask.any(0)
    table = net.table(rows, grams)
    both = np.concatenate([table[0], table[1]], axis=1)
    want = net.forward(both[ids.T + 1], mask)[0]
    assert np.allclose(net.logits(ids, table, batch=16), want, atol=1e-4)


def test_pipeline_stages(odd, spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(3))
    rows = []
    for k in range(120):
        rows.append((k, " ".join(word() for _ in range(200)), "en", f"s{k % 3}", 0))
    rows.append((500, rows[0][1].upper(), "en", "s0", 0))  # equal but for case: the larger id stays
    rows.append((501, rows[1][1] + " one more end", "en", "s0", 0))  # nearly equal: the smaller id stays
    rows.append((502, "too short", "en", "s0", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    first = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r.doc_id for r in first.collect()} == set(range(120)) | {500, 501}
    second = corpus_pipeline.drop_exact_copies(spark, first, "")
    assert {r.doc_id for r in second.collect()} == set(range(1, 120)) | {500, 501}
    third = corpus_pipeline.drop_near_copies(spark, second, "")
    assert {r.doc_id for r in third.collect()} == set(range(1, 120)) | {500}
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    words = fourth.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n"))
    total = third.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    share = {r.source: r.n / total for r in words.collect()}
    assert all(abs(share[f"s{k}"] - (k + 1) / 6) < 0.02 for k in range(3))
    packed = corpus_pipeline.pack_sequences(spark, fourth, "")
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens", "start", "sequence_id").where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_leaves_its_last_stage_alone(spark):
    """Inputs of stages and what they made on the way are gone when the pipeline is done; its result can be read again and again."""
    import os

    from tessera.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == out.count() > 0
    left = sorted(set(os.listdir(folder)) - before)
    assert len(left) == 1 and left[0].startswith("pipeline-")
    assert [n for n in os.listdir(f"{folder}/{left[0]}") if not n.startswith(".")] == ["4-packing"]


def test_pipeline_stages_on_odd_rows(odd, spark):
    """Each stage's stated result for nulls, empty and repeated rows."""
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert ids(corpus_pipeline.quality_rules(spark, odd, "")) == []  # none has 50 words that are not repeated
    assert ids(corpus_pipeline.drop_exact_copies(spark, odd, "")) == [0, 2, 4, 5, 6, 7, 8]
    assert ids(corpus_pipeline.drop_near_copies(spark, odd, "")) == [0, 1, 2, 3, 5, 6, 7, 8]
    mixed = corpus_pipeline.mix_sources(spark, odd, "")
    assert mixed.columns == odd.columns
    taken = [r.doc_id for r in mixed.collect()]
    # Sources a and null stop at three times their size; b, which has nearly all words, gets what is left.
    assert (taken.count(4), taken.count(3), taken.count(6), taken.count(5)) == (6, 3, 3, 1)
    pieces = corpus_pipeline.pack_sequences(spark, odd, "").collect()
    held = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(held) == {None, 1, 2, 3, 4, 5, 6, 7, 8} and sum(s == 0 for s, _, _ in held[4]) == 2
    assert held[1] == held[2] == [(0, 1, 1)] and all(sum(n for _, n, _ in own) == own[0][2] * (2 if i == 4 else 1) for i, own in held.items())
