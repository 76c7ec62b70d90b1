"""The opN queries on the smallest tables, row by row against plain Python."""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries as Q
from tessera.llm import tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], t["lang"]))


@pytest.fixture(scope="module")
def token_ids(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    return {i: e.ids for (i, *_), e in zip(docs, tok.encode_batch([t or "" for _, t, *_ in docs], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op1(spark, docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in Q.op1_exact_dedup(spark, SF).collect()}
    assert got == brute.exact([(i, t) for i, t, *_ in docs])


def test_op2(spark, token_ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op2_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(token_ids)
    for i, own in pieces.items():
        full, at = [*token_ids[i], 2], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(full), crc(full[at : at + r.length]))
            at += r.length
        assert at == len(full)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and at == own[0].sequence_length


def test_op3(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    rows = list(zip(t["conv_id"], t["turn"], t["role"], t["text"]))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op3_chat_formatting(spark, SF).collect()}
    assert got == brute.chat(rows)


def test_op4(spark, token_ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op4_token_files(spark, SF).collect()}
    at, want = 0, {}
    for i in sorted(token_ids):
        full = [*token_ids[i], 1]
        want[i] = (at, len(full), crc(full))
        at += len(full)
    assert got == want


def test_op5(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op5_near_dedup(spark, SF).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near([(i, t) for i, t, *_ in docs], 2).items()}


def spans_of(text):
    return [tuple(x.split(":")) for x in text.split(",")] if text else []


def test_op6(spark, docs):
    texts, kinds = {i: t for i, t, *_ in docs}, ["assign", "access", "hex", "random"]
    for r in Q.op6_secret_scan(spark, SF).collect():
        base = brute.secret_base(texts[r.doc_id])
        n = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n[0], n[1], n[2], brute.digest(base, kinds))
        assert [x for x in spans_of(r.spans) if x[0] != "random"] == [(kinds[k], str(s), str(e)) for s, k, e in base]


def test_op7(spark, docs):
    texts, kinds = {i: t for i, t, *_ in docs}, ["email", "ip", "card", "phone", "other"]
    for r in Q.op7_personal_data(spark, SF).collect():
        base = brute.pii_base(texts[r.doc_id])
        n = Counter(k for _, k, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n[0], n[1], n[2], n[3], brute.digest(base, kinds))
        assert [x for x in spans_of(r.spans) if x[0] != "other"] == [(kinds[k], str(s), str(e)) for s, k, e in base]


def test_op8(spark, docs):
    got = {r.doc_id: r for r in Q.op8_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.base_failed and r.kept)
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    good = [got[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1 and not got[i].base_failed]
    bad = [got[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 0 and not got[i].base_failed]
    assert all(r.kept for r in good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_op9(spark, docs):
    of = {i: s for i, _, s, _ in docs}
    rows = Q.op9_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(of)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(sizes[of[r.doc_id]] == r.source_size for r in rows)
    want = brute.mix_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 for s in want)
    largest = defaultdict(int)
    for r in rows:
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = Q.op9_mixing(spark, SF).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_op10(spark, docs):
    rows = Q.op10_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, *_ in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_pipeline(spark, docs, token_ids):
    kept = {r.doc_id for r in Q.op8_quality_rules(spark, SF).collect() if r.kept}
    alive = [(i, t) for i, t, *_ in docs if i in kept]
    unique = {i for i, (_, _, k, _) in brute.exact(alive).items() if k}
    final = {i for i, (_, c) in brute.near([(i, t) for i, t in alive if i in unique], 5).items() if i == c}
    size = {i: brute.quality(t)[0] for i, t, *_ in docs}
    source = {i: s for i, _, s, _ in docs}
    pieces, copies = defaultdict(Counter), Counter()
    for r in Q.pipeline(spark, SF).collect():
        pieces[r.doc_id][(r.start, r.length, r.ids_crc32)] += 1
        copies[r.doc_id] += r.start == 0
    assert set(pieces) <= final
    for i, own in pieces.items():
        full = [*token_ids[i], 2]
        assert sum(n * k for (_, n, _), k in own.items()) == copies[i] * len(full)
        assert all(c == crc(full[s : s + n]) for s, n, c in own)
    words, taken, largest = Counter(), Counter(), Counter()
    for i in final:
        words[source[i]] += size[i]
        taken[source[i]] += copies[i] * size[i]
        largest[source[i]] = max(largest[source[i]], size[i])
    want = brute.mix_targets(words)
    assert all(abs(taken[s] - want[s]) <= largest[s] and copies[i] <= 3 for s in want for i in final)
