"""What the methods add beyond the fixed patterns, measured: secrets and personal data planted into a copy of the tables' documents."""

from __future__ import annotations

import base64
import random
import string

from pyspark.sql import functions as F

from tessera.llm import pii, secrets

SF = "/root/testdata/sf0.01"


def planted(spark, makers, decoys, seed):
    """(documents with things put in, {doc_id: [(kind, start, end)]}): a thing in every second document, by turns, after the text."""
    rng = random.Random(seed)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    kinds, rows, put = [*makers, *decoys], [], {}
    for k, (i, text) in enumerate(docs):
        if k % 2 == 0:
            kind = kinds[k // 2 % len(kinds)]
            before, thing, after = ({**makers, **decoys})[kind](rng)
            at = len(text) + 1 + len(before)
            put[i] = (kind, at, at + len(thing))
            text = f"{text}\n{before}{thing}{after}"
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id long, text string"), put


def measured(got, put, kinds, decoys):
    """({kind: share found}, share of added spans that lie on something planted)."""
    hit = {k: [0, 0] for k in kinds}
    good = bad = 0
    for i, spans in got.items():
        kind, a, b = put.get(i, (None, 0, 0))
        on = [s < b and a < e for s, e in spans]
        if kind in hit:
            hit[kind][0] += any(on)
            hit[kind][1] += 1
        good += sum(on) if kind not in decoys else 0
        bad += len(on) - (sum(on) if kind not in decoys else 0)
    return {k: h / n for k, (h, n) in hit.items()}, good / max(1, good + bad)


def test_random_keys_among_documents(spark):
    """Five encodings against long names, paths and joined words."""
    pick = lambda letters, n: lambda r: ("the value ", "".join(r.choice(letters) for _ in range(n)), " is set")
    makers = {
        "HEX": pick("0123456789ABCDEF", 40), "base62": pick(string.ascii_letters + string.digits, 32), "base32": lambda r: ("see ", base64.b32encode(r.randbytes(25)).decode(), " here"),
        "base64": lambda r: ("see ", base64.b64encode(r.randbytes(33)).decode(), " here"), "base64url": lambda r: ("id ", base64.urlsafe_b64encode(r.randbytes(33)).decode(), "."),
    }
    words = ["user", "account", "list", "handler", "internal", "Factory", "service", "request", "manager", "Builder", "default", "config"]
    decoys = {
        "name": lambda r: ("call ", "".join(r.choice(words).capitalize() for _ in range(5)), " now"), "path": lambda r: ("at ", "/".join(r.choice(words) for _ in range(6)), " now"), "snake": lambda r: ("use ", "_".join(r.choice(words) for _ in range(5)), " now"),
        "runs": lambda r: ("line ", r.choice("-=_") * r.randrange(20, 60), " end"), "letters": lambda r: ("so ", r.choice("ahz") * 30, " ok"),
    }
    docs, put = planted(spark, makers, decoys, 3)
    got = {r["__row"].doc_id: [(x.s, x.e) for x in r.spans if x.kind == 3] for r in secrets.secrets(docs).collect()}
    recall, precision = measured(got, put, makers, decoys)
    print("random keys: recall", {k: round(v, 2) for k, v in recall.items()}, "precision", round(precision, 3))
    assert min(recall.values()) >= 0.7 and precision >= 0.85


def test_loose_personal_data_among_documents(spark):
    """Spelled-out addresses, bank accounts and local numbers after words that announce them, against numbers of other things."""
    digits = lambda r, n: "".join(r.choice(string.digits) for _ in range(n))
    name = lambda r: "".join(r.choice(string.ascii_lowercase) for _ in range(7))

    def iban(r):
        bank, account = digits(r, 8), digits(r, 10)
        return "DE" + f"{98 - int(bank + account + '131400') % 97:02d}" + bank + account

    makers = {
        "spelled": lambda r: ("write to ", f"{name(r)} (at) {name(r)} (dot) org", " please"), "iban": lambda r: ("account ", iban(r), " today"),
        "local": lambda r: ("call my mobile ", f"{digits(r, 3)} {digits(r, 3)} {digits(r, 4)}", " tonight"),
    }
    decoys = {
        "order": lambda r: ("order ", digits(r, 10), " was sent"), "isbn": lambda r: ("isbn ", f"978-{digits(r, 1)}-{digits(r, 2)}-{digits(r, 6)}-{digits(r, 1)}", " in print"), "price": lambda r: ("total $", f"{digits(r, 3)}.{digits(r, 3)}.{digits(r, 3)}", " paid"),
    }
    docs, put = planted(spark, makers, decoys, 5)
    other = pii.KINDS.index("other")
    got = {r.doc_id: [(x.s, x.e) for x in r.spans if x.kind == other] for r in pii.personal_data(docs).collect()}
    recall, precision = measured(got, put, makers, decoys)
    print("personal data: recall", {k: round(v, 2) for k, v in recall.items()}, "precision", round(precision, 3))
    assert min(recall.values()) >= 0.5 and precision >= 0.8
