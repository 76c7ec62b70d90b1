"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier decides.

Base spans come from four fixed patterns. Candidates are the base spans, the pattern matches that failed their checks, and
looser shapes: number groups, bank account numbers, spelled-out mail addresses. Five labelers vote yes, no or nothing
on each: the strict pattern, a gazetteer (mail endings, calling codes, card issuers, bank countries), words before the
span in four languages, the shape of its groups, and its surroundings. Expectation-maximisation over the counts of all
vote patterns estimates how each labeler votes on true and on false spans, without labels; its posteriors then train a
logistic span classifier on votes, family and shape. Candidates that the classifier accepts and that touch no base
span are added as kind `other`. Counts of patterns are all that the driver sees, and there is a fixed number of
patterns; texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written

KINDS = ["email", "ip", "card", "phone", "other"]
FAMILIES = ["email", "ip", "card", "phone", "number", "iban", "spelled"]
LABELERS = ["strict", "gazetteer", "context", "shape", "surroundings"]

#: P(no vote, yes, no) of false and of true spans before any data. A failed checksum or length starts out as a strong no.
PRIOR = {"strict": ((0.3, 0.02, 0.68), (0.3, 0.697, 0.003)), "others": ((0.4, 0.2, 0.4), (0.4, 0.45, 0.15))}
#: The prior's weight as a part of the data's: candidates decide, the prior breaks ties and names the classes.
PRIOR_WEIGHT = 0.2

# Gazetteers.
MAIL_ENDINGS = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "eu", "us", "co", "at", "ch", "example", "test"}
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2221", "2720")
BANK_COUNTRIES = {"AT", "BE", "CH", "DE", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "PT", "PL", "SE", "NO", "DK"}
CONTACT_WORDS = re.compile(
    r"(?:e-?mail|mail|contact|write|reach|phone|tel|call|fax|mobile|cell|whatsapp|card|visa|mastercard|credit|account|iban|ssn|social security|passport"
    r"|host|server|address|login|telefon|anruf|handy|karte|konto|adresse|kontakt|t[eé]l[eé]phone|appel|portable|carte|compte|tel[eé]fono|llama|m[oó]vil"
    r"|tarjeta|cuenta|correo|direcci[oó]n)\W{0,12}(?:\w{1,6}\W{1,3})?$",
    re.I,
)
OTHER_NUMBERS = re.compile(r"(?:version|release|v|page|pages|chapter|section|isbn|issn|doi|order|item|part|price|total|figure|table|[$€£#=])\W{0,4}$", re.I)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][0-9\x20().-]{5,28}[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?[A-Za-z0-9-]{1,63})+", re.I)
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _mails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail pattern, found from each @ outwards: linear in the text."""
    free, at = 0, t.find("@")
    while at >= 0:
        start = free + len(t[free:at].rstrip(LOCAL))
        m = _DOMAIN.match(t, at + 1)
        if m and start < at:
            yield start, m.end()
            free, at = m.end(), t.find("@", m.end())
        else:
            free, at = at + 1, t.find("@", at + 1)


def matches(t: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, passed) of the four base patterns, in no order."""
    out = [(s, 0, e, True) for s, e in _mails(t)]
    for run in _DOTTED.finditer(t):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(t, run.start(), run.end()):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                out.append((m.start(), 1, m.end(), all(len(p) < 4 and int(p or 0) <= 255 for p in parts)))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if len(digits) >= 13:
                out.append((m.start(), 2, m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in t:
        out += [(m.start(), 3, m.end(), 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15) for m in _PHONE.finditer(t)]
    return out


def _looser(t: str) -> Iterator[tuple[int, int, int]]:
    """(start, family, end) of shapes beyond the base patterns."""
    for m in _NUMBER.finditer(t):
        if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 19:
            yield m.start(), 4, m.end()
    for m in _IBAN.finditer(t):
        yield m.start(), 5, m.end()
    low = t.lower()
    if "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        for m in _SPELLED.finditer(t):
            yield m.start(), 6, m.end()


def votes(t: str, start: int, family: int, end: int, passed: bool | None) -> tuple[int, ...]:
    """One vote per labeler: 1 yes, 2 no, 0 none. passed: the base pattern's verdict, None for looser shapes."""
    span = t[start:end]
    digits = _NOT_DIGIT.sub("", span)
    strict = 0 if passed is None else 1 if passed else 2
    if family in (0, 6):
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span.rstrip(" )]"))[-1].lower() in MAIL_ENDINGS else 2
    elif family == 2:
        gazetteer = 1 if digits.startswith(CARD_ISSUERS) else 2
    elif family in (3, 4):
        gazetteer = 1 if span[0] == "+" and digits.startswith(CALLING_CODES) else 2 if span[0] == "+" else 0
    elif family == 5:
        gazetteer = 1 if span[:2] in BANK_COUNTRIES else 2
    else:
        gazetteer = 0
    before = t[max(0, start - 32) : start]
    context = 1 if CONTACT_WORDS.search(before) else 2 if OTHER_NUMBERS.search(before) else 0
    groups = [len(g) for g in re.split(r"[^0-9]+", span.strip("()+ ")) if g]
    if family == 5:
        rest = span.replace(" ", "")
        shape = 1 if int("".join(str(int(c, 36)) for c in rest[4:] + rest[:4])) % 97 == 1 else 2
    elif family in (0, 6):
        shape = 1 if len(span) <= 64 else 2
    elif family in (3, 4):
        shape = 1 if groups in ([3, 2, 4], [3, 3, 4], [1, 3, 3, 4]) or (span[0] == "+" and len(groups) >= 3) else 2 if len(groups) == 1 or min(groups) == 1 else 0
    else:
        shape = 1 if len(groups) > 1 and (len(set(groups)) == 1 or groups == [4, 6, 5]) else 0  # one run of digits says nothing
    left, right = t[start - 1 : start] if start else "", t[end : end + 1]
    surroundings = 2 if left.isalnum() or left in ("_", "-", ".", "/") or right.isalnum() or right in ("_", "/") else 1
    return strict, gazetteer, context, shape, surroundings


def pattern(family: int, vote: tuple[int, ...], length: int) -> int:
    """Everything that the classifier sees of a candidate, as one number."""
    code = family
    for v in vote:
        code = code * 3 + v
    return code * 4 + (length > 10) + (length > 16) + (length > 24)


def parts(code: int) -> tuple[int, list[int], int]:
    code, length = divmod(code, 4)
    vote = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.insert(0, v)
    return code, vote, length


def _scanner(batches: Iterator) -> Iterator:
    import pyarrow as pa

    base_type = pa.list_(pa.struct([("s", pa.int32()), ("kind", pa.int32()), ("e", pa.int32())]))
    found_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("code", pa.int32()), ("free", pa.bool_())]))
    for batch in batches:
        bases, founds = [], []
        for text in batch.column(1):
            t = text.as_py()
            base, found = [], []
            if _DOTTED.search(t) or "@" in t or "(" in t or "[" in t:
                hits = matches(t)
                base = sorted((s, k, e) for s, k, e, passed in hits if passed)
                taken = [(s, e) for s, _, e in base]
                candidates = [(s, k, e, passed) for s, k, e, passed in hits] + [(s, k, e, None) for s, k, e in _looser(t)]
                last, at = -1, 0
                for s, k, e, passed in sorted(candidates, key=lambda c: (c[0], c[1])):
                    while at < len(taken) and taken[at][1] <= s:
                        at += 1
                    free = not passed and s >= last and not any(a < e and s < b for a, b in taken[at : at + 4])
                    if passed or free:
                        found.append((s, e, pattern(k, votes(t, s, k, e, passed), e - s), free))
                        last = max(last, e) if free else last
            bases.append([{"s": s, "kind": k, "e": e} for s, k, e in base])
            founds.append([{"s": s, "e": e, "code": c, "free": f} for s, e, c, f in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, base_type), pa.array(founds, found_type)], names=["id", "base", "found"])


def reliabilities(counts: dict[int, int], rounds: int = 100):
    """EM over vote patterns: the chance that each pattern is personal data, and per labeler P(vote | true / false).

    Starts from the weight of yes against no votes and the labelers' PRIOR. Each family has a share of true spans of
    its own.
    """
    import numpy as np

    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], dtype=float)
    family, vote = np.array([parts(c)[0] for c in codes]), np.array([parts(c)[1] for c in codes])
    lean = (vote == 1).sum(1) - (vote == 2).sum(1) + 2.0 * (vote[:, 0] == 1) - 2.0 * (vote[:, 0] == 2)
    q = 1 / (1 + np.exp(-lean))
    table = np.zeros((2, vote.shape[1], 3))
    for _ in range(rounds):
        for y, share in ((1, q), (0, 1 - q)):
            for j in range(vote.shape[1]):
                prior = PRIOR["strict" if j == 0 else "others"]
                got = np.array([(n * share)[vote[:, j] == v].sum() for v in range(3)]) + (PRIOR_WEIGHT * n.sum() + 1) * np.array(prior[y])
                table[y, j] = got / got.sum()
        logit = np.zeros(len(codes))
        for f in np.unique(family):
            mine = family == f
            prior = ((n * q)[mine].sum() + 1) / (n[mine].sum() + 2)
            logit[mine] = np.log(prior / (1 - prior))
        for j in range(vote.shape[1]):
            logit += np.log(table[1, j, vote[:, j]]) - np.log(table[0, j, vote[:, j]])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return dict(zip(codes, q)), table


def features(code: int):
    import numpy as np

    family, vote, length = parts(code)
    x = np.zeros(len(FAMILIES) + 2 * len(LABELERS) + 4)
    x[family] = 1
    for j, v in enumerate(vote):
        if v:
            x[len(FAMILIES) + 2 * j + v - 1] = 1
    x[len(FAMILIES) + 2 * len(LABELERS) + length] = 1
    return x


def classifier(counts: dict[int, int], posterior: dict[int, float], ridge: float = 1.0) -> dict[int, float]:
    """Logistic regression from the posteriors, weighted by counts; pattern -> chance of personal data."""
    import numpy as np

    codes = sorted(counts)
    if not codes:
        return {}
    x = np.array([features(c) for c in codes])
    q, n = np.array([posterior[c] for c in codes]), np.log1p(np.array([counts[c] for c in codes], dtype=float))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - q)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.8) -> DataFrame:
    """Per row: id_col, base and spans, arrays of (s, kind, e) in order; kind indexes KINDS, code points, end exclusive.

    spans holds the base spans and what the classifier accepts beyond them. Null and empty texts have no spans; repeated
    rows get equal spans; null ids stay null; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, base array<struct<s:int,kind:int,e:int>>, found array<struct<s:int,e:int,code:int,free:boolean>>"
    )
    scan = written(rows.mapInArrow(_scanner, schema), "pii-scan")
    # At most families x 3^labelers x lengths patterns.
    counts = {r["code"]: r["n"] for r in scan.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    posterior, _ = reliabilities(counts) if counts else ({}, None)
    good = [c for c, p in classifier(counts, posterior).items() if p >= accept]
    taken = F.expr("filter(found, c -> false)")
    if good:
        taken = F.filter("found", lambda c: c["free"] & c["code"].isin(good))
    added = F.transform(taken, lambda c: F.struct(c["s"].alias("s"), F.lit(4).alias("kind"), c["e"].alias("e")))
    return scan.select(F.col("id").alias(id_col), "base", F.sort_array(F.concat("base", added)).alias("spans"))


def joined_spans(spans: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(get({names}, x.kind), ':', x.s, ':', x.e)), ',')"
