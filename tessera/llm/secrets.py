"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans come from three patterns. Beyond them every run of 20 or more key characters is a candidate; a run that no
encoding holds is cut at inner '=', and where '+' or '/' meet '_' or '-' at either pair, into candidates. Its encoding
is inferred (the smallest alphabet that holds it), its symbols become codes, and three tests ask whether they look
drawn at random: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs of codes in the upper half, and lag-1
serial correlation. The smallest of the three p-values, corrected for taking the smallest, is the candidate's p.
Random keys have p uniform on (0, 1); words pile up near 0. Within a stratum (encoding, length class) the share of
random candidates follows from how many have large p, hence the false-discovery rate of taking all above a cut; the
cut is the lowest that keeps it under the limit. Short strata, where words pass the tests by chance, so get a high
cut or none. A stratum too thin to tell takes its cut from a coarser one. Counts per stratum and p-bin are all that leaves the rows: a table of bounded size.

Positions: a pattern's matches and the pieces between them have lengths that add up to the matches' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, whole_row, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

#: name, pattern of the whole candidate, alphabet in the order of the codes.
ENCODINGS = [
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("HEX", "[0-9A-F]+", "0123456789ABCDEF"),
    ("lower", "[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[a-z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "[A-Za-z0-9]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "[A-Za-z0-9+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Lower ends of the length classes.
LENGTHS = [20, 24, 32, 48, 64, 128]
BINS = 40


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


_NONE = "CAST(array() AS array<struct<s:int,e:int,n:int,h:string>>)"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name standing for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scan(values: str, merge: str, identity: str) -> str:
    """SQL for the running totals of an array named by `values`: at each doubling every total takes in the one before its reach.

    merge is SQL over x and y. That is n log n steps; appending to an array n times would copy it n times.
    """
    rounds = f"CASE WHEN size({values}) > 1 THEN char_length(conv(CAST(size({values}) - 1 AS STRING), 10, 2)) ELSE 0 END"
    doublings = "array(" + ", ".join(str(1 << k) for k in range(31)) + ")"
    body = merge.replace("y", f"coalesce(get(a, i - k), {identity})")
    return f"aggregate(slice({doublings}, 1, {rounds}), {values}, (a, k) -> transform(a, (x, i) -> {body}))"


def _with_matches(rows: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds the array of (s, e, n, h): t's leftmost matches in code points, the length of a group, and the match."""
    p = _sql(pattern)
    pieces = {"g": f"split(t, {p}, -1)", "h": f"regexp_extract_all(t, {p}, 0)", "k": f"regexp_extract_all(t, {p}, {group})"}
    rows = rows.withColumn("__hit", F.expr(f"t RLIKE {p}"))
    rows = rows.withColumns({f"__{c}": F.expr(f"CASE WHEN __hit THEN {sql} END") for c, sql in pieces.items()})
    ends = _let("d", "transform(z.h, (h, i) -> char_length(get(z.g, i)) + char_length(h))", _scan("d", "x + y", "0"))
    placed = "transform(z.h, (h, i) -> struct(get(e, i) - char_length(h) AS s, get(e, i) AS e, char_length(get(z.k, i)) AS n, h AS h))"
    found = _let("z", "struct(__g AS g, __h AS h, __k AS k)", _let("e", ends, placed))
    return rows.withColumn(name, F.expr(f"CASE WHEN __hit THEN {found} ELSE {_NONE} END")).drop("__hit", "__g", "__h", "__k")


def _pieces(candidate: str, token: str) -> str:
    """SQL for the tokens of 20 or more characters of a candidate (s, e, n, h), which the pattern covers without gaps."""
    ends = _let("d", "transform(w, x -> char_length(x))", _scan("d", "x + y", "0"))
    placed = f"transform(w, (x, i) -> struct({candidate}.s + get(e, i) - char_length(x) AS s, {candidate}.s + get(e, i) AS e, char_length(x) AS n, x AS h))"
    long = f"filter({placed}, q -> q.n >= {LENGTHS[0]} AND q.h RLIKE '[A-Za-z0-9]')"
    return _let("w", f"regexp_extract_all({candidate}.h, {_sql(token)}, 0)", _let("e", ends, long))


def _fitting(rows: DataFrame, name: str) -> DataFrame:
    """Cuts candidates that no encoding holds: at inner '=', then at '_' and '-' as well as at '+' and '/', whichever is the key's."""
    inner = _pieces("c", "[^=]+=+$|[^=]+|=+")
    rows = rows.withColumn(name, F.expr(f"CASE WHEN exists({name}, c -> c.h RLIKE '=[^=]') THEN flatten(transform({name}, c -> CASE WHEN c.h RLIKE '=[^=]' THEN {inner} ELSE array(c) END)) ELSE {name} END"))
    mixed = "(c.h RLIKE '[+/]' AND c.h RLIKE '[_-]')"
    both = f"concat({_pieces('c', '[^_-]+|[_-]+')}, {_pieces('c', '[^+/]+|[+/]+')})"
    return rows.withColumn(name, F.expr(f"CASE WHEN exists({name}, c -> {mixed}) THEN flatten(transform({name}, c -> CASE WHEN {mixed} THEN {both} ELSE array(c) END)) ELSE {name} END"))


def _merged(spans: str) -> str:
    """SQL for the sorted spans (s, e) with those that overlap made one: a cut at either separators can give such.

    A span begins a new one where it begins at or behind all earlier ends; the new one goes to the furthest end before the next.
    """
    first = "filter(sequence(0, size(t) - 1), i -> i = 0 OR get(t, i).s >= get(m, i - 1))"
    taken = "transform(f, (i, j) -> struct(get(t, i).s AS s, get(m, coalesce(get(f, j + 1), size(t)) - 1) AS e))"
    furthest = _let("d", "transform(t, x -> x.e)", _scan("d", "greatest(x, y)", "0"))
    merged = _let("t", f"array_sort({spans})", _let("m", furthest, _let("f", first, taken)))
    return f"CASE WHEN size({spans}) > 0 THEN {merged} ELSE CAST(array() AS array<struct<s:int,e:int>>) END"


def _touches(spans: str, candidate: str) -> str:
    """SQL for whether a candidate touches any of an array's spans, which are in order and apart: by two binary searches."""
    steps = f"slice(array({', '.join(str(1 << k) for k in reversed(range(26)))}), -greatest(char_length(conv(CAST(size({spans}) AS STRING), 10, 2)), 1), 26)"
    before = lambda test: f"aggregate({steps}, 0, (p, k) -> p + CASE WHEN p + k <= size({spans}) AND {test} THEN k ELSE 0 END)"
    return f"({before(f'get({spans}, p + k - 1).s < {candidate}.e')} > {before(f'get({spans}, p + k - 1).e <= {candidate}.s')})"


def _upper_tail(z: str) -> str:
    """SQL for the chance that a normal variable exceeds z (Abramowitz and Stegun 26.2.17)."""
    poly = "u * (0.319381530D + u * (-0.356563782D + u * (1.781477937D + u * (-1.821255978D + u * 1.330274429D))))"
    u = f"(1D / (1D + 0.2316419D * abs({z})))"
    half = f"(exp(-least(({z}) * ({z}), 1400D) / 2D) * 0.3989422804014327D * {poly.replace('u', u)})"
    return f"(CASE WHEN ({z}) >= 0 THEN {half} ELSE 1D - {half} END)"


def _tested(candidates: str) -> str:
    """SQL for the candidates (s, e, n, h) that have an encoding, with their stratum and p."""
    encoding = "CASE " + " ".join(f"WHEN c.h RLIKE '^({p})$' THEN {k}" for k, (_, p, _) in enumerate(ENCODINGS)) + " ELSE -1 END"
    alphabets = "array(" + ", ".join(f"'{a}'" for _, _, a in ENCODINGS) + ")"
    named = f"""transform({candidates}, c -> struct(c.s AS s, c.e AS e, regexp_replace(c.h, '=+$', '') AS t, {encoding} AS enc))"""
    named = f"filter({named}, c -> c.enc >= 0 AND char_length(c.t) >= {LENGTHS[0]})"
    coded = f"""transform({named}, c -> struct(c.s AS s, c.e AS e, c.enc AS enc, c.t AS t, get({alphabets}, c.enc) AS alpha,
        transform(filter(split(c.t, ''), y -> y != ''), y -> CAST(instr(get({alphabets}, c.enc), y) AS DOUBLE)) AS x))"""
    summed = f"""transform({coded}, c -> struct(c.s AS s, c.e AS e, c.enc AS enc, c.x AS x,
        CAST(size(c.x) AS DOUBLE) AS n, CAST(char_length(c.alpha) AS DOUBLE) AS k,
        aggregate(c.x, 0D, (a, y) -> a + y) / size(c.x) AS m,
        aggregate(split(c.alpha, ''), 0D, (a, y) -> a + pow(CASE WHEN y = '' THEN 0 ELSE size(c.x) - char_length(replace(c.t, y, '')) END, 2)) AS squares,
        CAST(size(filter(c.x, y -> 2 * y > char_length(c.alpha))) AS DOUBLE) AS high))"""
    paired = f"""transform({summed}, c -> struct(c.s AS s, c.e AS e, c.enc AS enc, c.n AS n, c.k AS k, c.high AS high, c.squares AS squares,
        aggregate(c.x, 0D, (a, y) -> a + (y - c.m) * (y - c.m)) AS spread,
        aggregate(sequence(0, size(c.x) - 2), 0D, (a, i) -> a + (c.x[i] - c.m) * (c.x[i + 1] - c.m)) AS lagged,
        aggregate(sequence(0, size(c.x) - 2), 1D, (a, i) -> a + CASE WHEN (2 * c.x[i] > c.k) != (2 * c.x[i + 1] > c.k) THEN 1 ELSE 0 END) AS runs))"""
    # Chi-squared by Wilson and Hilferty; runs and serial correlation by their normal limits. Extremes fail outright.
    scored = f"""transform({paired}, c -> struct(c.s AS s, c.e AS e, c.enc AS enc, c.n AS n,
        (pow(greatest(c.k / c.n * c.squares - c.n, 0D) / (c.k - 1), 1D / 3) - (1 - 2 / (9 * (c.k - 1)))) / sqrt(2 / (9 * (c.k - 1))) AS z_chi,
        CASE WHEN c.high = 0 OR c.high = c.n THEN 40D ELSE
            (c.runs - (2 * c.high * (c.n - c.high) / c.n + 1)) / sqrt(greatest(2 * c.high * (c.n - c.high) * (2 * c.high * (c.n - c.high) - c.n) / (c.n * c.n * (c.n - 1)), 1e-9)) END AS z_runs,
        CASE WHEN c.spread = 0 THEN 40D ELSE (c.lagged / c.spread + 1 / c.n) * sqrt(c.n) END AS z_lag))"""
    least = f"least({_upper_tail('c.z_chi')}, 2 * {_upper_tail('abs(c.z_runs)')}, 2 * {_upper_tail('abs(c.z_lag)')})"
    length = "+".join(f"CAST(c.n >= {n} AS INT)" for n in LENGTHS)
    return f"""transform({scored}, c -> struct(c.s AS s, c.e AS e, c.enc * 100 + {length} AS stratum,
        1 - pow(1 - least({least}, 1D), 3) AS p))"""


def scanned(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """__row (carry's columns), base array<struct<s, kind, e>> in order, and tested candidates that touch no base span."""
    rows = docs.select(whole_row(docs, carry), text_or_empty(text_col).alias("t"))
    for name, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("found", CANDIDATE, 0)):
        rows = _with_matches(rows, name, pattern, group)
    rows = _fitting(rows, "found")
    for name, least in (("assign", 6), ("access", 20), ("hex", 24)):
        rows = rows.withColumn(name, F.expr(f"filter({name}, m -> m.n >= {least})"))
    base = [f"transform({name}, m -> struct(m.s AS s, {k} AS kind, m.e AS e))" for k, name in enumerate(("assign", "access", "hex"))]
    rows = rows.withColumn("base", F.expr(f"sort_array(concat({', '.join(base)}))"))
    free = " OR ".join(_touches(f"b.{name}", "m") for name in ("assign", "access", "hex"))
    free = _let("b", "struct(assign AS assign, access AS access, hex AS hex)", f"filter(found, m -> NOT ({free}))")
    rows = rows.withColumn("found", F.expr(f"CASE WHEN size(found) > 0 AND size(base) > 0 THEN {free} ELSE found END"))
    tested = F.expr(f"CASE WHEN size(found) > 0 THEN {_tested('found')} ELSE CAST(array() AS array<struct<s:int,e:int,stratum:int,p:double>>) END")
    return rows.select("__row", "base", tested.alias("tested"))


#: Families of encodings by the letters of their keys: lower case, upper case, both.
_FAMILY = [0, 1, 0, 1, 0, 2, 2, 2]
#: Which strata a thin one is pooled with: ever coarser, from neighbouring length classes to all.
_NEIGHBOURS = [
    lambda a, b: a // 100 == b // 100 and abs(a - b) <= 1,
    lambda a, b: a // 100 == b // 100,
    lambda a, b: _FAMILY[a // 100] == _FAMILY[b // 100],
    lambda a, b: True,
]


def _above(row: list[int]) -> list[int]:
    return [sum(row[b:]) for b in range(BINS)]


def _random(above: list[int]) -> float:
    """How many are random, p being uniform then: by the share beyond 1/2, and by that beyond 3/4 where it is clearly less.

    Words inflate the first more, but the second rests on half as many; it counts with its standard error on top.
    """
    return min(2 * above[BINS // 2], 4 * (above[3 * BINS // 4] + above[3 * BINS // 4] ** 0.5))


def _lowest(above: list[int], limit: float) -> int | None:
    """The lowest bin from which on the estimated words are within the limit, give or take half a standard error of the count."""
    random = _random(above)
    return next((b for b in range(1, BINS) if above[b] and above[b] - random * (1 - b / BINS) <= limit * above[b] + 0.5 * above[b] ** 0.5), None)


def cuts(scan: DataFrame, limit: float, least_random: float) -> dict[int, float]:
    """Stratum -> the lowest cut on p that holds the false-discovery rate under the limit. Reads counts of bounded size."""
    bin_ = F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int")
    counts: dict[int, list[int]] = {}
    for stratum, b, n in (
        scan.select(F.explode("tested").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), bin_.alias("bin")).count().collect()
    ):  # at most encodings x length classes x BINS rows
        counts.setdefault(stratum, [0] * BINS)[b] = n
    found = {}
    for stratum, row in counts.items():
        own = _above(row)
        if _random(own) >= least_random:
            cut = _lowest(own, limit)
        else:
            pools = (_above([sum(bins) for bins in zip(*(r for k, r in counts.items() if near(k, stratum)))]) for near in _NEIGHBOURS)
            cut = _lowest(next((p for p in pools if _random(p) >= least_random), own), limit)
            # It holds fewer random ones than least_random: where more lie above the pool's cut, they are words.
            while cut is not None and cut < BINS and own[cut] * (1 - limit) > least_random * (1 - cut / BINS):
                cut += 1
        if cut is not None and cut < BINS:
            found[stratum] = cut / BINS
    return found


def secrets(docs: DataFrame, text_col: str = "text", limit: float = 0.1, least_random: float = 4.0, carry: list[str] | None = None) -> DataFrame:
    """__row, spans array<struct<s, kind, e>> and base (the same without the method's own), code points, end exclusive.

    kind indexes KINDS. Null and empty texts have no spans; equal rows get equal spans; an empty table gives an empty
    result. A stratum with fewer than least_random random-looking candidates takes its cut from coarser ones, and if all
    together have fewer, from what it holds itself.
    """
    scan = written(scanned(docs, text_col, carry), "secret-scan")
    at = cuts(scan, limit, least_random)
    taken = F.expr("filter(tested, c -> false)")
    if at:
        table = "map(" + ", ".join(f"{k}, {v}D" for k, v in sorted(at.items())) + ")"
        taken = F.expr(f"filter(tested, c -> coalesce(c.p >= try_element_at({table}, c.stratum), false))")
    scan = scan.withColumn("taken", taken)
    return scan.select("__row", "base", F.expr("sort_array(concat(base, transform(" + _merged("taken") + ", c -> struct(c.s AS s, 3 AS kind, c.e AS e))))").alias("spans"))


def joined_spans(spans: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(get({names}, x.kind), ':', x.s, ':', x.e)), ',')"
