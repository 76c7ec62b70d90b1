"""SQL (DuckDB) for the queries that SQL can express. Packing, token files, secrets, personal data, toxicity: tested otherwise."""

from __future__ import annotations

import math

from tessera.llm import merkle, quality
from tessera.llm.common import LOWER, UPPER

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

CHAT = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  marked AS (SELECT *,
    len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) AS escapes FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

def _quality() -> str:
    gamma = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    bucket = lambda v: f"CAST(ceil(ln({v}) / {math.log(gamma)!r}::DOUBLE) AS INTEGER)"
    values = {
        "word_length": "word_chars / n_words", "other_share": f"(n_other + {quality.EVENTS}) / (word_chars + {quality.EVENTS})",
        "repetition": f"greatest(1 - ln(n_distinct) / ln(n_words), {quality.LEAST_REPETITION!r}::DOUBLE)",
    }
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {bucket(v)} AS b FROM m WHERE NOT base_failed" for m, v in values.items())
    quartile = lambda keys: f"""(SELECT {keys} metric, max(total) AS n, min(CASE WHEN upto >= total * 0.25 THEN b END) AS q25, min(CASE WHEN upto >= total * 0.75 THEN b END) AS q75
      FROM (SELECT *, sum(k) OVER (PARTITION BY {keys} metric) AS total, sum(k) OVER (PARTITION BY {keys} metric ORDER BY b) AS upto
        FROM (SELECT {keys} metric, b, count(*) AS k FROM long GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    drawn = lambda q: f"(o.n::DOUBLE * o.{q} + {quality.PULL} * ((l.n::DOUBLE * l.{q} + {quality.PULL} * w.{q}) / (l.n + {quality.PULL}))) / (o.n + {quality.PULL}) AS {q}"
    far = "CASE metric " + " ".join(f"WHEN '{m}' THEN {r!r}::DOUBLE" for m, r in quality.REACH.items()) + " END"
    sides = ", ".join(f"max(q25 - far * (q75 - q25 + 1)) FILTER (WHERE metric = '{m}') AS low_{m}, max(q75 + far * (q75 - q25 + 1)) FILTER (WHERE metric = '{m}') AS high_{m}" for m in values)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
  g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
  r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g), (VALUES (0), (1), (2)) x(j) WHERE k > 1 GROUP BY doc_id),
  m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS n_other, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id)),
  long AS ({long}), own AS {quartile("lang, source,")}, by_lang AS {quartile("lang,")}, whole AS {quartile("")},
  cuts AS (SELECT lang, source, {sides} FROM (SELECT *, {far} AS far FROM (SELECT o.lang, o.source, o.metric, {drawn("q25")}, {drawn("q75")}
    FROM own o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric JOIN whole w ON w.metric = o.metric)) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE NOT coalesce(
    {bucket(values["word_length"])} < low_word_length OR {bucket(values["word_length"])} > high_word_length
    OR CASE WHEN n_symbols > 0 THEN {bucket("n_symbols / word_chars")} > high_other_share ELSE false END OR {bucket(values["repetition"])} > high_repetition, false) END AS kept
FROM m LEFT JOIN cuts ON cuts.lang IS NOT DISTINCT FROM m.lang AND cuts.source IS NOT DISTINCT FROM m.source
"""


def _mixing(weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> str:
    listed = ", ".join(repr(float(w)) for w in weights)
    return rf"""
WITH d AS (SELECT *, CASE WHEN size < 256 THEN 1 WHEN size < 1024 THEN 2 WHEN size < 4096 THEN 4 ELSE 8 END::DOUBLE AS imp FROM (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('{seed}' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents)),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  ranked AS (SELECT *, list_extract([{listed}], CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} AS INTEGER) + 1)::DOUBLE AS weight, source_size * {float(cap)!r}::DOUBLE AS cap FROM s),
  filled AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM ranked),
  level AS (SELECT coalesce(arg_min(share, cap / weight) FILTER (WHERE cap > weight * share), 1e300) AS share FROM filled),
  t AS (SELECT r.source, source_size, CASE WHEN source_size = 0 THEN 0 WHEN cap <= weight * level.share THEN cap ELSE weight * level.share END AS target FROM ranked r, level),
  g AS (SELECT *, target - certain * source_size AS open_ FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM t)),
  c AS (SELECT source, imp, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
  sc AS (SELECT source, arg_max(scale, imp) AS scale FROM (SELECT c.source, imp, (open_ - (sum(words) OVER (PARTITION BY c.source ORDER BY imp DESC) - words))
      / nullif(sum(words * imp) OVER (PARTITION BY c.source ORDER BY imp DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale FROM c JOIN g ON g.source IS NOT DISTINCT FROM c.source) WHERE scale * imp < 1 GROUP BY source),
  w AS (SELECT d.*, source_size, target, certain, CASE WHEN open_ > 0 THEN coalesce(scale * imp, 1) ELSE 0 END AS chance FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN sc ON sc.source IS NOT DISTINCT FROM d.source),
  p AS (SELECT *, certain + CASE WHEN chance >= 1 THEN 1 ELSE 0 END AS whole, CASE WHEN chance < 1 THEN chance ELSE 0 END AS p FROM w),
  left_ AS (SELECT source, any_value(target) - CAST(sum(whole * size) AS BIGINT) AS open_ FROM p GROUP BY source),
  o AS (SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1 END AS v FROM p),
  runs AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY v) AS run FROM (SELECT o.source, v, sum(size) AS words, any_value(open_) AS open_ FROM o JOIN left_ ON left_.source IS NOT DISTINCT FROM o.source WHERE p > 0 GROUP BY o.source, v)),
  edge AS (SELECT source, min(v) AS cut_v, arg_min(words, v) AS cut_words, arg_min(open_ - run + words, v) AS gap FROM runs WHERE run > open_ GROUP BY source),
  fit AS (SELECT source, v, cut_v FROM (SELECT r.source, r.v, cut_v, gap, abs(gap - CASE WHEN r.v >= cut_v THEN words ELSE cut_words - words END) AS miss FROM runs r JOIN edge e ON e.source IS NOT DISTINCT FROM r.source)
    WHERE miss < gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, v) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND (e.cut_v IS NULL OR o.v < e.cut_v OR o.v = greatest(f.v, f.cut_v)) AND NOT (f.v IS NOT NULL AND f.v < f.cut_v AND o.v = f.v) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM o.source LEFT JOIN fit f ON f.source IS NOT DISTINCT FROM o.source
"""


def _merkle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in merkle.FIELDS) + ")"
    # CRC-32 bit by bit, least significant first.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> CAST(k AS INTEGER)) & 1 AS BIGINT))))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    climb = lambda name, base: f"""{name}(tree, level, pos, n, h) AS ({base} UNION ALL
        SELECT tree, level + 1, pos >> 1, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, pos >> 1)"""  # noqa: E731
    fold = lambda name, nodes, base: f"""{name}(id, tree, level, pos, n, h, around) AS ({base} UNION ALL
        SELECT f.id, f.tree, f.level + 1, f.pos >> 1, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.around || coalesce(s.h, '')
        FROM {name} f LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.pos = xor(f.pos, CAST(1 AS BIGINT)) WHERE f.n > 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS id, doc_id, lang AS tree, {leaf("n_chars")} AS leaf, {leaf("(CAST(n_chars AS HUGEINT) + 1)")} AS changed, coalesce({crc} % 7 = 0, false) AS chosen FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
  {climb("nodes", "SELECT tree, 0, pos, n, leaf FROM p")},
  subs AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
  {climb("tops", "SELECT '', 0, pos, n, h FROM subs")},
  {fold("f", "nodes", "SELECT id, tree, 0, pos, n, CASE WHEN chosen THEN changed ELSE leaf END, '' FROM p")},
  {fold("g", "tops", "SELECT id, '', 0, subs.pos, subs.n, f.h, around FROM f JOIN subs ON subs.tree IS NOT DISTINCT FROM f.tree WHERE f.n = 1")}
SELECT doc_id, leaf, subs.h AS subroot, r.h AS root, sha256(around) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM p JOIN g ON g.id = p.id AND g.n = 1 JOIN subs ON subs.tree IS NOT DISTINCT FROM p.tree JOIN (SELECT h FROM tops WHERE n = 1) r ON true
"""


DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  windows AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  grams AS (SELECT id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
  found AS (SELECT id, i, k, item FROM grams JOIN windows USING (k, g)),
  hit AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS spot FROM (SELECT DISTINCT id, i, k FROM found)) GROUP BY id),
  items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS listed FROM (SELECT DISTINCT id, item FROM found) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (id) LEFT JOIN items USING (id)
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
  own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  size AS (SELECT lang, count(*) AS v, sum(whole) AS whole_total FROM kept GROUP BY lang),
  groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) USING (lang, source)),
  p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 2) // (CAST(g.total AS HUGEINT) + 2 * v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (whole + 2) // (CAST(whole_total AS HUGEINT) + 2 * v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN size ON size.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  out AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM out) WHERE part = 'pair' OR rank <= 10
"""


SQL = {
    "op1_exact_dedup": EXACT_DEDUP, "op3_chat_formatting": CHAT, "op5_near_dedup": NEAR_DEDUP, "op8_quality_rules": _quality(), "op9_mixing": _mixing(),
    "op11_merkle_manifest": _merkle(), "op12_decontamination": DECONTAMINATION, "op13_source_divergence": DIVERGENCE,
}
