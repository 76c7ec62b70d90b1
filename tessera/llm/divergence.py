"""Source divergence audit by in-mapper stripes.

Each task folds whole documents into a hash table of stripes, (language, term) -> (documents, occurrences per source).
A table that reaches its bound is spilled as rows and begun anew, so a term that every document has leaves a task a few
times, not once a document. Stripes meet by key in one exchange, sorted, and merge in a walk through them. The
merged stripes of the terms that a language keeps are all that the divergences need: they are dealt out again in bins of
bounded size, each beside its language's totals, and every bin emits its part of the sums between sources and its own ten
best terms per source.

All values are integers: counts of up to 9.2e9 are divided in 64 bits, greater ones in Python's integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import erase, joined, utf8, written

#: Source entries and bytes of terms that a task's table holds before it spills, and rows of a batch that it gives out.
MOST_ENTRIES, MOST_BYTES, OUT_ROWS = 800_000, 64 << 20, 20_000
#: Terms of a bin.
BIN = 20_000
#: Below this, (count + 2) * SCALE fits 64 bits.
SCALE, MOST_COUNT = 1_000_000_000, 9_200_000_000
#: Letters after A-Z are lower-cased: a-z and every byte of a character beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
STRIPE = "lang string, term binary, docs long, sources array<string>, counts array<long>"


class _Table:
    """Stripes by language and term, held as one counter of documents a language and one of occurrences a source.

    The empty term stands for all documents of a language.
    """

    def __init__(self):
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.entries = self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        if lang not in self.docs:
            self.docs[lang], self.counts[lang] = Counter(), {}
        docs, counts = self.docs[lang], self.counts[lang].setdefault(source, Counter())
        terms = _TERM.findall(text.lower())
        terms.append(b"")
        before = len(docs), len(counts)
        counts.update(terms)
        docs.update(set(terms))
        self.entries += len(counts) - before[1]
        if len(docs) > before[0]:
            self.bytes += (len(docs) - before[0]) * len(text) // len(terms)  # as if new terms had the text's mean length, at most

    def spill(self) -> Iterator:
        """The stripes as rows; the table is empty afterwards."""
        import numpy as np
        import pyarrow as pa

        for lang, docs in self.docs.items():
            place = {term: k for k, term in enumerate(docs)}
            names, rows, codes, values = list(self.counts[lang]), [], [], []
            for code, counts in enumerate(self.counts[lang].values()):
                rows.append(np.fromiter(map(place.__getitem__, counts), np.int64, count=len(counts)))
                codes.append(np.full(len(counts), code, np.int32))
                values.append(np.fromiter(counts.values(), np.int64, count=len(counts)))
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(docs) + 1)).astype(np.int32)
            sources = pa.array(names, pa.string()).take(pa.array(np.concatenate(codes)[order]))
            columns = {
                "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(docs), np.int32))),
                "term": pa.array(list(docs), pa.large_binary()),
                "docs": pa.array(np.fromiter(docs.values(), np.int64, count=len(docs))),
                "sources": pa.ListArray.from_arrays(ends, sources),
                "counts": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)[order])),
            }
            whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            for at in range(0, len(whole), OUT_ROWS):
                yield _small_terms(whole.slice(at, OUT_ROWS))
        self.__init__()


def _small_terms(batch):
    import pyarrow as pa

    return batch.set_column(1, "term", batch.column("term").cast(pa.binary()))


def _fold(most_entries: int):
    def fold(batches: Iterator) -> Iterator:
        table = _Table()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                table.add(lang, source, text)
                if table.entries >= most_entries or table.bytes >= MOST_BYTES:
                    yield from table.spill()
        yield from table.spill()

    return fold


def _merged(table):
    """Neighbouring stripes of one key as one, counts added by source."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(table)
    lang, term = table.column("lang"), table.column("term")
    new = np.ones(n, bool)
    if n > 1:
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    if new.all():
        return table
    first, key = np.flatnonzero(new), np.cumsum(new) - 1
    docs = np.add.reduceat(table.column("docs").to_numpy(), first)
    lists = table.column("sources")
    sizes = pc.list_value_length(lists).to_numpy()
    names = lists.flatten().dictionary_encode()
    code, values = names.indices.to_numpy(), table.column("counts").flatten().to_numpy()
    mixed = np.repeat(key, sizes) * max(1, len(names.dictionary)) + code
    order = np.argsort(mixed, kind="stable")
    mixed, values = mixed[order], values[order]
    heads = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
    owner, who = np.divmod(mixed[heads], max(1, len(names.dictionary)))
    ends = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    sources = pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(who)))
    counts = pa.ListArray.from_arrays(ends, pa.array(np.add.reduceat(values, heads)))
    keep = pa.array(first)
    return pa.RecordBatch.from_arrays([lang.take(keep), term.take(keep), pa.array(docs), sources, counts], names=table.schema.names)


def _merge(batches: Iterator) -> Iterator:
    """Stripes that come sorted by key, merged; the last key of a batch waits for the next one."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
        batch = _merged(batch)
        if len(batch) > 1:
            yield batch.slice(0, len(batch) - 1)
        held = batch.slice(len(batch) - 1)
    if held is not None:
        yield held


def stripes(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, term, docs, sources, counts): in how many documents of a language a term is and how often each source has it.

    The row with the empty term has the language's documents, and by source its documents. Nulls count as ''.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("text"))
    spilled = rows.mapInArrow(_fold(most_entries), STRIPE).withColumn("key", F.xxhash64("lang", "term"))
    # The hash sorts faster than the names do; what shares one is told apart by them.
    return spilled.repartition("key").sortWithinPartitions("key", "lang", "term").drop("key").mapInArrow(_merge, STRIPE)


def _chances(counts, total: int, kept: int):
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    import numpy as np

    if counts.size and int(counts.max()) + 2 > MOST_COUNT or total + 2 * kept > MOST_COUNT:
        counts = counts.astype(object)
    return np.asarray(1 + (counts + 2) * SCALE // (total + 2 * kept))


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _bin(top: int):
    def emit(key, stripes_, totals):
        """The parts of one bin: sums between each two sources, and the best terms of each source."""
        import numpy as np
        import pyarrow as pa

        lang = key[0].as_py()
        order = np.argsort([s.encode() for s in totals.column("source").to_pylist()])
        names = [totals.column("source")[int(k)].as_py() for k in order]
        sums = [totals.column("total")[int(k)].as_py() for k in order]
        kept, whole = (totals.column("kept")[0].as_py(), totals.column("whole")[0].as_py()) if names else (0, 0)
        between = np.zeros((len(names), len(names)), object)
        out: list[tuple] = []
        place = {s: k for k, s in enumerate(names)}
        step = max(1, (1 << 20) // max(1, len(names)))
        best: list[list] = [[] for _ in names]
        for at in range(0, len(stripes_), step):
            part = stripes_.slice(at, step).combine_chunks()
            lists = part.column("sources").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            coded = lists.flatten().dictionary_encode()
            where = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            counts = np.zeros((len(part), len(names)), np.int64)
            counts[np.repeat(np.arange(len(part)), sizes), where] = part.column("counts").combine_chunks().flatten().to_numpy()
            own = np.stack([_chances(counts[:, k], sums[k], kept) for k in range(len(names))], axis=1)
            none = [int(_chances(np.zeros(1, np.int64), s, kept)[0]) for s in sums]
            overall = _chances(counts.sum(axis=1), whole, kept)
            terms = part.column("term").to_pylist()
            has = counts > 0
            for k in range(len(names)):
                rows = np.flatnonzero(has[:, k])
                # Pairs of two sources that both have a term are met from both sides, and counted from the first alone.
                apart = _apart(own[rows, k][:, None], own[rows])
                apart[:, :k][has[rows, :k]] = 0
                found = apart.sum(axis=0)
                between[k] += found
                between[:, k] += found
                value = _apart(own[rows, k], overall[rows])
                above = np.flatnonzero(own[rows, k] > overall[rows])
                if len(above) > top:
                    least = np.partition(value[above], len(above) - top)[len(above) - top]
                    above = above[value[above] >= least]
                best[k] = sorted([*best[k], *[(-int(value[r]), terms[rows[r]]) for r in above]])[:top]
            present = has.astype(np.int64)
            either = present.sum(axis=0)[:, None] + present.sum(axis=0)[None, :] - present.T @ present
            for k in range(len(names)):
                for m in range(len(names)):
                    between[k, m] += (len(part) - int(either[k, m])) * _apart(none[k], none[m])
        for k, name in enumerate(names):
            out += [(lang, name, "pair", names[m], int(between[k, m])) for m in range(len(names)) if m != k]
            out += [(lang, name, "term", t.decode(), -v) for v, t in best[k]]
        kinds = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
        columns = zip(*out) if out else [[]] * len(kinds)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    return emit


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms are from each other source's and from its language's.

    Part 'pair' has every other source of the language with the sum over all kept terms (those in at least least_docs of
    its documents), 0 where none is kept; part 'term' has the top terms that a source has more of than its language. Ties of
    value go by item in bytes. The pairs are a square of the sources of a language, as the report asks.

    Null languages, sources and texts are ''; texts without terms make their group known and nothing else; repeated rows
    are documents of their own; an empty table gives an empty result. Other columns are not read.
    """
    spark, log = docs.sparkSession, {}
    merged = stripes(docs, lang, source, text, most_entries)
    merged = written(merged.where((F.octet_length("term") == 0) | (F.col("docs") >= least_docs)), "stripes", log)
    terms, groups = merged.where(F.octet_length("term") > 0), merged.where(F.octet_length("term") == 0)
    entries = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    used = entries.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    known = groups.select("lang", F.explode("sources").alias("source"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("whole"))
    totals = known.join(used, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "kept", "whole"])
    totals = written(totals, "source-totals", log)
    bins = F.greatest(F.ceil(F.col("kept") / BIN), F.lit(1)).cast("int")
    per_lang = totals.groupBy("lang").agg(F.max(bins).alias("bins"))
    dealt = joined(terms, per_lang, ["lang"]).withColumn("bin", F.pmod(F.xxhash64("term"), F.col("bins")).cast("int"))
    beside = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), bins - 1)))
    parts = dealt.groupBy("lang", "bin").cogroup(beside.groupBy("lang", "bin")).applyInArrow(_bin(top), "lang string, source string, part string, item string, value long")
    parts = written(parts, "divergence-parts", log)
    erase(spark, log, "stripes", "source-totals")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # Of terms, each bin has at most `top` a source; a term is in one bin.
    ranked = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
