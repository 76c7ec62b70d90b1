"""Benchmark decontamination by suffix arrays of the training texts.

Every task cuts its documents into shards of some megabytes and builds a suffix array of each: all word positions from
which a test window could begin, sorted by the words that follow, as deep as the longest test item. Every suffix of every
test item is then binary-searched in it, one word deeper at a time: the range that is left when a window's words are used
up holds the window's occurrences, the last range that is not empty the longest verbatim match and its places. Words
are numbers there, given by a hash of their bytes to the test items' words; those of matches are compared byte
by byte before they count, so a hash never decides alone. Words that no test item has match nothing and begin no suffix.

The test items are the stated query set. They go to the tasks in blocks of bounded size; if there is more than one block, the
documents are searched once for each and the finds are joined by document and text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fitted, joined, text_or_empty, utf8, whole_row, written

WINDOW = 10
#: Bytes of text of a shard, and of test items that a pass takes.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 18
HIT = "struct<first:bigint,last:bigint>"
FOUND = f"sha string, n_words bigint, hits array<{HIT}>, items array<string>"
LONGEST = "item string, item_word bigint, words bigint, word bigint"


def _lowered():
    """Byte -> its lower case, 0 for bytes that are no part of a word."""
    import numpy as np

    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for first, last in ((b"0", b"9"), (b"a", b"z")):
        table[first[0] : last[0] + 1] = np.arange(first[0], last[0] + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


class Words:
    """The words of some texts that lie one after another in a buffer, by their places there."""

    def __init__(self, data, offsets):
        import numpy as np

        self.low = _lowered()[data]
        inside, begins = self.low != 0, np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        begins[len(data)] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | begins[1:-1]
        end[:-1] &= ~inside[1:] | begins[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: Text k has the words from first[k] to first[k + 1].
        self.first = np.searchsorted(self.start, offsets)

    def text(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()


class Hashes:
    """Polynomial hashes of words: sums of bytes times powers of an odd number, made independent of the place by its inverse."""

    def __init__(self, base: int, room: int):
        import numpy as np

        self.room = max(PIECE, room)
        self.powers, self.inverses = (
            np.cumprod(np.r_[np.uint64(1), np.full(self.room, x % 2**64, np.uint64)], dtype=np.uint64) for x in (base, pow(base, -1, 2**64))
        )

    def of(self, words: Words, which):
        """Hashes of the words numbered `which`, none longer than room."""
        import numpy as np

        start, end, found, at = words.start[which], words.end[which], np.empty(len(which), np.uint64), 0
        while at < len(which):
            to = max(at + 1, int(np.searchsorted(end, start[at] + self.room, "right")))
            base = int(start[at])
            seg = words.low[base : end[to - 1]].astype(np.uint64) * self.powers[: end[to - 1] - base]
            upto = np.r_[np.uint64(0), np.cumsum(seg, dtype=np.uint64)]
            found[at:to] = (upto[end[at:to] - base] - upto[start[at:to] - base]) * self.inverses[start[at:to] - base]
            at = to
        return found


class Probes:
    """A block of test items: their words as numbers, and what is needed to number other words alike."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        import numpy as np

        self.ids = [i for i, _ in items]
        offsets = np.cumsum([0, *[len(t) for _, t in items]])
        self.words = Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), offsets)
        w, n = self.words, len(self.words.start)
        self.most_bytes = int((w.end - w.start).max()) if n else 0
        distinct = len({w.text(k) for k in range(n)})
        for base in range(0x9E3779B97F4A7C15, 2**64, 2):  # until no two of the words share a hash
            self.hashes = Hashes(base, self.most_bytes)
            self.known, example, number = np.unique(self.hashes.of(w, np.arange(n)), return_index=True, return_inverse=True)
            if len(self.known) == distinct:
                break
        #: Number k + 1 has the bytes of word example[k].
        self.example, self.number = example, number.astype(np.int64) + 1
        size = np.diff(w.first)
        self.item = np.repeat(np.arange(len(items)), size)
        self.place = np.arange(n) - w.first[self.item]
        self.rest = size[self.item] - self.place
        #: Words of the window that begins here, 0 where none does.
        self.window = np.where(self.rest >= window, window, np.where(self.place == 0, self.rest, 0))
        self.shortest = int(self.window[self.window > 0].min()) if n else 0
        self.longest = int(size.max()) if n else 0

    def numbers(self, words: Words):
        import numpy as np

        found = np.zeros(len(words.start), np.int64)
        short = np.flatnonzero(words.end - words.start <= self.most_bytes)
        if len(short) and len(self.known):
            h = self.hashes.of(words, short)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            found[short] = np.where(self.known[at] == h, at + 1, 0)
        return found

    def differ(self, words: Words, which, numbers):
        """Whether these words differ in bytes from the test words whose numbers they got."""
        import numpy as np

        own = self.example[numbers - 1]
        size = words.end[which] - words.start[which]
        bad = size != self.words.end[own] - self.words.start[own]
        for at in range(0, len(which), 1 << 17):
            some = slice(at, at + (1 << 17))
            n = np.where(bad[some], 0, size[some])
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            unequal = words.low[np.repeat(words.start[which[some]], n) + inner] != self.words.low[np.repeat(self.words.start[own[some]], n) + inner]
            bad[some] |= np.bincount(np.repeat(np.arange(len(n)), n), unequal, len(n)) > 0
        return bad


class SuffixArray:
    """The suffixes of a shard that a test window may begin, sorted by their words, as deep as the tests go."""

    def __init__(self, words: Words, tests: Probes):
        import numpy as np

        number, n = tests.numbers(words), len(words.start)
        # A suffix ends with its text and before the first word that no test has.
        stop = np.where(number == 0, np.arange(n), n)
        last = words.first[1:][words.first[1:] > 0]
        stop[last - 1] = np.minimum(stop[last - 1], last)
        end = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        run = np.maximum(np.where(number == 0, 0, end - np.arange(n)), 0)
        self.number, self.run, self.depth = np.r_[number, 0], run, tests.longest
        self.order = np.flatnonzero(run >= max(1, tests.shortest))
        self._sort(max(1, int(len(tests.known)).bit_length()))

    def word(self, suffix, depth: int):
        """The number of the suffixes' word at this depth, 0 beyond their end."""
        import numpy as np

        return np.where(depth < self.run[suffix], self.number[np.minimum(suffix + depth, len(self.number) - 1)], 0)

    def _sort(self, bits: int) -> None:
        """Sorts by some words at a time; a group is sorted on as long as it has several suffixes."""
        import numpy as np

        group, step = np.zeros(len(self.order), np.int64), max(1, 62 // bits)
        open_ = np.arange(len(self.order))
        for depth in range(0, self.depth, step):
            if not len(open_):
                break
            suffix, key = self.order[open_], np.zeros(len(open_), np.int64)
            for k in range(step):
                key = (key << bits) | self.word(suffix, depth + k)
            by = np.lexsort((key, group[open_]))
            # Groups are ranges of places, so the sorted suffixes go to the same places.
            self.order[open_], key, own = suffix[by], key[by], group[open_]
            new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
            heads = open_[np.flatnonzero(new)]
            group[open_] = heads[np.cumsum(new) - 1]
            sizes = np.diff(np.r_[np.flatnonzero(new), len(open_)])
            open_ = open_[np.repeat(sizes > 1, sizes)]

    def search(self, tests: Probes):
        """Per test suffix: the range of its window's occurrences, and depth and range of its longest match."""
        import numpy as np

        n = len(tests.number)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        window_low, window_high, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n) if len(self.order) else np.zeros(0, np.int64)
        for d in range(tests.longest):
            live = live[tests.rest[live] > d]
            if not len(live):
                break
            wanted = tests.number[live + d]
            a, b = self._bound(low[live], high[live], wanted, d), self._bound(low[live], high[live], wanted + 1, d)
            there = a < b
            live, a, b = live[there], a[there], b[there]
            low[live], high[live], depth[live] = a, b, d + 1
            full = live[tests.window[live] == d + 1]
            window_low[full], window_high[full] = low[full], high[full]
        return window_low, window_high, depth, low, high

    def _bound(self, low, high, wanted, d: int):
        """Binary search: the first place of [low, high) whose word at depth d is wanted or beyond."""
        import numpy as np

        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.word(self.order[middle], d) < wanted[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def _ranges(low, high, *more):
    """The distinct rows of (low, high, more...) whose range is not empty."""
    import numpy as np

    some = low < high
    return np.unique(np.stack([low, high, *more], axis=1)[some], axis=0)


def _spread(low, high):
    """(row of the range, place) for every place of the ranges."""
    import numpy as np

    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


class Shard:
    """Some documents with their suffix array, searched by a block of tests."""

    def __init__(self, data, offsets, tests: Probes):
        import numpy as np

        self.words, self.tests = Words(data, offsets), tests
        self.array = SuffixArray(self.words, tests)
        low, high, self.depth, self.low, self.high = self.array.search(tests)
        # A place begins one window of a length, so the windows' ranges, each taken once, hold few places in all.
        self.windows = _ranges(low, high, tests.window)
        row, place = _spread(self.windows[:, 0], self.windows[:, 1])
        word, size = self.array.order[place], self.windows[row, 2]
        good = self._equal(word, size)
        self.row, self.word, self.size = row[good], word[good], size[good]
        self.of_test = np.stack([low, high], axis=1)

    def _covered(self, word, size):
        import numpy as np

        n = len(self.words.start)
        return np.cumsum(np.bincount(word, minlength=n + 1) - np.bincount(word + size, minlength=n + 1))[:n] > 0

    def _equal(self, word, size):
        """Whether all words of these matches have the bytes of the test's words."""
        import numpy as np

        covered = np.flatnonzero(self._covered(word, size))
        bad = np.zeros(len(self.words.start) + 1, np.int64)
        bad[covered + 1] = self.tests.differ(self.words, covered, self.array.number[covered])
        upto = np.cumsum(bad)
        return upto[word + size] == upto[word]

    def documents(self) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per document: words, runs of words that are hit (first, last), and the items that have windows there."""
        import numpy as np

        first = self.words.first
        n = len(first) - 1
        covered = self._covered(self.word, self.size)
        inner = np.zeros(len(covered) + 1, bool)
        inner[first[:-1]] = True
        edge = np.r_[covered, False]
        before = np.r_[False, covered]
        begins = np.flatnonzero(edge & (~before | inner))
        ends = np.flatnonzero(before & (~edge | inner)) - 1
        hits: list[list] = [[] for _ in range(n)]
        for doc, a, b in zip(np.searchsorted(first, begins, "right") - 1, begins, ends):
            hits[doc].append((int(a - first[doc]), int(b - first[doc])))
        items: list[list] = [[] for _ in range(n)]
        for item, docs in self._docs_of_items():
            for doc in docs:
                items[doc].append(self.tests.ids[item])
        return list(zip(np.diff(first).tolist(), hits, [sorted(set(x)) for x in items]))

    def _docs_of_items(self):
        import numpy as np

        doc = np.searchsorted(self.words.first, self.word, "right") - 1
        pairs = np.unique(np.stack([self.row, doc], axis=1), axis=0)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        used = np.flatnonzero(self.of_test[:, 0] < self.of_test[:, 1])
        place = {tuple(w): k for k, w in enumerate(self.windows.tolist())}
        rows: dict[int, set] = {}
        for t in used.tolist():
            rows.setdefault(int(self.tests.item[t]), set()).add(place[(*self.of_test[t].tolist(), int(self.tests.window[t]))])
        for item, own in rows.items():
            yield item, np.unique(np.concatenate([pairs[bounds[k] : bounds[k + 1], 1] for k in sorted(own)])).tolist()

    def longest(self) -> list[tuple[int, int, int, int, int]]:
        """Per item its longest match of a window or more: item, its first word there, words, document and first word there."""
        import numpy as np

        t = np.flatnonzero((self.depth > 0) & (self.depth >= self.tests.window) & (self.tests.window > 0))
        best: dict[int, tuple] = {}
        for k in t[np.lexsort((self.tests.place[t], -self.depth[t], self.tests.item[t]))].tolist():
            item = int(self.tests.item[k])
            if item in best:
                continue
            word, size = self.array.order[self.low[k] : self.high[k]], np.full(int(self.high[k] - self.low[k]), self.depth[k])
            word = word[self._equal(word, size)]
            if len(word):
                doc = int(np.searchsorted(self.words.first, word.min(), "right") - 1)
                best[item] = (item, int(self.tests.place[k]), int(self.depth[k]), doc, int(word.min() - self.words.first[doc]))
        return list(best.values())


def _shards(batches: Iterator, shard_bytes: int) -> Iterator:
    """(ids, shas, bytes, offsets) of texts that together have about shard_bytes; a longer text is one of its own."""
    import numpy as np
    import pyarrow as pa

    def full():
        return pa.array(ids, kind), shas, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    ids, shas, texts, size = [], [], [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if texts and size + len(text) > shard_bytes:
                yield full()
                ids, shas, texts, size = [], [], [], 0
            ids.append(i)
            shas.append(sha)
            texts.append(text)
            size += len(text)
    if texts:
        yield full()


def _marker(tests: Probes, shard_bytes: int):
    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for ids, shas, data, offsets in _shards(batches, shard_bytes):
            n_words, hits, items = zip(*Shard(data, offsets, tests).documents())
            hits = [[{"first": a, "last": b} for a, b in own] for own in hits]
            columns = [ids, pa.array(shas, pa.string()), pa.array(n_words, pa.int64()), pa.array(hits, runs), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sha", "n_words", "hits", "items"])

    return mark


def _finder(tests: Probes, shard_bytes: int):
    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, _, data, offsets in _shards(batches, shard_bytes):
            if found := Shard(data, offsets, tests).longest():
                item, item_word, words, doc, word = zip(*found)
                columns = [ids.take(pa.array(doc)), pa.array([tests.ids[k] for k in item], pa.string()), *[pa.array(x, pa.int64()) for x in (item_word, words, word)]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "item_word", "words", "word"])

    return find


def _joined_runs(batches: Iterator) -> Iterator:
    """Runs of hit words that overlap or touch, made one."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for runs in batch.column("hits").to_pylist():
            own: list[dict] = []
            for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
                if own and r["first"] <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(own[-1]["last"], r["last"])
                else:
                    own.append(dict(r))
            out.append(own)
        at = batch.schema.get_field_index("hits")
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


class Benchmark:
    """The test items, cut into blocks of about block_bytes by a hash; one block at a time is in the driver.

    Null ids are the id 'null'; null texts have no words; an item id with several texts has the windows of all of them.
    """

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
        self.items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), ascii_lower(text_or_empty(text_col)).alias("text")).distinct()
        self.window = window
        self.blocks = max(1, -(-(self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))

    def __iter__(self) -> Iterator[Probes]:
        for k in range(self.blocks):
            own = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks)) == k).collect()
            yield Probes(sorted((r.item, r.text.encode()) for r in own), self.window)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: id_col, sha (of its text), n_words, hits array<struct<first, last>>, items array<string>.

    hits are the runs of words inside occurrences of windows, counted from 0, items the ids of the test items with such
    windows, in order. A window is `window` consecutive words of an item, or all words of a shorter one.

    Null and empty texts have no words and no hits, on either side; repeated rows are found alike. Without test items nothing
    is hit; an empty table gives an empty result. Other columns are not read.
    """
    rows, tests = _rows(docs, id_col, text_col), Benchmark(benchmark, item_col, item_text, window, block_bytes)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}"
    passes = [written(rows.mapInArrow(_marker(block, shard_bytes), schema), "leaks") for block in tests]
    found = passes[0]
    if len(passes) > 1:
        # Equal rows are found alike, so one of them stands for all.
        own = [p.where(F.size("items") > 0).dropDuplicates(["id", "sha"]).select("id", "sha", "hits", "items") for p in passes]
        together = own[0]
        for p in own[1:]:
            together = together.unionByName(p)
        flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one array a block
        together = together.groupBy("id", "sha").agg(flat("hits").alias("hits"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
        together = written(together.mapInArrow(_joined_runs, together.schema), "leaks-joined")
        none = lambda c: F.coalesce(c, F.expr(f"CAST(array() AS {found.schema[c].dataType.simpleString()})"))
        found = joined(found.drop("hits", "items"), together, ["id", "sha"]).withColumns({c: none(c) for c in ("hits", "items")})
    return found.withColumnRenamed("id", id_col)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha"), text_or_empty(text_col).alias("text"))


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per test item that has a window in docs: item, item_word, words, id_col, word: its longest verbatim match and where it is.

    Of equally long ones the first of the item, then the one in the document with the smallest id. Odd rows as in contaminated().
    """
    rows, found = _rows(docs, id_col, text_col), []
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {LONGEST}"
    for block in Benchmark(benchmark, item_col, item_text, window, block_bytes):
        found.append(written(rows.mapInArrow(_finder(block, shard_bytes), schema), "longest"))
    together = found[0]
    for f in found[1:]:
        together = together.unionByName(f)
    # Every shard tells one match an item at most; they are combined before the exchange.
    best = F.min(F.struct((-F.col("words")).alias("minus"), "item_word", F.col("id").isNull().alias("no_id"), "id", "word"))
    return together.groupBy("item").agg(best.alias("b")).select("item", "b.item_word", (-F.col("b.minus")).alias("words"), F.col("b.id").alias(id_col), "b.word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their own columns, in which no window of the benchmark occurs; options as in contaminated().

    Affected rows are known by id and text. Up to 1,000,000 of them are broadcast, beyond that the anti-join shuffles.
    """
    found = contaminated(docs, benchmark, id_col, text_col, **options).where(F.size("items") > 0)
    lost = written(found.select(F.col(id_col).alias("lost_id"), F.col("sha").alias("lost_sha")).distinct(), "leaks-lost")
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha"))
    same = [F.col("id").eqNullSafe(F.col("lost_id")), F.col("sha") == F.col("lost_sha")]
    return rows.join(fitted(lost, 1_000_000), same, "left_anti").select("__row.*")
