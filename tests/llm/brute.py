"""Plain Python versions of the operators' contracts, to test against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def exact(rows):
    """rows: (doc_id, text) -> {doc_id: (keep_id, group_size, kept, sha)}"""
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {
        i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    }


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    covered = {k for i, g in enumerate(grams) if seen[g] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(t.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def mix_targets(sizes):
    """sizes: {source: words} -> {source: target}"""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    goal, stopped = sum(sizes.values()), set()
    while True:
        left = goal - sum(3 * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        above = {s for s in order if s not in stopped and left * weight[s] / open_ >= 3 * sizes[s]} if open_ else set()
        if not above:
            return {s: 3 * sizes[s] if s in stopped else left * weight[s] / open_ for s in order}
        stopped |= above


def shingle_sets(rows, width):
    """{doc_id: set of word shingles}"""
    out = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def near(rows, width, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets = shingle_sets(rows, width)
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secret_base(text):
    """[(start, kind, end)]"""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    """[(start, kind, end)]"""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p[-400:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def chat(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        of[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in of.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text), ids distinct -> {doc_id: (leaf, subroot, root, proof, folded, verified)}"""
    import zlib

    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        """levels of nodes, leaves first"""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def fold(levels, k, node):
        """(node at the top, siblings), with node in place of leaf k"""
        around = []
        for level in levels[:-1]:
            other = level[k ^ 1] if k ^ 1 < len(level) else None
            node = h(other, node) if other and k & 1 else h(node, other or "")
            around += [other] if other else []
            k >>= 1
        return node, around

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0)) for x in langs}
    trees = {x: climb([h(*map(field, r)) for r in of[x]]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    out = {}
    for place, x in enumerate(langs):
        for k, r in enumerate(of[x]):
            leaf = trees[x][0][k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, own = fold(trees[x], k, h(*map(field, (*r[:3], r[3] + 1, r[4]))) if changed else leaf)
            node, more = fold(top, place, node)
            out[r[0]] = (leaf, trees[x][-1][0], top[-1][0], h(*own, *more), node, node == top[-1][0])
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, window=10):
    """docs: (doc_id, text), items: (item_id, text) -> {doc_id: (n_words, hit words, item ids as sorted strings)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    sizes, out = {len(w) for w in windows}, {}
    for i, t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out[i] = (len(w), hit, sorted(found))
    return out


def longest(docs, items, window=10):
    """{item_id: (item_word, words, doc_id, word)}: the longest match of a window or more, the first of the item, the first document's"""
    texts, out = [(i, ALNUM.findall(low(t))) for i, t in sorted(docs)], {}
    for item, t in items:
        own = ALNUM.findall(low(t))
        for k in range(len(own)):
            if k and len(own) - k < window:
                break
            for i, w in texts:
                for at in range(len(w)):
                    n = 0
                    while k + n < len(own) and at + n < len(w) and own[k + n] == w[at + n]:
                        n += 1
                    if n >= min(window, len(own)) and n > out.get(item, (0, 0))[1]:
                        out[item] = (k, n, i, at)
    return out


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least_docs=10, top=10):
    """rows: (lang, source, text) -> {(lang, source, part, item, value, rank)}"""
    rows = [(a or "", b or "", Counter(x.translate(LOWER) for x in LETTERS.findall(t or ""))) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for a, b, terms in rows:
            if a == lang:
                docs.update(set(terms))
                groups[b].update(terms)
        kept = [t for t, n in docs.items() if n >= least_docs]
        whole = Counter({t: sum(g[t] for g in groups.values()) for t in kept})

        def chances(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: chances(c) for s, c in groups.items()}, chances(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, own in p.items():
            pairs = [(-sum(f(own[t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(own[t], q[t]), t.encode()) for t in kept if groups[s][t] > 0 and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)}
    return out
