"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (by hash) beside the elementwise largest of the vectors of its character pieces:
trigrams, and beginnings of three to six letters. Runs of more than 20 characters enter as overlapping pieces. Two GRUs read a window of words in both directions, attention pools their states, and a logistic unit scores the window. Windows overlap and
cover the whole text; a text's score is its highest window's, with the number of windows accounted for. The network
learns from documents' labels: each round trains on the windows that it then finds most toxic in each document, first
chosen by the words and pieces that labels single out beyond chance. Rare words and pieces keep the zero vector, as unseen
ones have, so nothing is learned by heart. Training rows are a bounded sample of labelled documents, the same on every run.

Scoring looks up each word's gate inputs, which are computed once per distinct word, so a step of a window costs one
small matrix product and a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, utf8, written

WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 8, 12, 8
PIECES = 24
#: Characters of the longest word that is one word to the network, and of the pieces that longer runs are cut into.
LONGEST, PIECE = PIECES - 4, PIECES - 6
#: Documents that a word or piece has to stand in to have a vector of its own.
LEAST_DOCS = 6
#: Vectors of words and pieces learn at this part of the network's rate, and what no gradient renews fades by FADE a step:
#: with few labelled documents the network would know them by heart otherwise. The first place, what labels single out, stays.
VECTOR_RATE, FADE = 0.1, 0.98
#: Labelled documents that training reads at most, toxic and clean, and the bytes of their texts.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
MOST_BYTES = 64 << 20
#: Bytes of one training text at most; where fewer bytes are allowed in all, a quarter of them.
MOST_OF_ONE = 2 << 20
ROUNDS = 6
WORD_CACHE = 150_000
EDGES = b".,;:!?\"'()[]{}<>#*$%&|"


def bare(word: bytes | str) -> str:
    """The word without punctuation around it, in lower case; punctuation alone and pieces of a run stay."""
    if isinstance(word, str):
        return word
    return (word.strip(EDGES) or word).decode("utf-8", "replace").lower()


def parts(words: list[str]):
    """Rows of words (n) and of their pieces (n, PIECES), -1 where a word has fewer.

    Pieces are the beginnings of three to six letters, with the word's start marked, and all trigrams of the marked word.
    Words have LONGEST characters at most, as split() gives them. All words are hashed at once, over their characters.
    """
    import numpy as np

    n = np.array([len(w) for w in words], dtype=np.int64)
    if n.max(initial=0) > LONGEST:
        raise ValueError(f"a word of {n.max()} characters has to be cut first")
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.cumsum(n + 2) - (n + 2)  # where each marked word begins
    mixed = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # Hash of a whole word: its characters' sum, each by its place.
    place = np.arange(len(letters)) - np.repeat(first, n + 2)
    whole = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * (2 * place.astype(np.uint64) + np.uint64(1)), first) if len(words) else np.zeros(0, np.uint64)
    rows = (((whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(WORD_ROWS)
    last = len(letters) - 1

    def spell(start, length):
        h = np.full(start.shape, length, dtype=np.uint64)
        for j in range(length):
            h = (h ^ mixed[np.minimum(start + j, last)]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(CHAR_ROWS)).astype(np.int32)

    i = np.arange(LONGEST)[None, :]
    trigrams = np.where(i < n[:, None], spell(first[:, None] + i, 3), -1)
    starts = [np.where(n >= k, spell(first, k + 1), -1) for k in (3, 4, 5, 6)]
    return rows.astype(np.int32), np.concatenate([trigrams, np.stack(starts, axis=1)], axis=1).astype(np.int32)


def pieces(run: str) -> list[str]:
    """Pieces of PIECE characters that cover a run of more than LONGEST, each half over the next.

    So every trigram stands in a piece, and whatever has up to half a piece's characters stands in one whole. NUL marks
    the ends that are none of the run's, lest they pass for a word's beginning or end.
    """
    last = len(run) - PIECE
    return ["\0" * (s > 0) + run[s : s + PIECE] + "\0" * (s < last) for s in [*range(0, last, PIECE // 2), last]]


def split(text: str | bytes | None) -> list[bytes | str]:
    """Words between white space; of runs longer than LONGEST (unspaced scripts, joined words) the pieces, as str."""
    words = (text.encode("utf-8") if isinstance(text, str) else text or b"").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[bytes | str] = []
    for w in words:
        if len(w) > LONGEST and len(run := bare(w)) > LONGEST:
            out += pieces(run)
        else:
            out.append(w)
    return out


def windows(ids):
    """Rows of WINDOW word numbers that cover ids; short texts are filled with -1. No words give one row of -1."""
    import numpy as np

    n = len(ids)
    if n <= WINDOW:
        return np.concatenate([ids, np.full(WINDOW - n, -1, dtype=ids.dtype)])[None, :]
    starts = np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))
    return ids[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, training pass and scoring pass."""

    def __init__(self, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "word": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "char": np.zeros((CHAR_ROWS, CHAR_DIM), np.float32),
            "Wf": f(d, 3 * h, scale=d**-0.5), "Uf": f(h, 3 * h, scale=h**-0.5), "bf": np.zeros(3 * h, np.float32),
            "Wb": f(d, 3 * h, scale=d**-0.5), "Ub": f(h, 3 * h, scale=h**-0.5), "bb": np.zeros(3 * h, np.float32),
            "A": f(2 * h, ATTENTION, scale=h**-0.5), "v": f(ATTENTION, scale=0.5), "o": f(2 * h, scale=h**-0.5), "c": np.zeros(1, np.float32),
        }
        self.level = (1.0, 0.0, 0.0)  # score = sigmoid(level[0] * logit + level[1] * log(windows) + level[2])
        self._m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self._t = 0

    def inputs(self, rows, grams, which=False):
        """Inputs of distinct words; with which, also the piece that gave each character input. grams ends with -1s."""
        import numpy as np

        vectors = np.where((grams >= 0)[:, :, None], self.p["char"][grams], -np.inf)
        vectors[(grams < 0).all(1), 0] = 0
        best = vectors.argmax(1)
        chars = np.take_along_axis(vectors, best[:, None, :], axis=1)[:, 0]
        x = np.concatenate([self.p["word"][rows], chars], axis=1).astype(np.float32)
        return (x, best) if which else x

    def gates(self, x):
        import numpy as np

        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)

    def table(self, rows, grams, part: int = 4096):
        """Gate inputs of no word, in row 0, and of the words, per direction. Works in parts: pieces' vectors are far wider."""
        import numpy as np

        out = np.empty((2, len(rows) + 1, 3 * HIDDEN), np.float32)
        self.fill(out, 0, np.zeros(1, np.int32), np.full((1, PIECES), -1, np.int32))
        for i in range(0, len(rows), part):
            self.fill(out, i + 1, rows[i : i + part], grams[i : i + part])
        return out

    def fill(self, table, at: int, rows, grams) -> None:
        got = self.gates(self.inputs(rows, grams))
        table[0, at : at + len(got)] = got[:, : 3 * HIDDEN]
        table[1, at : at + len(got)] = got[:, 3 * HIDDEN :]

    def _run(self, gates, steps, mask, u, keep):
        """States of one direction, (steps, batch, hidden), and what the backward pass needs."""
        import numpy as np

        h = np.zeros((mask.shape[1], HIDDEN), np.float32)
        states, kept = np.zeros((mask.shape[0], *h.shape), np.float32), []
        full = mask.all(axis=1)
        for t in steps:
            g, hu = gates[t], h @ u
            rz = 1 / (1 + np.exp(-np.clip(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN], -30, 30)))
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                kept.append((t, h, r, z, n, hu[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, kept

    def forward(self, gates, mask, keep=False):
        """gates: (steps, batch, 6 * hidden); mask: (steps, batch). Logits, and what the backward pass needs."""
        import numpy as np

        steps = range(mask.shape[0])
        sf, kf = self._run(gates[:, :, : 3 * HIDDEN], steps, mask, self.p["Uf"], keep)
        sb, kb = self._run(gates[:, :, 3 * HIDDEN :], reversed(steps), mask, self.p["Ub"], keep)
        both = np.concatenate([sf, sb], axis=2)
        a = np.tanh(both @ self.p["A"])
        e = np.where(mask, a @ self.p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * both).sum(0)
        return pooled @ self.p["o"] + self.p["c"][0], (kf, kb, both, a, w, pooled)

    def _back(self, d_states, kept, u, mask, name, grad):
        import numpy as np

        d_gates = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        d_u, dh = np.zeros_like(u), np.zeros_like(d_states[0])
        for t, before, r, z, n, hun in reversed(kept):
            total = d_states[t] + dh
            m = mask[t][:, None]
            d_new = total * m
            d_n = d_new * (1 - z) * (1 - n * n)
            d_hu = np.concatenate([d_n * hun * r * (1 - r), d_new * (before - n) * z * (1 - z), d_n * r], axis=1)
            d_gates[t] = np.concatenate([d_hu[:, : 2 * HIDDEN], d_n], axis=1)
            d_u += before.T @ d_hu
            dh = total * (1 - m) + d_new * z + d_hu @ u.T
        grad[name] = d_u
        return d_gates

    def learn(self, ids, labels, rows, grams, rate, own, rng):
        """One Adam step on windows ids (batch, steps) of words numbered by rows and grams; the mean loss.

        own: which rows of the word and piece tables learn. A quarter of the words lose one half of their input.
        """
        import numpy as np

        used, where = np.unique(ids.T, return_inverse=True)
        where = where.reshape(ids.T.shape)
        mask = ids.T >= 0
        mask[0] |= ~mask.any(0)
        safe = np.maximum(used, 0)
        x, best = self.inputs(rows[safe], grams[safe], which=True)
        lost = rng.random(len(x))[:, None] < np.where(np.arange(x.shape[1]) < WORD_DIM, 0.125, 0.0)
        lost |= rng.random(len(x))[:, None] < np.where(np.arange(x.shape[1]) < WORD_DIM, 0.0, 0.125)
        x[lost] = 0
        logit, (kf, kb, both, a, w, pooled) = self.forward(self.gates(x)[where], mask, keep=True)
        p = _sigmoid(logit)
        grad = {}
        d_logit = ((p - labels) / len(labels)).astype(np.float32)
        grad["o"], grad["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["o"]
        d_w = (both * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a * a)
        grad["v"] = (a * d_e[:, :, None]).sum((0, 1))
        grad["A"] = np.einsum("tbh,tba->ha", both, d_a)
        d_both = w[:, :, None] * d_pooled + d_a @ self.p["A"].T
        gf = self._back(d_both[:, :, :HIDDEN], kf, self.p["Uf"], mask, "Uf", grad)
        gb = self._back(d_both[:, :, HIDDEN:], kb, self.p["Ub"], mask, "Ub", grad)
        per_word = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(per_word, where.reshape(-1), np.concatenate([gf, gb], axis=2).reshape(-1, 6 * HIDDEN))
        f, b = per_word[:, : 3 * HIDDEN], per_word[:, 3 * HIDDEN :]
        grad["Wf"], grad["bf"], grad["Wb"], grad["bb"] = x.T @ f, f.sum(0), x.T @ b, b.sum(0)
        d_x = f @ self.p["Wf"].T + b @ self.p["Wb"].T
        d_x[lost] = 0
        d_word, d_char = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(d_word, rows[safe], d_x[:, :WORD_DIM])
        at = np.take_along_axis(grams[safe], best, axis=1)
        np.add.at(d_char, (np.maximum(at, 0), np.arange(CHAR_DIM)[None, :]), np.where(at >= 0, d_x[:, WORD_DIM:], 0))
        grad["word"], grad["char"] = d_word * own[0][:, None], d_char * own[1][:, None]
        self._t += 1
        for k, d in grad.items():
            m, s = self._m[k]
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            if k in ("word", "char"):
                self.p[k][:, 1:] *= FADE
            self.p[k] -= rate * (VECTOR_RATE if k in ("word", "char") else 1) * (m / (1 - 0.9**self._t)) / (np.sqrt(s / (1 - 0.999**self._t)) + 1e-8)
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return float(-(labels * np.log(q) + (1 - labels) * np.log(1 - q)).mean())

    def logits(self, ids, table, batch: int = 1024):
        """Logits of windows ids (n, steps) by the table of gate inputs; row 0 stands for no word.

        The same sums as forward(), in place: a step's gates are fetched when they are due, and both directions use the
        same buffers, which stay in the cache.
        """
        import numpy as np

        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), batch):
            own = np.ascontiguousarray(ids[i : i + batch].T) + 1
            held = own > 0
            held[0] |= ~held.any(0)
            full = held.all(axis=1)
            steps, n = own.shape
            both = np.empty((steps, n, 2 * HIDDEN), np.float32)
            g, hu, cell = np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
            for side, u in enumerate((self.p["Uf"], self.p["Ub"])):
                lanes = table[side]
                h = np.zeros((n, HIDDEN), np.float32)
                for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                    np.take(lanes, own[t], axis=0, out=g, mode="clip")
                    np.matmul(h, u, out=hu)
                    rz = g[:, : 2 * HIDDEN]
                    rz += hu[:, : 2 * HIDDEN]
                    np.negative(rz, out=rz)
                    np.minimum(rz, 60.0, out=rz)
                    np.exp(rz, out=rz)
                    rz += 1
                    np.reciprocal(rz, out=rz)
                    np.multiply(rz[:, :HIDDEN], hu[:, 2 * HIDDEN :], out=cell)
                    cell += g[:, 2 * HIDDEN :]
                    np.tanh(cell, out=cell)
                    if not full[t]:
                        before = h.copy()
                    h -= cell
                    h *= rz[:, HIDDEN:]
                    h += cell
                    if not full[t]:
                        h = np.where(held[t][:, None], h, before)
                    both[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
            a = both.reshape(-1, 2 * HIDDEN) @ self.p["A"]
            np.tanh(a, out=a)
            e = np.where(held, (a @ self.p["v"]).reshape(steps, n), np.float32(-1e9))
            e -= e.max(0)
            np.exp(e, out=e)
            e /= e.sum(0)
            out[i : i + batch] = (e * (both.reshape(-1, 2 * HIDDEN) @ self.p["o"]).reshape(steps, n)).sum(0) + self.p["c"][0]
        return out

    def document(self, best, n_windows):
        import numpy as np

        a, b, c = self.level
        return _sigmoid(a * np.asarray(best, dtype=np.float64) + b * np.log(n_windows) + c)

    def frozen(self) -> dict:
        return {"p": self.p, "level": self.level}


def singled_out(seen, n_pos, n_neg):
    """0 to 1 for rows by their documents per class, seen (2, rows): how far the label-1 share exceeds chance.

    The log-likelihood ratio against the base rate, less the logarithm of the number of rows that are tried.
    """
    import numpy as np

    clean, toxic = seen
    both, base = np.maximum(toxic + clean, 1), n_pos / (n_pos + n_neg)
    gain = toxic * np.log(np.maximum(toxic / both, 1e-12) / base) + clean * np.log(np.maximum(clean / both, 1e-12) / (1 - base))
    tried = max(2, int((toxic + clean >= LEAST_DOCS).sum()))
    return np.where(toxic / both > base, np.clip((gain - np.log(tried)) / 5, 0, 1), 0)


def train(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> dict:
    """Parameters learned from labelled texts. The same texts in the same order give the same parameters."""
    import numpy as np

    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0:
        return net.frozen()
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(bare(w), len(number)) for w in split(t)), np.int32) for t in texts]
    rows, grams = parts(list(number) or [""])
    number.clear()
    n_pos, n_neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    own, strength = [], []
    for size, of in ((WORD_ROWS, rows[:, None]), (CHAR_ROWS, grams)):
        seen = np.zeros((2, size))
        for ids, label in zip(docs, y):
            there = np.unique(of[np.unique(ids)])
            seen[int(label), there[there >= 0]] += 1
        own.append((seen.sum(0) >= LEAST_DOCS).astype(np.float32))
        strength.append(singled_out(seen, n_pos, n_neg) * own[-1])
    net.p["word"][:, 0], net.p["char"][:, 0] = strength
    strength = [x.astype(np.float32) for x in strength]
    hints = np.maximum(strength[0][rows], np.where(grams >= 0, strength[1][grams], np.float32(0)).max(1))
    framed = [windows(ids) for ids in docs]
    first = np.cumsum([0, *[len(p) for p in framed]])
    all_ = np.concatenate(framed)
    hint = np.where(all_ >= 0, hints[np.maximum(all_, 0)], np.float32(0)).sum(axis=1)
    weight = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    take = min(3000, 4 * len(y))
    for turn in range(rounds):
        if turn:
            hint = net.logits(all_, net.table(rows, grams))
        best = np.array([first[k] + int(np.argmax(hint[first[k] : first[k + 1]])) for k in range(len(y))])
        for _ in range(2):
            chosen = rng.choice(len(y), size=take, p=weight / weight.sum())
            # Of clean documents any window is clean: half of those drawn are the hardest, half are random.
            pick = np.where((y[chosen] == 0) & (rng.random(take) < 0.5), first[chosen] + (rng.random(take) * (first[chosen + 1] - first[chosen])).astype(int), best[chosen])
            for i in range(0, take, 64):
                net.learn(all_[pick[i : i + 64]], y[chosen[i : i + 64]], rows, grams, 0.01 if turn < rounds - 2 else 0.003, own, rng)
    logit = net.logits(all_, net.table(rows, grams))
    top = np.array([logit[first[k] : first[k + 1]].max() for k in range(len(y))], dtype=np.float64)
    x = np.stack([top, np.log(np.diff(first)), np.ones(len(y))], axis=1)
    level = np.array([1.0, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a logistic regression held near the network's own scale
        p = _sigmoid(x @ level)
        pull = np.array([0.05, 0.05, 0.001])
        g = x.T @ (p - y) + pull * (level - [1.0, 0.0, 0.0]) * len(y)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull * len(y)) + 1e-6 * np.eye(3), g)
        level = level - np.clip(step, -1, 1)
    net.level = tuple(float(v) for v in level)
    return net.frozen()


class _Table(dict):
    """Words' numbers, and the table of the distinct words' gate inputs, for a bounded number of words at a time."""

    def __init__(self, net: Network):
        import numpy as np

        self.net, self.room = net, np.empty((2, WORD_CACHE + 1, 3 * HIDDEN), np.float32)
        self.known: dict[str, int] = {}
        self.fresh: list[str] = []
        net.fill(self.room, 0, np.zeros(1, np.int32), np.full((1, PIECES), -1, np.int32))

    def __missing__(self, word: bytes | str) -> int:
        text = bare(word)
        k = self.known.get(text)
        if k is None:
            k = self.known[text] = len(self.known)
            self.fresh.append(text)
        self[word] = k
        return k

    def ready(self):
        """The table, with the words met since the last call."""
        import numpy as np

        done = len(self.known) - len(self.fresh)
        if len(self.known) >= self.room.shape[1]:
            self.room = np.concatenate([self.room[:, : done + 1], np.empty((2, len(self.fresh), 3 * HIDDEN), np.float32)], axis=1)
        for i in range(0, len(self.fresh), 4096):
            self.net.fill(self.room, done + 1 + i, *parts(self.fresh[i : i + 4096]))
        self.fresh = []
        return self.room

    def renew(self):
        if len(self.known) > WORD_CACHE or len(self) > 2 * WORD_CACHE:
            self.clear()
            self.__init__(self.net)


def _scorer(frozen: dict):
    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        net = Network()
        net.p, net.level = frozen["p"], frozen["level"]
        known = _Table(net)
        for batch in batches:
            parts, scores, held = [], [], 0
            for t in utf8(batch.column(1)):
                words = split(t)
                parts.append(windows(np.fromiter(map(known.__getitem__, words), np.int32, count=len(words))))
                held += len(parts[-1])
                if held >= 2048:
                    scores += _of_parts(net, known, parts)
                    parts, held = [], 0
                    known.renew()
            scores += _of_parts(net, known, parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return score


def _of_parts(net: Network, known: _Table, parts: list) -> list[float]:
    import numpy as np

    if not parts:
        return []
    first = np.cumsum([0, *[len(p) for p in parts]])
    logit = net.logits(np.concatenate(parts), known.ready())
    return net.document(np.maximum.reduceat(logit, first[:-1]), np.diff(first)).tolist()


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: tuple[int, int], most_bytes: int = MOST_BYTES) -> tuple[list, list]:
    """At most most[0] toxic and most[1] clean labelled texts of at most most_bytes in all, chosen by a hash of the id.

    Ids held out are left out. An id has one text, the least of its rows, so repeated rows add nothing. Texts are taken
    whole, toxic and clean ones by turns, as long as they fit; one of more than MOST_OF_ONE bytes, or a quarter of
    most_bytes, is not trained on and counts for nothing, so no text takes the room of others.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    some = known.where("__label = 1").orderBy(*order).limit(most[0]).unionByName(known.where("__label = 0").orderBy(*order).limit(most[1]))
    some = written(some, "toxic-sample")  # at most sum(most) narrow rows
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("__id"))
    texts = written(texts.groupBy("id").agg(F.first("__label").alias("label"), F.min("text").alias("text")), "toxic-texts")
    # Both windows order at most sum(most) rows of lengths.
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    lengths = texts.select("id", "label", F.octet_length("text").cast("long").alias("n")).where(F.col("n") <= min(MOST_OF_ONE, most_bytes // 4)).withColumn("turn", turn)
    spent = F.sum("n").over(Window.orderBy("turn", F.desc("label"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fit = written(lengths.withColumn("spent", spent).where(F.col("spent") <= most_bytes).select(F.col("id").alias("__id")), "toxic-fit")
    rows = texts.join(F.broadcast(fit), F.col("id") == F.col("__id")).select("id", "label", "text")
    found = sorted(rows.collect(), key=lambda r: r["id"])  # at most sum(most) rows and most_bytes bytes of text
    return [r["text"] for r in found], [int(r["label"]) for r in found]


def held_out(id_):
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (MOST_TOXIC, MOST_CLEAN), threshold: float = 0.7, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as texts without words. Null ids are not held out, nor are they trained on; null
    labels are ignored, and an id labelled twice counts as toxic if either label says so. Without labels every score
    comes from an untrained network. Repeated rows get equal scores; an empty table gives an empty result.
    """
    frozen = train(*sample(docs, labels, id_col, text_col, label_col, most, most_bytes))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = written(rows.mapInArrow(_scorer(frozen), f"id {rows.schema['id'].dataType.simpleString()}, score double"), "toxic-scores")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
