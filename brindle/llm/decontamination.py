"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of digits, ASCII letters (case folded) and characters from U+0080; shingles are 3 words, weighted by
their bytes. An item's fingerprint is the 128-bit SimHash of its shingles. A text's windows have as many words as an
item (the whole text, if it is shorter). Left out are only windows that no item of their size can be as similar to as
``LEAST``, since what they hold of the whole benchmark's shingles weighs too little; all others are fingerprinted, and
the fingerprints looked up by 16 blocks of 8 bits: two within ``RADIUS`` bits agree in some block up to RADIUS // 16
bits, so none within the radius is missed. What is looked up and within the radius is a candidate; it counts if the
weighted Jaccard similarity of its shingle set and the window's is at least ``LEAST``, and of an item's windows in a
text the most similar is given.

Defined results: a null or empty text, and a null, empty or under three-word item, are in no result; of windows
equally similar the first is given; repeated rows and repeated items are each answered; a null doc_id or item_id is
passed on; texts of any length are searched whole, about ``WINDOWS`` windows at a time; other columns are left behind
(``clean`` keeps them all, whatever their names). No benchmark rows or no documents: no result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._tables import pick
from brindle.llm._text import ALNUM, U, mix, pieces, prefix, rolling, strings, word_hashes, words

K = 3
#: At a similarity of LEAST the fingerprints differ in 39 bits on average, with a deviation of about 6: this is the mean
#: and four deviations. (It is also the most that looks up blocks within 3 bits.)
RADIUS = 63
LEAST = 0.4
BLOCKS = 16
#: So many items are searched in one pass over the texts; a larger benchmark takes more passes.
ITEMS = 20_000
#: Windows that are fingerprinted together.
WINDOWS = 1 << 14


def _bits(h: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of 128 bits of each hash."""
    two = np.stack([mix(h ^ U(0xA0761D6478BD642F)), mix(h ^ U(0xE7037ED1A0B428DB))], 1)
    return np.unpackbits(two.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, 16 bytes each, of weighted sums of bits."""
    return np.packbits(sums > 0, axis=1)


def _fold(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The fingerprint of weighted shingles, a part at a time."""
    total = np.zeros(128, np.int64)
    for a in range(0, len(bits), WINDOWS):
        total += (bits[a : a + WINDOWS] * w[a : a + WINDOWS, None].astype(np.int32)).sum(0)
    return _pack(total[None])[0]


_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)
_NEAR = [np.flatnonzero(_POP[np.arange(256) ^ v] <= RADIUS // BLOCKS) for v in range(256)]


class Fingerprints:
    """Items of one size by their fingerprints: ``table[block, value]`` marks all whose block is within RADIUS // BLOCKS bits."""

    def __init__(self, who: np.ndarray, prints: np.ndarray, least: float):
        self.who, self.prints, self.least = who, prints, least
        self.table = np.zeros((BLOCKS, 256, len(who)), bool)
        for b in range(BLOCKS):
            for v in np.unique(prints[:, b]):
                self.table[b][np.ix_(_NEAR[v], np.flatnonzero(prints[:, b] == v))] = True

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of ``prints``, position in ``who``) within the radius."""
        out = [(np.zeros(0, np.int64),) * 2]
        step = max(1, (1 << 22) // len(self.who))
        for a in range(0, len(prints), step):
            p = prints[a : a + step]
            met = self.table[0][p[:, 0]]
            for b in range(1, BLOCKS):
                met |= self.table[b][p[:, b]]
            i, j = np.nonzero(met)
            close = _POP[p[i] ^ self.prints[j]].sum(1) <= RADIUS
            out.append((a + i[close], j[close]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _runs(which: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Ascending positions as ranges [a, z) that leave nothing out and are at most ``longest`` long; gaps of a few join."""
    if not len(which):
        return []
    cut = np.flatnonzero(np.diff(which) > 64) + 1
    out = []
    for a, z in zip(which[np.concatenate([[0], cut])].tolist(), which[np.append(cut, len(which)) - 1].tolist()):
        out += [(x, min(x + longest, z + 1)) for x in range(a, z + 1, longest)]
    return out


def _sums(n: int, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each of n windows the weight of what is in it; the i-th is in windows lo to hi - 1."""
    keep = np.flatnonzero(lo < hi)
    lo, hi, w = lo[keep], hi[keep], w[keep]
    d = np.bincount(lo, w, n + 1)[: n + 1] - np.bincount(hi, w, n + 1)[: n + 1]
    return np.rint(np.cumsum(d)[:n]).astype(np.int64)


class Items:
    """A benchmark, ready to be searched for."""

    def __init__(self, ids: list, texts: list):
        col = pa.array(texts, pa.string())
        buf, offs = strings(col)
        a, z, row = words(buf, offs, ALNUM)
        h = word_hashes(buf, a, z, lower=True)
        weight = (z - a).astype(np.int64)
        n = np.bincount(row, minlength=len(ids))
        first = np.concatenate([[0], np.cumsum(n)])
        self.ids, sizes, total = [], [], []
        prints, hashes, weights, owner = [], [], [], []
        for r in np.flatnonzero(n >= K):
            i, j = first[r], first[r + 1]
            s = rolling(prefix(h[i:j]), K)
            w = np.convolve(weight[i:j], np.ones(K, np.int64), "valid")
            u, at = np.unique(s, return_index=True)
            owner += [len(self.ids)] * len(u)
            hashes.append(u)
            weights.append(w[at])
            self.ids.append(ids[r])
            sizes.append(int(n[r]))
            total.append(int(w[at].sum()))
            prints.append(_fold(_bits(s), w)[None])
        none = [np.zeros(0, U)]
        order = np.argsort(np.concatenate(hashes or none), kind="stable")
        self.hashes = np.concatenate(hashes or none)[order]
        self.weights = np.concatenate(weights or [np.zeros(0, np.int64)])[order]
        self.owner = np.array(owner, np.int64)[order]
        self.sizes, self.total = np.array(sizes, np.int64), np.array(total, np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> U(44)).astype(np.int64)] = True
        self.by_size = {}
        for size in sorted(set(sizes)):
            who = np.flatnonzero(self.sizes == size)
            self.by_size[size] = Fingerprints(who, np.concatenate([prints[i] for i in who]), LEAST * self.total[who].min())

    def find(self, col: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of every item in every text."""
        if not self.ids:
            return []
        buf, offs = strings(col)
        a, z, row = words(buf, offs, ALNUM)
        if len(a) < K:
            return []
        s = rolling(prefix(word_hashes(buf, a, z, lower=True)), K)
        w = np.convolve((z - a).astype(np.int64), np.ones(K, np.int64), "valid")
        row = row.astype(np.int64)
        hit = np.flatnonzero(self.maybe[(s >> U(44)).astype(np.int64)] & (row[: len(s)] == row[K - 1 :]))
        hit = hit[np.searchsorted(self.hashes, s[hit]) < np.searchsorted(self.hashes, s[hit], "right")]
        # texts that hold too little of the benchmark for any item
        held = np.bincount(row[hit], w[hit], len(offs))
        dirty = np.flatnonzero(held >= LEAST * self.total.min())
        if not len(dirty):
            return []
        begin, end = np.searchsorted(row, dirty), np.searchsorted(row, dirty, "right")
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        held = np.concatenate([[0], np.cumsum(np.bincount(hit, w[hit], len(s)))])
        full: dict[int, np.ndarray] = {}
        for size, index in self.by_size.items():
            parts = [np.zeros(0, np.int64)]
            for b, e in zip(begin.tolist(), end.tolist()):
                if e - b >= size:
                    t = np.arange(b, e - size + 1)
                    parts.append(t[held[t + size - K + 1] - held[t] >= index.least])
                elif e - b >= K and held[e - K + 1] - held[b] >= index.least:
                    self._whole(index, s[b : e - K + 1], w[b : e - K + 1], int(row[b]), e - b, best)
            full[size] = np.concatenate(parts)
        longest = max(self.by_size) - K + 1
        for lo, hi in _runs(np.unique(np.concatenate(list(full.values()))), WINDOWS):
            self._range(lo, hi, s[lo : hi - 1 + longest], w[lo : hi - 1 + longest], row, full, best)
        start = dict(zip(dirty.tolist(), begin.tolist()))
        return [(r, i, at - start[r] if at >= 0 else 0, n, sim) for (r, i), (sim, at, n) in sorted(best.items())]

    def _found(self, s: np.ndarray, w: np.ndarray):
        """The benchmark's shingles in s: places, items, weights, and for every place the one before where the same stands (-1 if none)."""
        order = np.argsort(s, kind="stable")
        before = np.full(len(s), -1, np.int64)
        same = s[order[1:]] == s[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        lo, hi = np.searchsorted(self.hashes, s), np.searchsorted(self.hashes, s, "right")
        n = hi - lo
        place = np.repeat(np.arange(len(s)), n)
        which = np.repeat(lo, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[which]
        order = np.argsort(item, kind="stable")
        return place[order], item[order], self.weights[which[order]], before

    def _range(self, lo: int, hi: int, s: np.ndarray, w: np.ndarray, row: np.ndarray, full: dict, best: dict) -> None:
        """Windows that start at lo to hi - 1: fingerprints, lookup, exact similarities of what is found."""
        sums = np.zeros((len(s) + 1, 128), np.int32)
        np.cumsum(_bits(s) * w[:, None].astype(np.int32), 0, out=sums[1:])
        place, item, weight, before = self._found(s, w)
        first = np.searchsorted(item, np.arange(len(self.ids) + 1))
        for size, index in self.by_size.items():
            t = full[size]
            t = t[np.searchsorted(t, lo) : np.searchsorted(t, hi)] - lo
            if not len(t):
                continue
            m = size - K + 1
            at, which = index.near(_pack(sums[t + m] - sums[t]))
            if not len(at):
                continue
            n = len(s) - m + 1
            p = np.arange(len(s))
            all_ = _sums(n, np.maximum(before + 1, np.maximum(p - m + 1, 0)), np.minimum(p + 1, n), w)
            order = np.argsort(which, kind="stable")
            at, which = at[order], which[order]
            cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(which)).tolist()):
                i = int(index.who[which[x]])
                k = slice(first[i], first[i + 1])
                if k.start == k.stop:
                    continue
                q = place[k]
                both = _sums(n, np.maximum(before[q] + 1, np.maximum(q - m + 1, 0)), np.minimum(q + 1, n), weight[k])
                u = t[at[x:y]]
                sim = both[u] / (self.total[i] + all_[u] - both[u])
                for v, got in zip(u[sim >= LEAST].tolist(), sim[sim >= LEAST].tolist()):
                    key = (int(row[lo + v]), i)
                    old = best.get(key)
                    if old is None or got > old[0] or (got == old[0] and lo + v < old[1]):
                        best[key] = (got, lo + v, size)

    def _whole(self, index: Fingerprints, s: np.ndarray, w: np.ndarray, row: int, size: int, best: dict) -> None:
        """A text shorter than the items: its one window is all of it."""
        at, which = index.near(_fold(_bits(s), w)[None])
        place, item, weight, before = self._found(s, w)
        new = before[place] < 0
        both = np.rint(np.bincount(item[new], weight[new], len(self.ids))).astype(np.int64)
        all_ = int(w[before < 0].sum())
        for i in index.who[which].tolist():
            sim = both[i] / (self.total[i] + all_ - both[i])
            if sim >= LEAST:
                best[row, i] = (float(sim), -1, size)


def _benchmarks(benchmark: DataFrame, block: int) -> list[Items]:
    """The benchmark in blocks of about ``block`` items, each of which fits the driver and a task."""
    b = pick(benchmark, item_id="bigint", text="string").where(F.col("text").isNotNull())
    n = -(-b.count() // block)
    out = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect() if n > 1 else b.collect()
        out.append(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: one row for each item found in each text."""
    d = pick(docs, doc_id="bigint", text="string")
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    out = None
    for items in _benchmarks(benchmark, block):

        def run(batches, items=items):
            for b in pieces(batches, "text"):
                got = items.find(b.column(1))
                if got:
                    r, i, at, n, sim = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(sim, pa.float64())], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else d.sparkSession.createDataFrame([], schema)


def dirty(text: Column, items: Items) -> Column:
    """Whether a text holds any of the items."""

    @F.arrow_udf("boolean")
    def run(col: pa.Array) -> pa.Array:
        parts = [np.zeros(0, bool)]
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            hit = np.zeros(b.num_rows, bool)
            hit[[r for r, *_ in items.find(b.column(0))]] = True
            parts.append(hit)
        return pa.array(np.concatenate(parts))

    return run(text)


def clean(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found."""
    for items in _benchmarks(benchmark, block):
        docs = docs.where(~dirty(F.col("`text`").cast("string"), items))
    return docs
