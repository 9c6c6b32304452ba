"""Substring dedup by a hash-compared suffix sort.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere else too, in the same
document or another. Which contexts have to be compared is found as in repeats.py. Those of an anchor are
brought together, and their suffixes from the anchor on are sorted by mergesort: two are compared by their
common extension, which a binary search over prefix polynomial hashes finds in a logarithmic number of
steps. Going outward from a context in that order, the least extension passed is what it shares to the
right; what it shares to the left is searched the same way. Every stretch found by sorting is verified on the bytes,
and a group in which a hash collided is compared by bytes alone.

Two kinds of match aren't sorted, but told by 128 bits of hash in Spark: contexts that recur whole (most of what exact
copies share), and the windows of an anchor in more than ``HOT`` differing contexts, which is not brought to one task.
Contexts are compared in hashed buckets of some thousands.

Defined results: a null text is empty; matches never cross documents; a repeated row is another document,
so both copies go; overlaps within one document count; the hash of nothing kept is that of the empty
string; a null doc_id is passed on; texts of any length are read whole; an empty table gives no rows; other columns
are left behind."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import repeats
from brindle.llm._tables import hot_counts, spread_join
from brindle.llm._text import _BYTE, U, mix, pieces, prefix, signed, span_hashes, strings
from brindle.session import stored

LENGTH = 200
GRAM = 32
HOT = 1000
BUCKET = 3000


def _symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = strings(col)
    return _BYTE[buf], offs


def extension(pre: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols, at most ``most``, follow (or precede) x and y alike, by binary search over hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
    live = np.flatnonzero(hi > 0)
    first = True
    while len(live):
        # the whole is tried first: many extensions are as long as can be
        m = hi[live] if first else (lo[live] + hi[live] + 1) // 2
        first = False
        a, b = x[live], y[live]
        if back:
            eq = span_hashes(pre, a - m, a) == span_hashes(pre, b - m, b)
        else:
            eq = span_hashes(pre, a, a + m) == span_hashes(pre, b, b + m)
        lo[live[eq]] = m[eq]
        hi[live[~eq]] = m[~eq] - 1
        live = live[lo[live] < hi[live]]
    return lo


def suffix_sort(buf: np.ndarray, pre: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes (start ``at``, length ``size``) by group, then bytes, a prefix first: a bottom-up mergesort.

    All merges of a level advance together: each suffix finds its place in the neighbouring run by binary
    search, comparing by extension."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(start, append=len(g))
    begin, n = np.repeat(start, count), np.repeat(count, count)
    i = np.arange(len(g)) - begin
    width = 1
    while width < count.max(initial=0):
        run = i // width
        right = run % 2 == 1
        other = np.where(right, run - 1, run + 1) * width
        todo = np.flatnonzero((n > width) & (other < n))
        lo, hi = np.zeros(len(todo), np.int64), np.minimum(n[todo] - other[todo], width)
        base, mine, rt = begin[todo] + other[todo], order[todo], right[todo]
        live = np.arange(len(todo))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            them, me = order[base[live] + mid], mine[live]
            short = np.minimum(size[me], size[them])
            e = extension(pre, at[me], at[them], short)
            end = e == short
            bx, by = buf[at[me] + np.where(end, 0, e)], buf[at[them] + np.where(end, 0, e)]
            before = np.where(end, np.where(size[me] == size[them], rt[live], size[them] < size[me]), by < bx)
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
            live = live[lo[live] < hi[live]]
        to = np.arange(len(g))
        to[todo] = begin[todo] + np.minimum(run[todo] * width, other[todo]) + i[todo] % width + lo
        new = np.empty_like(order)
        new[to] = order
        order = new
        width *= 2
    return order


def shared(buf: np.ndarray, begin: np.ndarray, off: np.ndarray, size: np.ndarray, group: np.ndarray, asks: np.ndarray, length: int):
    """Stretches of at least ``length`` bytes around the anchor that contexts of a group share.

    A context starts at ``begin``, has ``size`` bytes and its anchor at ``off``. The suffixes from the
    anchors on are sorted; how far a context and its d-th neighbour agree to the right is the least
    extension between them, to the left it is searched for. Each d is one pass over all contexts that can
    still share enough. Gives (context, left, right) for contexts that ``asks`` marks."""
    pre = prefix(_BYTE[buf])
    order = suffix_sort(buf, pre, begin + off, size - off, group)
    b, o, n, g, ask = begin[order], off[order], size[order], group[order], asks[order]
    at = b + o
    k = np.flatnonzero(g[:-1] == g[1:])
    lcp = np.zeros(len(g), np.int64)
    lcp[k] = extension(pre, at[k], at[k + 1], np.minimum(n - o, np.roll(n - o, -1))[k])
    k = np.flatnonzero((lcp > 0) & (lcp + o >= length))
    far, d = lcp[k], 1
    out, bad = [], []
    while len(k):
        j = k + d
        use = np.flatnonzero((far + np.minimum(o[k], o[j]) >= length) & (ask[k] | ask[j]))
        x, y, right = k[use], j[use], far[use]
        left = extension(pre, at[x], at[y], np.minimum(o[x], o[y]), back=True)
        ok = np.flatnonzero(left + right >= length)
        x, y, left, right = x[ok], y[ok], left[ok], right[ok]
        for c in range(0, len(x), 1 << 14):
            u, v, ll, w = x[c : c + (1 << 14)], y[c : c + (1 << 14)], left[c : c + (1 << 14)], (left + right)[c : c + (1 << 14)]
            step = np.arange(int(w.max()))
            inside = step[None, :] < w[:, None]
            p = np.where(inside, (at[u] - ll)[:, None] + step, 0)
            q = np.where(inside, (at[v] - ll)[:, None] + step, 0)
            bad.append(g[u[(buf[p] != buf[q]).any(1)]])
        for z in (x, y):
            w = ask[z]
            out.append((order[z[w]], left[w], right[w]))
        d += 1
        k = k[k + d < len(g)]
        far = np.minimum(far[: len(k)], lcp[k + d - 1])
        go = (far > 0) & (far + o[k] >= length)
        k, far = k[go], far[go]
    none = np.zeros(0, np.int64)
    i, left, right = (np.concatenate(x) for x in zip(*out)) if out else (none, none, none)
    wrong = np.unique(np.concatenate(bad)) if bad else none
    if len(wrong):
        keep = ~np.isin(group[i], wrong)
        more = [_plainly(buf, begin, off, size, np.flatnonzero(group == w), asks, length) for w in wrong]
        i, left, right = (np.concatenate([a[keep], *b_]) for a, b_ in zip((i, left, right), zip(*more)))
    return i, left, right


def _plainly(buf, begin, off, size, who, asks, length):
    """The same for one group in which hashes collided: bytes against bytes."""
    out = []
    at = {int(i): (buf[begin[i] : begin[i] + off[i]].tobytes()[::-1], buf[begin[i] + off[i] : begin[i] + size[i]].tobytes()) for i in who}

    def common(a: bytes, b: bytes) -> int:
        m = min(len(a), len(b))
        return next((t for t in range(m) if a[t] != b[t]), m)

    for i in who.tolist():
        for j in who.tolist():
            if i != j and asks[i]:
                ll, rr = common(at[i][0], at[j][0]), common(at[i][1], at[j][1])
                if ll + rr >= length:
                    out.append((i, ll, rr))
    cols = np.array(out, np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def _listed(b: pa.RecordBatch, *names: str):
    """The list column (fourth) flattened: each entry's row, and its fields."""
    col = b.column(3)
    n = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(len(n)), n), [flat.field(flat.type.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _bytes(batches):
    """For each listed context its bytes."""
    for b in pieces(batches, "text"):
        buf, offs = strings(b.column(2))
        r, (anchor, place, settled) = _listed(b, "anchor", "place", "settled")
        a = offs[r] + (place >> 24)
        m = place & 4095
        ends = np.cumsum(m)
        raw = buf[np.arange(ends[-1]) + np.repeat(a - (ends - m), m)] if len(m) else buf[:0]
        body = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        i = pa.array(r)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column(0).take(i), b.column(1).take(i), pa.array(place), pa.array(settled.astype(bool)), body], ["anchor", "doc_id", "h", "place", "settled", "body"])


def _sort(length: int):
    """In a bucket of contexts: the stretches that recur, of contexts not yet settled."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        buf, offs = strings(t["body"].chunk(0))
        place = t["place"].to_numpy()
        _, group = np.unique(t["anchor"].to_numpy(), return_inverse=True)
        off = place >> 12 & 4095
        i, left, right = shared(buf, offs[:-1], off, place & 4095, group, ~t["settled"].to_numpy(zero_copy_only=False), length)
        at = (place >> 24)[i] + off[i]
        # of a context's stretches with the same left end only the longest counts
        order = np.lexsort((-right, left, i))
        keep = order[np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(left[order]) != 0)])] if len(i) else order
        r = pa.array(i[keep])
        return pa.table([t["doc_id"].take(r), t["h"].take(r), pa.array((at - left)[keep]), pa.array((at + right)[keep])], names=["doc_id", "h", "a", "z"])

    return run


def _windows(length: int):
    """For each listed context its windows: anchor and place, two hashes, document, start, settled."""

    def run(batches):
        for b in pieces(batches, "text", 1 << 18):
            buf, offs = strings(b.column(2))
            pre, other = prefix(_BYTE[buf]), prefix(mix(_BYTE[buf] + U(1)))
            r, (anchor, place, settled) = _listed(b, "anchor", "place", "settled")
            many = (place & 4095) - length + 1
            e = np.repeat(np.arange(len(r)), many)
            s = np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)
            at = offs[r[e]] + (place[e] >> 24) + s
            w1 = mix(span_hashes(pre, at, at + length) ^ mix(anchor[e].astype(U) + (s - (place[e] >> 12 & 4095) + 4096).astype(U)))
            w2 = mix(span_hashes(other, at, at + length))
            i = pa.array(r[e])
            yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), b.column(0).take(i), b.column(1).take(i), pa.array((place[e] >> 24) + s), pa.array(settled[e].astype(bool))], ["w1", "w2", "doc_id", "h", "s", "settled"])

    return run


def _kept(with_text: bool):
    """Counts and hash of what is left, and the bytes themselves if wanted."""

    def run(batches):
        for b in pieces(batches, "text"):
            lists = b.column(3).to_pylist()
            buf, offs = strings(b.column(2))
            out = []
            for r in range(b.num_rows):
                raw = buf[offs[r] : offs[r + 1]].tobytes()
                n, a, z = len(raw), [], []
                if lists[r]:
                    a, z = (x.tolist() for x in repeats.merged(np.array([x["a"] for x in lists[r]]), np.array([x["z"] for x in lists[r]])))
                    parts, at = [], 0
                    for x, y in zip(a, z):
                        parts.append(raw[at:x])
                        at = y
                    raw = b"".join(parts) + raw[at:]
                out.append((n, n - len(raw), len(a), hashlib.sha256(raw).hexdigest()) + ((raw,) if with_text else ()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + with_text]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def intervals(d: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, h, a, z: byte intervals to remove from the documents of ``repeats.documents``."""
    t = repeats.contexts(d, _symbols, length, gram, 1 << 18)
    again = t.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
    s = repeats.where_again(t, again.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("several")))
    c = s.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(1 << 62))).alias("first"))
    often = hot_counts(c.select("anchor", "ctx", F.col("n").alias("_n")), ["anchor", "ctx"], s.count())
    s = spread_join(s, c, ["anchor", "ctx"], often, F.struct("h", "place"))
    s = stored(s.select("anchor", "ctx", "doc_id", "h", "place", "several", (F.col("n") > 1).alias("settled"), F.coalesce(F.coalesce("doc_id", F.lit(1 << 62)) == F.col("first"), F.lit(False)).alias("lead")))
    whole = s.where("settled").select("doc_id", "h", F.shiftright("place", 24).alias("a"), (F.shiftright("place", 24) + F.col("place").bitwiseAND(4095)).alias("z"))
    lead = s.where("several and lead")
    n = stored(lead.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("anchor").alias("_a")))
    many = lead.count()
    cold = lead.join(n, lead["anchor"] == n["_a"], "left_anti")
    schema = "anchor long, doc_id long, h long, place long, settled boolean, body binary"
    sub = repeats.beside(d, repeats.per_document(cold, "anchor", "place", "settled"), "inner").mapInArrow(_bytes, schema)
    part = sub.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-many // BUCKET)))).alias("bucket")).applyInArrow(_sort(length), "doc_id long, h long, a long, z long")
    out = whole.unionByName(part)
    if n.head(1):
        heat = repeats.per_document(lead.join(n, lead["anchor"] == n["_a"], "left_semi"), "anchor", "place", "settled")
        w = stored(repeats.beside(d, heat, "inner").mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, h long, s long, settled boolean"))
        found = w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        out = out.unionByName(w.join(found, ["w1", "w2"]).where("not settled").select("doc_id", "h", F.col("s").alias("a"), (F.col("s") + length).alias("z")))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row."""
    d = repeats.documents(docs)
    gone = repeats.per_document(intervals(d, length, gram, hot), "a", "z")
    return repeats.beside(d, gone, "left").mapInArrow(_kept(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
