"""Windows of fixed length that recur: what substring dedup by hashing and by suffix sorting share.

Shipping a hash for every window would move many times the text. Each window has an anchor: the k-gram
in it with the least hash, the first of equals. Equal windows have equal anchors at the same place in
them, so a window whose anchor occurs once in the corpus is unique and needn't be moved. All windows of
one anchor occurrence form its context, one row: (anchor, hash of the context, document, place).
Contexts that recur whole are settled by counting rows. Only where an anchor stands in differing contexts
are windows looked at one by one, in one document of each context.

Documents are told apart by doc_id and a hash of the text, so rows that share a doc_id don't mix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._tables import hot_counts, pick, spread_join
from brindle.llm._text import U, mix, pieces, prefix, rolling, signed, sliding_min, span_hashes
from brindle.session import stored

#: Bits of a window's key that hold the place of its anchor, so a piece has fewer symbols than 2**BITS.
BITS = 28
#: Longer texts are gone through in parts of so many windows.
PART = 1 << 22


def anchors(sym: np.ndarray, pre: np.ndarray, end: np.ndarray, length: int, k: int):
    """Contexts of a piece: anchor and context hashes, first window's start, offset of the anchor, symbols.

    ``end``: for each symbol where its document ends."""
    n = len(sym)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U), none.astype(U), none, none, none
    g = rolling(pre, k)
    key = (g >> U(BITS) << U(BITS)) | np.arange(len(g), dtype=U)
    p = (sliding_min(key, length - k + 1) & U((1 << BITS) - 1)).astype(np.int64)
    s = np.flatnonzero(np.arange(length, n + 1) <= end[: n - length + 1])
    if not len(s):
        return none.astype(U), none.astype(U), none, none, none
    p = p[s]
    fresh = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    a = s[fresh]
    z = s[np.append(fresh[1:], len(s)) - 1] + length
    at = p[fresh]
    ctx = mix(span_hashes(pre, a, z) + mix(((at - a) * (1 << 20) + z - a).astype(U)))
    return g[at], ctx, a, at - a, z - a


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text."""
    return pick(docs, doc_id="bigint", text="string").withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")


def contexts(docs: DataFrame, symbols, length: int, k: int, size: int) -> DataFrame:
    """anchor, ctx, doc_id, h, place of every context; ``symbols(column)`` gives symbols and each row's start in them.

    place packs start (from bit 24), offset of the anchor (12 bits) and length (12 bits)."""

    def run(batches):
        for b in pieces(batches, "text", size):
            sym, first = symbols(b.column(2))
            n = np.diff(first)
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            for x in range(0, max(len(sym), 1), PART):
                # parts overlap by a window less one symbol, so each window is in one of them
                y = sym[x : x + PART + length - 1]
                g, c, a, off, m = anchors(y, prefix(y), first[1:][row[x : x + len(y)]] - x, length, k)
                if not len(a):
                    continue
                a = a + x
                r = row[a]
                i = pa.array(r)
                place = (a - first[r]) << 24 | off << 12 | m
                yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(signed(c)), b.column(0).take(i), b.column(1).take(i), pa.array(place)], ["anchor", "ctx", "doc_id", "h", "place"])

    if 2 * length >= 1 << 12:
        raise ValueError("the window is too long")
    return docs.mapInArrow(run, "anchor long, ctx long, doc_id long, h long, place long")


def per_document(rows: DataFrame, *cols: str) -> DataFrame:
    """doc_id, h and a list of the different values of the other columns: as long at most as the document."""
    return rows.groupBy("doc_id", "h").agg(F.collect_set(F.struct(*cols)).alias("list"))


def where_again(t: DataFrame, again: DataFrame) -> DataFrame:
    """Contexts whose anchor is in ``again`` (anchor, n, several), with its columns; those of a hot anchor are spread."""
    again = stored(again)
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = hot_counts(again.select("anchor", F.col("n").alias("_n")), ["anchor"], total)
    return stored(spread_join(t, again.drop("n"), ["anchor"], hot, F.struct("h", "place")))


def beside(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """doc_id, h, text, list by document."""
    j = docs.join(lists.toDF("_d", "_h", "list"), docs["doc_id"].eqNullSafe(F.col("_d")) & docs["h"].eqNullSafe(F.col("_h")), how)
    return j.select("doc_id", "h", "text", "list")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal intervals that half-open intervals cover; touching ones are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return a[fresh], z[np.append(fresh[1:], len(a)) - 1]
