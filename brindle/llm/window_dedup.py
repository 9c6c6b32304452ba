"""Substring dedup by Rabin-Karp hashes of every fixed-length window of words.

A word goes if some window of ``LENGTH`` words that covers it starts in a document with a smaller doc_id
too. Window hashes are counted in Spark (see repeats.py for what has to move), with the least doc_id of
each; windows found earlier merge into maximal removal intervals. A window is told by its 64-bit
polynomial hash together with the 64-bit hash of its anchor.

Defined results: null texts have no words; windows never leave a document; a document shorter than a
window keeps all; a null doc_id counts as larger than all others; rows with the same doc_id are one place
(neither is smaller), and each is answered; the hash of nothing kept is that of the empty string; texts of any length
are read whole; an empty table gives no rows; other columns are left behind."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import repeats
from brindle.llm._tables import hot_counts, spread_join
from brindle.llm._text import TOKEN, pieces, prefix, signed, span_hashes, strings, word_hashes, words
from brindle.llm._text import U, mix
from brindle.session import stored

LENGTH = 50
GRAM = 8
LAST = (1 << 63) - 1


def _symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = strings(col)
    a, z, row = words(buf, offs, TOKEN)
    return word_hashes(buf, a, z), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offs) - 1))])


def _windows(length: int):
    """For each listed context its windows: anchor, hash, document, start."""

    def run(batches):
        for b in pieces(batches, "text"):
            sym, first = _symbols(b.column(2))
            pre = prefix(sym)
            col = b.column(3)
            n = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            r = np.repeat(np.arange(len(n)), n)
            place = flat.field(flat.type.get_field_index("place")).to_numpy()
            many = (place & 4095) - length + 1
            r = np.repeat(r, many)
            s = np.repeat(place >> 24, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = first[r] + s
            w = mix(span_hashes(pre, at, at + length) ^ U(0x9FB21C651E98DF25))
            anchor = np.repeat(flat.field(flat.type.get_field_index("anchor")).to_numpy(), many)
            i = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(signed(w)), b.column(0).take(i), b.column(1).take(i), pa.array(s)], ["anchor", "w", "doc_id", "h", "s"])

    return run


def _kept(with_text: bool):
    """Counts and hash of what is left, and the text itself if wanted."""

    def run(batches):
        for b in pieces(batches, "text"):
            texts, lists = b.column(2), b.column(3).to_pylist()
            buf, offs = strings(texts)
            out = []
            for r in range(b.num_rows):
                w = buf[offs[r] : offs[r + 1]].tobytes().split()
                gone, n = 0, len(w)
                if lists[r]:
                    a, z = repeats.merged(np.array([x["a"] for x in lists[r]]), np.array([x["z"] for x in lists[r]]))
                    gone = int((z - a).sum())
                    keep, at = [], 0
                    for x, y in zip(a.tolist(), z.tolist()):
                        keep += w[at:x]
                        at = y
                    w = keep + w[at:]
                raw = b" ".join(w)
                out.append((n, gone, hashlib.sha256(raw).hexdigest()) + ((raw.decode("utf-8", "replace"),) if with_text else ()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + with_text]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return run


def intervals(d: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, h, a, z: word intervals to remove from the documents of ``repeats.documents``."""
    t = repeats.contexts(d, _symbols, length, gram, 1 << 19)
    o = F.coalesce("doc_id", F.lit(LAST))
    again = t.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("least"), F.max(o).alias("most"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("least < most")
    s = repeats.where_again(t, again.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("several")))
    first = s.groupBy("anchor", "ctx").agg(F.min(o).alias("first"), F.count(F.lit(1)).alias("_n"))
    hot = hot_counts(first.select("anchor", "ctx", "_n"), ["anchor", "ctx"], s.count())
    s = stored(spread_join(s, first.drop("_n"), ["anchor", "ctx"], hot, F.struct("h", "place")).withColumn("later", o > F.col("first")).drop("first"))
    whole = s.where("later").select("doc_id", "h", F.shiftright("place", 24).alias("a"), (F.shiftright("place", 24) + F.col("place").bitwiseAND(4095)).alias("z"))
    lone = repeats.per_document(s.where("several and not later"), "anchor", "place")
    w = stored(repeats.beside(d, lone, "inner").mapInArrow(_windows(length), "anchor long, w long, doc_id long, h long, s long"))
    found = stored(w.groupBy("anchor", "w").agg(F.min(o).alias("least"), F.max(o).alias("most"), F.count(F.lit(1)).alias("_n")).where("least < most"))
    hot = hot_counts(found.select("anchor", "w", "_n"), ["anchor", "w"], w.count())
    part = spread_join(w, found.select("anchor", "w", "least"), ["anchor", "w"], hot, F.struct("h", "s")).where(o > F.col("least")).select("doc_id", "h", F.col("s").alias("a"), (F.col("s") + length).alias("z"))
    return whole.unionByName(part)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by spaces) of every row."""
    d = repeats.documents(docs)
    gone = repeats.per_document(intervals(d, length, gram), "a", "z")
    return repeats.beside(d, gone, "left").mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def oracle(length: int = LENGTH) -> str:
    """The same rows in DuckDB."""
    return f"""
with a as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
b as (select doc_id, unnest(range(1, len(w) - {length - 2})) i, w from a where len(w) >= {length}),
c as (select doc_id, i, md5(array_to_string(w[i:i + {length - 1}], ' ')) x from b),
m as (select x, min(doc_id) least from c group by x having min(doc_id) < max(doc_id)),
g as (select doc_id, list(distinct i + o) p from (select c.doc_id, c.i, unnest(range(0, {length})) o from c join m on m.x = c.x and c.doc_id > m.least) group by doc_id),
k as (select a.doc_id, w, coalesce(p, []) p from a left join g on g.doc_id = a.doc_id),
r as (select doc_id, w, p, list_sort(list_filter(range(1, len(w) + 1), lambda i: not list_contains(p, i))) q from k)
select doc_id, len(w)::bigint n_words, len(p)::bigint n_removed, sha256(array_to_string(list_transform(q, lambda i: w[i]), ' ')) kept_sha256 from r"""
