"""Greedy sentence chunks, and the documents-to-chunks table function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = 500
_CUT = re.compile(r"(?<=[.!?])")


def split(text: str, target: int = TARGET) -> list[str]:
    """Paragraphs are cut after every . ! ? and the pieces packed up to about ``target`` characters.

    A piece longer than that is a chunk of its own; a paragraph's end flushes what holds at least 0.6 of
    the target."""
    out: list[str] = []
    buf = ""
    for par in filter(None, (p.strip() for p in text.split("\n\n"))):
        for piece in filter(None, _CUT.split(par)):
            if not buf:
                buf = piece.strip()
            elif len(buf) + len(piece) + 1 <= target:
                buf += " " + piece.strip()
            else:
                out.append(buf)
                buf = piece.strip()
        if len(buf) >= 0.6 * target:
            out.append(buf)
            buf = ""
    out.append(buf)
    return [c for c in (b.strip() for b in out) if c]


def pieces(text: Column, target: int = TARGET, chunker=split) -> Column:
    """The chunks of a text column, as an array; null text has none. ``chunker``: text to list of texts."""

    @F.arrow_udf("array<string>")
    def cut(col: pa.Array) -> pa.Array:
        return pa.array([chunker(t, target) if t else [] for t in col.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def native_pieces(text: Column, target: int = TARGET) -> Column:
    """The same as one fold of JVM expressions; slower, kept to check the other against."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    pars = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def cut(p):
        s = F.filter(F.split(p, r"(?<=[.!?])"), lambda x: x != "")
        return F.transform(s, lambda x, i: F.struct(x.alias("s"), (i == F.size(s) - 1).alias("last")))

    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fits = F.length(acc["buf"]) + F.length(x["s"]) + 1 <= target
        buf = F.when(acc["buf"] == "", strip(x["s"])).when(fits, F.concat(acc["buf"], F.lit(" "), strip(x["s"]))).otherwise(strip(x["s"]))
        out = F.when((acc["buf"] == "") | fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))
        flush = x["last"] & (F.length(buf) >= 0.6 * target)
        return F.struct(F.when(flush, F.lit("")).otherwise(buf).alias("buf"), F.when(flush, F.concat(out, F.array(buf))).otherwise(out).alias("out"))

    done = F.aggregate(F.flatten(F.transform(pars, cut)), start, step, lambda a: F.concat(a["out"], F.array(a["buf"])))
    return F.filter(F.transform(done, strip), lambda c: c != "")


def chunks(docs: DataFrame, source: str, text: str = "text", target: int = TARGET, native: bool = False, chunker=split, keep: tuple = ()) -> DataFrame:
    """source, ord, chunk_id (source#chunk-0000), text, sha256 of every chunk; ``keep`` names columns to carry."""
    arr = native_pieces(F.col(text), target) if native else pieces(F.col(text), target, chunker)
    d = docs.select(F.col(source).alias("source"), *[F.col(c) for c in keep], F.posexplode(arr).alias("ord", "text"))
    return d.select("source", "ord", F.concat(F.col("source").cast("string"), F.format_string("#chunk-%04d", "ord")).alias("chunk_id"), "text", F.sha2("text", 256).alias("sha256"), *keep)
