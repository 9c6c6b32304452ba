"""Mixing sources to target weights by systematic sampling.

Each source's target is its weighted share of all words, at most ``cap`` times its own words; what is
cut goes to the others by weight. A document's expected copies are target / words of its source. Within
a source, largest documents first, these are prefix-summed; one offset in (0, 1) is added, and a copy is
emitted for each integer that the running sum crosses. Neighbours are alike in size, so the words taken
come within about one document of the target.

A source may hold most rows: places are found by counting (source, size) cells first, and a cell of more
than ``CELL`` rows is split by a hash of the doc_id, so no task ranks more than about that many rows. Rows that
repeat one doc_id too often for that (in a hot cell, more than a 1024th of all rows) come last in their cell, and are
split by where they stand in the input.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source
without words has target 0 and nothing taken; an empty table gives no rows; of repeated rows each is
counted and sampled as a document; a null doc_id is passed on; texts of any length are counted whole; other columns
are left behind. ``emitted`` keeps them all, but a column copy_no, which it replaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._tables import hot_keys, pick
from brindle.llm._text import TOKEN, pieces, strings, words
from brindle.session import stored

WEIGHTS = (1, 2, 3)
CAP = 3
CELL = 100_000


def _count(col: pa.Array) -> pa.Array:
    parts = [np.zeros(0, np.int64)]
    for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
        buf, offs = strings(b.column(0))
        parts.append(np.bincount(words(buf, offs, TOKEN)[2], minlength=b.num_rows))
    return pa.array(np.concatenate(parts).astype(np.int64))


def word_count(text) -> Column:
    """How many words, separated by ASCII white space, a text has."""
    return F.arrow_udf(_count, "long")(text)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size): one row a source, weights by code point order."""
    one = lambda *o: Window.partitionBy(F.lit(0)).orderBy(*o)
    all_ = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(one(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap)).withColumn("r", F.col("most") / F.col("w"))
    before = one("r", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("k", F.row_number().over(one("r", F.asc_nulls_last("source"))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("k", "level"))).over(all_)["level"])
    return s.select("source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def offset(source, seed: str):
    """The source's random offset, strictly between 0 and 1."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))))
    return (F.conv(F.substring(h, 1, 4), 16, 10).cast("double") + F.lit(0.5)) / F.lit(65536.0)


def sampled(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = "mix", cell: int = CELL) -> DataFrame:
    """``rows`` (with doc_id, source, size, tie) and source_size, target, copies of each."""
    slim = rows.select("doc_id", "source", "size", "tie")
    counts = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    t = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    most = counts.agg(F.max("n")).first()[0] or 0
    digits = 0
    while most > cell * 16**digits:
        digits += 1
    part = F.substring("tie", 1, digits) if digits else F.lit("")
    count = lambda x: x.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = count(slim.withColumn("part", part))
    hot = None
    if most > 4 * cell and (cells.agg(F.max("n")).first()[0] or 0) > 4 * cell:
        hot = hot_keys(slim, ["tie"], many=cell)
    if hot is not None:
        # g comes after all hexadecimal digits
        part = F.when(F.col("_hot"), F.concat(F.lit("g"), "tie", F.format_string("%03d", "spot"))).otherwise(part)
        spot = F.pmod(F.xxhash64(F.shiftright(F.monotonically_increasing_id(), 12)), F.lit(1000))
        rows = rows.withColumn("spot", spot).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "tie", "left")  # fewer than PARTS rows
        cells = count(rows.withColumn("part", part).select("source", "size", "part"))
    w = Window.partitionBy("source").orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)))
    info = cells.join(t, cells["source"].eqNullSafe(t["source"])).select(cells["source"].alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), "ahead", "source_size", "target")
    r = rows.withColumn("part", part)
    r = r.join(info, r["source"].eqNullSafe(F.col("_s")) & (r["size"] == F.col("_z")) & (r["part"] == F.col("_p")))
    r = r.withColumn("place", F.col("ahead") + F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("tie", "doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("place") * rate + u) - F.floor((F.col("place") - 1) * rate + u)
    return r.withColumn("copies", F.least(copies, F.lit(cap)).cast("long")).drop("_s", "_z", "_p", "part", "place", "ahead", "spot", "_hot")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken (words times copies) of every row."""
    d = pick(docs, doc_id="bigint", source="string", text="string").withColumn("size", word_count("text"))
    d = stored(d.select("doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie")))
    s = sampled(d, weights, cap, seed)
    return s.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies, with ``copy_no`` from 1."""
    cols = [c for c in docs.columns if c.lower() != "copy_no"]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *[F.col(f"`{c}`").cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("source", "string"), ("text", "string"))])
    d = d.withColumn("size", word_count("text")).withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).drop("text")
    s = sampled(d, weights, cap, seed).where(F.col("copies") > 0)
    return s.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no")).select("_row.*", "copy_no")


def oracle(weights: tuple = WEIGHTS, cap: int = CAP, seed: str = "mix") -> str:
    """The same rows in DuckDB."""
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::double source_size, list_extract([{", ".join(f"{x}.0" for x in weights)}]::double[], ((row_number() over (order by source nulls last) - 1) % {len(weights)} + 1)::bigint) w from d group by source),
r as (select *, source_size * {cap}.0::double most, source_size * {cap}.0::double / w r from s),
l as (select *, (sum(source_size) over () - coalesce(sum(most) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) level from r window b as (order by r, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(most, w * (select first(level order by r, source nulls last) from l where level <= r)) target from l),
p as (select d.doc_id, d.size, t.source_size::bigint source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end rate,
  (('0x' || substr(md5('{seed}:' || coalesce(d.source, '')), 1, 4))::bigint + 0.5)::double / 65536.0::double u,
  (row_number() over (partition by d.source order by d.size desc, md5(coalesce(d.doc_id::varchar, '')), d.doc_id))::double place from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target::double target, size * least(floor(place * rate + u) - floor((place - 1) * rate + u), {cap})::bigint taken from p"""
