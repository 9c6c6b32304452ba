"""Reading tables so that odd columns do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import ready, stored


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, cast; columns of other names, whatever they are called, are left behind.

    ``pick(docs, doc_id="bigint", text="string")``"""
    ready(df.sparkSession)
    return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in cols.items()])


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the number as text, modulo m; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


#: A key is hot if more than one in so many of the rows have it, and more than ``MANY``; so there are fewer hot keys than this.
PARTS = 1024
MANY = 1 << 16


def hot_keys(rows: DataFrame, keys: list[str], parts: int = PARTS, many: int = MANY) -> DataFrame | None:
    """The keys that more than a ``parts``-th of all rows have: fewer than ``parts`` rows, which may be broadcast. None if there are none."""
    total = rows.count()
    return hot_counts(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, total, parts, many) if total > many else None


def hot_counts(counts: DataFrame, keys: list[str], total: int, parts: int = PARTS, many: int = MANY) -> DataFrame | None:
    """The same from counts (keys, _n) of keys that are there already, and how many rows there are."""
    if total <= many:
        return None
    hot = stored(counts.where(F.col("_n") > max(total / parts, many)).select(*keys), 1)
    return hot if hot.head(1) else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: str | Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """``many`` joined with ``one``, which has a row a key or few; rows of hot keys are spread over ``salts`` tasks by a hash of ``by``."""
    if hot is None:
        return many.join(one, keys, how)
    h = F.broadcast(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot")))  # fewer than PARTS rows

    def flagged(df: DataFrame) -> DataFrame:
        on = None
        for i, k in enumerate(keys):
            c = df[k].eqNullSafe(h[f"_h{i}"])
            on = c if on is None else on & c
        return df.join(h, on, "left")

    a = flagged(many).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)).select(*many.columns, "_salt")
    b = flagged(one).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).select(*one.columns, "_salt")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
