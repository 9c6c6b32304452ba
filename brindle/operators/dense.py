"""Top-k over vectors and codes, exact ranking with ties to the lower row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; k below 1 gives none and k beyond the table all. A partial top-k per task comes first."""
    return df.orderBy(*order).limit(max(0, k))


def ranked(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows with their rank; only those k are ever in the ranking window's one partition."""
    return top(df, order, k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def knn(df: DataFrame, query, k: int = 10, vec: str = "embedding", row: str = "row") -> DataFrame:
    """row, dense_sim (inner product), dense_dist (angular, ten-thousandths), dense_rank."""
    s = df.select(F.col(row).alias("row"), V.dot_literal(F.col(vec), query).alias("dense_sim")).withColumn("dense_dist", V.angular(F.col("dense_sim")))
    return ranked(s, [F.col("dense_dist"), F.col("row")], k, "dense_rank")


def hamming_scan(df: DataFrame, words, bits: int, code: str = "code", row: str = "row") -> DataFrame:
    """row, dense_dist, dense_sim (share of agreeing bits) of every code."""
    d = V.hamming_literal(F.col(code), words)
    return df.select(F.col(row).alias("row"), d.alias("dense_dist")).withColumn("dense_sim", 1 - F.col("dense_dist") / F.lit(float(bits)))


def hamming_top(df: DataFrame, words, bits: int, k: int = 10, code: str = "code", row: str = "row") -> DataFrame:
    return ranked(hamming_scan(df, words, bits, code, row), [F.col("dense_dist"), F.col("row")], k, "dense_rank")


def batch(scored: DataFrame, k: int, order: list[Column], by: str = "qid", name: str = "dense_rank") -> DataFrame:
    """The first k rows of each query; Spark limits each group before the shuffle and after it."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def in_blocks(rows: DataFrame, queries: DataFrame, fn, schema: str, block: int = 4096) -> DataFrame:
    """``fn(queries, rows)`` (Arrow tables) for every block of queries (qid) against every block of rows (row): all meet all,
    and no task holds more than about two blocks."""
    nb, qb = (max(1, -(-df.count() // block)) for df in (rows, queries))
    r = rows.withColumn("_v", F.pmod(F.xxhash64("row"), F.lit(nb)).cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = queries.withColumn("_u", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    return q.groupBy("_u", "_v").cogroup(r.groupBy("_u", "_v")).applyInArrow(fn, schema)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def products(rows: DataFrame, queries: DataFrame, k: int | None = None, by=None) -> DataFrame:
    """qid, row, sim: inner products of all rows (row, embedding) with all queries (qid, q), in double precision.

    With ``k`` only each block's k best by ``by(sim)`` (ascending; ties to the lower row), from which the k best overall
    are sure to come."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, qs = r["row"].to_numpy(), q["qid"].to_numpy()
        s = _matrix(q["q"]) @ _matrix(r["embedding"]).T if len(ids) and len(qs) else np.zeros((len(qs), len(ids)))
        if k is None or k >= len(ids):
            return pa.table({"qid": np.repeat(qs, len(ids)), "row": np.tile(ids, len(qs)), "sim": s.ravel()})
        key = by(s)
        top = np.array([np.lexsort((ids, x))[:k] for x in key], np.int64).reshape(len(qs), k)
        return pa.table({"qid": np.repeat(qs, k), "row": ids[top].ravel(), "sim": np.take_along_axis(s, top, 1).ravel()})

    return in_blocks(rows.select("row", "embedding"), queries.select("qid", "q"), run, "qid long, row long, sim double")


def _words(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _differing(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if codes.shape[1] != len(x):
        raise ValueError(f"codes of {codes.shape[1]} and {len(x)} words")
    return np.bitwise_count((codes ^ x).view(np.uint64)).sum(1, dtype=np.int64)


def distances(rows: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """qid, row, dist: differing bits of all rows' codes (row, code) with all queries' (qid, q).

    With ``k`` only each block's k nearest (ties to the lower row), from which the k nearest overall are sure to come."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, qs = r["row"].to_numpy(), q["qid"].to_numpy()
        if k is not None and k < len(ids):
            a, top, near = _words(r["code"]), np.zeros((len(qs), k), np.int64), np.zeros((len(qs), k), np.int64)
            order = np.argsort(ids, kind="stable")
            ids, a = ids[order], a[order]
            for i, x in enumerate(_words(q["q"])):
                d = _differing(a, x)
                few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                few = few[np.argsort(d[few], kind="stable")[:k]]
                top[i], near[i] = ids[few], d[few]
            return pa.table({"qid": np.repeat(qs, k), "row": top.ravel(), "dist": near.ravel()})
        d = np.zeros((len(qs), len(ids)), np.int64)
        if len(ids) and len(qs):
            a = _words(r["code"])
            for i, x in enumerate(_words(q["q"])):
                d[i] = _differing(a, x)
        return pa.table({"qid": np.repeat(qs, len(ids)), "row": np.tile(ids, len(qs)), "dist": d.ravel()})

    return in_blocks(rows.select("row", "code"), queries.select("qid", "q"), run, "qid long, row long, dist long")


def rank_correlations(rows: DataFrame, queries: DataFrame, digits: int = 9, block: int = 128) -> DataFrame:
    """qid, rho: for each query (qid, q, qcode) the correlation of all rows' ordinal ranks by inner product (rounded) and by
    differing bits of codes, ties to the lower row. Rows are row, embedding, code.

    A task takes a block of queries and all rows, of which it holds vectors and codes: all pairs are compared, and none
    is written."""
    qb = max(1, -(-queries.count() // block))
    u = F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")
    q = queries.select("qid", "q", "qcode").withColumn("_u", u)
    r = rows.select("row", "embedding", "code").withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and r.num_rows:
            order = np.argsort(r["row"].to_numpy(), kind="stable")
            x, codes, n = _words(r["embedding"])[order], _words(r["code"])[order], len(order)
            v, qcodes = _matrix(q["q"]), _words(q["qcode"])
            at, ranks, step = np.empty(n, np.int64), np.arange(n, dtype=np.int64), 1 << 16
            for i in range(0, len(v), 8):
                s = np.empty((len(v[i : i + 8]), n))
                for j in range(0, n, step):
                    s[:, j : j + step] = v[i : i + 8] @ x[j : j + step].astype(np.float64).T
                s *= 10.0**digits
                s = -np.sign(s) * np.floor(np.abs(s) + 0.5)  # halves away from zero, as in SQL
                for y, c in zip(s, qcodes[i : i + 8]):
                    d = _differing(codes, c)
                    a, b = np.argsort(y, kind="stable"), np.argsort(d.astype(np.int16) if 64 * codes.shape[1] < 1 << 15 else d, kind="stable")
                    at[a] = ranks
                    gap = (at[b] - ranks).astype(np.float64)
                    out.append(1 - 6 * float(gap @ gap) / (n * (n * n - 1)) if n > 1 else None)
        return pa.table({"qid": q["qid"].slice(0, len(out)), "rho": pa.array(out, pa.float64())})

    return q.groupBy("_u").cogroup(r.groupBy("_u")).applyInArrow(run, "qid long, rho double")


def auto_floor(live: int, bits: int | None = None, dim: int | None = None) -> float:
    """The similarity that chance alone reaches about once in ``live`` rows, with a margin of one deviation."""
    z = math.sqrt(2 * math.log(max(live, 2))) + 1
    return 0.5 + 0.5 * z / math.sqrt(bits) if bits else z / math.sqrt(dim)


def check_floor(value):
    """A floor as given: None, 'auto', 'off' (also 'none' and ''), or a number from 0 to 1."""
    if value is None or value in ("auto", "off"):
        return value
    if isinstance(value, str) and value.lower() in ("none", ""):
        return "off"
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"min_sim {value!r}: a number from 0 to 1, 'auto' or 'off'")
    return float(value)


def resolve_floor(given, stored, live: int, bits: int | None, dim: int | None) -> float | None:
    """The caller's floor if there is one, else the index's; 'off' overrides both."""
    v = check_floor(given if given is not None else stored)
    if v is None or v == "off":
        return None
    return auto_floor(live, bits, dim) if v == "auto" else v


def mean_vector(df: DataFrame, vec: str = "embedding", digits: int = 9) -> DataFrame:
    """pos, mean: the average of each component, rounded so that no summation order shows."""
    return df.select(F.posexplode(V.doubles(F.col(vec)))).groupBy("pos").agg(F.round(F.avg("col"), digits).alias("mean"))
