"""Approximate nearest neighbours, by inner product, with a permutation index.

Equal vectors are one class; classes are indexed and searched, and results name the rows of a class again. There
are about ``PER_ROOT`` pivots to the square root of the number of classes. A class is represented by the ordered
list of its ``LENGTH`` nearest pivots, and posted in the inverted files of the ``POSTED`` nearest. A query reads the
files of its ``READ`` nearest. Each file ranks its classes by footrule distance to the query (the sum over pivots of
how far their ranks are apart, absent ones counting as last), and the nearest ``SHARE`` of them (``LEAST`` at least)
are reranked by their inner product on the original vectors; what can't be among the k best, as k + 1 pivots' own
vectors are better, isn't passed on. So a file has some square root of n classes, a query
looks at a constant number of files, and nothing jumps or is capped at any size. ``exact`` is the exact way: one
pivot, whose only file is read and reranked whole, in blocks.

Permutations know directions only, while a long vector reaches an inner product from farther off. The footrule is
therefore read as an inner product: length times the cosine that this footrule stands for in the sample, and ``SURE``
standard deviations more. Among vectors of one length that is the order by footrule itself. A vector r times as long
as the median, if r > 1, is posted in r * r times as many files.

Pivots, median and cosines are fitted on a bounded sample: the classes with the least hashes, at most ``SAMPLE``.
Every class is indexed. A file with many classes is cut into blocks of about ``BLOCK``, and the queries that read it
likewise, so a hot pivot is shared by many tasks; of a class only the k + 1 least vec_ids can count, so that many go
along with it, and a class with very many rows is spread when its rows are answered.

Defined results: null vectors, zero vectors, those with a null or non-finite component or without a vec_id take no
part, as candidates or queries; an inner product is defined between vectors of one length (dimension), so each length
is searched by itself; a row repeated exactly counts once; another vector under the query's own vec_id is a candidate,
and a query of its own; ties go to the smaller vec_id; products beyond the doubles score infinity, of their sign; a
query with fewer candidates than k gets all; an empty table gives no rows; other columns are left behind."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._tables import hot_keys, pick, spread_join
from brindle.session import stored

K = 20
SAMPLE = 1 << 16
PER_ROOT = 4
LENGTH = 96
POSTED = 8
READ = 64
SHARE = 0.25
LEAST = 60
SURE = 2.0
BLOCK = 8192
_OUT = "query_id long, rank int, vec_id long, score double"


def far_apart(unit: np.ndarray, m: int) -> np.ndarray:
    """Which m of the sample's unit vectors are pivots: each the farthest from those before among a fixed draw."""
    rng = np.random.default_rng(7)
    chosen = [0]
    best = unit @ unit[0]
    best[0] = np.inf
    for _ in range(m - 1):
        draw = rng.integers(0, len(unit), 8)
        c = int(draw[best[draw].argmin()])
        if best[c] == np.inf:
            c = int(best.argmin())
        chosen.append(c)
        best = np.maximum(best, unit @ unit[c])
        best[c] = np.inf
    return np.array(chosen)


def _valid(df: DataFrame, vec: str) -> DataFrame:
    """vec_id, vec (float or double as given, all finite, not zero) and f1, f2, 128 bits that tell vectors apart; each different row once."""
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    e = pick(df, vec_id="bigint", **{vec: kind}).withColumnRenamed(vec, "vec").where("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: F.coalesce(x > float("-inf"), F.lit(False)) & (x < float("inf")) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    return e.where(fine).withColumn("f1", F.xxhash64("vec")).withColumn("f2", F.xxhash64(F.lit(1), "vec")).dropDuplicates(["vec_id", "f1", "f2"])


def _matrix(col, dtype=np.float64) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(col), -1)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided by a power of two that brings it near 1, and the powers; nothing is rounded."""
    e = np.frexp(np.abs(x).max(1, initial=0))[1]
    return np.ldexp(x, -e[:, None]), e


def _logs(x: np.ndarray) -> np.ndarray:
    """The logarithms of the lengths."""
    s, e = _scaled(x)
    return np.log(np.linalg.norm(s, axis=1)) + e * math.log(2)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, as if summed without rounding: twice the precision of doubles, rounded once.

    So a pair has the same score in whatever block it is met."""
    (x, a), (y, b) = _scaled(x), _scaled(y)
    hi, lo = np.zeros(len(x)), np.zeros(len(x))
    for i in range(x.shape[1]):
        u, v = x[:, i], y[:, i]
        p = u * v
        c = 134217729.0 * u
        u1 = c - (c - u)
        c = 134217729.0 * v
        v1 = c - (c - v)
        u2, v2 = u - u1, v - v1
        lo += u2 * v2 - (((p - u1 * v1) - u2 * v1) - u1 * v2)
        s = hi + p
        t = s - hi
        lo += (hi - (s - t)) + (p - t)
        hi = s
    with np.errstate(over="ignore"):
        return np.ldexp(hi + lo, a + b)


class Model:
    """Pivots and what a footrule stands for, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, pivots: int, length: int):
        unit = _scaled(sample)[0]
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        chosen = far_apart(unit, min(pivots, len(unit)))
        self.pv, self.known = unit[chosen], sample[chosen]
        self.listed = min(length, len(self.pv))
        self.typical = float(np.median(_logs(sample)))
        top = self.listed * (self.listed + 1)
        rng = np.random.default_rng(11)
        n = min(len(unit), 2000)
        a, b = rng.integers(0, n, 40_000), rng.integers(0, n, 40_000)
        a, b = a[a != b], b[a != b]
        self.cosine = np.full(top + 1, 1.0) - np.arange(top + 1) / max(top, 1)
        if len(a):
            o = self.orders(unit[:n])
            ranks = np.full((n, len(self.pv)), self.listed, np.int16)
            np.put_along_axis(ranks, o.astype(np.int64), np.arange(self.listed, dtype=np.int16)[None], 1)
            f = np.concatenate([np.abs(ranks[i].astype(np.int32) - ranks[j]).sum(1) for i, j in zip(np.array_split(a, 40), np.array_split(b, 40))])
            c = (unit[a] * unit[b]).sum(1)
            by = np.argsort(f, kind="stable")
            parts = [(x.mean(), y.mean(), y.var()) for x, y in zip(np.array_split(f[by], 40), np.array_split(c[by], 40)) if len(x)]
            x, y, v = (np.array(z) for z in zip(*parts))
            # equal permutations stand for equal directions
            self.cosine = np.interp(np.arange(top + 1), np.concatenate([[0], x + 1]), np.concatenate([[1.0], np.minimum.accumulate(y)])) + SURE * math.sqrt(v.mean())

    def orders(self, x: np.ndarray) -> np.ndarray:
        """The listed pivots of each vector, nearest first, ties to the lower pivot."""
        out = np.empty((len(x), self.listed), np.int32)
        step = max(1, (1 << 22) // len(self.pv))
        for a in range(0, len(x), step):
            far = -(_scaled(x[a : a + step])[0] @ self.pv.T)
            if far.shape[1] > 4 * self.listed:
                near = np.sort(np.argpartition(far, self.listed, axis=1)[:, : self.listed], axis=1)
                by = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
                out[a : a + step] = np.take_along_axis(near, by, 1)
            else:
                out[a : a + step] = np.argsort(far, axis=1, kind="stable")[:, : self.listed]
        return out

    def floors(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query what its k best classes reach at least: all pivots are classes, one may be its own."""
        out = np.full(len(x), -np.inf)
        if len(self.known) > k:
            step = max(1, (1 << 22) // len(self.known))
            for a in range(0, len(x), step):
                with np.errstate(over="ignore", invalid="ignore"):
                    s = x[a : a + step] @ self.known.T
                    s -= 4 * x.shape[1] * 2.0**-52 * np.linalg.norm(x[a : a + step], axis=1)[:, None] * np.linalg.norm(self.known, axis=1)
                    out[a : a + step] = np.partition(s, -k - 1, axis=1)[:, -k - 1]
        return np.where(np.isfinite(out), out, -np.inf)

    def files(self, x: np.ndarray, order: np.ndarray, posted: float) -> list[np.ndarray]:
        """The files that each vector is posted in; rounding errors don't make one long."""
        r = _logs(x) - self.typical
        depth = np.minimum(len(self.pv), np.ceil(posted * np.exp(2 * np.where(r > 1e-6, np.minimum(r, 300), 0)))).astype(np.int64)
        return [o[:d] if d <= len(o) else np.argsort(-(_scaled(v[None])[0][0] @ self.pv.T), kind="stable")[:d].astype(np.int32) for o, d, v in zip(order, depth, x)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def permutations(classes: DataFrame, model: Model, k: int, posted: float, read: int) -> DataFrame:
    """``classes`` with order (nearest pivots), files (where posted), reads (the files a query reads) and floor (what counts for it)."""

    @F.arrow_udf("struct<order:array<int>,files:array<int>,floor:double>")
    def place(col: pa.Array) -> pa.Array:
        x = _matrix(col) if len(col) else np.zeros((0, model.pv.shape[1]))
        o = model.orders(x)
        return pa.StructArray.from_arrays([_lists(list(o)), _lists(model.files(x, o, posted) if len(x) else []), pa.array(model.floors(x, k))], ["order", "files", "floor"])

    return classes.withColumn("_p", place("vec")).withColumn("order", F.col("_p.order")).withColumn("files", F.col("_p.files")).withColumn("floor", F.col("_p.floor")).withColumn("reads", F.slice("order", 1, read)).drop("_p")


def _footrules(q: np.ndarray, xo: np.ndarray, pivots: int, listed: int) -> np.ndarray:
    """Footrule distances of queries to vectors, both given by their lists of pivots."""
    names = np.unique(q)
    local = np.full(pivots, len(names), np.int64)
    local[names] = np.arange(len(names))
    ranks = np.full((len(names) + 1, len(xo)), listed, np.int16)
    ranks[local[xo].ravel(), np.repeat(np.arange(len(xo)), listed)] = np.tile(np.arange(listed, dtype=np.int16), len(xo))
    q = local[q]
    out = np.full((len(q), len(xo)), listed * (listed + 1) // 2, np.int16)
    for i in range(listed):
        r = ranks[q[:, i]]
        out += r
        r -= i
        np.abs(r, out=r)
        out += r
        out -= listed
    return out


def rerank(q: pa.Table, x: pa.Table, model: Model, k: int, share: float, least: int) -> pa.Table:
    """A block of queries against a block of a file: for each query the best k + 1 classes of those nearest by footrule."""
    q, x = q.combine_chunks(), x.combine_chunks()
    qs, xs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(q) and len(x):
        x = x.sort_by([("f1", "ascending"), ("f2", "ascending")])
        xv, qv = _matrix(x["vec"]), _matrix(q["vec"])
        xo, qo = _matrix(x["order"], np.int64), _matrix(q["order"], np.int64)
        logs = _logs(xv)
        length = np.exp(logs - logs.max())
        low = x["ids"].combine_chunks()
        low = low.flatten().to_numpy()[low.offsets.to_numpy()[:-1] - low.offsets[0].as_py()]
        top = max(least, math.ceil(share * len(xv)))
        xe = int(np.frexp(np.abs(xv).max())[1])
        xw, (qw, qe) = np.ldexp(xv, -xe), _scaled(qv)
        known = np.ldexp(q["floor"].to_numpy(), -(qe + xe))
        slack = 4 * xv.shape[1] * 2.0**-52 * np.linalg.norm(xw, axis=1)
        step = max(1, (1 << 24) // (len(xv) * model.listed))
        for a in range(0, len(qv), step):
            s = qw[a : a + step] @ xw.T
            if top < len(xv):
                near = model.cosine[_footrules(qo[a : a + step], xo, len(model.pv), model.listed)] * length
                s[near < np.partition(near, -top, axis=1)[:, -top][:, None]] = -np.inf
            err = slack[None] * np.linalg.norm(qw[a : a + step], axis=1)[:, None]
            c = min(k + 1, len(xv))
            floor = np.maximum(np.partition(s - err, -c, axis=1)[:, -c], known[a : a + step])
            i, j = np.nonzero((s + err >= floor[:, None]) & (s > -np.inf))
            exact = inner(qv[a + i], xv[j])
            by = np.lexsort((low[j], -exact, i))
            i, j, exact = i[by], j[by], exact[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place <= k
            qs.append(a + i[keep])
            xs.append(j[keep])
            scores.append(exact[keep])
    qi, xi = pa.array(np.concatenate(qs)), pa.array(np.concatenate(xs))
    same = (q["f1"].take(qi).to_numpy() == x["f1"].take(xi).to_numpy()) & (q["f2"].take(qi).to_numpy() == x["f2"].take(xi).to_numpy())
    return pa.table([q["f1"].take(qi), q["f2"].take(qi), x["f1"].take(xi), x["f2"].take(xi), x["ids"].take(xi), pa.array(same), pa.array(np.concatenate(scores))], names=["q1", "q2", "f1", "f2", "ids", "same", "score"])


def _search(e: DataFrame, k: int, every: int, per_root: float, length: int, posted: float, read: int, share: float, least: int, block: int) -> DataFrame:
    """The search among vectors of one length: ``e`` as _valid gives it."""
    asks = F.col("vec_id") % every == 0
    first = Window.partitionBy("f1", "f2").orderBy("vec_id")
    few = e.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    some = e.where(asks).select("f1", "f2").distinct().withColumn("asks", F.lit(True))
    classes = few.groupBy("f1", "f2").agg(F.min_by("vec", "_n").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")).join(some, ["f1", "f2"], "left")
    classes = stored(classes)
    n = classes.count()
    sample = np.array([r[0] for r in classes.orderBy("f1", "f2").limit(SAMPLE).select("vec").collect()], float)
    model = Model(sample, math.ceil(per_root * math.sqrt(n)) if per_root else 1, length)
    p = stored(permutations(classes, model, k, posted, read))
    at = lambda col: p.select("f1", "f2", "vec", "ids", "asks", "floor", "order", F.explode(col).alias("pivot"))
    sizes = p.select(F.explode("files").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.join(p.where("asks").select(F.explode("reads").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("nq")), "pivot"))
    cut = lambda c: F.ceil(F.col(c) / block).cast("int")
    f = F.broadcast(sizes.select("pivot", cut("n").alias("vb"), cut("nq").alias("qb")))  # a row a pivot: at most SAMPLE
    right = at("files").join(f, "pivot").withColumn("v", F.pmod("f1", "vb")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    left = at("reads").where("asks").join(f, "pivot").withColumn("u", F.pmod("f2", "qb")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    key = [F.col("pivot"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")]
    left = left.select(*key, "f1", "f2", "vec", "order", "floor").toDF("p", "a", "b", "f1", "f2", "vec", "order", "floor").groupBy("p", "a", "b")
    right = right.select(*key, "f1", "f2", "vec", "order", "ids").groupBy("pivot", "u", "v")
    near = left.cogroup(right).applyInArrow(lambda q, x: rerank(q, x, model, k, share, least), "q1 long, q2 long, f1 long, f2 long, ids array<long>, same boolean, score double")
    # one shuffle serves all three: pairs met in several files, the best classes, their rows
    near = near.repartition("q1", "q2").groupBy("q1", "q2", "f1", "f2").agg(F.first("ids").alias("ids"), F.first("same").alias("same"), F.first("score").alias("score"))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.get("ids", F.lit(0)), "f1")
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    near = near.select("q1", "q2", F.explode("ids").alias("vec_id"), "same", "score")
    rows = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "same")
    near = near.withColumn("_n", F.row_number().over(rows)).where(F.col("_n") <= k + 1)
    near = near.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "same", "score"))).alias("list"))
    who = stored(e.where(asks).select(F.col("vec_id").alias("query_id"), F.col("f1").alias("q1"), F.col("f2").alias("q2")))
    out = spread_join(who, near, ["q1", "q2"], hot_keys(who, ["q1", "q2"]), "query_id")
    others = F.slice(F.filter("list", lambda r: ~(r["same"] & (r["vec_id"] == F.col("query_id")))), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "r"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def search(vectors: DataFrame, vec: str = "embedding", k: int = K, every: int = 20, per_root: float = PER_ROOT, length: int = LENGTH, posted: float = POSTED, read: int = READ, share: float = SHARE, least: int = LEAST, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each vector whose vec_id ``every`` divides; ``exact``: the k nearest."""
    if exact:
        per_root, posted, share = 0, 1, 1.0
    e = stored(_valid(vectors, vec))
    out = None
    for r in e.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").collect():
        part = _search(e.where(F.size("vec") == r["d"]), k, every, per_root, length, posted, read, share, least, block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else e.sparkSession.createDataFrame([], _OUT)
