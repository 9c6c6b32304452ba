"""Exact n-gram Jaccard join in a metric space.

A document's set is its distinct 5-word shingles, and 1 - Jaccard is a metric on sets. Two documents
link if their distance is at most ``RADIUS`` (100 * intersection >= 90 * union).

1. Documents with equal sets are one class, at distance 0; only classes are joined.
2. In the whole space every pair of unrelated documents is at distance 1, so no pivot tells them apart.
   The first level therefore works in slices of the universe: sizes of linked sets are within 10/9, so
   classes of like size share a slicing into b slices, where b exceeds the most shingles (a 19th of the
   two sizes together) that linked sets can differ in. Hence in some slice they are equal: its distinct
   contents are the pivots, and each cell of this Voronoi partition is one pivot's own. Empty slices
   count for nothing; a document with too many of them is sliced again by another hash. Classes that
   meet in a cell are hooked together, and the connected groups are the regions.
3. Regions are joined exactly in the full space: pivots make Voronoi cells; a document is also a guest of
   each cell whose pivot is at most 2 * RADIUS further than its own (triangle inequality); cells are
   joined recursively, a pair counting only in the lesser of its two home cells. In a small or
   unsplittable cell pairs are ruled out by |d(x,p) - d(y,p)| > RADIUS, ruled in by
   d(x,p) + d(y,p) <= RADIUS, and else verified on the sets. A region of more than ``BLOCK`` classes is
   (or ``BYTES`` of sets) is first split by pivots in Spark, and what stays larger, or is such that pivots don't
   split it, is joined in pairs of hashed blocks, so that no task holds much more than ``BLOCK`` classes.

Defined results: documents without words, and null texts, have an empty set, link with nothing and are
their own component; fewer than five words make one shingle; repeated rows are documents of their own
(each sees the other as similar); a null doc_id is linked and counted, but no component is named by it
unless all of its are null; texts of any length are read whole; an empty table gives no rows; other columns are
left behind. ``representatives`` keeps all columns, whatever their names, and exactly one row of each component (of
rows with the same doc_id and text the one of the least row hash); every row without words stays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._tables import hot_counts, pick, spread_join
from brindle.llm._text import TOKEN, U, mix, pieces, prefix, rolling, signed, span_hashes, strings, word_hashes, words
from brindle.llm.components import components
from brindle.session import stored

K = 5
PERCENT = 90
RADIUS = 1 - PERCENT / 100
BLOCK = 2048
BYTES = 32 << 20
#: A side table of up to this many rows, each of five numbers (so 4 MB), is broadcast; a larger one is joined by shuffle.
SMALL = 100_000

_EDGES = np.unique(np.floor(9 * 1.5 ** np.arange(60)).astype(np.int64))


def shingle_sets(col: pa.Array, k: int = K):
    """Each row's set: its distinct shingle hashes, ascending."""
    buf, offs = strings(col)
    a, z, row = words(buf, offs, TOKEN)
    h = word_hashes(buf, a, z, lower=True)
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    pre = prefix(h)
    all_ = rolling(pre, k)
    for r in range(len(n)):
        i, m = int(first[r]), int(n[r])
        if m >= k:
            s = np.sort(all_[i : i + m - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif m:
            yield mix(span_hashes(pre, np.array([i]), np.array([i + m])) + U(m))
        else:
            yield h[:0]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(s):
        return 0, 0
    f = np.array([s.sum(dtype=U) + U(len(s)), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U)
    return tuple(signed(mix(f)).tolist())


def cells(s: np.ndarray) -> np.ndarray:
    """The cells of a set: hashes of its slices in the slicings of its own size class and the next, if a linked set may be there."""
    n = len(s)
    out = [s[:0]]
    low = int(np.searchsorted(_EDGES, n))
    for c in range(low, int(np.searchsorted(_EDGES, n * 100 // PERCENT)) + 1):
        differ = 2 * int(_EDGES[c]) * (100 - PERCENT) // (100 + PERCENT)
        if not differ:
            continue
        b = differ + 2 + differ // 40
        for seed in range(64):
            t = s if not seed else np.sort(mix(s + U(seed)))
            at = ((t >> U(32)) * U(b)) >> U(32)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.add.reduceat(mix(t ^ U(0x2545F4914F6CDD1D)), starts)
            out.append(mix(sums + (at[starts] + U(1)) * U(0x9E3779B97F4A7C15) + U((c * 64 + seed + 1) * 0xC2B2AE3D27D4EB4F % 2**64)))
            if b - len(starts) < b - differ:
                break
        else:
            # so few filled slices in 64 slicings that pigeonholes promise nothing: one cell for all such sets of this class
            out.append(mix(np.array([c + 1], U) * U(0xD6E8FEB86659FD93)))
    return np.concatenate(out)


def _describe(text: Column) -> Column:
    @F.arrow_udf("struct<n:long,f1:long,f2:long,cells:array<long>>")
    def run(col: pa.Array) -> pa.Array:
        n, f, parts = [], [], [np.zeros(0, U)]
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            for s in shingle_sets(b.column(0)):
                n.append(len(s))
                f.append(fingerprint(s))
                parts.append(cells(s))
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts[1:]])]).astype(np.int32)
        f1, f2 = zip(*f) if f else ((), ())
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(signed(np.concatenate(parts))))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], ["n", "f1", "f2", "cells"])

    return run(text)


class Sets:
    """Many sets as one sparse matrix, and exact distances between them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(names), np.int64)

    def shared(self, x: int, ys: np.ndarray) -> np.ndarray:
        """How many elements set x shares with each of ys."""
        mine = self.flat[self.at[x] : self.at[x + 1]]
        self.flag[mine] = 1
        n = self.size[ys]
        ends = np.cumsum(n)
        where = np.arange(ends[-1]) + np.repeat(self.at[ys] - (ends - n), n) if len(ys) else ends
        out = np.add.reduceat(self.flag[self.flat[where]], ends - n) if len(ys) else ends
        self.flag[mine] = 0
        return out

    def distances(self, x: int, ys: np.ndarray) -> np.ndarray:
        s = self.shared(x, ys)
        return 1 - s / (self.size[x] + self.size[ys] - s)

    def linked(self, x: int, ys: np.ndarray) -> np.ndarray:
        s = self.shared(x, ys)
        return 100 * s >= PERCENT * (self.size[x] + self.size[ys] - s)


_NONE = np.zeros((0, 2), np.int64)
_EPS = 1e-9


def join(sets: Sets, idx: np.ndarray, leaf: int = 32, pivots: int = 8, side: np.ndarray | None = None) -> np.ndarray:
    """All linked pairs among sets ``idx``, as rows (i, j) of positions; see the module's step 3. ``side``: only pairs whose sides differ."""
    m = len(idx)
    if m <= leaf:
        out = [_NONE]
        for k in range(m - 1):
            ys = idx[k + 1 :]
            ys = ys if side is None else ys[side[ys] != side[idx[k]]]
            ys = ys[sets.linked(idx[k], ys)]
            out.append(np.stack([np.full(len(ys), idx[k]), ys], 1))
        return np.concatenate(out)
    d = np.zeros((pivots, m))
    p, near = 0, np.full(m, 2.0)
    for k in range(pivots):
        d[k] = sets.distances(idx[p], idx)
        near = np.minimum(near, d[k])
        p = int(near.argmax())
    home, least = d.argmin(0), d.min(0)
    inside = d <= least + 2 * RADIUS + _EPS
    if inside.sum(1).max() <= 0.7 * m:
        out = [_NONE]
        of = dict(zip(idx.tolist(), home.tolist()))
        for k in range(pivots):
            if (home == k).any():
                pairs = join(sets, idx[inside[k]], leaf, pivots, side)
                if len(pairs):
                    first = np.array([min(of[i], of[j]) for i, j in pairs.tolist()])
                    out.append(pairs[first == k])
        return np.concatenate(out)
    out = [_NONE]
    for k in range(m - 1):
        apart = np.abs(d[:, k + 1 :] - d[:, k : k + 1]).max(0)
        sure = (d[:, k + 1 :] + d[:, k : k + 1]).min(0) <= RADIUS - _EPS
        if side is not None:
            across = side[idx[k + 1 :]] != side[idx[k]]
            apart, sure = np.where(across, apart, 2.0), sure & across
        ask = np.flatnonzero((apart <= RADIUS + _EPS) & ~sure)
        yes = np.concatenate([np.flatnonzero(sure), ask[sets.linked(idx[k], idx[k + 1 + ask])] if len(ask) else ask])
        if len(yes):
            out.append(np.stack([np.full(len(yes), idx[k]), idx[k + 1 + yes]], 1))
    return np.concatenate(out)


_OUT = "f1 long, f2 long, linked long, r1 long, r2 long"


def _join_region(t: pa.Table) -> pa.Table:
    """For each class of a region with links in it: the documents it links with here, and its group's least class."""
    key = np.stack([t["f1"].to_numpy(), t["f2"].to_numpy()], 1)
    order = np.lexsort((key[:, 1], key[:, 0]))
    fresh = np.concatenate([[True], (np.diff(key[order], axis=0) != 0).any(1)])
    keep = order[fresh]
    key, w = key[keep], t["w"].to_numpy()[keep]
    raw = t["members"].take(pa.array(keep)).to_pylist()
    sets = Sets([np.frombuffer(x, U) for x in raw])
    two = t["a"][0].as_py() != t["z"][0].as_py()
    pairs = join(sets, np.arange(len(keep)), side=t["block"].to_numpy()[keep] if two else None)
    homes = np.array(t["homes"].take(pa.array(keep)).to_pylist(), np.int64).reshape(len(keep), -1)
    for lvl, p in enumerate(t["path"][0].as_py()):
        pairs = pairs[np.minimum(homes[pairs[:, 0], lvl], homes[pairs[:, 1], lvl]) == p]
    n = np.zeros(len(keep), np.int64)
    np.add.at(n, pairs[:, 0], w[pairs[:, 1]])
    np.add.at(n, pairs[:, 1], w[pairs[:, 0]])
    root = np.arange(len(keep))
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    got = np.flatnonzero(n)
    cols = [key[got, 0], key[got, 1], n[got], key[root[got], 0], key[root[got], 1]]
    return pa.table([pa.array(c) for c in cols], names=["f1", "f2", "linked", "r1", "r2"])


_FIELDS = ("region", "f1", "f2", "w", "members", "homes", "path")


def _whole(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(0) for c in ("block", "a", "z")}).select(*_FIELDS, "block", "a", "z")


def _paired(big: DataFrame) -> DataFrame:
    """Regions in pairs of hashed blocks; a pair holds about what the bounds allow (_n is how often they are exceeded)."""
    count = F.ceil(2 * F.col("_n")).cast("int")
    big = big.withColumn("block", F.pmod(F.xxhash64("f1", "f2"), count).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(F.least(o, "block").alias("a"), F.greatest(o, "block").alias("z")))
    return big.withColumn("_p", F.explode(pair)).select(*_FIELDS, "block", "_p.a", "_p.z")


def _split(rows: DataFrame, block: int, pivots: int = 16, levels: int = 2) -> DataFrame:
    """Splits regions of more than ``block`` classes or ``BYTES``: by pivots up to ``levels`` times, then into pairs of blocks.

    A region that pivots don't split (near copies of one text are guests of every cell) goes into pairs of blocks at once,
    else each level would copy it ``pivots`` times.
    ``rows``: region (array), f1, f2, w, members, homes (array), path (array). Adds block, a, z."""
    rows = rows.withColumn("region", F.array(F.col("region")))
    weight = F.sum(F.greatest(F.lit(1.0 / block), F.octet_length("members") / F.lit(float(BYTES))))
    done = None
    for level in range(levels + 1):
        n = stored(rows.groupBy("region").agg(weight.alias("_n"), F.count(F.lit(1)).alias("_m")).where("_n > 1.001 and _m > 1"))
        if not n.head(1):
            return _whole(rows) if done is None else done.unionByName(_whole(rows))
        small = _whole(rows.join(n, "region", "left_anti"))
        done = small if done is None else done.unionByName(small)
        big = rows.join(n, "region")
        if level == levels:
            return done.unionByName(_paired(big))
        pick_ = big.groupBy("region", F.pmod("f1", F.lit(pivots)).alias("_b")).agg(F.min("f1").alias("f1"))
        pv = big.join(pick_.select("region", "f1"), ["region", "f1"], "left_semi").select("region", F.col("members").alias("pivot"), F.explode(F.sequence(F.lit(0), F.ceil("_n").cast("int") - 1)).alias("part"))
        pv = stored(pv)  # a cogroup of two plans over the same rows can't tell their columns apart
        placed = stored(_cells(big.withColumn("part", F.pmod(F.xxhash64("f1", "f2"), F.ceil("_n")).cast("int")).drop("_n", "_m"), pv))
        sizes = placed.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count(F.lit(1)).alias("_c")).groupBy("region").agg(F.max("_c").alias("_most"), F.sum("_c").alias("_all"))
        tough = stored(n.join(sizes, "region").where("_most > 0.7 * _m or _all > 2 * _m").select("region", "_n"))
        done = done.unionByName(_paired(placed.join(tough, "region")))
        one = lambda c: F.array(F.col(c))
        rows = placed.join(tough, "region", "left_anti").withColumn("cell", F.explode("cells"))
        rows = rows.select(F.concat("region", one("cell")).alias("region"), "f1", "f2", "w", "members", F.concat("homes", one("home")).alias("homes"), F.concat("path", one("cell")).alias("path"))
    return done


def _cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Adds home, each row's nearest pivot, and cells: its own and, as a guest, those at most 2 * RADIUS further. A part of a region meets its pivots once."""

    def place(x: pa.Table, p: pa.Table) -> pa.Table:
        ps = [np.frombuffer(q, U) for q in sorted(set(p["pivot"].to_pylist()))]
        cells, home = [], []
        for m in x["members"].to_pylist():
            s = np.frombuffer(m, U)
            d = []
            for q in ps:
                i = np.searchsorted(q, s)
                both = int((q[np.minimum(i, len(q) - 1)] == s).sum())
                d.append(1 - both / (len(s) + len(q) - both))
            near = int(np.argmin(d))
            cells.append([k for k, far in enumerate(d) if far <= d[near] + 2 * RADIUS + _EPS])
            home.append(near)
        x = x.drop_columns(["part"])
        return x.append_column("home", pa.array(home, pa.int64())).append_column("cells", pa.array(cells, pa.list_(pa.int64())))

    kind = "region array<long>, f1 long, f2 long, w long, members binary, homes array<long>, path array<long>, home long, cells array<long>"
    return rows.select(*_FIELDS, "part").groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInArrow(place, kind)


def _members(docs: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """The classes' sets, from one document of each: region, f1, f2, w, members, homes, path, block, a, z."""

    def build(batches):
        for b in pieces(batches, "text"):
            f1, f2 = b.column(1).to_pylist(), b.column(2).to_pylist()
            keep, sets = [], []
            for r, s in enumerate(shingle_sets(b.column(0))):
                if fingerprint(s) == (f1[r], f2[r]):
                    keep.append(r)
                    sets.append(s.tobytes())
            if keep:
                c = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([c.column(4), c.column(1), c.column(2), c.column(3), pa.array(sets, pa.binary())], ["region", "f1", "f2", "w", "members"])

    j = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep.doc_id"]) & (docs["h"] == reps["rep.h"])).select("text", "f1", "f2", "w", "region")
    # rows that are repeated, id and text, are one class's: the first found is enough
    j = j.withColumn("_n", F.row_number().over(Window.partitionBy("f1", "f2").orderBy("w"))).where("_n = 1").drop("_n")
    rows = j.mapInArrow(build, "region long, f1 long, f2 long, w long, members binary")
    none = F.array().cast("array<long>")
    return _split(stored(rows.withColumn("homes", none).withColumn("path", none)), block)


def _linked(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Of every row doc_id, h (hash of the text), n, f1, f2; and of every class f1, f2, w, root and how many other documents it links with."""
    d = pick(docs, doc_id="bigint", text="string").withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    t = stored(d.withColumn("_r", _describe(F.col("text"))).select("doc_id", "h", "_r.*"))
    full = t.where("n > 0")
    classes = full.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("w"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"))
    meet = full.select(F.explode("cells").alias("cell"), "f1", "f2")
    met = meet.groupBy("cell").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi")
    hooks = meet.join(met, "cell").where("f1 <> lo").select(F.col("lo").alias("a"), F.col("f1").alias("b")).distinct()
    regions = components(hooks).toDF("f1", "region")
    reps = stored(classes.join(regions, "f1").select("f1", "f2", "w", "rep", "region"))
    if reps.count() <= SMALL:
        reps = F.broadcast(reps)
    groups = _members(d, reps, block).groupBy("region", "path", "a", "z")
    found = stored(groups.applyInArrow(_join_region, _OUT))
    node = lambda a, b: F.struct(F.col(a).alias("f1"), F.col(b).alias("f2"))
    comp = components(found.select(node("f1", "f2").alias("a"), node("r1", "r2").alias("b")))
    linked = found.groupBy("f1", "f2").agg(F.sum("linked").alias("linked"))
    linked = linked.join(comp.select("node.f1", "node.f2", "root"), ["f1", "f2"])
    c = classes.join(linked, ["f1", "f2"], "left").withColumn("root", F.coalesce("root", node("f1", "f2")))
    return t.drop("cells"), stored(c.select("f1", "f2", "w", "least", "root", F.coalesce("linked", F.lit(0)).alias("linked")))


def link(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every row."""
    t, c = _linked(docs, block)
    least = c.groupBy("root").agg(F.min("least").alias("component_id"))
    hot = hot_counts(c.select("f1", "f2", F.col("w").alias("_n")), ["f1", "f2"], t.count())
    c = c.join(least, "root").select("f1", "f2", (F.col("w") - 1 + F.col("linked")).alias("n_similar"), "component_id")
    # rows without words are answered where they are; a class of very many copies is spread
    out = spread_join(t.where("n > 0"), c, ["f1", "f2"], hot, "doc_id").select("doc_id", "n", "n_similar", "component_id")
    out = out.unionByName(t.where("n = 0").select("doc_id", "n", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id")


def representatives(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id."""
    t, c = _linked(docs, block)
    hot = hot_counts(c.select("f1", "f2", F.col("w").alias("_n")), ["f1", "f2"], t.count())
    rows = spread_join(t.where("n > 0").select("doc_id", "h", "f1", "f2"), c.select("f1", "f2", "root"), ["f1", "f2"], hot, "doc_id")
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.h").alias("t"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(F.struct(*cols).alias("row"), F.col("`doc_id`").cast("bigint").alias("i"), F.coalesce(F.xxhash64(F.col("`text`").cast("string")), F.lit(0)).alias("t"), F.coalesce(F.col("`text`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    one = Window.partitionBy("i", "t").orderBy(F.xxhash64("row"))
    first = d.where("words").withColumn("n", F.row_number().over(one)).where("n = 1")
    kept = first.join(keep.select(F.col("i").alias("_i"), F.col("t").alias("_t")), F.col("i").eqNullSafe(F.col("_i")) & (F.col("t") == F.col("_t")), "left_semi")
    return kept.select("row").unionByName(d.where("not words").select("row")).select("row.*")


def oracle() -> str:
    """The same rows in DuckDB, by counting shared shingles of all pairs that share one."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive a as (select doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') w from documents),
b as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) end s from a),
n as (select doc_id, len(s) n from b),
e as (select doc_id, unnest(s) x from b),
p as (select l.doc_id a, r.doc_id b, count(*) k from e l join e r on l.x = r.x and l.doc_id <> r.doc_id group by 1, 2),
k as materialized (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 90 * (x.n + y.n - p.k)),
c(a, b) as (select doc_id, doc_id from n union select c.a, k.b from c join k on c.b = k.a),
m as (select a, min(b) component_id from c group by a),
s as (select a, count(*) n from k group by a)
select n.doc_id, n.n::bigint n_shingles, coalesce(s.n, 0)::bigint n_similar, m.component_id from n left join s on s.a = n.doc_id join m on m.a = n.doc_id"""
