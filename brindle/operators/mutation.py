"""Snapshots of a chunk table: diff, tombstones, append, compaction, numbering, shards, Merkle root."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import stored

#: Rows that one task lays into shards or folds into a Merkle subtree.
SHARD_ROWS = 1 << 20
SUBTREE = 1 << 16
COMPACT_AT = 0.2


def last_by_id(df: DataFrame, order: str, id: str = "chunk_id") -> DataFrame:
    """One row an id: the last by ``order``."""
    w = Window.partitionBy(id).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diff(live: DataFrame, desired: DataFrame, id: str = "chunk_id", sha: str = "sha256") -> DataFrame:
    """id, action: added, updated, unchanged or deleted, by content hash, in one full outer join."""
    a = live.select(F.col(id).alias("_a"), F.col(sha).alias("_as"))
    b = desired.select(F.col(id).alias("_b"), F.col(sha).alias("_bs"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    act = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_as") == F.col("_bs"), "unchanged").otherwise("updated")
    return j.select(F.coalesce("_a", "_b").alias(id), act.alias("action"))


def sync_stats(actions: DataFrame) -> DataFrame:
    """One row: added, updated, deleted, unchanged, embedded (to be encoded), changed."""
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.agg(n("added").alias("added"), n("updated").alias("updated"), n("deleted").alias("deleted"), n("unchanged").alias("unchanged")).select(
        "*", (F.col("added") + F.col("updated")).alias("embedded"), (F.col("added") + F.col("updated") + F.col("deleted") > 0).alias("changed")
    )


def unknown(live: DataFrame, ids: DataFrame, id: str = "chunk_id") -> DataFrame:
    """The ids that no live row has."""
    return ids.join(live, id, "left_anti")


def tombstoned(snapshot: DataFrame, ids: DataFrame, id: str = "chunk_id") -> DataFrame:
    """The snapshot with the latest live row of each of ``ids`` marked deleted."""
    w = Window.partitionBy(id, "tombstone").orderBy(F.desc("row"))
    s = snapshot.join(ids.select(id).distinct().withColumn("_hit", F.lit(True)), id, "left")
    s = s.withColumn("_n", F.row_number().over(w))
    return s.withColumn("tombstone", F.col("tombstone") | (F.coalesce("_hit", F.lit(False)) & (F.col("_n") == 1))).drop("_hit", "_n")


def numbered(df: DataFrame, order: list, start: int = 0, row: str = "row") -> DataFrame:
    """Rows numbered from ``start`` in order, without bringing them to one task.

    The table is range-sorted and written once; then only its partitions' sizes reach the driver."""
    s = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = {r[0]: r[1] for r in s.groupBy(part).count().collect()}
    at, offsets = start, {}
    for p in sorted(sizes):
        offsets[p] = at
        at += sizes[p]
    table = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return s.withColumn(row, (F.element_at(table, part) + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_m")


def compacted(snapshot: DataFrame) -> DataFrame:
    """Live rows only, renumbered from 0 in row order."""
    return numbered(snapshot.where("not tombstone").drop("tombstone").withColumnRenamed("row", "_old"), ["_old"]).drop("_old").withColumn("tombstone", F.lit(False))


def counts(snapshot: DataFrame) -> DataFrame:
    """total_rows, live_count, tombstones, tombstone_ratio (0 for an empty snapshot)."""
    c = snapshot.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("tombstone")).alias("live_count"), F.count_if("tombstone").alias("tombstones"))
    return c.withColumn("tombstone_ratio", F.when(F.col("total_rows") > 0, F.col("tombstones") / F.col("total_rows")).otherwise(F.lit(0.0)))


def should_compact(total: int, ratio: float, threshold: float = COMPACT_AT) -> bool:
    return total > 0 and ratio > threshold


def _rolls(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each row (and after the last), and the row that begins the next shard if one begins at this row."""
    before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    end = np.searchsorted(before, before[:-1] + limit, "right") - 1
    alone = (end < len(n)) & (before[end] == before[:-1])  # a row beyond the limit, in an empty shard
    return before, end + alone


def _first_roll(before: np.ndarray, roll: int, at: int, limit: int) -> int:
    """The first row that begins a shard, if ``at`` bytes are in the open one. ``roll``: that row at 0 bytes."""
    return max(1, int(np.searchsorted(before, limit - at, "right"))) - 1 if at else roll


def _outcomes(n: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """What the fill of a block comes to, by the first row j that begins a shard, for every j that can be.

    Bytes before each of these rows; shards begun from j on; bytes in the last of them."""
    before, nxt = _rolls(n, limit)
    m, to = len(n), nxt.tolist()
    begun, left = [0] * (m + 1), [0] * m + [int(before[m])]
    for i in range(m - 1, -1, -1):
        begun[i] = begun[to[i]] + 1
        left[i] = left[to[i]] if to[i] < m else int(before[m] - before[i])
    z = to[0] + 1
    return before[: z + 1].tolist(), begun[:z], left[:z]


def sharded(rows: DataFrame, limit: int, size: str = "n_bytes", block: int = SHARD_ROWS) -> DataFrame:
    """row, shard_id, byte_offset: rows in order, a new shard when one would pass ``limit`` (unless it is empty).

    Filling is sequential over all rows. A task a block of ``block`` rows finds what the block comes to for each row
    at which its first shard can begin, at most a shard's rows; the driver goes through these from block to block;
    then each block is filled from the bytes that the blocks before leave in the open shard."""

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        before, begun, left = _outcomes(pdf.sort_values("row")["n"].to_numpy(), limit)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "before": [before], "begun": [begun], "left": [left]})

    r = stored(rows.select(F.floor(F.col("row") / block).cast("long").alias("block"), "row", F.col(size).cast("long").alias("n")))
    o = r.groupBy("block").applyInPandas(outcomes, "block long, before array<long>, begun array<long>, left array<long>")
    starts, shard, at = {}, 0, 0
    for b in stored(o).orderBy("block").toLocalIterator():
        starts[b["block"]] = (shard, at)
        j = _first_roll(np.array(b["before"]), len(b["begun"]) - 1, at, limit)
        shard, at = shard + b["begun"][j], b["left"][j] + (0 if b["begun"][j] else at)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        shard, at = starts[pdf["block"].iloc[0]]
        before, nxt = _rolls(pdf["n"].to_numpy(), limit)
        begins = np.zeros(len(pdf), np.int64)
        base = np.full(len(pdf), -at, np.int64)
        i = _first_roll(before, int(nxt[0]), at, limit)
        while i < len(pdf):
            begins[i] = 1
            base[i : nxt[i]] = before[i]
            i = int(nxt[i])
        return pd.DataFrame({"row": pdf["row"], "shard_id": shard + np.cumsum(begins), "byte_offset": before[:-1] - base})

    return r.groupBy("block").applyInPandas(fill, "row long, shard_id long, byte_offset long")


def _fold(hashes: list[bytes], levels: int | None = None) -> bytes:
    """The root of a binary tree; an odd node pairs with itself. ``levels``: that high, also from one node."""
    while len(hashes) > 1 if levels is None else levels > 0:
        hashes = [hashlib.sha256(hashes[i] + hashes[min(i + 1, len(hashes) - 1)]).digest() for i in range(0, len(hashes), 2)]
        if levels is not None:
            levels -= 1
    return hashes[0]


def folded(hashes) -> bytes:
    """The root over hashes as they come, of which there is one at least; no more than a subtree's are held."""
    roots, some = [], []
    for h in hashes:
        some.append(h)
        if len(some) == SUBTREE:
            roots.append(_fold(some))
            some = []
    if some:
        roots.append(_fold(some, SUBTREE.bit_length() - 1 if roots else None))
    return _fold(roots)


def merkle_root(rows: DataFrame, sha: str = "sha256", subtree: int = SUBTREE) -> str:
    """The root over all rows in order, deleted ones too; 64 zeros if there are none.

    Aligned subtrees fold in parallel; only their roots go on."""
    level = rows.select("row", F.unhex(sha).alias("h"))
    n = level.agg((F.max("row") + 1).alias("n")).first()["n"]
    if not n:
        return "0" * 64
    high = subtree.bit_length() - 1
    while n > subtree:

        def up(t: pa.Table) -> pa.Table:
            t = t.sort_by("row")
            return pa.table([pa.array([t["row"][0].as_py() // subtree]), pa.array([_fold(t["h"].to_pylist(), high)])], names=["row", "h"])

        level = stored(level.groupBy(F.floor(F.col("row") / subtree).alias("b")).applyInArrow(up, "row long, h binary"))
        n = -(-n // subtree)
    return _fold([bytes(r["h"]) for r in level.orderBy("row").collect()]).hex()


def merkle_frame(rows: DataFrame, sha: str = "sha256") -> DataFrame:
    """The root as a table, by log2(n) grouping rounds of plain expressions; for checking the other."""
    level = rows.select(F.col("row").alias("i"), F.col(sha).alias("h"))
    n = level.count()
    if not n:
        return rows.sparkSession.createDataFrame([("0" * 64,)], "root string")
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"))
        level = stored(pair.select("i", F.sha2(F.unhex(F.concat("l", "r")), 256).alias("h")))
        n = -(-n // 2)
    return level.select(F.col("h").alias("root"))
