"""How well one ranking reproduces another: recall, rank correlation, discounted gain, mean cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """recall: the mean share of each query's k true rows that were found. Both have qid, row."""
    hit = truth.select("qid", "row").join(found.select("qid", "row").withColumn("_f", F.lit(1)), ["qid", "row"], "left")
    return hit.groupBy("qid").agg((F.count("_f") / F.lit(float(k))).alias("r")).agg(F.avg("r").alias("recall"))


def spearman(scores: DataFrame, a: str, b: str, by: str = "qid") -> DataFrame:
    """by, rho: correlation of the ordinal ranks of two scores, ties to the lower row."""
    ra = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(a), "row"))
    rb = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(b), "row"))
    r = scores.select(by, ra.cast("double").alias("ra"), rb.cast("double").alias("rb"))
    return r.groupBy(by).agg(F.corr("ra", "rb").alias("rho"))


def ndcg(ranked: DataFrame, ideal: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """by, ndcg: gain of a ranking (by, rank, grade) over that of the ideal one, both cut at k; 0 without gain."""
    gain = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0))
    d = ranked.where(F.col("rank") <= k).groupBy(by).agg(gain.alias("dcg"))
    i = ideal.where(F.col("rank") <= k).groupBy(by).agg(gain.alias("idcg"))
    return d.join(i, by).select(by, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def mean_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """cosine: the mean over rows of the cosine of two vectors."""
    from brindle.functions import vectors as V

    return pairs.agg(F.avg(V.dot(V.normalized(F.col(a)), V.normalized(F.col(b)))).alias("cosine"))
