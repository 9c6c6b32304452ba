"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives a row of transformed statistics (logs of counts, arcsine roots of shares). Class means
and covariances come from sums over all labelled rows, added up in Spark; a covariance is shrunk towards
the pooled one and its diagonal. The score is the logistic of the difference of the two log densities
(Mahalanobis distances through Cholesky factors kept with the model) plus the log of the class ratio.

Defined results: a null text is read as empty, and empty texts are scored like any other; labels other
than 0 and 1, and null ones, teach nothing; if only one class is labelled its value is every score, and
0.5 without any labels; a document with several label rows counts once for each; repeated rows are each
scored; a null doc_id joins no label and is never held out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._tables import crc_mod, pick
from brindle.llm._text import LOWER, TOKEN, pieces, strings, word_hashes, words
from brindle.session import stored

_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*@^~_=<>/\\+{}[]")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
NAMES = ("log_words", "log_bytes_a_word", "upper", "marks", "bars", "exclaims", "digits", "stops", "newlines", "letters", "short", "distinct", "bigrams", "ends_marked")
THRESHOLD = 0.3


def _share(a, b):
    return np.arcsin(np.sqrt(np.clip((a + 0.05) / (b + 1.0), 0, 1)))


def statistics(col: pa.Array) -> np.ndarray:
    """A row of NAMES for each text of a column."""
    parts = [np.zeros((0, len(NAMES)))]
    for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
        buf, offs = strings(b.column(0))
        rows = b.num_rows
        a, z, row = words(buf, offs, TOKEN)
        n = np.bincount(row, minlength=rows).astype(float)
        size = np.diff(offs).astype(float)

        def of(mask):
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[offs]).astype(float)

        def distinct(h, r):
            if not len(h):
                return np.zeros(rows)
            k = np.sort(((h >> np.uint64(24)) | (r.astype(np.uint64) << np.uint64(40))))
            return np.bincount((k[np.concatenate([[True], k[1:] != k[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=rows).astype(float)

        h = word_hashes(buf, a, z, lower=True)
        same = row[:-1] == row[1:]
        letters = of(_LETTER[buf])
        end = buf[z - 1] if len(z) else np.zeros(0, np.uint8)
        odd = np.isin(end, np.frombuffer(b"#$%&*!|", np.uint8))
        parts.append(
            np.stack(
                [
                    np.log1p(n),
                    np.log1p(size / np.maximum(n, 1)),
                    _share(of(_UPPER[buf]), letters),
                    _share(of(_MARKS[buf]), size),
                    _share(of(buf == 0x7C), n),
                    _share(of(buf == 0x21), n),
                    _share(of((buf >= 0x30) & (buf <= 0x39)), size),
                    _share(of((buf == 0x2E) | (buf == 0x2C)), n),
                    _share(of(buf == 0x0A), n),
                    _share(letters, size),
                    _share(np.bincount(row, weights=(z - a) <= 3, minlength=rows), n),
                    _share(distinct(h, row), n),
                    _share(distinct((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same], row[:-1][same]), n),
                    _share(np.bincount(row, weights=odd, minlength=rows), n),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts)


_D = len(NAMES)


def _measure(col: pa.Array) -> pa.Array:
    s = statistics(col)
    return pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * _D, s.ravel())


def measured(text) -> Column:
    """The statistics of a text column, as an array."""
    return F.arrow_udf(_measure, "array<double>")(text)


class Discriminant:
    """Means, Cholesky factors and log ratios of the classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, ridge: float = 1e-3):
        self.seen = sorted(k for k, s in sums.items() if s[0] > 0)
        self.model = {}
        if len(self.seen) < 2:
            return
        cov, total = {}, sum(sums[k][0] for k in self.seen)
        for k in self.seen:
            n, s, q = sums[k]
            m = s / n
            cov[k] = q / n - np.outer(m, m)
        pooled = sum(cov[k] * sums[k][0] for k in self.seen) / total
        for k in self.seen:
            n, s, _ = sums[k]
            c = (1 - shrink) * cov[k] + shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + ridge * np.eye(len(s))
            low = np.linalg.cholesky(c)
            self.model[k] = (s / n, np.linalg.inv(low), float(np.log(np.diag(low)).sum()), float(np.log(n / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.seen) < 2:
            return np.full(len(x), float(self.seen[0]) if self.seen else 0.5)
        g = []
        for k in (0, 1):
            m, inv, logdet, prior = self.model[k]
            g.append(prior - logdet - 0.5 * (((x - m) @ inv.T) ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(g[1] - g[0], -700, 700)))


def fit(measures: DataFrame, labels: DataFrame, **kw) -> Discriminant:
    """From (doc_id, x) and (doc_id, quality): all labelled rows count, as sums of x and of its products."""
    lab = pick(labels, doc_id="bigint", quality="int").where(F.col("quality").isin(0, 1))
    x = measures.select("doc_id", "x").join(lab, "doc_id").select("quality", "x")

    def sums(batches):
        out = {k: np.zeros(1 + _D + _D * _D) for k in (0, 1)}
        for b in batches:
            q = b.column(0).to_numpy(zero_copy_only=False)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)
            for k in (0, 1):
                w = v[q == k]
                out[k] += np.concatenate([[len(w)], w.sum(0), (w.T @ w).ravel()])
        for k, s in out.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["k", "i", "v"])

    got = {k: np.zeros(1 + _D + _D * _D) for k in (0, 1)}
    for r in x.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        got[r["k"]][r["i"]] = r["v"]
    return Discriminant({k: (s[0], s[1 : 1 + _D], s[1 + _D :].reshape(_D, _D)) for k, s in got.items()}, **kw)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out rows are not learned."""
    d = pick(docs, doc_id="bigint", text="string")
    m = stored(d.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), measured("text").alias("x")))
    model = fit(m.where(~F.col("held_out")), labels)

    @F.arrow_udf("double")
    def judge(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)))

    out = m.select("doc_id", "held_out", judge("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
