"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the list of a language's most frequent n-grams (1 to 3 characters of a document's words, with
one boundary before, between and after them), most frequent first. A text is ranked the same way; its distance to a language is the sum
over its own top n-grams of how far each is out of place, or the profile's length where it is absent.

Defined results: a null text, an empty one and one without any letter give ``und`` and score 0; equal
distances go to the language that comes first by code point; with nothing to learn from, as in an empty table, all is
``und``; repeated rows are each answered, and each is learned from; a null doc_id is never learned from; texts of any
length are read whole, one at a time if long; other columns are left behind (``accepted`` keeps them all, whatever
their names). Any number of languages is learned; the model is a profile of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._tables import crc_mod, pick
from brindle.llm._text import pieces, strings

UNKNOWN = "und"
DEPTH = 300
#: Profiles are fitted on about so many documents of each language (all, if there are fewer).
SAMPLE = 4000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    global _LETTER
    if _LETTER is None:
        t = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LETTER = t
    return _LETTER


def _letter_runs(col: pa.Array):
    """For each row its letters in lower case with 1 at every word's edge; empty if it has none."""
    buf, offs = strings(col)
    raw = buf.tobytes()
    try:
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
        parts = [cps[a:z] for a, z in zip(at[:-1], at[1:])]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:z].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, z in zip(offs[:-1], offs[1:])]
    table = _letters()
    for p in parts:
        s = table[p]
        keep = s > 0
        if not keep.any():
            yield s[:0]
            continue
        after = keep.copy()
        after[1:] |= keep[:-1]
        s = s[after]
        s[s == 0] = 1
        yield np.concatenate([np.ones(1, np.uint64), s, np.ones(int(s[-1] != 1), np.uint64)])


def _counts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a row of letters, or of several one after another, ascending, and how often each occurs.

    Where two edges meet, a row ends; no n-gram goes across."""
    on = (s[:-1] != 1) | (s[1:] != 1)
    two, three = s[:-1] | s[1:] << np.uint64(21), s[:-2] | s[1:-1] << np.uint64(21) | s[2:] << np.uint64(42)
    k = np.sort(np.concatenate([s[s != 1], two[on], three[on[:-1] & on[1:]]]))
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.diff(at, append=len(k))


def _top(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent n-grams; equal counts in ascending order of the n-gram."""
    most = int(counts.max())
    order = np.argsort((most - counts).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
    return keys[order[:depth]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, sample: int = SAMPLE) -> dict[str, list[int]]:
    """The profile of each language that ``docs`` name.

    About ``sample`` documents of a language are used, chosen by hash; how many rows a language has is
    counted first, over all of them. What comes to the driver is ``depth`` rows a language."""
    d = pick(docs, **{text: "string", lang: "string"}).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = d.groupBy(lang).count().collect()  # a row a language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], int(min(1.0, sample / r[1]) * (1 << 20)))])
    d = d.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < F.element_at(share, F.col(lang))).select(lang, text)

    def grams(batches):
        for b in pieces(batches, text):
            langs = np.array(b.column(0).to_pylist(), object)
            of: dict[str, list] = {}
            for who, s in zip(langs, _letter_runs(b.column(1))):
                if len(s):
                    of.setdefault(who, []).append(s)
            for who, runs in of.items():
                k, c = _counts(np.concatenate(runs))
                yield pa.RecordBatch.from_arrays([pa.array([who] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    n = d.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("lang", "gram", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def classify(text: Column, profiles: dict[str, list[int]], depth: int = DEPTH) -> Column:
    """struct(lang, score) of a text column: the nearest profile and 1 - distance / largest distance."""
    names = sorted(profiles)
    grams = np.array([g for n in names for g in profiles[n]], np.uint64)
    by = np.argsort(grams, kind="stable")
    grams = grams[by]
    owner = np.repeat(np.arange(len(names)), [len(profiles[n]) for n in names])[by]
    rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(profiles[n])) for n in names]])[by]

    @F.arrow_udf("struct<lang:string,score:double>")
    def nearest(col: pa.Array) -> pa.Array:
        langs, scores = [], []
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            for s in _letter_runs(b.column(0)):
                if not len(s) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                top = _top(*_counts(s), depth)
                lo = np.searchsorted(grams, top)
                n = np.searchsorted(grams, top, "right") - lo
                mine = np.repeat(np.arange(len(top)), n)
                at = np.repeat(lo, n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
                near = depth - np.minimum(np.abs(rank[at] - mine), depth)
                far = depth * len(top) - np.bincount(owner[at], near, len(names))
                best = int(far.argmin())
                langs.append(names[best])
                scores.append(1 - float(far[best]) / (depth * len(top)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return nearest(text)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that the fixed split leaves for learning."""
    return docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))


def identify(docs: DataFrame, profiles: dict[str, list[int]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the same table if not given profiles."""
    if profiles is None:
        profiles = learn(learnable(docs))
    d = pick(docs, doc_id="bigint", text="string").withColumn("_r", classify(F.col("text"), profiles))
    return d.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("_r.lang").alias("lang_pred"), F.col("_r.score").alias("score"))


def accepted(docs: DataFrame, profiles: dict[str, list[int]] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: not ``und``, score above ``least``."""
    if profiles is None:
        profiles = learn(learnable(docs))
    r = classify(F.col("`text`").cast("string"), profiles)
    return docs.where((r["lang"] != UNKNOWN) & (r["score"] > least))
