"""What every operator and stage gives for nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontamination, language, licenses, mixing, near_duplicates, neighbours, pii, quality, suffix_dedup, window_dedup
from brindle.llm.components import components

SENTENCE = "the quick brown fox jumps over the lazy dog and then it runs away from all of us into the dark wood "
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
ROWS = [
    (1, SENTENCE * 3, "en", "a"), (2, SENTENCE * 3, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "   \n", "de", "b"), (6, "123 4.5.6.7 !?", "en", "b"), (7, LONG, "en", None),
    (None, "no id here but words, many words of all kinds and sorts", "en", "c"), (None, SENTENCE * 3, None, "c"), (1, "same id, another text entirely, for what it is worth", "en", "a"), (1, SENTENCE * 3, "en", "a"), (9, "über straße 東京 naïve", "de", "b"), (10, "a", "en", "a"),
]
ODD = ("_id", "_n", "_keep", "copy_no", "_row", "n", "h", "row", "hash", "w", "list", "_salt", "n_words")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"mine {c}") for c in ODD})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1), (7, 1, 0), (9, 5, 0), (10, 0, 0), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, SENTENCE), (None, SENTENCE), (2, None), (3, ""), (4, "one two"), (5, "words that are nowhere else in any of the documents of this test")], "item_id long, text string")


OPS = {
    "op1": lambda d, x, b: language.identify(d), "op2": lambda d, x, b: licenses.scan(d), "op3": lambda d, x, b: window_dedup.dedup(d), "op6": lambda d, x, b: near_duplicates.link(d), "op7": lambda d, x, b: pii.detect(d),
    "op8": lambda d, x, b: mixing.mix(d), "op9": lambda d, x, b: suffix_dedup.dedup(d), "op10": lambda d, x, b: quality.score(d, x),
}


@pytest.mark.parametrize("op", OPS)
def test_every_row_is_answered(spark, docs, labels, bench, op):
    rows = OPS[op](docs, labels, bench).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    none = OPS[op](docs.where("false"), labels.where("false"), bench)
    assert none.count() == 0 and none.columns == OPS[op](docs, labels, bench).columns


def by(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_language(docs):
    r = by(language.identify(docs).collect())
    assert {x["lang_pred"] for i in (3, 4, 5) for x in r[i]} == {"und"} and all(0 <= x["score"] <= 1 for v in r.values() for x in v) and r[9][0]["lang_pred"] in ("en", "de")
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {1, 2, 7, 9, 10, None}


def test_windows(docs):
    r = by(window_dedup.dedup(docs).collect())
    assert r[2][0]["n_removed"] == r[2][0]["n_words"] == 66 and r[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and r[2][0]["kept"] == ""
    assert sorted(x["n_removed"] for x in r[1]) == [0, 0, 0] and sorted(x["n_removed"] for x in r[None]) == [0, 66] and r[3][0]["n_words"] == 0
    assert r[7][0]["n_words"] == 120_000


def test_suffixes(docs):
    r = by(suffix_dedup.dedup(docs).collect())
    n = len(SENTENCE) * 3
    assert sorted(x["n_removed"] for x in r[1]) == [0, n, n] and r[2][0]["n_removed"] == n and r[2][0]["n_spans"] == 1 and r[3][0]["n_bytes"] == 0
    assert r[7][0]["n_removed"] > 0 and bytes(r[9][0]["kept"]).decode() == ROWS[-2][1]


def test_near_duplicates(docs):
    r = by(near_duplicates.link(docs).collect())
    assert [x["n_similar"] for x in r[2]] == [3] and {x["component_id"] for x in r[2]} == {1} and sorted(x["n_similar"] for x in r[1]) == [0, 3, 3]
    assert (r[3][0]["n_shingles"], r[3][0]["n_similar"], r[3][0]["component_id"]) == (0, 0, 3) and r[10][0]["n_shingles"] == 1
    kept = near_duplicates.representatives(docs)
    assert kept.columns == docs.columns
    k = by(kept.collect())
    assert 2 not in k and len(k[1]) == 2 and len(k[None]) == 1 and {3, 4, 5, 7, 9, 10} <= set(k) and all(x["_id"] == "mine _id" and x["_n"] == "mine _n" for v in k.values() for x in v)
    assert near_duplicates.representatives(docs.where("false")).count() == 0


def test_decontamination(docs, bench):
    got = decontamination.leaks(docs, bench).collect()
    assert sorted((str(x["doc_id"]), str(x["item_id"])) for x in got) == sorted((str(i), j) for i in (1, 1, 2, None) for j in ("1", "None")) and {x["first_word"] for x in got} == {0} and all(x["similarity"] == 1 for x in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, decontamination.leaks(docs, bench, block=1).collect()), key=str)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 4 and decontamination.clean(docs, bench.where("false")).count() == len(ROWS)
    assert decontamination.leaks(docs.where("false"), bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0


def test_pii_masks_and_keeps(docs):
    m = pii.masked(docs)
    r = by(m.collect())
    assert m.columns == docs.columns and r[3][0]["text"] is None and r[6][0]["text"] == "123 <ip> !?" and r[6][0]["n_chars"] == len("123 <ip> !?")


def test_mix(docs):
    m = mixing.emitted(docs)
    assert m.columns == [*[c for c in docs.columns if c != "copy_no"], "copy_no"] and {r["copy_no"] for r in m.collect()} <= {1, 2, 3}
    taken = by(mixing.mix(docs).collect())
    assert all(0 <= x["taken"] <= 3 * x["size"] for v in taken.values() for x in v) and mixing.emitted(docs.where("false")).count() == 0


def test_quality(docs, labels):
    r = quality.score(docs, labels).collect()
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in r)
    assert {x["score"] for x in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert {x["score"] for x in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 2), (5, 5), (None, 1), (7, None), (9, 8), (10, 9)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(e.withColumn("x", F.lit(1))).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 8)}
    assert components(e.where("false")).count() == 0
    line = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1300).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r["root"] for r in components(line.union(star)).collect()} == {0, 1000}


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, docs, bench, tmp_path_factory, stage):
    sf = str(tmp_path_factory.mktemp("sf"))
    bench.write.parquet(f"{sf}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, sf)
    rows = out.collect()
    if stage != "mix":
        assert out.columns == docs.columns and all(r["_id"] == "mine _id" and r["copy_no"] == "mine copy_no" for r in rows)
    assert f(spark, docs.where("false"), sf).count() == 0
    ids = {r["doc_id"] for r in rows}
    assert {"language_id": {3, 4, 5, 6} & ids == set(), "jaccard_join": 2 not in ids, "decontaminate": 2 not in ids and 9 in ids, "mask_pii": len(rows) == len(ROWS), "mix": 7 in ids}[stage]


def test_neighbours_take_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (20, [1.0]), (21, [2.0]), (22, [1e200]), (40, [1e200]), (60, [-1e200])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit("y"), "f1": F.lit("z"), "label": F.lit(1)})
    got = {}
    for r in neighbours.search(d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    two = sorted(got.pop(0))
    assert two == sorted([(1, 1, 0.9), (2, 2, 0.9), (3, 0, 0.5), (1, 0, 0.5), (2, 1, 0.5), (3, 2, 0.5)])
    assert got[20] == [(1, 22, 1e200), (2, 40, 1e200), (3, 21, 2.0), (4, 60, -1e200)]
    assert got[40] == [(1, 22, inf), (2, 21, 2e200), (3, 20, 1e200), (4, 60, -inf)] and [x[1] for x in got[60]] == [20, 21, 22, 40]
    assert neighbours.search(d.where("false")).count() == 0 and neighbours.search(d.where("vec_id = 1")).count() == 0
