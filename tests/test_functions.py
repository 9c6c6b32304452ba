"""Functions and small operators on literals."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.functions import embedding, projection
from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import chunking, dense, evaluation, fusion, lexical, mutation, skew
from brindle.operators.codecs import LevelCodec, SignCodec


def one(spark, col, **kw):
    df = spark.range(1)
    for k, v in kw.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("bits", [2048, 768, 512, 300, 100, 56])
def test_hamming_against_numpy(spark, bits):
    rng = np.random.default_rng(bits)
    raw = rng.integers(0, 256, (200, -(-bits // 8)), dtype=np.uint8)
    words = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))).view(">i8").astype(np.int64)
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "row long, code array<long>")
    got = [r["dense_dist"] for r in dense.hamming_scan(df, words[0], bits).orderBy("row").collect()]
    want = np.unpackbits(raw ^ raw[0], axis=1).sum(1).tolist()
    assert got == want
    pairs = dense.distances(df, df.where("row < 3").select(F.col("row").alias("qid"), F.col("code").alias("q"))).where("qid = 0").orderBy("row")
    assert [r["dist"] for r in pairs.collect()] == want


def test_hamming_refuses_other_widths(spark):
    df = spark.createDataFrame([([1, 2], [1], None)], "a array<long>, b array<long>, n array<long>")
    for c in (V.hamming(F.col("a"), F.col("b")), V.hamming_literal(F.col("b"), [1, 2])):
        with pytest.raises(PySparkException):
            df.select(c).collect()
    assert df.select(V.hamming(F.col("a"), F.col("a")).alias("x"), V.hamming_literal(F.col("n"), [1]).alias("n")).first().asDict() == {"x": 0, "n": None}


def test_top_k_is_stable_at_the_boundary(spark):
    d = [5] * 10 + [1, 2, 3] + [5] * 50
    df = spark.createDataFrame(list(enumerate(d)), "row long, dist int").repartition(7)
    got = [r["row"] for r in dense.ranked(df, [F.col("dist"), F.col("row")], 6, "rank").orderBy("rank").collect()]
    assert got == [10, 11, 12, 0, 1, 2]
    assert dense.top(df, [F.col("dist")], 0).count() == 0 and dense.top(df, [F.col("dist")], 1000).count() == len(d)


def test_products_in_blocks(spark):
    x = np.random.default_rng(0).standard_normal((50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, embedding array<double>")
    q = df.where("row < 7").select(F.col("row").alias("qid"), F.col("embedding").alias("q"))
    got = {(r["qid"], r["row"]): r["sim"] for r in dense.in_blocks(df, q, lambda a, b: a.select(["qid"]).slice(0, 0).append_column("n", a["qid"].slice(0, 0)), "qid long, n long", 16).collect()}
    assert got == {}
    got = {(r["qid"], r["row"]): r["sim"] for r in dense.products(df, q).collect()}
    assert len(got) == 350 and max(abs(got[a, b] - x[a] @ x[b]) for a, b in got) < 1e-12
    best = dense.batch(dense.products(df, q, 3, lambda s: -s), 3, [F.desc("sim"), F.col("row")])
    for a in range(7):
        assert [r["row"] for r in best.where(f"qid = {a}").orderBy("dense_rank").collect()] == np.argsort(-(x @ x[a]), kind="stable")[:3].tolist()


TEXTS = ["Hello World_1 a b", "naïve Café ÀB ünïcode", "x", "", "!!! ---", "a/b\\c path.to:file", "İstanbul", "foo_bar foo-bar FOO"]


def test_tokens(spark):
    import re

    for t in TEXTS:
        want = re.findall(r"\w\w+", t.lower())
        if "İ" not in t:
            assert one(spark, T.tokens(F.col("t")), t=t) == want == lexical.query_tokens(t)


def test_entities_of_all_kinds(spark):
    h = "<title> Caf&eacute; &#8217;&#x41;&nbsp;&lt;b&gt; &amp;amp; </title><meta property='og:description' content=x><meta name=description content=' &hellip; '><link rel=canonical href='a?b=1&amp;c'><meta name=date content=\"2020\">"
    assert one(spark, T.html_title(F.col("h")), h=h) == "Café ’A <b> &amp;"
    assert one(spark, T.html_description(F.col("h")), h=h) == "…"
    assert one(spark, T.html_url(F.col("h")), h=h) == "a?b=1&c" and one(spark, T.html_date(F.col("h")), h=h) == "2020"
    assert one(spark, T.html_title(F.col("h")), h="<title> </title>") is None and one(spark, T.html_url(F.col("h")), h="") is None


def test_front_matter(spark):
    for t, front, body in (("---\na: 1\n---\nrest", "a: 1", "rest"), ("---\r\na\r\n---\r\nx", "a", "x"), ("no\n---\na\n---\n", None, "no\n---\na\n---\n"), ("", None, "")):
        assert one(spark, T.front_matter(F.col("t")), t=t) == front and one(spark, T.without_front_matter(F.col("t")), t=t) == body


def test_chunks_keep_all_but_white_space_and_agree_with_the_fold(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "Ende. ", "was? ", "x" * 40 + " ", "\n\n", "!", "a.b ", " "]) for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["", "   ", ". . .", "y" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    a, b = ({(r["source"], r["ord"]): r["text"] for r in chunking.chunks(df, "id", native=n).collect()} for n in (False, True))
    assert a == b
    squeeze = lambda s: "".join(s.split())
    for i, t in enumerate(texts):
        mine = [a[k] for k in sorted(a) if k[0] == i]
        assert squeeze("".join(mine)) == squeeze(t) and all(c.strip() == c and c for c in mine)


def test_projections():
    assert set(np.unique(projection.rademacher(16, 2, 3))) == {-1.0, 1.0}
    q = projection.srht(16, 2, 5, 3).astype(float)
    assert np.allclose(np.linalg.norm(q, axis=1), 1, atol=1e-6) and np.allclose(q[0] @ q[0].T, np.eye(16), atol=1e-5)
    h = projection.haar(12, 2, 1).astype(float)
    assert all(np.allclose(x @ x.T, np.eye(12), atol=1e-5) for x in h) and not np.allclose(h[0], h[1])
    c, s = projection.to_int8(h)
    assert np.abs(projection.from_int8(c, s) - h).max() <= s.max() / 2 + 1e-6
    assert not (projection.rademacher(16, 2, 3) == projection.rademacher(16, 2, 4)).all()


def test_codecs(spark):
    x = np.random.default_rng(2).standard_normal((20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (1, 2, 4, 8):
        c = LevelCodec(64, bits, 3)
        i = c.index(x)
        assert (c.unpack(b"".join(r.tobytes() for r in c.encode(x))) == i).all()
        assert (c.decode(i) * x).sum(1).mean() > {1: 0.7, 2: 0.9, 4: 0.99, 8: 0.999}[bits]
        # reading the code of what it stands for gives it again, but for the length
        assert (c.index(c.decode(i)) == i).mean() > 0.5
    s = SignCodec(32, 2, 1, "rademacher")
    assert (s.encode(np.zeros((1, 64))) == 0).all()  # a projection of exactly zero is a zero bit
    df = spark.createDataFrame([(0, x[0].tolist()), (1, None)], "id long, v array<double>")
    got = {r["id"]: r for r in df.select("id", s.column(F.col("v")).alias("w"), s.packed(F.col("v")).alias("b"), LevelCodec(64, 4, 3).column(F.col("v")).alias("l")).collect()}
    assert got[1]["w"] is None and got[1]["b"] is None and got[1]["l"] is None and bytes(got[0]["b"]) == s.encode(x[:1])[0].tobytes() and got[0]["w"] == s.words(x[:1])[0].tolist()


def test_fusion(spark):
    d = spark.createDataFrame([(0, 10, 0.9, 1), (1, 20, 0.8, 2)], "row long, dense_dist int, dense_sim double, dense_rank int")
    x = spark.createDataFrame([(1, 2.0, 1), (0, 1.0, 2), (7, 0.5, 3)], "row long, score double, lex_rank int")
    r = fusion.rrf(d, x, 3).orderBy("rank").collect()
    assert [y["row"] for y in r] == [0, 1, 7] and math.isclose(r[0]["fused"], 1 / 61 + 1 / 62)
    w = {y["row"]: y["fused"] for y in fusion.weighted(d, x, 3, 0.5).collect()}
    assert math.isclose(w[0], 0.5 + 0.5 * (1.0 - 0.5) / 1.5) and math.isclose(w[1], 0.5) and w[7] == 0
    assert fusion.rrf(d, x.where("false"), 3).count() == 2 and fusion.rrf(d, x, 0).count() == 0


def test_lexical(spark):
    docs = spark.createDataFrame([(0, "red green green"), (1, "red"), (2, ""), (3, None), (4, "x y z")], "row long, text string")
    p = lexical.postings(docs)
    r = {(x["row"], x["token"]): x for x in p.collect()}
    assert set(r) == {(0, "red"), (0, "green"), (1, "red")} and r[0, "green"]["tf"] == 2
    avg = (3 + 1) / 5
    assert math.isclose(r[0, "green"]["impact"], math.log(1 + (5 - 1 + 0.5) / 1.5) * 2 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))
    once, twice = (lexical.search(p, q, 5).orderBy("lex_rank").collect() for q in ("green", "green green"))
    assert math.isclose(twice[0]["score"], 2 * once[0]["score"], rel_tol=1e-8) and lexical.search(p, "! x", 5).count() == 0 and lexical.search(p, "none", 5).count() == 0
    q = spark.createDataFrame([(1, "red"), (2, "green red"), (3, "?")], "qid long, text string")
    many = {(x["qid"], x["lex_rank"]): x["row"] for x in lexical.search_many(p, q, 2).collect()}
    assert many == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 1}
    assert lexical.postings(docs.where("false")).count() == 0


def test_spread_join_gives_the_rows_of_a_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    many = many.unionByName(spark.range(3).select(F.lit(None).cast("long").alias("k"), F.col("id")))
    few = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(many, ["k"], parts=10, many=100)
    assert [r["k"] for r in hot.collect()] == [7]
    key = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()), key=repr)
    assert key(skew.spread_join(many, few, ["k"], hot, "id", salts=8)) == key(many.join(few, "k"))
    assert skew.hot_keys(many, ["k"]) is None


def test_evaluation(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "qid long, row long")
    f = spark.createDataFrame([(1, 1), (1, 9), (2, 2), (2, 1)], "qid long, row long")
    assert evaluation.recall(t, f, 2).first()["recall"] == 0.75
    s = spark.createDataFrame([(1, r, float(r), float(-r)) for r in range(5)], "qid long, row long, a double, b double")
    assert math.isclose(evaluation.spearman(s, "a", "b").first()["rho"], -1.0)
    g = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 1)], "qid long, rank long, grade int")
    i = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 0)], "qid long, rank long, grade int")
    want = (3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3))
    assert math.isclose(evaluation.ndcg(g, i, 3).first()["ndcg"], want)


def test_merkle(spark):
    import hashlib

    for n in (0, 1, 2, 5, 13):
        d = spark.createDataFrame([(i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)], "row long, sha256 string")
        h = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        while len(h) > 1:
            h = [hashlib.sha256(h[i] + h[min(i + 1, len(h) - 1)]).digest() for i in range(0, len(h), 2)]
        assert mutation.merkle_root(d) == mutation.merkle_root(d, subtree=4) == mutation.merkle_frame(d).first()["root"] == (h[0].hex() if h else "0" * 64)


def test_embedders():
    e = embedding.HashEmbedder(16, {"query": "q: ", "document": ""}, batch_size=2)
    texts = ["long text of words", "a", "", "words", "other words here"]
    x = e.encode(texts)
    assert x.dtype == np.float32 and x.shape == (5, 16) and np.allclose(x, [e.encode([t])[0] for t in texts])
    assert (x[2] == 0).all() and np.allclose(np.linalg.norm(x[[0, 3, 4]], axis=1), 1, atol=1e-6)
    assert not np.allclose(e.encode(["words"], prompt="query") if False else e._vectors(["query words"]), e._vectors(["words"]))
    seen = []

    class Odd(embedding.Embedder):
        full_dim = 4

        def _vectors(self, t):
            seen.append([len(x) for x in t])
            return np.zeros((len(t), 4 if len(t[0]) < 9 else 3))

    assert Odd(batch_size=2).encode(["xxx", "x", "xx", "x"]).shape == (4, 4) and seen == [[1, 1], [2, 3]]
    with pytest.raises(ValueError):
        Odd().encode(["x" * 10])
    assert embedding.version("v1.12.3") == (1, 12) and embedding.version("main") is None
    assert embedding.new_enough("1.12", "1.9") and not embedding.new_enough("1.8", "1.9") and embedding.new_enough(None, "1.9")


def test_floors():
    assert dense.resolve_floor(None, None, 10, 64, None) is None and dense.resolve_floor("off", 0.5, 10, 64, None) is None
    assert dense.resolve_floor(0.0, 0.5, 10, 64, None) == 0.0 and dense.resolve_floor(None, 0.5, 10, 64, None) == 0.5
    assert dense.resolve_floor("auto", None, 1000, 128, None) == dense.auto_floor(1000, 128) > 0.5
    for bad in (-0.1, 1.1, "x", True):
        with pytest.raises(ValueError):
            dense.check_floor(bad)


def test_only_a_local_master_gets_a_folder_of_its_own(spark, monkeypatch):
    from brindle import session as S

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        S.shared_dir(type("X", (), {"conf": Conf(), "sparkContext": Context()})())
    at = S.mark()
    keep = S.stored(spark.range(3))
    S.stored(spark.range(4))
    assert S.dropped(spark, at, 0) == 2 and S.mark() == at
    with pytest.raises(Exception):
        keep.count()
