"""What must hold for tables that outgrow a task or the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import lexical

DOCS = [(0, "red green green"), (1, "red blue"), (2, ""), (3, None), (4, "x y z"), (5, "the red the blue the"), (6, "green the")]


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame(DOCS, "row long, text string")
    c = lexical.term_counts(docs)
    assert "Exchange" not in c._jdf.queryExecution().executedPlan().toString()
    assert _rows(c, "row", "token", "tf") == sorted((i, w, t.split().count(w)) for i, t in DOCS for w in set((t or "").split()) if len(w) > 1)


@pytest.mark.parametrize("tokens", [["the", "green"], ["none"], []])
def test_postings_of_some_tokens_have_the_statistics_of_all(spark, tokens):
    docs = spark.createDataFrame(DOCS, "row long, text string")
    some = lexical.postings(docs, tokens=tokens)
    assert _rows(some, "row", "token", "tf", "impact") == _rows(lexical.postings(docs).where(F.col("token").isin(*tokens) if tokens else F.lit(False)), "row", "token", "tf", "impact")


def test_searches_write_no_more_than_their_tokens_postings(spark, monkeypatch):
    from brindle.plans import catalog

    seen, real = [], lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, *a: seen.append(df := real(df, *a)) or df)
    sf = "/root/testdata/sf0.001"
    for name in ("bm25_search_top10", "rrf_hybrid", "weighted_hybrid", "bm25_batch_topk"):
        catalog.queries()[name](spark, sf)
    of_all = lexical.term_counts(catalog._docs(spark, sf)).count()
    assert seen and all(d.count() < of_all / 2 for d in seen)


def test_no_texts_or_postings_reach_the_driver(spark, tmp_path, monkeypatch):
    from brindle.functions.embedding import HashEmbedder
    from brindle.sources import archive as A

    def refused(df, *a, **kw):
        assert not {"text", "body", "token", "code"} & set(df.columns), df.columns
        return real(df, *a, **kw)

    real = DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    e, q = HashEmbedder(64), A.SignCodec(64, 2, 1, "srht")
    d = spark.createDataFrame([(i, i, f"c{i}", f"text {i} of {i % 7}", '{"n": %d}' % i, i % 5 == 0) for i in range(60)], "row long, pos long, chunk_id string, text string, meta string, tombstone boolean")
    rows = e.attach(d).withColumn("code", q.packed(F.col("vector"))).repartition(5)
    one, two = str(tmp_path / "a.kb"), str(tmp_path / "a.kbi")
    A.write_v1(rows, one, e, q)
    A.write_v2(rows, two, A._embedder(e), e.prompts, q, 64, shard_max_bytes=300)
    want = [(i, f"c{i}", f"text {i} of {i % 7}") for i in range(60)]
    assert _rows(A.read(spark, one), "row", "chunk_id", "text") == _rows(A.read(spark, two), "row", "chunk_id", "text") == want
    a = A.Archive(two)
    p = lexical.postings(d.where("not tombstone")).withColumn("impact", F.col("impact").cast("float").cast("double"))
    monkeypatch.setattr(A, "POSTINGS", 16)
    assert _rows(a.postings(spark), "row", "token", "impact") == _rows(p, "row", "token", "impact")
    assert "Broadcast" not in a.postings(spark)._jdf.queryExecution().executedPlan().toString()
    assert _rows(a.postings(spark, ["of"]), "row", "token", "impact") == _rows(p.where("token = 'of'"), "row", "token", "impact")


def test_more_shards_than_two_bytes_number():
    from brindle.sources import archive as A

    e = np.array([(4464, 0, 1, 7, 9, 0), (3, 0, 0, 0, 5, 0)], A.ENTRY)
    assert A.ENTRY.itemsize == A.MAP.size and A._places("s/", e) == [("s/shard-70000.bin", 7, 9), ("s/shard-0003.bin", 0, 5)]


def test_a_root_folds_as_hashes_come(monkeypatch):
    import hashlib

    from brindle.operators import mutation

    monkeypatch.setattr(mutation, "SUBTREE", 4)
    for n in range(1, 23):
        h = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        assert mutation.folded(iter(h)) == mutation._fold(h)


def test_a_vocabulary_is_read_in_pieces(tmp_path, monkeypatch):
    import json
    import zipfile

    from brindle.sources import archive as A

    want = {f'w"\\{i}é\n': i for i in range(50)}
    for text, ok in ((json.dumps(want), True), (json.dumps(want, ensure_ascii=False, indent=1), True), ("{}", True), (" { } ", True), (json.dumps(want)[:-9], False), ("", False), ("[1]", False)):
        with zipfile.ZipFile(tmp_path / "v", "w") as z:
            z.writestr(A.BM25[4], text)
        for block in (7, 64, 1 << 20):
            monkeypatch.setattr(A, "BLOCK", block)
            a = object.__new__(A.Archive)
            a.zip = zipfile.ZipFile(tmp_path / "v")
            if ok:
                assert dict(a.vocab()) == (want if "w" in text else {})
            else:
                with pytest.raises(ValueError):
                    list(a.vocab())


def _weights(spark, ix):
    live = ix.hot.where("not tombstone").select("row").join(ix.cold.select("row", "text"), "row")
    return [(r, t, round(x, 9)) for r, t, x in _rows(lexical.postings(live), "row", "token", "impact")]


def test_a_version_adds_only_its_own_rows_postings(spark, tmp_path):
    from brindle.functions.embedding import HashEmbedder
    from brindle.plans.index import Index, IndexWriter

    e, path = HashEmbedder(32), str(tmp_path / "ix")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, text string, pos long")
    w = IndexWriter.create(spark, path, e, dim=32, k=2)
    w.add_chunks(rows(("a", "red green green", 2), ("b", "the red fox", 0), ("c", "", 1), ("d", "the the end", 3)))
    w.commit()
    w.update_chunks(["a"], rows(("a", "green end of all", 0)))
    w.delete_chunks(["d"])
    w.commit()
    assert {r["row"] for r in spark.read.parquet(f"{path}/postings/v=2").collect()} == {4}
    for v in (1, 2):
        ix = Index(spark, path, v)
        assert [(r, t, round(x, 9)) for r, t, x in _rows(ix.impacts(), "row", "token", "impact")] == _weights(spark, ix)
    assert [r["chunk_id"] for r in ix.search("green", embedder=e, k=2, alpha=0.0, min_sim="off").collect()][0] == "a" and w.m["n_tokens"] == 7
    w.compact()
    ix = Index(spark, path)
    assert [(r, t, round(x, 9)) for r, t, x in _rows(ix.impacts(), "row", "token", "impact")] == _weights(spark, ix)
    assert _rows(ix.hot, "row", "chunk_id") == [(0, "b"), (1, "c"), (2, "a")] and ix.manifest["postings"] == [3] == ix.manifest["cold"]


def test_an_index_with_weights_for_postings_goes_on(spark, tmp_path):
    import json

    from brindle.functions.embedding import HashEmbedder
    from brindle.plans.index import Index, IndexWriter

    e, path = HashEmbedder(32), str(tmp_path / "ix")
    rows = spark.createDataFrame([("a", "red green green", 0), ("b", "the red fox", 1)], "chunk_id string, text string, pos long")
    w = IndexWriter.create(spark, path, e, dim=32, k=2)
    w.add_chunks(rows)
    w.commit()
    hot, cold = w.hot().drop("dl").localCheckpoint(), w.cold()
    hot.write.mode("overwrite").parquet(f"{path}/hot/v=1")
    lexical.postings(cold.select("row", "text")).write.mode("overwrite").parquet(f"{path}/postings/v=1")
    m = json.load(open(f"{path}/manifests/v=1.json"))
    for f in (tmp_path / "ix" / "manifests").iterdir():
        f.unlink()
    (tmp_path / "ix" / "manifests" / "v=1.json").write_text(json.dumps({k: v for k, v in m.items() if k not in ("postings", "n_tokens")}))
    one = Index(spark, path)
    assert [(r, t, round(x, 9)) for r, t, x in _rows(one.impacts(), "row", "token", "impact")] == _weights(spark, one)
    w = IndexWriter.open(spark, path, e)
    w.update_chunks(["b"], spark.createDataFrame([("c", "a new fox")], "chunk_id string, text string"))
    w.commit()
    two = Index(spark, path)
    assert [(r, t, round(x, 9)) for r, t, x in _rows(two.impacts(), "row", "token", "impact")] == _weights(spark, two) and two.manifest["n_tokens"] == 5


def test_texts_are_shuffled_once_by_a_commit(spark, tmp_path, monkeypatch):
    from brindle.functions.embedding import HashEmbedder
    from brindle.operators import mutation
    from brindle.plans import index as I

    def watched(df, *a):
        assert "text" not in df.columns
        return real(df, *a)

    real = I.stored
    for mod in (I, mutation, lexical):
        monkeypatch.setattr(mod, "stored", watched)
    rows = lambda n: spark.createDataFrame([(str(i), f"text {i % n}") for i in range(20)], "chunk_id string, text string")
    w = I.IndexWriter.create(spark, str(tmp_path / "ix"), HashEmbedder(32), dim=32, k=2)
    w.add_chunks(rows(20))
    w.commit()
    w.sync(rows(15))
    w.commit()
    assert w.compact() == 3 and w.live_count == w.total_rows == 20


def test_blocks_give_only_their_nearest_codes(spark):
    from brindle.operators import dense

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(rng.integers(0, 16, 300))], "row long, code array<long>")
    q = df.where("row < 4").select(F.col("row").alias("qid"), F.col("code").alias("q"))
    d = dense.distances(df, q, 10)
    assert d.count() == 4 * 10  # one block
    order = [F.col("dist"), F.col("row")]
    pick = lambda x: _rows(dense.batch(x, 10, order), "qid", "row", "dist", "dense_rank")
    assert pick(d) == pick(dense.distances(df, q)) and pick(dense.distances(df, q, 500)) == _rows(dense.batch(dense.distances(df, q), 500, order).where("dense_rank <= 10"), "qid", "row", "dist", "dense_rank")


def test_rank_correlations_without_pairs(spark):
    from brindle.operators import dense, evaluation

    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, (90, 4)).astype(float)  # with many ties, and products of minus zero
    df = spark.createDataFrame([(i, v.tolist(), [int(c)]) for i, (v, c) in enumerate(zip(x, rng.integers(0, 8, 90)))], "row long, embedding array<double>, code array<long>").repartition(3)
    q = df.where("row % 9 = 0").select(F.col("row").alias("qid"), F.col("embedding").alias("q"), F.col("code").alias("qcode"))
    got = {r["qid"]: r["rho"] for r in dense.rank_correlations(df, q, block=3).collect()}
    h = dense.distances(df, q.select("qid", F.col("qcode").alias("q"))).select("qid", "row", (-F.col("dist")).alias("h"))
    s = dense.products(df, q).select("qid", "row", F.round("sim", 9).alias("s")).join(h, ["qid", "row"])
    want = {r["qid"]: r["rho"] for r in evaluation.spearman(s, "s", "h").collect()}
    assert set(got) == set(want) and len(got) == 10 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_texts_are_scored_where_they_are_read(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([*DOCS, *((i, " ".join(rng.choice(["red", "green", "the", "fox", "end"], rng.integers(0, 9)))) for i in range(7, 200))], "row long, text string").repartition(4)
    q = spark.createDataFrame([(10, "red"), (20, "green red green"), (30, "?"), (40, "nowhere"), (50, "the end fox blue")], "qid long, text string")
    cols = ("qid", "lex_rank", "row", "score")
    got, real = {}, lexical.search_many
    want = _rows(real(lexical.postings(docs), q, 4), *cols)
    monkeypatch.setattr(lexical, "search_many", lambda *a: got.setdefault("joined", True) and real(*a))
    assert _rows(lexical.search_texts(docs, q, 4), *cols) == want and len(want) == 12 and not got
    monkeypatch.setattr(lexical, "HELD", 3)
    assert _rows(lexical.search_texts(docs, q, 4), *cols) == want and got
    assert lexical.search_texts(docs, q.where("qid = 30"), 4).count() == 0
