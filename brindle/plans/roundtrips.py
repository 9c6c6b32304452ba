"""Named queries that take the test tables through files and indexes and back: directories, both file formats, the
versioned index, the stream; and the rules by which they refuse. Each has SQL over the same tables in oracle.py."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import embedding as E
from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import dense, evaluation, mutation
from brindle.operators.codecs import LevelCodec, SignCodec
from brindle.plans import catalog as C
from brindle.plans.index import Index, IndexWriter
from brindle.session import shared_dir, stored
from brindle.sources import archive as A
from brindle.sources import documents as D
from brindle.streaming import upserts


def _folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file(spark, name: str) -> str:
    """A new file name in the shared folder, which for single files must be mounted."""
    return re.sub(r"^file:/+", "/", _folder(spark, "file")) + name


# --- directories and pages


def _tree(spark, sf) -> str:
    """The pages as files of five kinds in seven folders."""
    p = C._t(spark, sf, "pages").withColumn("k", F.col("page_id") % 5)
    md = F.concat(F.lit("---\ntitle: "), "url", F.lit("\n---\n# "), "url", F.lit("\n\n"), "html")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".md", ".txt", ".rst", ".HTML", ".bin")]), (F.col("k") + 1).cast("int"))
    path = F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), suffix)
    root = _folder(spark, "tree")
    D.write_files(p.select(path.alias("path"), F.when(F.col("k") == 0, md).otherwise(F.col("html")).alias("content")), root)
    return root


def directory_scan(spark, sf):
    """Files of known suffixes, read by kind; HTML by patterns."""
    d = D.directory(spark, _tree(spark, sf), D.HANDLERS | {".html": D.html_patterns})
    return d.select("path", F.col("meta")["kind"].alias("kind"), F.col("meta")["title"].alias("title"), F.col("meta")["frontmatter_raw"].alias("front"), F.col("meta")["source_path"].alias("source_path"), F.sha2("text", 256).alias("sha256"))


def corpus_scan(spark, sf):
    """Plain .txt and .md files of some folders, front matter kept."""
    root = _tree(spark, sf)
    some = D.directory(spark, root, {".txt": D.plain("text")}, "d[0-3]/*.txt").select("path")
    return D.corpus(spark, root).select("path", F.sha2("text", 256).alias("sha256")).join(some.withColumn("in_glob", F.lit(True)), "path", "left").withColumn("in_glob", F.coalesce("in_glob", F.lit(False)))


def html_dom_text(spark, sf):
    """Pages through the HTML parser."""
    d = C._t(spark, sf, "pages").withColumn("_d", D.html_any(F.encode("html", "utf-8")))
    return d.select("page_id", F.col("_d.text").alias("text"), F.col("_d.meta")["title"].alias("title"))


def html_metadata(spark, sf):
    """Head metadata with entities of every kind, in all quoting styles."""
    h = F.concat(
        F.lit("<html><head><TITLE>\n Caf&eacute; &#8217;&#x41; "), F.col("page_id").cast("string"), F.lit(" &amp;amp; </TITLE><meta content='d&uuml;nn &lt;"), F.col("page_id").cast("string"), F.lit("&gt; ' name=description><meta property=\"article:published_time\" content=2024-0"),
        (F.col("page_id") % 9 + 1).cast("string"), F.lit("><link rel='x canonical' href=\""), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("\"></head><body>x</body></html>"),
    )
    return C._t(spark, sf, "pages").select("page_id", T.html_title(h).alias("title"), T.html_description(h).alias("description"), T.html_url(h).alias("url"), T.html_date(h).alias("date"))


def sitemap_urls(spark, sf):
    """A sitemap of all pages, written and read."""
    p = C._t(spark, sf, "pages").select("page_id", F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("x"))
    body = p.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda r: r["x"]), "").alias("b"))  # one document, as sitemaps are
    x = body.select(F.lit("sitemap.xml").alias("path"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit("</urlset>")).alias("content"))
    root = _folder(spark, "map")
    D.write_files(x, root)
    return D.sitemap(spark, f"{root}/sitemap.xml").select(F.col("pos").cast("long").alias("pos"), "url")


# --- the two file formats


def _rows(spark, sf) -> tuple[DataFrame, SignCodec]:
    """Documents with a vector: row, pos, chunk_id, text, meta, tombstone, vector, code; Spanish ones are tombstones."""
    e = C._t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    c = SignCodec(C.DIM, C.STACKS, C.SEED, "rademacher", mean=C._mean(spark, sf))
    d = C._t(spark, sf, "documents").join(e, "doc_id")
    d = d.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.to_json(F.struct("lang")).alias("meta"), F.coalesce(F.col("lang") == "es", F.lit(False)).alias("tombstone"), "vector")
    return stored(d.withColumn("code", c.packed(F.col("vector")))), c


def _embedder(spark, sf) -> E.TableEmbedder:
    return E.TableEmbedder(C._t(spark, sf, "embeddings"), 64, "vec_id")


def _v1(spark, sf) -> str:
    d, c = _rows(spark, sf)
    out = _file(spark, "a.kb")
    A.write_v1(d, out, _embedder(spark, sf), c, "documents")
    return out


def _v2(spark, sf, **kw) -> str:
    d, c = _rows(spark, sf)
    e = _embedder(spark, sf)
    out = _file(spark, "a.kbi")
    A.write_v2(d, out, A._embedder(e), e.prompts, c, 64, shard_max_bytes=20_000, source="documents", **kw)
    return out


def _bits(code) -> F.Column:
    byte = lambda i: F.lpad(F.conv(F.substring(F.hex(code), 2 * i + 1, 2), 16, 2), 8, "0")
    return F.array_join(F.array(*[byte(i) for i in range(C.DIM * C.STACKS // 8)]), "")


def _read(spark, path: str) -> DataFrame:
    d = A.read(spark, path)
    lang = F.get_json_object("meta", "$.lang")
    return d.select("row", "chunk_id", "sha256", (F.sha2("text", 256) == F.col("sha256")).alias("verified"), lang.alias("lang"), "tombstone", _bits(F.col("code")).alias("bits"))


def archive_v1_roundtrip(spark, sf):
    return _read(spark, _v1(spark, sf))


def archive_v2_roundtrip(spark, sf):
    return _read(spark, _v2(spark, sf, with_lexical=False))


def migrate_roundtrip(spark, sf):
    """Format 1 to 2; codes, ids, texts and hashes stay."""
    a, b = _v1(spark, sf), _file(spark, "b.kbi")
    A.migrate(spark, a, b, 20_000)
    return _read(spark, b).withColumn("formats", F.lit(A.detect(a) + A.detect(b)))


def archive_postings(spark, sf):
    """The lexical index of the live rows, as the file holds it."""
    a = A.Archive(_v2(spark, sf))
    return a.postings(spark).select("row", "token", "impact")


def archive_shards(spark, sf):
    """Where each row's text is: shard and first byte."""
    a = A.Archive(_v2(spark, sf, with_lexical=False))
    return spark.createDataFrame(pa.table({"row": np.arange(a.n), "shard_id": a.shard_ids(), "byte_offset": a.map["at"].astype(np.int64)}))


def archive_search(spark, sf):
    """The first vector's twenty nearest live rows in a file of either format, fetched and verified."""
    e, out = _embedder(spark, sf), None
    for kind, path in (("1", _v1(spark, sf)), ("2", _v2(spark, sf, with_lexical=False))):
        ix = A.ArchiveIndex(spark, path)
        hits = stored(ix.search("0", embedder=e, k=20))
        f = ix.fetch(hits).select(F.lit(kind).alias("format"), F.col("rank").cast("long").alias("rank"), F.sha2("text", 256).alias("sha256"), "verified")
        f = f.join(hits.select(F.col("rank").cast("long").alias("rank"), "chunk_id", F.col("dense_dist").cast("long").alias("dist")), "rank")
        out = f if out is None else out.unionByName(f)
    return out


def _rewritten(path: str, out: str, change: dict) -> str:
    """A copy with some entries changed: by a function of their bytes, or, for the texts, of their blocks."""
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as w:
        for n in z.namelist():
            blocks = _blocks(z, n)
            if n in change:
                blocks = change[n](blocks) if n == "chunks.jsonl" else [change[n](b"".join(blocks))]
                if blocks == [None]:
                    continue
            with w.open(zipfile.ZipInfo(n), "w", force_zip64=z.getinfo(n).file_size > zipfile.ZIP64_LIMIT // 2) as f:
                for block in blocks:
                    f.write(block)
    return out


def _blocks(z: zipfile.ZipFile, name: str):
    with z.open(name) as f:
        while block := f.read(A.BLOCK):
            yield block


def _once(old: bytes, new: bytes):
    """A function of blocks that replaces the first occurrence of some bytes."""

    def run(blocks):
        rest, done = b"", False
        for block in blocks:
            rest += block
            if not done and old in rest:
                rest, done = rest.replace(old, new, 1), True
            keep = 0 if done else len(old) - 1
            yield rest[: len(rest) - keep]
            rest = rest[len(rest) - keep :]
        yield rest

    return run


def _set(key: str, value):
    def run(raw: bytes) -> bytes:
        m = json.loads(raw)
        at = m
        *path, last = key.split("/")
        for p in path:
            at = at[p]
        at[last] = value(at[last]) if callable(value) else value
        return json.dumps(m).encode()

    return run


def open_validation(spark, sf):
    """Files with one fault each: the check that finds it when the file is opened."""
    a, b = _v1(spark, sf), _v2(spark, sf)
    size = A.MAP.size

    def moved(raw: bytes) -> bytes:
        return raw[: size - 8] + (1 << 40).to_bytes(8, "little") + raw[size:]

    spaced, sha = _once(b"\n", b"\n\n"), hashlib.sha256()
    with zipfile.ZipFile(a) as z:
        for blocks in (_blocks(z, "vectors.bin"), spaced(_blocks(z, "chunks.jsonl"))):
            for block in blocks:
                sha.update(block)
    faults = {
        "no vectors": (b, {"vectors.bin": lambda r: None}), "other version": (b, {"manifest.json": _set("spec_version", "9")}), "other kind": (b, {"manifest.json": _set("kind", "x")}), "other binarizer": (b, {"manifest.json": _set("binarizer/kind", "x")}),
        "a vector short": (b, {"vectors.bin": lambda r: r[: -C.DIM * C.STACKS // 8]}), "a map entry short": (b, {"chunk_map.bin": lambda r: r[:-size]}), "id out of range": (b, {"chunk_map.bin": moved}), "id not ended": (b, {"chunk_ids.bin": lambda r: r[:-1]}),
        "id no UTF-8": (b, {"chunk_ids.bin": lambda r: b"\xff" + r[1:]}), "live count": (b, {"manifest.json": _set("chunks/live_count", lambda n: n + 1)}), "postings of other rows": (b, {A.BM25[3]: _set("num_docs", lambda n: n + 1)}), "part of the postings": (b, {A.BM25[0]: lambda r: None}),
        "chunk count": (a, {"manifest.json": _set("corpus/chunk_count", lambda n: n + 1)}), "a changed text": (a, {"chunks.jsonl": _once(b'"text": "', b'"text": "x')}), "half a vector": (a, {"vectors.bin": lambda r: r[:-1]}), "a long mean": (a, {"manifest.json": _set("binarizer/mean_vector_b64", "AAAA")}),
        "nothing": (b, {}), "nothing, format 1": (a, {}), "a blank line": (a, {"chunks.jsonl": spaced, "manifest.json": _set("corpus/build_hash", sha.hexdigest())}),
    }
    rows = []
    for name, (path, change) in faults.items():
        file = _rewritten(path, _file(spark, "f.kb"), change)
        try:
            A.Archive(file)
            rows.append((name, 0))
        except A.ArchiveError as x:
            rows.append((name, x.step))
        os.remove(file)
    return spark.createDataFrame(rows, "fault string, step long")


# --- the index


def _old(spark, sf) -> DataFrame:
    return C._snapshots(spark, sf)[0].select("chunk_id", "text", F.col("chunk_id").cast("long").alias("pos"))


def _lifecycle(spark, sf) -> str:
    """An index made of the first snapshot, reopened and synced to the second, then compacted: versions 1 to 3."""
    e, path = E.HashEmbedder(64), _folder(spark, "index")
    w = IndexWriter.create(spark, path, e, dim=32, k=4)
    w.add_chunks(_old(spark, sf))
    w.commit()
    w = IndexWriter.open(spark, path, e)
    w.sync(C._snapshots(spark, sf)[1].select("chunk_id", "text").withColumn("pos", F.lit(0).cast("long")))
    w.commit()
    w.compact()
    return path


def index_lifecycle(spark, sf):
    """Every row of every version."""
    path, out = _lifecycle(spark, sf), None
    for v in (1, 2, 3):
        d = Index(spark, path, v).hot.select(F.lit(v).cast("long").alias("version"), "row", "chunk_id", "sha256", "tombstone")
        out = d if out is None else out.unionByName(d)
    return out


def index_manifests(spark, sf):
    """What each version's manifest says of it."""
    path, rows = _lifecycle(spark, sf), []
    for v in (1, 2, 3):
        m = Index(spark, path, v).info()
        rows.append((m["version"], m["total_rows"], m["live_count"], m["merkle_root"], m["dim"], m["k"], m["projection"]))
    d = spark.createDataFrame(rows, "version long, total_rows long, live_count long, merkle_root string, dim long, k long, projection string")
    ratio = F.round(1 - F.col("live_count") / F.col("total_rows"), 9)
    return d.withColumn("tombstone_ratio", ratio).withColumn("should_compact", ratio > mutation.COMPACT_AT)


def index_cold_rows(spark, sf):
    """The texts that the last version can fetch, whole and verified."""
    ix = Index(spark, _lifecycle(spark, sf))
    return ix.cold.select("row", "chunk_id", "sha256", (F.sha2("text", 256) == F.col("sha256")).alias("verified"), F.octet_length("text").cast("long").alias("n_bytes"))


def index_update_delete(spark, sf):
    """Staged updates and deletions in one commit: old rows marked, new ones appended under other ids."""
    e, path = E.HashEmbedder(64), _folder(spark, "index")
    w = IndexWriter.create(spark, path, e, dim=32, k=4)
    w.add_chunks(_old(spark, sf))
    w.commit()
    d = C._t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "lang", "doc_id")
    de = d.where("lang = 'de'")
    w.update_chunks(de.select("chunk_id"), de.select(F.concat(F.lit("new-"), "chunk_id").alias("chunk_id"), F.concat("text", F.lit("!")).alias("text"), F.col("doc_id").alias("pos")))
    w.delete_chunks(d.where("lang = 'fr'").select("chunk_id"))
    w.commit()
    return Index(spark, path).hot.select("row", "chunk_id", "sha256", "tombstone")


def index_precoded(spark, sf):
    """An index made of codes from elsewhere; the first vector's twenty nearest rows."""
    d, c = _rows(spark, sf)
    path = _folder(spark, "index")
    w = IndexWriter.create(spark, path, _embedder(spark, sf), dim=C.DIM, k=C.STACKS, seed=C.SEED, projection="rademacher")
    w.ingest(d.select("chunk_id", "text", F.create_map().cast("map<string,string>").alias("meta"), "pos", c.column(F.col("vector")).alias("code")), mean=C._mean(spark, sf))
    ix = Index(spark, path)
    top = dense.ranked(ix.dense(C._query_vector(spark, sf)), [F.col("dense_dist"), F.col("row")], 20, "rank")
    return top.select("row", F.col("dense_dist").cast("long").alias("dist"), F.col("rank").cast("long").alias("rank"))


def stream_upserts(spark, sf):
    """The documents as a stream of changes in two files, the later of which deletes and edits; what is live in the end."""
    src, root = _folder(spark, "changes"), _folder(spark, "stream")
    d = C._t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "lang", "source")
    day = lambda n: F.timestamp_seconds(F.lit(86400 * n))
    d.select("chunk_id", "text", F.lit(False).alias("deleted"), day(1).alias("changed_at")).write.mode("append").json(src)
    e = E.HashEmbedder(64)
    upserts.follow(spark, src, f"{root}/index", e, f"{root}/at", once=True, dim=32, k=4).awaitTermination()
    late = d.where("lang = 'es' or source = 'src1'")
    late.select("chunk_id", F.concat("text", F.lit(" (edited)")).alias("text"), (F.col("lang") == "es").alias("deleted"), day(2).alias("changed_at")).write.mode("append").json(src)
    upserts.follow(spark, src, f"{root}/index", e, f"{root}/at", once=True, dim=32, k=4).awaitTermination()
    return Index(spark, f"{root}/index").hot.where("not tombstone").select("chunk_id", "sha256")


# --- rules


def _refused(fn) -> str:
    """The kind of error that a call ends in."""
    try:
        r = fn()
        if isinstance(r, DataFrame):
            r.collect()
        return "none"
    except Exception as x:  # the kind is the result
        return type(x).__name__


def refusals(spark, sf):
    """What must be refused, and how it is."""
    e, path = E.HashEmbedder(64), _folder(spark, "index")
    w = IndexWriter.create(spark, path, e, dim=32, k=4)
    one = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    w.add_chunks(one)
    w.commit()

    def staged(stage):
        x = IndexWriter.open(spark, path, e)
        stage(x)
        return x.commit()

    rough = E.HashEmbedder(64)
    rough.normalize_l2 = False
    v1 = _v1(spark, sf)
    model = _file(spark, "model.bin")
    with open(model, "wb") as f:
        f.write(b"model")
    code = spark.createDataFrame([([1, 2], [1])], "a array<long>, b array<long>")
    cases = {
        "delete of an unknown id": lambda: staged(lambda x: x.delete_chunks(["zzz"])), "a live id again": lambda: staged(lambda x: x.add_chunks(one)), "an update under the same id": lambda: staged(lambda x: x.update_chunks(["a"], one.where("chunk_id = 'a'"))), "nothing staged": lambda: staged(lambda x: None),
        "create where one is": lambda: IndexWriter.create(spark, path, e), "open where none is": lambda: IndexWriter.open(spark, path + "x", e), "another embedder": lambda: IndexWriter.open(spark, path, E.HashEmbedder(32)), "unknown setting": lambda: IndexWriter.create(spark, path + "y", e, depth=3),
        "levels of rough vectors": lambda: IndexWriter.create(spark, path + "z", rough, codec="levels", dim=64), "a floor beyond 1": lambda: dense.check_floor(1.5), "a floor of a word": lambda: dense.check_floor("high"), "a floor off": lambda: dense.check_floor("none"),
        "dim of 12": lambda: SignCodec(12, 1), "nine bits": lambda: LevelCodec(64, 9), "codes of other widths": lambda: code.select(V.hamming(F.col("a"), F.col("b"))), "code of another width": lambda: code.select(V.hamming_literal(F.col("a"), [1])), "code of its width": lambda: code.select(V.hamming_literal(F.col("b"), [1])),
        "migrate onto a file": lambda: A.migrate(spark, v1, v1), "no zip file": lambda: A.detect(model), "a changed download": lambda: E.verified(model, "0" * 64), "a download": lambda: E.verified(model, "9372c470eeadd5ecd9c3c74c2b3cb633f8e2f2fad799250a0f70d652b6b825e4"), "unknown prompt": lambda: e.encode(["a"], prompt="x"),
        "old version": lambda: None if E.new_enough("1.9", "2.0") else 1 / 0, "odd version": lambda: None if E.new_enough("main", "2.0") else 1 / 0, "compact of nothing": lambda: IndexWriter.create(spark, path + "w", e, dim=32, k=4).compact(),
    }
    return spark.createDataFrame([(k, _refused(f)) for k, f in cases.items()], "case string, error string")


def floor_rules(spark, sf):
    """The floor in force, for what the caller and the index say."""
    n = C._emb(spark, sf).count()
    rows = [(str(a), str(b), dense.resolve_floor(a, b, n, 128, None), dense.resolve_floor(a, b, n, None, 32)) for a in (None, "off", "auto", 0.25) for b in (None, "off", "auto", 0.75)]
    return spark.createDataFrame(rows, "given string, kept string, hamming double, cosine double").withColumns({c: F.round(c, 9) for c in ("hamming", "cosine")})


# --- codecs


def multibit_cosine(spark, sf):
    """Cosines of the decoded codes (four bits, no rotation) with the first vector."""
    c = LevelCodec(64, 4, rotation=np.eye(64))
    e = C._emb(spark, sf).withColumn("code", c.column(F.col("embedding")))
    return e.select(F.col("row").alias("vec_id"), F.round(c.similarity(F.col("code"), C._query_vector(spark, sf)), 6).alias("cosine"))


def mean_cosine(spark, sf):
    """How near its decoded code (two bits, no rotation) each vector is, on average."""
    c = LevelCodec(64, 2, rotation=np.eye(64))
    e = C._emb(spark, sf).select("embedding", c.decoded(c.column(F.col("embedding"))).alias("back"))
    return evaluation.mean_cosine(e, "embedding", "back").select(F.round("cosine", 6).alias("cosine"))


def codec_fidelity(spark, sf, n: int = 2000, d: int = 256, queries: int = 200):
    """Recall at 5 and 10 and rank correlation of codes against exact scores, on isotropic unit vectors made here."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, embedding array<double>").repartition(8))
    q = e.where(F.col("row").isin(rng.choice(n, queries, replace=False).tolist())).select(F.col("row").alias("qid"), F.col("embedding").alias("q"))
    truth = stored(dense.products(e, q))
    out = None
    for bits, kind in ((1, "levels"), (2, "levels"), (4, "levels"), (8, "levels"), (2, "sign"), (4, "sign"), (8, "sign")):
        if kind == "levels":
            c = LevelCodec(d, bits, 0)
            found = dense.products(e.withColumn("embedding", c.decoded(c.column(F.col("embedding")))), q).withColumnRenamed("sim", "s")
        else:
            c = SignCodec(d, bits, 0, "haar", mean=x.mean(0))
            s = e.withColumn("code", c.column(F.col("embedding")))
            qc = q.withColumn("q", c.column(F.col("q")))
            found = dense.distances(s, qc).select("qid", "row", (-F.col("dist").cast("double")).alias("s"))
        both = stored(truth.join(found, ["qid", "row"]))
        rank = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "row"))
        r = both.withColumn("a", rank("sim")).withColumn("b", rank("s"))
        m = r.groupBy("qid").agg((F.count_if((F.col("a") <= 5) & (F.col("b") <= 5)) / 5).alias("r5"), (F.count_if((F.col("a") <= 10) & (F.col("b") <= 10)) / 10).alias("r10"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("rho"))
        m = m.agg(F.round(F.avg("r5"), 3).alias("recall5"), F.round(F.avg("r10"), 3).alias("recall10"), F.round(F.avg("rho"), 3).alias("rho"))
        m = m.select(F.lit(kind).alias("codec"), F.lit(bits).alias("bits"), F.lit(c.row_bytes).alias("row_bytes"), "recall5", "recall10", "rho")
        out = m if out is None else out.unionByName(m)
    return out


QUERIES = [
    directory_scan, corpus_scan, html_dom_text, html_metadata, sitemap_urls, archive_v1_roundtrip, archive_v2_roundtrip, migrate_roundtrip, archive_postings, archive_shards, archive_search, open_validation,
    index_lifecycle, index_manifests, index_cold_rows, index_update_delete, index_precoded, stream_upserts, refusals, floor_rules, multibit_cosine, mean_cosine, codec_fidelity,
]
