"""Command line: pack, sync, query, info and migrate, with JSON results."""

from __future__ import annotations

import argparse
import json
import os
import sys

from brindle.functions.embedding import HashEmbedder
from brindle.session import session


def _embedder_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--full-dim", type=int, default=256, help="width of the embedder's vectors")
    p.add_argument("--batch-size", type=int, default=64, help="texts that go through the embedder together")
    p.add_argument("--query-prompt", default="")
    p.add_argument("--document-prompt", default="")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="command", required=True)

    def build(name):
        c = sub.add_parser(name)
        c.add_argument("corpus")
        c.add_argument("-o", "--out", required=True)
        c.add_argument("--pattern", default="**/*")
        c.add_argument("--dim", type=int, default=256)
        c.add_argument("--k", type=int, default=8)
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--codec", choices=("sign", "levels"), default="sign")
        c.add_argument("--bits", type=int, default=4)
        c.add_argument("--source", default="")
        c.add_argument("--projection", choices=("srht", "rademacher", "haar"), default="srht")
        c.add_argument("--srht-rounds", type=int, default=3)
        c.add_argument("--rotations-quant", choices=("float32", "int8"), default="float32")
        c.add_argument("--min-sim")
        _embedder_flags(c)
        c.add_argument("--name", default="index")
        return c

    b = build("pack")
    b.add_argument("--format", choices=("index", "1", "2"), help="a versioned index, one file, or an index file with shards; by default after the name: .kb is 1, .kbi is 2")
    b.add_argument("--v2", action="store_const", const="2", dest="format")
    s = build("sync")
    s.add_argument("--compact-threshold", type=float, default=0.2)
    s.add_argument("--no-compact", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("index")
    q.add_argument("query")
    q.add_argument("--k", type=int, default=5)
    q.add_argument("--alpha", type=float)
    q.add_argument("--min-sim")
    q.add_argument("--over-fetch", type=int)
    q.add_argument("--rrf-c", type=float, default=60)
    _embedder_flags(q)
    q.add_argument("--pretty", action="store_true")
    sub.add_parser("info").add_argument("index")
    m = sub.add_parser("migrate")
    m.add_argument("file")
    m.add_argument("--out", required=True)
    m.add_argument("--shard-max-bytes", type=int, default=20 << 20)
    return p


def _floor(v):
    if v is None:
        return None
    try:
        return float(v)
    except ValueError:
        return v


def main(argv: list[str] | None = None, embedder=None, spark=None) -> int:
    from brindle.operators import mutation
    from brindle.plans.index import Files, Index, IndexWriter, pack_directory
    from brindle.sources import archive
    from brindle.sources.documents import directory_chunks

    a = _parser().parse_args(argv)
    spark = spark or session()
    say = lambda x, pretty=False: print(json.dumps(x, indent=2 if pretty else None, ensure_ascii=False, default=str))
    e = embedder or (HashEmbedder(a.full_dim, {"query": a.query_prompt, "document": a.document_prompt}, a.batch_size) if hasattr(a, "full_dim") else None)
    knobs = {}
    if a.command in ("pack", "sync"):
        knobs = {"dim": a.dim, "k": a.k, "seed": a.seed, "codec": a.codec, "bits": a.bits, "source": a.source, "projection": a.projection, "srht_rounds": a.srht_rounds, "rotations_quant": a.rotations_quant, "min_sim": _floor(a.min_sim), "name": a.name}
    kind = getattr(a, "format", None) or {".kb": "1", ".kbi": "2"}.get(os.path.splitext(getattr(a, "out", ""))[1], "index")
    if a.command == "pack" and kind != "index":
        try:
            n = archive.pack(spark, a.corpus, a.out, e, kind, pattern=a.pattern, **{k: v for k, v in knobs.items() if k != "name"})
        except ValueError as x:
            print(x, file=sys.stderr)
            return 1
        say({"file": a.out, "format": kind, "live_count": n})
    elif a.command == "pack":
        try:
            w = pack_directory(spark, a.corpus, a.out, e, pattern=a.pattern, **knobs)
        except ValueError as x:
            print(x, file=sys.stderr)
            return 1
        say({"index": a.out, "live_count": w.live_count, "version": w.version})
    elif a.command == "sync":
        c = mutation.numbered(directory_chunks(spark, a.corpus, pattern=a.pattern), ["source_path", "ord"], row="pos")
        if not c.head(1):
            print("no chunks", file=sys.stderr)
            return 1
        exists = bool(Files(spark, a.out.rstrip("/")).versions())
        w = IndexWriter.open(spark, a.out, e, _floor(a.min_sim)) if exists else IndexWriter.create(spark, a.out, e, **knobs)
        st = w.sync(c)
        w.commit()
        packed = not a.no_compact and w.should_compact(a.compact_threshold)
        if packed:
            w.compact()
        say(vars(st) | {"embedded": st.embedded, "changed": st.changed, "live_count": w.live_count, "total_rows": w.total_rows, "tombstone_ratio": round(w.tombstone_ratio, 4), "compacted": packed})
    elif a.command == "query":
        ix = archive.ArchiveIndex(spark, a.index) if a.index.endswith((".kb", ".kbi")) else Index(spark, a.index)
        hits = ix.search(a.query, embedder=e, k=a.k, alpha=a.alpha, min_sim=_floor(a.min_sim), over_fetch=a.over_fetch, rrf_c=a.rrf_c)
        ids = {r["row"]: r["chunk_id"] for r in hits.collect()}
        rows = [{"id": ids[r["row"]], "dense_distance": r["dense_dist"], "dense_sim": r["dense_sim"], "bm25_score": r["bm25_score"], "fused": r["fused"], "verified": r["verified"], "text": r["text"], "meta": r["meta"]} for r in ix.fetch(hits).collect()]
        say({"query": a.query, "fusion": "rrf" if a.alpha is None else "weighted", "hits": rows}, a.pretty)
    elif a.command == "info":
        say(archive.info(a.index) if a.index.endswith((".kb", ".kbi")) else Index(spark, a.index).info(), True)
    else:
        try:
            archive.migrate(spark, a.file, a.out, a.shard_max_bytes)
        except (ValueError, FileExistsError) as x:
            print(x, file=sys.stderr)
            return 1
        say({"out": a.out})
    return 0


if __name__ == "__main__":
    sys.exit(main())
