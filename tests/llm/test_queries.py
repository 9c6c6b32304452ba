"""The ten queries and the pipeline on whole tables: against their SQL, against brute force, or by held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_check import same

import __spark_entry__
import corpus_pipeline
from brindle.llm import language, pii, quality, queries, repeats, suffix_dedup, window_dedup
from brindle.session import dropped, mark

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same(spark, Q[name], SQL[name], SF)


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if re.match(r"op\d", n)] == list(Q) and len(Q) == 10 and "pipeline" in names


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def _grams(text):
    """The profile's n-grams, by strings and a counter."""
    words = "".join(ch if ch.isalpha() else " " for ch in text).split()
    p = "\1".join(["", *("".join(x.lower() if len(x.lower()) == 1 else x for x in w) for w in words), ""])
    c = Counter(x for x in p if x != "\1")
    c.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1) if words)
    return c


def _code(g):
    return sum(ord(x) << 21 * i for i, x in enumerate(g))


def _ranked(c):
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], _code(x[0])))][:300]


def test_op1_against_counters(spark, docs):
    total = defaultdict(Counter)
    for r in docs:
        if crc(r["doc_id"], 4) != 2 and r["lang"] is not None and r["text"] is not None:
            total[r["lang"]] += _grams(r["text"])
    place = {k: {g: i for i, g in enumerate(_ranked(c))} for k, c in total.items()}
    got = {r["doc_id"]: r for r in Q["op1_language_id"](spark, SF).collect()}
    for r in docs:
        top = _ranked(_grams(r["text"] or ""))
        far = {k: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(top)) for k, p in place.items()}
        want = min(sorted(far), key=far.get) if top else "und"
        assert got[r["doc_id"]]["lang_pred"] == want and got[r["doc_id"]]["held_out"] == (crc(r["doc_id"], 4) == 2)
        assert abs(got[r["doc_id"]]["score"] - (1 - far[want] / (300 * len(top)) if top else 0)) < 1e-9


def test_op1_profiles_have_no_gram_across_documents(spark):
    d = spark.createDataFrame([("ab", "x")] * 50 + [("c", "y")], "text string, lang string")
    p = language.learn(d)
    assert set(p["x"]) == {_code(g) for g in ("a", "b", "\1a", "ab", "b\1", "\1ab", "ab\1")} and set(p["y"]) == {_code(g) for g in ("c", "\1c", "c\1", "\1c\1")}


def test_op1_held_out(spark):
    d = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    r = Q["op1_language_id"](spark, BIG).join(d, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert r.where("lang = lang_pred").count() / r.count() > 0.99


def test_op10_held_out(spark):
    lab = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    r = Q["op10_quality"](spark, BIG).join(lab, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    rank = r.score.rank().to_numpy()
    pos = r.quality.to_numpy() == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.99 and (r.predicted == r.quality).mean() > 0.97


def test_op10_against_plain_algebra(spark):
    rng = np.random.default_rng(0)
    x = {k: rng.standard_normal((40, 14)) * (1 + k) + k for k in (0, 1)}
    m = quality.Discriminant({k: (40, v.sum(0), v.T @ v) for k, v in x.items()}, shrink=0.2, ridge=1e-3)
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (cov[0] + cov[1]) / 2
    g = []
    y = rng.standard_normal((9, 14))
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-3 * np.eye(14)
        z = y - x[k].mean(0)
        g.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(m.scores(y), 1 / (1 + np.exp(g[0] - g[1])))


def test_op9_against_all_strings(spark, docs):
    seen = Counter()
    for r in docs:
        b = (r["text"] or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    got = {r["doc_id"]: r for r in Q["op9_suffix_dedup"](spark, SF).collect()}
    for r in docs:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op9_hot_anchors_and_parts_give_the_same(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()))
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    want = rows(suffix_dedup.dedup(d, with_text=False))
    assert rows(suffix_dedup.dedup(d, hot=2, with_text=False)) == want
    monkeypatch.setattr(repeats, "PART", 1000)
    buf = np.frombuffer((" ".join(r["text"] or "" for r in d.limit(5).collect())).encode(), np.uint8)
    for length in (50, 200):
        sym = suffix_dedup._BYTE[buf]
        one = _windows_of(sym, length, 1 << 22)
        assert _windows_of(sym, length, 1000) == one


def _windows_of(sym, length, part):
    """All windows that the contexts of a text cover, part by part, with their anchors."""
    from brindle.llm._text import prefix

    out = set()
    for x in range(0, len(sym), part):
        y = sym[x : x + part + length - 1]
        g, _, a, off, m = repeats.anchors(y, prefix(y), np.full(len(y), len(sym) - x), length, 16)
        out |= {(int(q), int(s + x)) for q, b, n in zip(g, a, m) for s in range(b, b + n - length + 1)}
    return out


def test_op9_suffix_sort():
    from brindle.llm._text import _BYTE, prefix

    rng = np.random.default_rng(1)
    buf = rng.integers(0, 2, 400).astype(np.uint8) + 97
    at, size = np.arange(0, 390), 400 - np.arange(0, 390)
    group = np.arange(390) % 3
    order = suffix_dedup.suffix_sort(buf, prefix(_BYTE[buf]), at, size, group)
    raw = buf.tobytes()
    assert order.tolist() == sorted(range(390), key=lambda i: (group[i], raw[i:]))


def test_op3_long_texts_in_parts(spark, monkeypatch):
    base = " ".join(f"w{i % 83}" for i in range(400))
    d = spark.createDataFrame([(1, base), (2, "x " + base + " y"), (3, base[:300])], "doc_id long, text string")
    r = {x["doc_id"]: x["n_removed"] for x in window_dedup.dedup(d).collect()}
    assert r[1] == 0 and r[2] == 400 and r[3] == len(base[:300].split()) - (0 if base[300] == " " else 1)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def _base(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= sum(c.isdigit() for c in m.group()) <= 19 and _luhn(m.group()) % 10 == 0]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_op7_against_plain_patterns(spark, docs):
    extra = ["a@b.c@d.e x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (212) 555-0100 +49.30.123456 +1 2", "0001.2.3.4 é@é.de mail é.x@y.zz"]
    got = {r["doc_id"]: r for r in Q["op7_pii"](spark, SF).collect()}
    for r in docs:
        want = _base(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{z}" for k, a, z in want) <= set(g["spans"].split(","))
    for t in extra:
        assert pii.base_spans(t) == _base(t), t


def test_op7_tagger():
    t = pii.trained()
    rng = np.random.default_rng(0)
    n = len(t.labels)
    for size in (1, 2, 5):
        e = rng.standard_normal((size, n))
        e[0, ~t.begins] = -1e9
        go = np.where(t.allowed, t.pass_, -1e9)

        def score(y):
            return e[0, y[0]] + sum(go[y[i - 1], y[i]] + e[i, y[i]] for i in range(1, size))

        best = t.viterbi([e, rng.standard_normal((7, n))])[0]
        sample = [list(rng.integers(0, n, size)) for _ in range(3000)]
        assert score(best) >= max(map(score, sample)) - 1e-9
    texts = ['token = "9ac699e1188f96204dbebab91ab85687d33eeaaf" here', "her ssn 219-09-1234 was read", "phone: (415) 555-2671 now", "the year 1984 had 12 months"]
    kinds = [[s[0] for s in spans] for _, spans in pii.find(texts, t)]
    assert kinds == [["secret"], ["ssn"], ["phone"], []]


def test_op7_is_linear_in_long_texts():
    import resource
    import time

    t = pii.trained()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.time()
    (_, spans), *rest = pii.find(["17 " * 100_000, *["a 5 b"] * 511], t)
    many = " ".join(f"a{i}@b.com token = 9ac699e1188f96204dbe{i:05d}bab91ab85687d33eea" for i in range(4000))
    base, all_ = pii.find([many], t)[0]
    assert len(base) == 4000 and len(all_) > 6000
    assert time.time() - start < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_pipeline_against_its_stages_by_hand(spark):
    """The rows that run() gives: what each stage keeps follows from the queries that have SQL or brute force of their own."""
    at = mark()
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lang = {r["doc_id"] for r in Q["op1_language_id"](spark, SF).where("lang_pred <> 'und' and score > 0").collect()}
    kept = spark.createDataFrame([docs[i] for i in sorted(lang)], "doc_id long, text string, lang string, source string, n_chars long")
    from brindle.llm import decontamination, near_duplicates

    comp = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_duplicates.link(kept).collect()}
    one = {i for i in lang if comp[i][0] == i or not comp[i][1]}
    leak = {r["doc_id"] for r in decontamination.leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    one -= leak
    assert lang and leak and one < lang
    masked = {}
    for i in sorted(one):
        (_, spans), out, end = pii.find([docs[i]["text"] or ""], pii.trained())[0], [], 0
        for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [docs[i]["text"][end:a], f"<{k}>"]
            end = max(end, z)
        masked[i] = "".join(out) + (docs[i]["text"] or "")[end:] if spans else docs[i]["text"]
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= one and max(copies.values()) <= 3 and all(r["text"] == masked[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert all(sorted(r["copy_no"] for r in got if r["doc_id"] == i) == list(range(1, n + 1)) for i, n in copies.items())
    # words by source against the targets
    size = {i: len((t or "").split()) for i, t in masked.items()}
    src = defaultdict(int)
    for i in masked:
        src[docs[i]["source"]] += size[i]
    names = sorted(src, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(src.values())
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 3 * src[s]}
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 3 * src[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    took = defaultdict(int)
    for i, n in copies.items():
        took[docs[i]["source"]] += n * size[i]
    for s in names:
        assert abs(took[s] - target[s]) <= max(size[i] for i in masked if docs[i]["source"] == s)
    dropped(spark, at)
