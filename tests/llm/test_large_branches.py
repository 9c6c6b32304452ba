"""Branches that only large tables take, on small ones: regions and anchors above the bounds give the same rows as below them."""

from collections import Counter

import pytest

from brindle.llm import _tables, near_duplicates, suffix_dedup

BASE = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def near(spark):
    """A group of near copies, each with a word or two replaced, two other groups linked to it by a chain, copies, and texts of their own."""
    texts = []
    for i in range(90):
        w = list(BASE)
        w[4 * i] = f"x{i}"
        w[(4 * i + 160) % 400] = f"y{i % 3}"
        texts.append(" ".join(w))
    for j in range(0, 120, 3):
        texts.append(" ".join([*BASE[j // 3 :], *[f"v{i}" for i in range(j // 3)]]))
    texts += [" ".join(f"z{i * k % 61}" for k in range(300)) for i in range(1, 30)]
    texts += texts[:20]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).localCheckpoint()


def rows(df):
    return sorted(map(tuple, df.collect()))


def by_hand(docs):
    """doc_id, n_shingles, n_similar, component_id, all pairs compared."""
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    s = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    links = {i: [j for j in s if j != i and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j])] for i in s}
    root = {}
    for i in sorted(s):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return sorted((i, len(s[i]), len(links[i]), root[i]) for i in s)


@pytest.fixture(scope="module")
def want(near):
    return by_hand(near)


@pytest.mark.parametrize("block", [2048, 40, 7])
def test_stage_two_of_the_pipeline_splits_large_regions(near, want, block):
    got = near_duplicates.representatives(near, block)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for *_, c in want})


@pytest.mark.parametrize("block, size", [(40, 32 << 20), (7, 32 << 20), (2048, 20_000)])
def test_op6_links_all_in_large_regions(near, want, monkeypatch, block, size):
    monkeypatch.setattr(near_duplicates, "BYTES", size)
    assert rows(near_duplicates.link(near, block)) == want


def test_op6_copies_a_region_that_pivots_do_not_split_once_a_block(near, monkeypatch):
    """A group of near copies has every pivot in reach: cells would hold it 16 times a level."""
    got = []
    whole = near_duplicates._split
    monkeypatch.setattr(near_duplicates, "_split", lambda r, b: got.append((r, whole(r, b))) or got[-1][1])
    near_duplicates.link(near.where("doc_id < 90"), 30)
    (before, after), = got
    assert before.count() == 90 and after.count() <= 90 * 7 and max(r["count"] for r in after.groupBy("region", "path", "a", "z").count().collect()) < 60


def test_op6_parts_without_rows(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BYTES", 4000)
    w = [f"u{i}" for i in range(3000)]
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w, "end"])), (3, " ".join(w[:2000]))], "doc_id long, text string")
    assert rows(near_duplicates.link(d)) == by_hand(d)


def removed(docs, length=200):
    """doc_id and how many bytes go, from all strings of ``length`` bytes."""
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    seen = Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    out = []
    for d, b in sorted(texts.items()):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, sum(gone)))
    return out


@pytest.mark.parametrize("many", [1 << 16, 10])
def test_op9_tells_hot_anchors_by_hash(near, monkeypatch, many):
    """Anchors in more contexts than ``hot`` aren't sorted in one task, whether or not some context is itself very frequent."""
    calls = []
    windows = suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "_windows", lambda length: calls.append(length) or windows(length))
    monkeypatch.setattr(_tables.hot_counts, "__defaults__", (1024, many))
    d = near.where("doc_id < 90")
    got = suffix_dedup.dedup(d, hot=5, with_text=False)
    assert calls == [200] and rows(got.select("doc_id", "n_removed")) == removed(d)
