"""op5 against brute force: edited copies of items, with the exact similarity of every window."""

import random

import pyarrow as pa

from brindle.llm.decontamination import LEAST, Items


def _set(words):
    return {tuple(words[i : i + 3]): sum(map(len, words[i : i + 3])) for i in range(len(words) - 2)}


def _best(item, text):
    """The largest weighted Jaccard similarity of the item and a window of as many words."""
    a, best = _set(item), 0.0
    for t in range(max(1, len(text) - len(item) + 1)):
        b = _set(text[t : t + len(item)])
        both = sum(v for k, v in a.items() if k in b)
        best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def test_edited_copies_are_found_down_to_the_least_similarity():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10)))
    items = [[word() for _ in range(rng.randint(6, 60))] for _ in range(150)]
    texts = []
    for item in items:
        for _ in range(4):
            share = rng.uniform(0.05, 0.2)
            copy = [word() if rng.random() < share else w for w in item]
            texts.append([word() for _ in range(5)] + copy + [word() for _ in range(5)])
    want = {(r, r // 4): s for r, t in enumerate(texts) if (s := _best(items[r // 4], t)) >= LEAST}
    assert sum(s < 0.5 for s in want.values()) > 100
    found = Items(list(range(len(items))), [" ".join(x) for x in items]).find(pa.array([" ".join(t) for t in texts]))
    got = {(r, i): s for r, i, _, _, s in found}
    assert got.keys() == want.keys(), f"{len(want.keys() - got.keys())} of {len(want)} lost"
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
