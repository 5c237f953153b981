"""Ranked search against scoring every document in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from dealflux.llm import lexical_search as L

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(L.TERM, (text or "").translate(ASCII))


def brute(docs, items, k=10):
    held = [(i, cut(t)) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n_docs, n_all = len(held), sum(len(ts) for _, ts in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, ts in held:
            score = 0
            for t in query & set(ts):
                df = sum(t in set(x) for _, x in held)
                tf, m = ts.count(t), 10 + (90 * len(ts) * n_docs) // n_all
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(repr, out))


def seen(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture
def some():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "A", "a"]
    docs = [(i if i % 17 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 9, 30])))) for i in range(150)]
    docs += [(200 + i, "w1 w2, w3!") for i in range(12)] + [(300, None), (301, "--"), (7, "w1 w2")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 70, 150])))) for i in range(12)]
    return docs, items + [(0, "w5 w6 W7"), (None, "w1"), (90, None), (91, "unseen"), (92, "..."), (93, "w1")]


@pytest.mark.parametrize("per_block,part", [(4096, 100_000), (64, 20)])
def test_ranks_equal_brute_force(make, monkeypatch, some, per_block, part):
    monkeypatch.setattr(L, "BLOCK_DOCS", per_block)
    monkeypatch.setattr(L, "BLOCK_TERMS", part)
    docs, items = some
    got = L.search(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"))
    assert seen(got) == brute(docs, items)


def test_odd_rows(make, odd_docs, no_docs):
    items = make([(1, "A b f", 4), (2, "w3x0 more", 4), (3, "c", 4)], "item_id long, text string, doc_id int")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert seen(L.search(odd_docs, items)) == brute(rows, [(1, "A b f"), (2, "w3x0 more"), (3, "c")])
    assert L.search(no_docs, items).count() == 0 and L.search(odd_docs, items.limit(0)).count() == 0


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 7)
    text = "Alpha,beta-GAMMA  é1 " * 9 + "x" * 40
    assert [t.decode() for part in L.terms(text) for t in part] == cut(text)


def test_masks_group_documents_by_terms_held():
    block = L.Block(np.array([3, 3, 1, 2]), np.array([2, 2, 1, 0]), np.array([0, 70, 0, 70, 5]), np.array([1, 2, 2, 1, 1]), 80, 4, 9)
    held, order, ends = block.masks(np.arange(80))
    groups = {tuple(np.flatnonzero(h)): sorted(order[s:e].tolist()) for h, s, e in zip(held, [0, *ends[:-1]], ends, strict=True)}
    assert groups == {(0, 70): [0, 1], (5,): [2], (): [3]}


def test_low_bounds_are_not_evaluated(monkeypatch):
    n = np.full(4000, 10)
    tfs = np.ones(4000, np.int64)
    tfs[:20] = 9
    ids = np.where(np.arange(4000) < 40, 0, 1)
    block = L.Block(n, np.ones(4000, np.int64), ids, tfs, 2, 4000, 40000)
    looked = []
    monkeypatch.setattr(L.np, "ix_", lambda q, r, f=np.ix_: looked.extend(r.tolist()) or f(q, r))
    found = block.best(np.array([0, 1]), np.array([5000, 3]), 10, 1)
    assert len(looked) == 40 and {i for _, i in found} <= set(range(40))
