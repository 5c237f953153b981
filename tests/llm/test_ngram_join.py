"""The shingle join against every pair, and the R-tree against the bound of every pair."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from llm_fixtures import near_texts, no_docs, odd_docs  # noqa: F401

from dealflux.llm import common, components
from dealflux.llm import ngram_join as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    holds = defaultdict(list)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holds[x])
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
        for x in s:
            holds[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(repr((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 3])
def test_components_equal_brute_force(spark, near_texts, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_POINTS", block)
    got = N.join(spark.createDataFrame(near_texts, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(near_texts)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = N.join(odd_docs).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)
    assert N.join(no_docs).count() == 0
    kept = N.one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and (1, "a b c d e f g") in texts and (2, "A b  c d e\tf g") not in texts
    assert sum(not (t or "").split() for _, t in texts) == 4


@pytest.mark.parametrize("n", [1, 15, 40, 700])
def test_tree_finds_every_pair_within_the_bound(n):
    rng = np.random.default_rng(n)
    base = rng.poisson(2, (max(1, n // 4), N.GROUPS))
    vec = np.maximum(base[rng.integers(0, len(base), n)] + rng.integers(-1, 2, (n, N.GROUPS)) * (rng.random((n, N.GROUPS)) < 0.1), 0).astype("<u4")
    size = vec.sum(axis=1).astype(np.int64)
    label = rng.integers(0, max(2, n // 3), n)
    a, b = N.RTree({"vec": vec, "coarse": N.coarse(vec), "n": size, "label": label}).pairs(80)
    i, j = np.triu_indices(n, 1)
    ok = N.enough(N._bound(vec[i], vec[j]), size[i] + size[j], 80) & (label[i] != label[j]) & N.near_sizes(size[i], size[j], 80)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == {frozenset(p) for p in zip(i[ok].tolist(), j[ok].tolist())}


@pytest.mark.parametrize("sizes", [(100, 130), (129, 129), (300, 500), (1000, 1030), (4000, 5000), (70_000, 80_000)])
def test_finer_bound_is_never_below_the_intersection(sizes):
    rng = np.random.default_rng(sizes[0])
    for shared in (0.0, 0.5, 0.95):
        common = rng.integers(0, 1 << 63, int(sizes[0] * shared), dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for n in sizes)
        fine = [N.fine_counts(h) for h in (a, b)]
        assert [f is None for f in fine] == [len(h) <= N.GROUPS for h in (a, b)]
        if None in fine:
            continue
        bound = N.fine_bound(*(zstandard.ZstdDecompressor().decompress(f) for f in fine))
        assert len(common) <= bound <= min(len(a), len(b))
        if shared == 0.5:
            assert not N.enough(np.array([bound]), np.array([len(a) + len(b)]), 80)[0] or sizes[0] > N.MOST_GROUPS


def test_dense_hub_names_a_forest_first():
    # 60 near copies with vectors of 100 shingles that are all within the bound of each other, in components of their own.
    rng = np.random.default_rng(2)
    vec = np.tile(rng.poisson(1, N.GROUPS) + 1, (60, 1)).astype("<u4")
    vec[np.arange(60), np.arange(60)] += 1
    rows = {"hub": np.full(60, 9), "cell": np.zeros(60, np.int64), "node": np.arange(60) * 7, "label": np.arange(60) * 7, "n": vec.sum(axis=1).astype(np.int64), "vec": vec, "fine": np.full(60, None, object)}
    for turn in range(N.FOREST_TURNS):
        pairs, more = N._hub_pairs(dict(rows), 80, turn)
        assert len(pairs) == 59 and more.tolist() == [9]
    pairs, more = N._hub_pairs(dict(rows), 80)
    assert len(pairs) == 60 * 59 // 2 and not len(more)


def test_many_near_copies_whose_hub_is_another_text_cost_few_pairs(spark, monkeypatch):
    # All share a long passage with each other; chains of edits make groups that only some members link.
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(40, 3, replace=False):
            own[at * 5] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:30] + [f"y{i}_{j}" for j in range(170)]) for i in range(40)]
    rows = list(enumerate(texts))
    seen, verify = [], N._verify
    monkeypatch.setattr(N, "_verify", lambda between, *rest: seen.append(between.count()) or verify(between, *rest))
    got = N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)
    assert sum(seen[1:]) <= 10 * len(rows)


@pytest.mark.parametrize("n", [1, 100, 128, 129, 3000])
def test_packed_vectors_come_back(n):
    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    fine = N.fine_counts(h)
    vec, back = N.unpacked([None if fine else N.counts(h)], [fine])
    assert vec[0].tolist() == np.bincount((h % np.uint64(N.GROUPS)).astype(int), minlength=N.GROUPS).tolist()
    assert back[0] is None if fine is None else len(back[0]) > N.GROUPS
    same = np.full(500, 3, np.uint64)
    assert N.unpacked([N.counts(same)], [None])[0][0, 3] == 500


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [None, "", "  ", "A b\tc\x0bD é", "a\x00 a \x00a", *("".join(rng.choice([*"abC \n\r\x1c\x85"], rng.integers(0, 80))) for _ in range(60))]
    want = [t.encode().lower().split() if t else [] for t in texts]
    for block in (1 << 18, 5):
        monkeypatch.setattr(common, "HASH_BLOCK", block)
        hashes, ends = common.word_hashes(texts)
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist() and len(hashes) == ends[-1]
        assert hashes.tolist() == [common.WordHashes()[w] for ws in want for w in ws]
        sets = common.shingle_sets(texts)
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
        assert all((s == common.shingle_set(common.WordHashes().of(common.words(t)))).all() for s, t in zip(sets, texts))
    assert [len(s) for s in common.shingle_sets([])] == []


def test_components_end_in_one_task_as_in_rounds(spark):
    rng = np.random.default_rng(8)
    for n, m in ((40, 0), (40, 30), (300, 200), (50, 400)):
        edges = spark.createDataFrame([(int(a) * 7 - 50, int(b) * 7 - 50) for a, b in rng.integers(0, n, (m, 2))] + [(1, 1), (None, 3)], "a long, b long")
        one, two = (sorted(map(tuple, components.components(edges, "a", "b", most).collect())) for most in (1 << 20, 0))
        assert one == two
    chain = np.random.default_rng(9).permutation(5000)
    node, label = components.least_reached(chain[1:], chain[:-1])
    assert node.tolist() == list(range(5000)) and not label.any()


def test_sets_that_meet_by_one_hash_of_two_enter_no_tree(spark, monkeypatch):
    # Each text shares five words with the next one only; of the last three, all share most.
    texts = [" ".join([f"p{i}_{j}" for j in range(5)] + [f"p{i + 1}_{j}" for j in range(5)]) for i in range(30)]
    texts += [" ".join([f"q{j}" for j in range(60)] + [f"r{i}"]) for i in range(3)]
    seen, split = [], N._split_hubs
    monkeypatch.setattr(N, "_split_hubs", lambda *a: seen.append(split(*a).cache()) or seen[-1])
    got = N.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(list(enumerate(texts)))
    assert sum(s.count() for s in seen) == 0
