"""Exact duplicates against a dictionary of normalised texts."""

import hashlib
from collections import defaultdict

import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401

from dealflux.llm import exact_dedup as X
from dealflux.llm import group_joins

ASCII = str.maketrans(X.UPPER, X.LOWER)


def brute(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[(t or "").translate(ASCII)].append(i)
    out = []
    for t, ids in of.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(repr, out))


def seen(found):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["digest"])) for r in found)


TEXTS = [(1, "Aé B"), (2, "aé b"), (3, "aÉ b"), (4, None), (5, ""), (6, "same len"), (7, "len same"), (8, "İ"), (9, "i̇")]
TEXTS += [(20 + i, "p" * 300 + str(i % 3)) for i in range(7)] + [(40 + i, "HOT text") for i in range(50)]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_groups_equal_brute_force(spark, make, monkeypatch, limit):
    monkeypatch.setattr(group_joins.mark_members, "__defaults__", (limit,))
    found = X.groups(make(TEXTS, "doc_id long, text string"), digests=True).collect()
    assert seen(found) == brute(TEXTS)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_odd_rows(spark, odd_docs):
    found = X.groups(odd_docs, digests=True, carry={"label": odd_docs["label"]}).collect()
    assert seen(found) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    kept = defaultdict(int)
    for r in found:
        kept[r["digest"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_only_survivors_are_hashed(make):
    rows = [(1, "a"), (2, "bb"), (3, "cc"), (4, "dd"), (5, "DD"), (6, "z" * 300 + "1"), (7, "z" * 300 + "2")]
    found = {r["doc_id"]: r["digest"] is not None for r in X.groups(make(rows, "doc_id long, text string")).collect()}
    assert not found[1] and found[4] and found[5] and found[6] and found[7]


def test_deduplicated_keeps_all_columns(odd_docs, no_docs):
    out = X.deduplicated(odd_docs)
    assert out.schema.names == odd_docs.schema.names
    texts = [(r["text"] or "").translate(ASCII) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(ASCII) for r in odd_docs.collect()})
    assert X.deduplicated(no_docs).count() == 0 and X.groups(no_docs).count() == 0
