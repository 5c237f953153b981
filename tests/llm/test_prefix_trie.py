"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dealflux.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def tie(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute(rows):
    turns = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=tie):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        own = (len(cs) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own
    return sorted(repr((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p, cs in members.items())


def seen(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture
def talks():
    rng = random.Random(11)
    rows = []
    for c in range(130):
        if c % 40 == 20:
            continue
        like = rng.choice([0, 7, 9, c])
        n = rng.choice([1, 1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 70])
        rows += [(c, t if t % 9 else None, rng.choice(["user", None]) if like == c else "user", f"turn {t * (t < 30 or like)} of {like if t < 50 else c}" if t % 7 else None, "x", 1) for t in range(n)]
    rows += [(3, 1, "user", "again", "x", 1)] * 3 + [(None, 1, "user", "lost", "x", 1), (500, None, None, None, None, None), (501, 0, "a", "b", "x", 1), (501, 0, "b", "a", "x", 1)]
    return rows


@pytest.mark.parametrize("height", [8, 2])
def test_nodes_equal_brute_force(make, monkeypatch, talks, height):
    monkeypatch.setattr(P, "HEIGHT", height)
    assert seen(P.trie(make(talks, SCHEMA))) == brute(talks)


def test_short_and_empty(make):
    rows = [(c, t, "user", f"t{t}", None, None) for c in (0, 1, 2, 3) for t in range(2)]
    assert seen(P.trie(make(rows, SCHEMA))) == brute(rows)
    assert P.trie(make([], SCHEMA)).count() == 0
    alone = [(21, 0, "user", "gone", None, None)]
    assert seen(P.trie(make(alone, SCHEMA))) == brute(alone)


def test_ids_of_a_node_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "JOINED", 10)
    rows = pa.RecordBatch.from_pylist([{"name": n, "conv": c} for n, cs in ((b"a", range(50)), (b"b", [7])) for c in cs])
    pieces = pa.Table.from_batches(P._joined(iter([rows.slice(0, 20), rows.slice(20)]))).select(["name", "ids"])
    assert pieces.num_rows > 8
    got = pa.Table.from_batches(P._hashed(iter(pieces.to_batches(max_chunksize=3)))).to_pylist()
    assert {r["name"]: r["ends_sha256"] for r in got} == {
        b"a": hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}
