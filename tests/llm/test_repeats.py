"""Byte repeats against counts of every window."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from dealflux.llm import repeats as R


def windows(texts, least):
    return Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))


def brute(texts, least):
    count, out = windows(texts, least), []
    for t in texts:
        change = np.zeros(len(t) + 1, int)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                change[i] += 1
                change[i + least] -= 1
        gone = np.cumsum(change[:-1]) > 0
        runs = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(t), int(gone.sum()), len(runs) // 2, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_transform_parts_exactly_what_is_repeated():
    rng = random.Random(3)
    for _ in range(40):
        least, parts = rng.choice([5, 9, 16]), []
        for _ in range(rng.randint(1, 8)):
            p = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(least, 40)))
            if parts and rng.random() < 0.5:
                p = parts[0][: rng.randint(0, len(parts[0]))] + p
            parts.append(p)
        count = windows(parts, least)
        for p, flags in zip(parts, R._block_repeats(parts, least)):
            assert [count[p[i : i + least]] > 1 for i in range(len(p) - least + 1)] == flags.tolist()


@pytest.mark.parametrize("hot, run, segment", [(2048, 1024, 1 << 20), (2, 1024, 1 << 20), (2048, 7, 100)])
def test_removed_equals_brute_force(spark, monkeypatch, hot, run, segment):
    for name, value in (("HOT_RUNS", hot), ("RUN_WINDOWS", run), ("SEGMENT", segment)):
        monkeypatch.setattr(R, name, value)
    rng, rows = random.Random(8), []
    for i in range(150):
        k = rng.choice([0, 3, 30, 80, 200])
        t = "".join(rng.choice("abcdé \n\0") for _ in range(k))
        if rng.random() < 0.4 and rows:
            o = rng.choice(rows)[1] or ""
            a = rng.randint(0, len(o))
            t = t[: k // 2] + o[a : a + rng.randint(0, 90)] + t[k // 2 :]
        if rng.random() < 0.1:
            t += "xyz" * rng.randint(1, 60)
        rows.append((i if i % 40 else None, None if i == 7 else t))
    got = R.removed(spark.createDataFrame(rows, "doc_id long, text string"), 40, 8).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], 40))]
    assert sorted(map(repr, [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got])) == sorted(map(repr, want))


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = R.removed(odd_docs)
    assert got.columns == [*odd_docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    want = brute([(r.text or "").encode() for r in rows], 400)
    assert sorted(map(repr, [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()])) == sorted(map(repr, want))
    assert R.removed(no_docs).count() == 0


def test_runs_that_share_a_window_stay_and_others_leave():
    rng = random.Random(4)
    least, gram, keys, parts = 80, 8, [], []
    for _ in range(60):
        core = bytes(rng.choice(b"abcdefgh") for _ in range(90))
        for cut in (0, 3, 40):  # with 40 bytes of the core, two runs share no window
            data = bytes(rng.choice(b"ijkl") for _ in range(60)) + core[cut:] + bytes(rng.choice(b"ijkl") for _ in range(60))
            found, _ = R.window_keys(np.frombuffer(data, np.uint8), least, gram)
            key = R.window_keys(np.frombuffer(core[3:83], np.uint8), least, gram)[0][0] if cut < 40 else found[50]
            keys.append(int(key.view(np.int64)))
            parts.append(data)
    kept = R.sharing(keys, parts, least, gram)
    count = windows(parts, least)
    twice = [any(count[p[i : i + least]] > 1 for i in range(len(p) - least + 1)) for p in parts]
    assert all(k for k, t in zip(kept, twice) if t) and sum(twice) == 120
    assert not kept[2::3].any()


def test_search_begins_where_sorting_ended():
    text = np.array([2 + b for b in b"abcabcabxabcabcaby" * 30] + [1, 0], np.uint16)
    order, known, starts = R.suffix_order(text, 60)
    assert known == 56 and 1 < starts.sum() < len(text)
    first = [text[i : i + known].tolist() for i in order]
    assert [a != b for a, b in zip(first[1:], first)] == starts[1:].tolist()
