"""Bitmap rollups against plain distinct counts."""

from dealflux.operators import activity as A
from dealflux.operators import distinct_sets as D


def test_rollups_merge_to_exact_counts(make):
    rows = [(f"k{i % 3}" if i % 7 else None, f"s{i % 2}", i % 90 if i % 5 else None, f"v{i * i % 50000}") for i in range(40000)] + [("none", "s0", None, None)]
    df = make(rows, "k string, part string, a int, b string")
    sets = D.rollup(df, ["k", "part"], ["a", "b"])
    assert sets.where("column = 'b'").select("bucket").distinct().count() == 1 + len({r[3] for r in rows if r[3]}) // 32769
    for keys, of in ((["k", "part"], lambda r: r[:2]), (["k"], lambda r: r[:1]), ([], lambda r: ())):
        want = {}
        for r in rows:
            a, b = want.setdefault(of(r), (set(), set()))
            a.update({r[2]} - {None})
            b.update({r[3]} - {None})
        got = {tuple(r[k] for k in keys): (r.n_a, r.n_b) for r in D.counts(sets, keys, {"a": "n_a", "b": "n_b"}).collect()}
        assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}
    again = D.counts(D.merged(sets, ["k"]), [], {"a": "n_a"}).first().n_a
    assert again == len({r[2] for r in rows} - {None})


def test_overview_of_no_rows(make):
    schema = "user_id long, session_id string, event_type string, country string, city string, event_time timestamp"
    got = A.overview(make([], schema)).first()
    assert got.events == 0 and got.users == 0 and got.first_time is None
    assert D.counts(D.rollup(make([], schema), ["country"], ["user_id"]), ["country"], {"user_id": "n"}).count() == 0
