"""Steps that must not grow faster than their rows."""

import datetime as dt

import numpy as np
import pandas as pd

from dealflux.operators import boosting as B
from dealflux.operators import investing as I
from dealflux.operators import series as R


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filled_months_are_neither_joined_nor_sorted(make):
    d = dt.date
    rows = [(1, d(2020, 1, 5), 4.0), (1, d(2020, 1, 9), 1.0), (1, d(2020, 4, 1), 2.0), (2, d(2020, 2, 1), None), (3, None, 7.0), (4, d(2020, 2, 1), float("nan")),
            (5, d(2020, 3, 1), None), (5, None, 2.0), (None, d(2019, 1, 1), 2.0)]
    out = R.monthly_returns(make(rows, "company_id long, date date, amount double"))
    assert "Window" not in plan(out) and "Join" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(r.company_id, {})[r.month.month] = (r.amount, r.change)
    nothing = {m: (0.0, 0.0) for m in (1, 2, 3, 4)}
    assert got == {1: {1: (5.0, 0.0), 2: (0.0, -1.0), 3: (0.0, 0.0), 4: (2.0, None)}, 4: nothing, 5: nothing}


def test_equal_rows_are_scored_once():
    """Two batches of 200 rows with five different values: five rows go through the trees."""
    tree = (np.array([0, -1, -1], np.int32), np.array([1, 0, 0], np.int32), np.array([0.0, 0.5, -0.5]))
    model = B.Boosted(["h"], ["a", "b"], [[0.0, 1.0, 2.0, 3.0]], np.zeros(2), 1, [[tree, tree[:2] + (-tree[2],)]])
    values = pd.Series([float(i % 5) for i in range(400)])
    want, plain, walked = B.softmax(model.margins(model.coded([values]))), model.margins, []
    model.margins = lambda coded: walked.append(len(coded)) or plain(coded)
    got = np.array([list(p) for part in B.chances_of(model, iter([(values[:200],), (values[200:],)])) for p in part])
    assert (got == want).all() and sum(walked) == 5


def test_investments_are_counted_without_a_second_join(make):
    lines = make([(1, 7, "x"), (1, 8, "y"), (2, 7, "x"), (3, 8, "y"), (None, 8, "y")], "deal_id long, investor_id long, investor_name string")
    deals = make([(1, 1, 10.0, None, 2020), (2, 1, None, None, 2020), (2, 1, 8.0, None, 2020)], "id long, company_id long, amount double, date date, year int")
    out = I.estimated_amounts(lines, deals)
    assert plan(out).count("Join") == 1
    assert [(r.investor_id, r.deals, r.amount) for r in out.collect()] == [(7, 3, 9.0), (8, 2, 5.0)]
