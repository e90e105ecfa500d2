import numpy as np
import pytest

from tests.helpers import day
from tidemark.operators import metrics as mt


@pytest.fixture(scope="module")
def profits(spark):
    """Three series of one market; one begins later, one ends earlier, one has a null."""
    rng = np.random.default_rng(12)
    market = rng.normal(0, 0.01, 200)
    rows, held = [], {}
    for k, (run, span) in enumerate((("a", range(200)), ("b", range(30, 200)), ("c", range(170)))):
        for i in span:
            v = None if (run, i) == ("a", 50) else float(market[i] * (k + 1) + rng.normal(0, 0.01))
            rows.append((run, day(i), v))
            if v is not None:
                held.setdefault(run, {})[i] = v
    rows += [("other", day(i), 9.0) for i in range(200)]
    return spark.createDataFrame(rows, "run_id string, date date, net double"), held


def test_weights_over_every_subset():
    assert mt.simplex(3) == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (.5, .5, 0), (.5, 0, .5), (0, .5, .5), (1 / 3, 1 / 3, 1 / 3)]
    assert len(mt.simplex(4, 2)) == 10


def test_blends_meet_on_common_dates(profits):
    df, held = profits
    common = sorted(set(held["a"]) & set(held["b"]) & set(held["c"]))
    got = {r["weight"]: r for r in mt.blend_series(df, ("a", "b", "c"), every=7).collect()}
    assert len(got) == 7 and len(common) == 139
    for w, name in zip(mt.simplex(3), ("100/0/0", "0/100/0", "0/0/100", "50/50/0", "50/0/50", "0/50/50", "33/33/33")):
        net = np.array([sum(x * held[r][i] for x, r in zip(w, "abc")) for i in common])
        assert got[name]["sharpe_raw"] == pytest.approx(net.mean() / net.std() * 252 ** 0.5)
        part = net[::7]
        assert got[name]["sharpe"] == pytest.approx(part.mean() / part.std() * (252 / 7) ** 0.5)


def test_correlations_of_all_pairs(profits):
    df, held = profits
    got = {(r["first"], r["second"]): r for r in mt.pnl_correlations(df, ("a", "b", "c")).collect()}
    assert list(got) == [("a", "b"), ("a", "c"), ("b", "c")]
    for (x, y), r in got.items():
        both = sorted(set(held[x]) & set(held[y]))
        want = np.corrcoef([held[x][i] for i in both], [held[y][i] for i in both])[0, 1]
        assert r["pnl_corr"] == pytest.approx(want) and r["common"] == len(both)
        assert (r["dropped_first"], r["dropped_second"]) == (len(held[x]) - len(both), len(held[y]) - len(both))
