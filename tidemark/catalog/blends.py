"""Queries that blend and compare any number of profit series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import evaluation as ev
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import rounded
from tidemark.operators import metrics as mt
from tidemark.operators import portfolio as pf

RUNS = ("MeanReversion", "MomentumRank", "MomentumRank_avg21")
#: One series ends earlier and one begins later, so that pairs drop dates on both sides.
FIRST, LAST = "1997-03-01", "2001-03-01"
KEPT = f"NOT (run_id = '{RUNS[1]}' AND date > DATE '{LAST}') AND NOT (run_id = '{RUNS[2]}' AND date < DATE '{FIRST}')"
IN = ", ".join(f"'{r}'" for r in RUNS)
cte("three", f"""
SELECT run_id, date, net FROM (SELECT run_id, date, net FROM pnl UNION ALL SELECT run_id, date, net FROM pnl_avg)
WHERE run_id IN ({IN}) AND {KEPT}""", "pnl", "pnl_avg")
cte("three_legs", "SELECT date, " + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN net END) AS n{i}" for i, r in enumerate(RUNS))
    + " FROM three GROUP BY 1", "three", stored=True)
_grid = ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format("/".join(f"{100 * x:.0f}" for x in w), *w) for w in mt.simplex(3))
cte("three_mix", f"""
SELECT g.name AS run_id, date, a * n0 + b * n1 + c * n2 AS net FROM three_legs, (VALUES {_grid}) g(name, a, b, c)
WHERE n0 IS NOT NULL AND n1 IS NOT NULL AND n2 IS NOT NULL""", "three_legs")
ev.sharpe_cte("three_sharpe", "three_mix", 63)


def three(s, d):
    preds = ev.rk_preds(s, d)
    avg = pf.smooth_predictions(preds, 21).withColumn("run_id", F.concat("run_id", F.lit("_avg21")))
    return cut_lineage(ev.pnl2(preds.unionByName(avg)).where(F.col("run_id").isin(*RUNS)).where(KEPT).select("run_id", "date", "net"))


@query("a20_blend_series", with_("three_sharpe three_mix", f"""
SELECT run_id AS weight, {rnd('ann_return ann_vol max_drawdown sharpe sharpe_raw', 6)} FROM three_sharpe JOIN (
  SELECT run_id, avg(net) * sqrt(252.0::DOUBLE) / nullif(stddev_pop(net), 0) AS sharpe_raw FROM three_mix GROUP BY 1) USING (run_id)"""))
def _(s, d):
    return rounded(mt.blend_series(three(s, d), RUNS), 6, "weight", "ann_return", "ann_vol", "max_drawdown", "sharpe", "sharpe_raw")


@query("a21_pnl_correlations", with_("three_legs", " UNION ALL ".join(f"""
SELECT '{RUNS[i]}' AS first, '{RUNS[j]}' AS second, {rnd(f'corr(n{i}, n{j}) AS pnl_corr')},
  count(CASE WHEN n{i} IS NOT NULL AND n{j} IS NOT NULL THEN 1 END) AS common,
  count(CASE WHEN n{i} IS NOT NULL AND n{j} IS NULL THEN 1 END) AS dropped_first,
  count(CASE WHEN n{j} IS NOT NULL AND n{i} IS NULL THEN 1 END) AS dropped_second FROM three_legs"""
    for i, j in ((0, 1), (0, 2), (1, 2)))))
def _(s, d):
    return rounded(mt.pnl_correlations(three(s, d), RUNS), 8)
