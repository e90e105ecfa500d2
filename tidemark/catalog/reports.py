"""Queries of whole report tables, compared value by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import evaluation as ev
from tidemark.catalog import ledger as cl
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, over_other, rnd, with_
from tidemark.functions.expr import rounded
from tidemark.plans import jobs
from tidemark.sources import tables as tb

TAG = "cafe0001"
TAGGED = f", '{TAG}' AS config_tag"


def backtest(s, d, name):
    return jobs.backtest_report(ev.sa_preds(s, d), 5, 5.0, TAG)[name]


@query("j07_report_comparison", with_("sa_run_m sa_stats_all", f"""
SELECT run_id, {rnd('pooled_ic pooled_rank_ic mean_ic', 4)}, {rnd('ic_stability sharpe', 2)},
  {rnd('ann_return max_drawdown turnover hit_rate', 3)}{TAGGED} FROM sa_run_m JOIN sa_stats_all USING (run_id)"""))
def _(s, d):
    return backtest(s, d, "comparison")


@query("j07_report_folds", with_("sa_fold_m sa_preds", f"""
SELECT run_id, fold_id, test_rows, {rnd('ic rank_ic hit_rate', 6)}, first_date, last_date{TAGGED} FROM sa_fold_m JOIN (
  SELECT run_id, fold_id, min(date) AS first_date, max(date) AS last_date FROM sa_preds GROUP BY 1, 2) USING (run_id, fold_id)"""))
def _(s, d):
    return rounded(backtest(s, d, "folds"), 6, "run_id", "fold_id", "test_rows", "ic", "rank_ic", "hit_rate", "first_date",
                   "last_date", "config_tag")


@query("j07_report_curve", with_("sa_pnl", f"""
SELECT run_id, date, CASE WHEN abs(e) < 1e-290 THEN 0.0 ELSE CAST(printf('%.6e', e) AS DOUBLE) END AS equity{TAGGED} FROM (
  SELECT run_id, date, product(1 + coalesce(net, 0)) {ev.SW} AS e FROM sa_pnl)"""))
def _(s, d):
    tiny = F.abs("equity") < 1e-290                          # below that a double loses digits
    return backtest(s, d, "curve").withColumn("equity", F.when(tiny, 0.0).otherwise(
        F.format_string("%.6e", "equity").cast("double")))


@query("j07_report_rolling_ic", with_("sa_preds", f"""
SELECT run_id, date, {rnd(f'''CASE WHEN count(*) {ev.W63} >= 31 THEN covar_pop(pred, realized) {ev.W63}
  / nullif(stddev_pop(pred) {ev.W63} * stddev_pop(realized) {ev.W63}, 0) END AS rolling_ic''', 6)}{TAGGED} FROM sa_preds
WHERE run_id IN (SELECT run_id FROM sa_preds GROUP BY 1 HAVING stddev_pop(pred) >= 1e-12)"""))
def _(s, d):
    return rounded(backtest(s, d, "rolling_ic"), 6)


# ── live report: trades before an account's start are left out ─────────────
cte("live_trades", """
SELECT t.* FROM trades t LEFT JOIN acc a ON a.account = t.account WHERE a.active_from IS NULL OR open_date >= a.active_from""",
    "trades", "acc")
over_other("trades", "live_trades", "_live", "fid")


def live(s, d, name):
    return jobs.live_report(cl.signals(s, d), ct.bars(s, d), tb.trades(s, d), tb.accounts(s, d), tb.snapshots(s, d), 2000.0,
                            min_pairs=3)[name]


@query("j06_report_fidelity", with_("fid_live", "SELECT date, missing, extra, wrong_dir, ok FROM fid_live"))
def _(s, d):
    return live(s, d, "fidelity").select("date", "missing", "extra", "wrong_dir", "ok")


@query("j06_report_ic", with_("ic_tab", f"""
SELECT date, n_pairs, hits, n_active, complete, reconstructed, {rnd('paper_ret_net cs_ric hit_rate')} FROM ic_tab"""))
def _(s, d):
    return rounded(live(s, d, "ic"), 8)
