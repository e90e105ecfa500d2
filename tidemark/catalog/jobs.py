"""Queries of leakage audits, fitted models and composite jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog import evaluation as ev
from tidemark.catalog import ledger as cl
from tidemark.catalog import panel as cp
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import rnd, with_
from tidemark.functions.cluster import cut_lineage, scratch_path
from tidemark.functions.expr import rounded
from tidemark.operators import audit as au
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import panel as pn
from tidemark.operators import portfolio as pf
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf
from tidemark.plans import jobs
from tidemark.sources import files as fs
from tidemark.sources import tables as tb

CUT = "2001-09-01"


# ── audits ──────────────────────────────────────────────────────────────────
@query("k01_truncation_own_features", with_("bars", "SELECT c AS \"column\", 0::BIGINT AS n_diff, n_rows FROM ("
       f"SELECT count(*) AS n_rows FROM bars WHERE date <= DATE '{CUT}'), (VALUES "
       + ", ".join(f"('{c}')" for c in ts.OWN_COLUMNS) + ") t(c)"))
def _(s, d):
    return au.truncation_diff(ct.bars(s, d), ts.own_features, CUT, ("asset", "date"), ts.OWN_COLUMNS)


REL = [f"rel_{c}" for c in pn.CROSS]


@query("k01_truncation_cross_features", with_("cross4", "SELECT c AS \"column\", 0::BIGINT AS n_diff, n_rows FROM ("
       f"SELECT count(*) AS n_rows FROM cross4 WHERE date <= DATE '{CUT}'), (VALUES "
       + ", ".join(f"('{c}')" for c in REL) + ") t(c)"))
def _(s, d):
    p = ct.bars(s, d).where(F.col("asset").isin(*ct.BASKET))
    return au.truncation_diff(p, lambda x: pn.cross_features(x, ct.calendar(x)), CUT,
                              ("asset", "date"), REL)


@query("k02_release_dates", with_("cot_block", """
SELECT asset, count(mm_net) AS n_days, 0::BIGINT AS n_late FROM cot_block GROUP BY 1"""))
def _(s, d):
    return au.release_violations(tb.positioning(s, d), ct.calendar(ct.bars(s, d)))


@query("k03_zero_sum", with_("cross4", f"""
SELECT date, {', '.join(f'CASE WHEN count({c}) > 0 THEN 0.0::DOUBLE END AS {c}' for c in REL)} FROM cross4 GROUP BY 1"""))
def _(s, d):
    p = ct.bars(s, d).where(F.col("asset").isin(*ct.BASKET))
    return rounded(au.basket_sums(pn.cross_features(p, ct.calendar(p)), REL), 8)


@query("k04_fold_integrity", with_("date_folds", """
SELECT fold_id, count(DISTINCT date) AS n_dates, 0::BIGINT AS n_mixed, 0::BIGINT AS n_short FROM date_folds GROUP BY 1"""))
def _(s, d):
    rows = cp.ranking_rows(s, d)
    ax = wf.date_axis(rows)
    return au.fold_integrity(wf.assign(rows, wf.date_folds(ax, cp.fold_table(ax))), 5)


@query("k05_label_overlap", with_("date_folds", """
SELECT fold_id, 0::BIGINT AS n_overlap FROM date_folds GROUP BY 1"""))
def _(s, d):
    return au.label_overlap(cp.dates(s, d), 5)


# ── fitted models ───────────────────────────────────────────────────────────
FEATURES = list(ts.OWN_COLUMNS)
SP = wf.Splitter(504, 252, 5)
TREES = {"max_iter": 100, "depth": 3}       # the limit; the validation tail ends a fit


def panel(s, d):
    return cp.ranking_rows(s, d).dropna(subset=FEATURES).select("date", "asset", *FEATURES, "target")


def fitted(s, d, name, fit):
    df = jobs.model_predictions(panel(s, d), SP, {name: fit}, FEATURES)
    return rounded(df, 8)


@query("m10_quantile_trees")
def _(s, d):
    return fitted(s, d, "QuantileTrees", md.quantile_trees(0.9, **TREES))


@query("m11_pairwise_ranker")
def _(s, d):
    return fitted(s, d, "PairwiseLinear", md.pairwise_linear())


@query("m11_boosted_relevance")
def _(s, d):
    return fitted(s, d, "BoostedRelevance", md.boosted_relevance(**TREES))


@query("m17_null_features", with_("panel_all", f"""
SELECT asset, date, CAST({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in cp.PANEL)} AS INTEGER) AS n_null
FROM panel_all WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ts.OWN_COLUMNS)} AND mideast_ret_1d IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) = 1"""))
def _(s, d):
    latest = pn.latest_rows(cp.features(s, d), (*ts.OWN_COLUMNS, "mideast_ret_1d"))
    return md.null_features(latest, cp.PANEL)


@query("s28_model_registry", f"""
SELECT DATE '2001-11-01' AS trained_at, 4 AS age_days, false AS stale, {len(FEATURES)} AS n_features FROM (SELECT count(*) FROM lineitem)""")
def _(s, d):
    root = scratch_path(s, "models")
    p = panel(s, d)
    for day, alpha in ((dt.date(2001, 10, 1), 0.01), (dt.date(2001, 11, 1), 0.001)):
        fs.register_model(md.elastic_net(alpha)(p, FEATURES).model, root, "net", day, FEATURES, s)
    return fs.is_stale(fs.latest_model(s, root, "net"), dt.date(2001, 11, 5)).select(
        "trained_at", "age_days", "stale", F.size("features").alias("n_features"))


# ── jobs ────────────────────────────────────────────────────────────────────
@query("j01_ranking_backtest", with_("rk_table", "SELECT * FROM rk_table"))
def _(s, d):
    bt = jobs.ranking_backtest(cp.ranking_rows(s, d), 5, wf.Splitter(504, 252, 5), 5, ev.BPS, n_legs=2)
    return bt.table


@query("j01_ranking_backtest_models")
def _(s, d):
    models = {"BoostedTrees": md.boosted_trees(**TREES), "PairwiseLinear": md.pairwise_linear()}
    return jobs.ranking_backtest(panel(s, d), 5, SP, 5, ev.BPS, models, FEATURES, n_legs=2,
                                 vol_target=0.10).table


@query("j03_single_series_backtest", with_("sa_run_m sa_stats_all", f"""
SELECT run_id, {rnd('pooled_ic pooled_rank_ic mean_ic', 4)}, {rnd('ic_stability sharpe', 2)},
  {rnd('ann_return max_drawdown turnover hit_rate', 3)} FROM sa_run_m JOIN sa_stats_all USING (run_id)
WHERE run_id NOT LIKE 'Reversal%'"""))
def _(s, d):
    return jobs.single_series_backtest(ct.bars(s, d), 5, wf.Splitter(504, 252, 5), 5.0)[2]


@query("j04_horizon_sweep", with_("sweep rk_table_avg rk_table_avg_21 rk_table_avg_63", """
SELECT model, horizon, sharpe, mean_cs_ric, turnover FROM sweep """ + " ".join(
    f"UNION ALL SELECT run_id, {h}, sharpe, mean_cs_ric, turnover FROM rk_table_avg{'' if h == 5 else f'_{h}'}" for h in ev.HORIZONS)))
def _(s, d):
    panels = {}
    for h in ev.HORIZONS:
        df = ts.forward_log_return(ts.own_features(ct.bars(s, d)), h)
        panels[h] = df.join(wf.complete_dates(df, ["ret_5d", "mom_21d", "target"], 5), ["date"], "left_semi")
    return jobs.horizon_sweep(panels, 5, ev.BPS, 504, 252, n_legs=2)


@query("j04_sweep_with_averages", with_("rk_table rk_table_avg", """
SELECT run_id AS model, 5 AS horizon, sharpe, mean_cs_ric, turnover FROM (
  SELECT * FROM rk_table UNION ALL SELECT * FROM rk_table_avg)"""))
def _(s, d):
    return jobs.horizon_sweep({5: cp.ranking_rows(s, d)}, 5, ev.BPS, 504, 252, n_legs=2)


@query("j05_weekly_signal", with_("rev ewma", """
SELECT r.asset, r.date, 5 AS horizon, CAST(row_number() OVER (ORDER BY -mom DESC, r.asset) AS INTEGER) AS rank,
  CASE row_number() OVER (ORDER BY -mom DESC, r.asset) WHEN 1 THEN 'LONG' WHEN 5 THEN 'SHORT' ELSE 'FLAT' END AS position,
  round(coalesce(-mom, 0), 6) + 0.0 AS predicted_return, round(mom, 6) + 0.0 AS recent_mom_5d, round(vol, 4) + 0.0 AS current_vol,
  CASE WHEN avg(vol) OVER () < 0.18 THEN 'low' WHEN avg(vol) OVER () > 0.3 THEN 'high' ELSE 'normal' END AS vol_regime,
  round(least(2.0, 0.1::DOUBLE / avg(vol) OVER ()), 3) + 0.0 AS vol_scale
FROM rev r JOIN (SELECT asset, max_by(ewma_vol, date) AS vol FROM ewma GROUP BY 1) v ON v.asset = r.asset"""))
def _(s, d):
    return jobs.weekly_signal(ct.bars(s, d))


@query("j05_trained_signal")
def _(s, d):
    """The model is stored, found as the newest of its name and applied."""
    root, p = scratch_path(s, "models"), panel(s, d)
    for day, alpha in ((dt.date(2001, 10, 1), 0.01), (dt.date(2001, 11, 1), 0.001)):
        fs.register_model(md.elastic_net(alpha)(p, FEATURES).model, root, "net", day, FEATURES, s)
    predict, features, _ = jobs.stored_predictor(s, root, "net")
    return jobs.weekly_signal(ct.bars(s, d), predict=predict, features=features)


@query("j06_live_report", with_("ic_tab acc trades fid", """
SELECT (SELECT count(*) FROM ic_tab) AS n_weeks, (SELECT count(*) FROM fid) AS n_fidelity,
  (SELECT count(*) FROM acc) AS n_accounts, (SELECT count(*) FROM trades t LEFT JOIN acc a ON a.account = t.account
    WHERE profit IS NOT NULL AND (a.active_from IS NULL OR open_date >= a.active_from)) AS n_closed"""))
def _(s, d):
    r = jobs.live_report(cl.signals(s, d), ct.bars(s, d), tb.trades(s, d), tb.accounts(s, d),
                         tb.snapshots(s, d), 2000.0, min_pairs=3)
    return r["trades"].select(
        r["ic_summary"].select("n_weeks").scalar().alias("n_weeks"),
        r["fidelity_summary"].select("n_all").scalar().alias("n_fidelity"),
        r["accounts"].agg(F.count(F.lit(1))).scalar().alias("n_accounts"), "n_closed")


@query("j07_backtest_report", with_("sa_preds", """
SELECT 'comparison' AS section, count(DISTINCT run_id) AS n_rows FROM sa_preds
UNION ALL SELECT 'folds', count(DISTINCT (run_id, fold_id)) FROM sa_preds UNION ALL SELECT 'curve', count(*) FROM sa_preds
UNION ALL SELECT 'rolling_ic', count(*) FROM sa_preds WHERE model <> 'RandomWalk'
UNION ALL SELECT 'verdict', count(DISTINCT run_id) FROM sa_preds"""))
def _(s, d):
    out = None
    for name, df in jobs.backtest_report(ev.sa_preds(s, d), 5, 5.0, "cafe0001").items():
        n = df.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("j08_feature_matrix", with_("matrix", f"SELECT date, {rnd(' '.join(cp.MATRIX), 7)} FROM matrix"))
def _(s, d):
    p = ct.bars(s, d)
    macro = ts.macro_block(tb.macro_series(s, d), ct.calendar(p), cp.SPEC.macro_levels, cp.SPEC.macro_changes)
    df = jobs.feature_matrix(p, macro, "AMERICA", scratch_path(s, "matrix"), context=(ct.LATE,),
                             late=(ct.LATE,), names=ct.NAMES)
    return rounded(df, 7, "date", *cp.MATRIX)


# ── flagship ────────────────────────────────────────────────────────────────
def flagship(s, d):
    """Weekly long-short book of the one-week reversal ranker over the flag assets,
    with net profit per unit of gross exposure and the week's rank IC."""
    df = ts.lagged_returns(tb.flag_bars(s, d).select("asset", "date", "close"), (1,))
    df = df.withColumn("realized", F.lead("ret_1d", 1).over(ts.hist())).dropna(
        subset=["ret_1d", "realized"])
    preds = df.select(F.lit("reversal").alias("run_id"), "date", "asset",
                      (-F.col("ret_1d")).alias("pred"), "realized").persist()
    pnl = pf.book_pnl(pf.book_steps(pf.long_short_book(preds, 2, 2), pf.run_dates(preds)), 4, 3.0)
    out = pnl.join(mt.cs_ric(preds), ["run_id", "date"], "left")
    return rounded(out, 8, "date", "gross", "cost", "net", "cs_ric")


from tidemark.catalog.sql import cte  # noqa: E402

cte("fl_ret", f"SELECT asset, date, ln(close / lag(close) {ct.W}) AS r FROM flag_bars", "flag_bars")
cte("fl_preds", f"""
SELECT 'reversal' AS run_id, date, asset, -r AS pred, nx AS realized FROM (
  SELECT *, lead(r) {ct.W} AS nx FROM fl_ret) WHERE r IS NOT NULL AND nx IS NOT NULL""", "fl_ret")
ev.positions_cte("fl_pos", "fl_preds", 2)
ev.ranks_cte("fl_ranks", "fl_preds", "run_id, date")
cte("fl_grid", """
SELECT d.date, a.asset, coalesce(p.pos, 0) AS pos, p.realized FROM (SELECT DISTINCT date FROM fl_pos) d
CROSS JOIN (SELECT DISTINCT asset FROM fl_pos) a LEFT JOIN fl_pos p ON p.date = d.date AND p.asset = a.asset""", "fl_pos")
cte("fl_pnl", f"""
SELECT date, coalesce(sum(pos * realized), 0) / 4 AS gross, sum(abs(pos - prev)) / 4 * 0.0003::DOUBLE AS cost FROM (
  SELECT *, coalesce(lag(pos) {ct.W}, 0) AS prev FROM fl_grid) GROUP BY 1""", "fl_grid")
FLAGSHIP_SQL = with_("fl_pnl fl_ranks", f"""
SELECT p.date, {rnd('gross|cost|gross - cost AS net')}, {rnd('cs_ric')} FROM fl_pnl p LEFT JOIN (
  SELECT date, CASE WHEN count(*) >= 2 AND stddev_pop(pred) > 1e-12 AND stddev_pop(realized) > 1e-12 THEN
    round({ev.CORR.format('r_pred', 'r_realized')}, 12) END AS cs_ric FROM fl_ranks GROUP BY 1) c ON c.date = p.date""")
query("flagship_weekly_reversal", FLAGSHIP_SQL)(flagship)
