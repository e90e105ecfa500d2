"""Queries of linear models from fold moments, and of all six models on each series alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import boosting as cb
from tidemark.catalog import jobs as cj
from tidemark.catalog import evaluation as ev
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, over_other, rnd, sig, with_
from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import rounded, significant
from tidemark.operators import moments as mo
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf
from tidemark.plans import jobs

FEATURES = cj.FEATURES
K, SWEEPS, ALPHA, L1 = len(FEATURES), 60, 0.01, 0.5

cte("six_rows", f"""
SELECT f.asset, f.date, {', '.join('f.' + c for c in FEATURES)}, target_5d AS target,
       row_number() OVER (PARTITION BY f.asset ORDER BY f.date) - 1 AS idx
FROM feat f JOIN label USING (asset, date) WHERE {' AND '.join(f'f.{c} IS NOT NULL' for c in FEATURES)} AND target_5d IS NOT NULL""",
    "feat", "label", stored=True)
cte("six_folds", """
SELECT asset, CAST(k AS INTEGER) AS fold_id, 504 + 252 * k AS train_hi, 509 + 252 * k AS test_lo, 761 + 252 * k AS test_hi
FROM (SELECT asset, count(*) AS n FROM six_rows GROUP BY 1), range(0, 1000) t(k) WHERE 761 + 252 * k <= n""", "six_rows", stored=True)


def net_ctes(x: str, rows: str, folds: str, keys: list[str], alpha: float = ALPHA) -> None:
    """``{x}_net``: coefficients and intercept per key and fold. One row for each
    pair of columns holds their covariance; descent is a recursion over steps."""
    k = ", ".join(keys)
    on = "".join(f"f.{c} = r.{c} AND " for c in keys)
    head = "".join(f"f.{c}, " for c in keys)
    cov = ", ".join(f"covar_pop({a}, {b}) AS c_{i}_{j}" for i, a in enumerate([*FEATURES, "target"])
                    for j, b in enumerate([*FEATURES, "target"]) if i <= j)
    c = lambda i, j: f"c_{min(i, j)}_{max(i, j)}"
    sd = lambda i: f"CASE WHEN c_{i}_{i} = 0 THEN 1 ELSE sqrt(c_{i}_{i}) END"
    cte(f"{x}_moments", f"""
SELECT {head}fold_id, count(*) AS n, avg(target) AS mean_y, {', '.join(f'avg({f}) AS mean_{i}' for i, f in enumerate(FEATURES))}, {cov}
FROM {folds} f JOIN {rows} r ON {on}idx < train_hi GROUP BY {head}fold_id""", rows, folds, stored=True)
    cte(f"{x}_scaled", f"""
SELECT {k}{', ' if keys else ''}fold_id, [{', '.join('[' + ', '.join(f'{c(i, j)} / ({sd(i)} * {sd(j)})' for j in range(K)) + ']' for i in range(K))}] AS c,
  [{', '.join(f'{c(i, K)} / ({sd(i)})' for i in range(K))}] AS g, [{', '.join(sd(i) for i in range(K))}] AS sd, mean_y,
  [{', '.join(f'mean_{i}' for i in range(K))}] AS means FROM {x}_moments""", f"{x}_moments", stored=True)
    rest = "(g[s % {0} + 1] - list_sum(list_transform(range({0}), lambda i: c[s % {0} + 1][i + 1] * w[i + 1])) + c[s % {0} + 1][s % {0} + 1] * w[s % {0} + 1])".format(K)
    cte(f"{x}_cd", f"""
SELECT {k}{', ' if keys else ''}fold_id, c, g, 0 AS s, list_transform(range({K}), lambda i: 0.0::DOUBLE) AS w FROM {x}_scaled
UNION ALL
SELECT {k}{', ' if keys else ''}fold_id, c, g, s + 1, list_transform(w, lambda v, i: CASE WHEN i = s % {K} + 1 THEN new ELSE v END) FROM (
  SELECT *, sign(rest) * greatest(abs(rest) - {alpha * L1}, 0) / (c[s % {K} + 1][s % {K} + 1] + {alpha * (1 - L1)}) AS new FROM (
    SELECT *, {rest} AS rest FROM {x}_cd WHERE s < {SWEEPS * K}))""", f"{x}_scaled")
    cte(f"{x}_net", f"""
SELECT {k}{', ' if keys else ''}fold_id, list_transform(range({K}), lambda i: w[i + 1] / sd[i + 1]) AS coef,
  mean_y - list_sum(list_transform(range({K}), lambda i: w[i + 1] / sd[i + 1] * means[i + 1])) AS intercept
FROM {x}_cd JOIN {x}_scaled USING ({k}{', ' if keys else ''}fold_id) WHERE s = {SWEEPS * K}""", f"{x}_cd", f"{x}_scaled", stored=True)


net_ctes("six", "six_rows", "six_folds", ["asset"])


def series_rows(s, d):
    df = ts.forward_log_return(ts.own_features(ct.bars(s, d)), 5).dropna(subset=[*FEATURES, "target"])
    rows = cut_lineage(df.join(wf.date_axis(df, "asset"), ["asset", "date"]))
    return rows, wf.folds(wf.axis_counts(rows, "asset"), cj.SP, "asset")


def net(s, d):
    rows, fd = series_rows(s, d)
    return mo.elastic_net(mo.fold_moments(rows, fd, [*FEATURES, "target"], "asset"), K, ALPHA, L1, SWEEPS)


@query("m08_series_coefficients", with_("six_net", f"""
SELECT asset, fold_id, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature, round(unnest(coef), 8) + 0.0 AS coefficient,
  round(intercept, 8) + 0.0 AS intercept FROM six_net""", recursive=True))
def _(s, d):
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in FEATURES]).alias("feature"), "coef")
    df = net(s, d).select("asset", "fold_id", "intercept", F.explode(pairs).alias("p")).select(
        "asset", "fold_id", F.col("p.feature").alias("feature"), F.col("p.coef").alias("coefficient"), "intercept")
    return rounded(df, 8)


@query("w08_fold_statistics", with_("six_rows six_folds", f"""
SELECT f.asset, fold_id, count(*) AS train_rows, {rnd('avg(target) AS train_mean|stddev_pop(mom_21d) AS train_sd')}
FROM six_folds f JOIN six_rows r ON r.asset = f.asset AND idx < train_hi GROUP BY 1, 2"""))
def _(s, d):
    rows, fd = series_rows(s, d)
    return rounded(mo.fold_statistics(rows, fd, "mom_21d", "asset"), 8)


cte("six_parts", """
WITH f AS (SELECT asset AS series, *, train_hi - greatest(20, floor(train_hi * 0.15::DOUBLE)) AS start FROM six_folds)
SELECT r.*, target AS y, series, fold_id, CASE WHEN idx >= test_lo AND idx < test_hi THEN 'test' WHEN idx >= train_hi THEN NULL
  WHEN start - 5 < 20 OR idx < start - 5 THEN 'fit' WHEN idx >= start THEN 'val' END AS part
FROM f JOIN six_rows r ON r.asset = f.asset WHERE part IS NOT NULL""", "six_rows", "six_folds", stored=True)
cb.boost_ctes("sixb", "six_parts", ["series", "fold_id"], FEATURES, {"BoostedTrees": None, "BoostedTrees_q90": 0.9})
_pred = " + ".join(f"coef[{i + 1}] * r.{c}" for i, c in enumerate(FEATURES))
cte("six_stats", """
SELECT f.asset, fold_id, avg(target) AS train_mean, stddev_pop(mom_21d) AS train_sd
FROM six_folds f JOIN six_rows r ON r.asset = f.asset AND idx < train_hi GROUP BY 1, 2""", "six_folds", "six_rows")
cte("six_test", f"""
SELECT r.*, f.fold_id, train_mean, CASE WHEN train_sd = 0 THEN 1.0 ELSE train_sd END AS train_sd, intercept + {_pred} AS net
FROM six_folds f JOIN six_rows r ON r.asset = f.asset AND idx >= test_lo AND idx < test_hi
JOIN six_stats s ON s.asset = f.asset AND s.fold_id = f.fold_id JOIN six_net e ON e.asset = f.asset AND e.fold_id = f.fold_id""",
    "six_folds", "six_rows", "six_stats", "six_net", stored=True)
_plain = {"RandomWalk": "0.0::DOUBLE", "Drift": "train_mean", "Momentum": "sign(mom_21d) * train_sd", "ElasticNet": "net"}
cte("six_preds", " UNION ALL ".join(
    f"SELECT '{m}:' || asset AS run_id, '{m}' AS model, asset, fold_id, date, {p} AS pred, target AS realized FROM six_test"
    for m, p in _plain.items()) + """
UNION ALL SELECT model || ':' || series, model, series, fold_id, date, pred, realized FROM sixb_preds""", "six_test", "sixb_preds", stored=True)
over_other("sa_preds", "six_preds", "_six", "sa_run_m", "sa_stats_all")


@query("j03_six_models", with_("sa_run_m_six sa_stats_all_six", f"""
SELECT run_id, {rnd('pooled_ic pooled_rank_ic mean_ic', 4)}, {rnd('ic_stability sharpe', 2)},
  {rnd('ann_return turnover hit_rate', 3)}, {sig('round(max_drawdown, 3)', 'max_drawdown')} FROM sa_run_m_six JOIN sa_stats_all_six USING (run_id)""", recursive=True))
def _(s, d):
    return significant(jobs.six_model_backtest(ct.bars(s, d), 5, cj.SP, 5.0, ALPHA, **cb.HOW)[2], "max_drawdown")


# ── the panel: one model for all assets ─────────────────────────────────────
cte("net_rows", """
SELECT p.*, y AS target, idx FROM bt_panel p JOIN (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bt_panel)) USING (date)""", "bt_panel", stored=True)
cte("net_folds", """
SELECT CAST(k AS INTEGER) AS fold_id, 504 + 252 * k AS train_hi, 509 + 252 * k AS test_lo, 761 + 252 * k AS test_hi
FROM range(0, 1000) t(k) WHERE 761 + 252 * k <= (SELECT max(idx) + 1 FROM net_rows)""", "net_rows", stored=True)
net_ctes("pan", "net_rows", "net_folds", [])
cte("pan_preds", f"""
SELECT 'ElasticNet' AS run_id, f.fold_id, r.date, r.asset, intercept + {_pred} AS pred, target AS realized
FROM net_folds f JOIN net_rows r ON idx >= test_lo AND idx < test_hi JOIN pan_net e ON e.fold_id = f.fold_id""",
    "net_folds", "net_rows", "pan_net", stored=True)
cte("all_fold", "SELECT 0 AS fold_id, max(idx) + 1 AS train_hi FROM net_rows", "net_rows", stored=True)
net_ctes("allp", "net_rows", "all_fold", [], 0.001)
over_other("rk_preds", "pan_preds", "_net", "pnl")


@query("m07_elastic_net", with_("pan_preds", f"SELECT run_id, fold_id, date, asset, {rnd('pred realized')} FROM pan_preds", recursive=True))
def _(s, d):
    return rounded(jobs.linear_predictions(cj.panel(s, d), cj.SP, FEATURES, ALPHA, L1), 8)


@query("m08_coefficients", with_("allp_net", f"""
SELECT unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature, round(unnest(coef), 8) + 0.0 AS coefficient FROM allp_net""", recursive=True))
def _(s, d):
    p = cut_lineage(cj.panel(s, d))
    ax = wf.date_axis(p)
    whole = wf.axis_counts(ax).select(F.lit(0).alias("fold_id"), F.lit(0).alias("train_lo"), F.col("n").cast("int").alias("train_hi"))
    m = mo.elastic_net(mo.fold_moments(p.join(ax, "date"), whole, [*FEATURES, "target"]), K, 0.001, L1, SWEEPS)
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in FEATURES]).alias("feature"), F.col("coef").alias("coefficient"))
    return rounded(m.select(F.inline(pairs)), 8)


@query("j02_one_model_run", with_("pnl_net", f"SELECT run_id, date, {rnd('gross cost net')} FROM pnl_net", recursive=True))
def _(s, d):
    bt = jobs.evaluate(jobs.linear_predictions(cj.panel(s, d), cj.SP, FEATURES, ALPHA, L1), 5, 5, ev.BPS, n_legs=2)
    return rounded(bt.pnl, 8, "run_id", "date", "gross", "cost", "net")


cte("fit_preds", """
SELECT * FROM pan_preds UNION ALL SELECT 'ListwiseTrees', fold_id, date, asset, pred, realized FROM lst_preds""", "pan_preds", "lst_preds", stored=True)
over_other("rk_preds", "fit_preds", "_fit", "rk_table")


@query("j01_ranking_backtest_fitted", with_("rk_table_fit", "SELECT * FROM rk_table_fit", recursive=True))
def _(s, d):
    """A linear and a listwise model beside each other, over all folds."""
    trees = cb.bo.listwise(cb.panel_parts(s, d), ["fold_id"], FEATURES, **cb.HOW).withColumn("run_id", F.lit("ListwiseTrees"))
    net_preds = jobs.linear_predictions(cj.panel(s, d), cj.SP, FEATURES, ALPHA, L1)
    return jobs.evaluate(net_preds.unionByName(trees), 5, 5, ev.BPS, n_legs=2).table
