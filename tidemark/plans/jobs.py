"""User-facing jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import n_long_short_of
from tidemark.operators import boosting as bo
from tidemark.operators import ledger as lg
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import moments as mo
from tidemark.operators import panel as pn
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sg
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf
from tidemark.sources import files


@dataclass
class Backtest:
    """Tables of a ranking backtest; all runs share each table."""

    preds: DataFrame
    book: DataFrame
    pnl: DataFrame
    table: DataFrame


def baseline_predictions(panel: DataFrame, sp: wf.Splitter, smooth: int = 1) -> DataFrame:
    """Test-date predictions of the three rankers that need no fit."""
    ax = wf.date_axis(panel)
    fd = wf.folds(wf.axis_counts(ax), sp)
    test = wf.assign(panel, wf.date_folds(ax, fd).where("part = 'test'"))
    runs = F.array(*[F.struct(F.lit(m).alias("run_id"), p.alias("pred")) for m, p in (
        ("EqualWeight", F.lit(0.0)), ("MomentumRank", F.col("mom_21d")),
        ("MeanReversion", -F.col("ret_5d")))])
    preds = test.select("fold_id", "date", "asset", F.col("target").alias("realized"),
                        F.explode(runs).alias("m")).select(
        "m.run_id", "fold_id", "date", "asset", "m.pred", "realized")
    return preds if smooth <= 1 else pf.smooth_predictions(preds, smooth)


def model_predictions(panel: DataFrame, sp: wf.Splitter, models: dict[str, md.Fit],
                      features: Sequence[str]) -> DataFrame:
    """Fit every model on every fold. The panel is checkpointed once: each fit
    scans it several times."""
    panel = cut_lineage(panel)
    ax = wf.date_axis(panel)
    folds = wf.folds(wf.axis_counts(ax), sp).collect()       # a few integers per fold
    out = None
    for name, fit in models.items():
        p = md.walk_forward(panel, ax, folds, features, fit, name)
        out = p if out is None else out.unionByName(p)
    return out


def linear_predictions(panel: DataFrame, sp: wf.Splitter, features: Sequence[str], alpha: float = 0.01,
                       l1_ratio: float = 0.5, name: str = "ElasticNet") -> DataFrame:
    """Test-date predictions of an elastic net on every fold, from fold moments: the
    panel is summed once for all folds, and no training row is copied."""
    panel = cut_lineage(panel)
    ax = wf.date_axis(panel)
    fd = cut_lineage(wf.folds(wf.axis_counts(ax), sp))
    net = mo.elastic_net(mo.fold_moments(panel.join(ax, "date"), fd, [*features, "target"]), len(features), alpha, l1_ratio)
    test = wf.assign(panel, wf.date_folds(ax, fd).where("part = 'test'"))
    return test.join(net.select("fold_id", "coef", "intercept"), "fold_id").select(
        F.lit(name).alias("run_id"), "fold_id", "date", "asset", mo.linear_prediction(features).alias("pred"),
        F.col("target").alias("realized"))


def evaluate(preds: DataFrame, n_assets: int, horizon: int, cost_bps: float,
             n_legs: int | None = None, vol_target: float | None = None) -> Backtest:
    """Books, profit and the comparison table of all runs in ``preds``. Each
    intermediate feeds several measures and is checkpointed, not recomputed."""
    legs = n_legs or n_long_short_of(n_assets)
    preds = cut_lineage(preds)
    book = cut_lineage(pf.long_short_book(preds, legs, legs))
    dates = pf.run_dates(preds)
    steps = pf.book_steps(book, dates)
    pnl = (pf.book_pnl(steps, 2 * legs, cost_bps) if vol_target is None else
           pf.vol_targeted_pnl(steps, 2 * legs, cost_bps, vol_target))
    pnl = cut_lineage(pnl)
    capture = pf.spread_capture(preds, book).groupBy("run_id").agg(F.avg("capture").alias("capture"))
    n_folds = preds.groupBy("run_id").agg(F.countDistinct("fold_id").alias("n_folds"))
    table = mt.ranking_table(mt.cs_ric_summary(mt.cs_ric(preds)), mt.sharpe_stats(pnl, horizon),
                             capture, pf.mean_turnover(pnl, n_assets), n_folds)
    return Backtest(preds, book, pnl, table)


def ranking_backtest(panel: DataFrame, n_assets: int, sp: wf.Splitter, horizon: int, cost_bps: float,
                     models: dict[str, md.Fit] | None = None, features: Sequence[str] = (),
                     n_legs: int | None = None, vol_target: float | None = None,
                     smooth: int = 1) -> Backtest:
    """Baselines and, if given, fitted models on one panel."""
    preds = baseline_predictions(panel, sp)
    if models:
        preds = preds.unionByName(model_predictions(panel, sp, models, features))
    if smooth > 1:
        preds = pf.smooth_predictions(preds, smooth)
    return evaluate(preds, n_assets, horizon, cost_bps, n_legs, vol_target)


def horizon_sweep(panels: dict[int, DataFrame], n_assets: int, cost_bps: float, min_train: int,
                  test_size: int, smooth: int = 21, n_legs: int | None = None) -> DataFrame:
    """(model, horizon, sharpe, mean_cs_ric, turnover), every run also with its
    predictions averaged over ``smooth`` dates. Runs of one horizon are evaluated
    together."""
    out = None
    for h, panel in panels.items():
        preds = baseline_predictions(panel, wf.Splitter(min_train, test_size, h))
        avg = pf.smooth_predictions(preds, smooth).withColumn(
            "run_id", F.concat("run_id", F.lit(f"_avg{smooth}")))
        t = evaluate(preds.unionByName(avg), n_assets, h, cost_bps, n_legs).table.select(
            F.col("run_id").alias("model"), F.lit(h).alias("horizon"), "sharpe", "mean_cs_ric",
            "turnover")
        out = t if out is None else out.unionByName(t)
    return out


def single_series_rows(prices: DataFrame, horizon: int, sp: wf.Splitter) -> DataFrame:
    """Complete rows of every asset with its own folds."""
    df = ts.forward_log_return(ts.own_features(prices), horizon).dropna(
        subset=[*ts.OWN_COLUMNS, "target"])
    ax = wf.date_axis(df, "asset")
    fd = wf.folds(wf.axis_counts(ax, "asset"), sp, "asset")
    return wf.assign(df, wf.date_folds(ax, fd, "asset"), "asset")


def single_series_backtest(prices: DataFrame, horizon: int, sp: wf.Splitter,
                           cost_bps: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RandomWalk, Drift and Momentum on each asset alone: (preds, folds, table)."""
    rows = cut_lineage(single_series_rows(prices, horizon, sp))
    stats = md.fold_statistics(rows, "mom_21d", "asset")
    test = rows.where("part = 'test'").join(stats, ["asset", "fold_id"])
    sd = F.when(F.col("train_sd") == 0, 1.0).otherwise(F.col("train_sd"))
    runs = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in (
        ("RandomWalk", F.lit(0.0)), ("Drift", F.col("train_mean")),
        ("Momentum", F.signum("mom_21d") * sd))])
    preds = test.select("asset", "fold_id", "date", F.col("target").alias("realized"),
                        F.explode(runs).alias("m")).select(
        F.concat_ws(":", "m.model", "asset").alias("run_id"), "m.model", "asset", "fold_id", "date",
        "m.pred", "realized")
    return preds, *series_report(preds, horizon, cost_bps)


def six_model_backtest(prices: DataFrame, horizon: int, sp: wf.Splitter, cost_bps: float, alpha: float = 0.01,
                       **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three models of ``single_series_backtest`` with ElasticNet and two boosted
    models, mean and upper decile, on each asset alone: (preds, folds, table). All
    assets and folds are fitted together: linear models from fold moments, trees in
    one boosting loop. ``how`` goes to the trees."""
    features = list(ts.OWN_COLUMNS)
    rows = ts.forward_log_return(ts.own_features(prices), horizon).dropna(subset=[*features, "target"])
    rows = cut_lineage(rows.join(wf.date_axis(rows, "asset"), ["asset", "date"]))
    fd = cut_lineage(wf.folds(wf.axis_counts(rows, "asset"), sp, "asset"))
    dates = wf.date_folds(rows.select("asset", "date", "idx"), fd, "asset")
    net = mo.elastic_net(mo.fold_moments(rows, fd, [*features, "target"], "asset"), len(features), alpha)
    stats = mo.fold_statistics(rows, fd, "mom_21d", "asset").join(net.select("asset", "fold_id", "coef", "intercept"), ["asset", "fold_id"])
    test = rows.drop("idx").join(dates.where("part = 'test'"), ["asset", "date"]).join(stats, ["asset", "fold_id"])
    sd = F.when(F.col("train_sd") == 0, 1.0).otherwise(F.col("train_sd"))
    runs = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in (
        ("RandomWalk", F.lit(0.0)), ("Drift", F.col("train_mean")), ("Momentum", F.signum("mom_21d") * sd),
        ("ElasticNet", mo.linear_prediction(features)))])
    plain = test.select("asset", "fold_id", "date", F.col("target").alias("realized"), F.explode(runs).alias("m")).select(
        "m.model", "asset", "fold_id", "date", "m.pred", "realized")
    parts = bo.fold_parts(rows.drop("idx"), dates, ["asset"], min_val=20).withColumn("series", F.col("asset"))
    trees = bo.boost(parts, ["series", "fold_id"], features, {"BoostedTrees": None, "BoostedTrees_q90": 0.9}, **how)
    preds = plain.unionByName(trees.drop("series")).withColumn("run_id", F.concat_ws(":", "model", "asset"))
    return preds, *series_report(preds, horizon, cost_bps)


def series_report(preds: DataFrame, horizon: int, cost_bps: float) -> tuple[DataFrame, DataFrame]:
    preds = cut_lineage(preds)
    folds = cut_lineage(mt.fold_metrics(preds, "run_id"))
    pnl = pf.series_pnl(pf.sign_positions(preds), cost_bps)
    table = mt.comparison_table(mt.run_metrics(preds, folds), mt.strategy_stats(pnl, horizon))
    return folds, table


def stored_predictor(spark, root: str, name: str):
    """(predict, features, trained_at) of the newest stored model of a name."""
    m = files.latest_model(spark, root, name).first()              # one row
    model = DefaultParamsReader.loadParamsInstance(m.path, spark.sparkContext)
    features = list(m.features)

    def predict(rows: DataFrame) -> DataFrame:
        return model.transform(md.assemble(rows, features)).drop("_features").withColumnRenamed(
            "prediction", "pred")
    return predict, features, m.trained_at


def weekly_signal(prices: DataFrame, horizon: int = 5, predict=None,
                  features: Sequence[str] = ()) -> DataFrame:
    """Latest signal: ranking, momentum and volatility per asset with the
    volatility regime and scale of the universe. Scores are the reversal's, or those
    of a trained model on each asset's last complete row; an asset without one gets 0."""
    score = pf.reversal_score(prices)
    if predict is not None:
        latest = pn.align_columns(pn.latest_rows(ts.own_features(prices), features), features)
        score = score.drop("pred").join(predict(latest).select("asset", "pred"), "asset", "left").withColumn(
            "pred", F.coalesce("pred", F.lit(0.0)))
    score = pf.live_ranking(score)
    ret = ts.log_returns(prices.where(F.col("close").isNotNull())).where(F.col("ret").isNotNull())
    vol = ts.ewma_vol(ret.select("asset", "date", "ret")).groupBy("asset").agg(
        F.max_by("ewma_vol", "date").alias("vol"))
    regime = pf.vol_regime(vol).select(F.struct("vol_regime", "vol_scale")).scalar()
    df = score.join(vol, "asset", "left").withColumn("_g", regime)
    return df.select("asset", "date", F.lit(horizon).alias("horizon"), "rank", "position",
                     F.round("pred", 6).alias("predicted_return"),
                     F.round("recent_mom", 6).alias("recent_mom_5d"),
                     F.round("vol", 4).alias("current_vol"),
                     F.col("_g.vol_regime").alias("vol_regime"),
                     F.round("_g.vol_scale", 3).alias("vol_scale"))


def live_report(signals: DataFrame, prices: DataFrame, trades: DataFrame, accounts: DataFrame,
                snapshots: DataFrame, start: float, min_pairs: int = 10) -> dict[str, DataFrame]:
    """All tables of the live report by name."""
    trades = lg.active_trades(trades, accounts)
    ic = cut_lineage(lg.ic_table(signals, prices, min_pairs=min_pairs))
    fid = cut_lineage(lg.fidelity_table(signals, trades))
    pnl = cut_lineage(lg.pnl_timeseries(trades))
    weekly = lg.weekly_pnl(pnl.where("symbol = 'TOTAL'"))
    return {
        "ic": ic, "ic_summary": lg.skill_call(lg.ic_summary(ic)), "fidelity": fid,
        "fidelity_summary": lg.fidelity_summary(fid), "pnl": pnl, "weekly": weekly,
        "weekly_pairs": lg.weekly_pair_pnl(pnl), "pairs": lg.pair_stats(trades),
        "accounts": lg.account_stats(accounts, trades), "trades": lg.trade_stats(trades),
        "positions": lg.current_positions(signals, snapshots),
        "wallet": lg.wallet(trades, lg.floating_pnl(snapshots), start),
        "projection": lg.project_wallet(weekly, start), "unscored": lg.unscored(signals, ic),
        "missing_history": files.missing_history(accounts, trades)}


def backtest_report(preds: DataFrame, horizon: int, cost_bps: float, tag: str) -> dict[str, DataFrame]:
    """Comparison, per-fold, curve, rolling IC and verdict tables of series runs,
    each row tagged with the configuration fingerprint."""
    preds = cut_lineage(preds)
    folds, table = series_report(preds, horizon, cost_bps)
    curve = pf.equity_curve(pf.daily_net(pf.sign_positions(preds), cost_bps))
    named = table.select(F.split_part("run_id", F.lit(":"), F.lit(1)).alias("model"),
                         F.split_part("run_id", F.lit(":"), F.lit(2)).alias("series"), "pooled_ic",
                         "ic_stability", "sharpe")
    out = {"comparison": table, "folds": folds.join(mt.fold_dates(preds, "run_id"),
                                                    ["run_id", "fold_id"]),
           "curve": curve.select("run_id", "date", "equity"),
           "rolling_ic": mt.rolling_ic(preds).select("run_id", "date", "rolling_ic"),
           "verdict": mt.verdict(named)}
    return {k: v.withColumn("config_tag", F.lit(tag)) for k, v in out.items()}


def feature_matrix(prices: DataFrame, macro_features: DataFrame, target: str, path: str,
                   force: bool = False, **kw) -> DataFrame:
    """Single-target matrix stored under ``path`` and read back afterwards."""
    spark = prices.sparkSession

    def build() -> DataFrame:
        m = pn.target_matrix(prices, macro_features, target, **kw)
        bad = pn.calendar_mismatch(m, prices, target).limit(1).count()
        if bad:
            raise ValueError("feature matrix does not match the target's calendar")
        return m
    return files.cached(spark, path, build, force)


def signal_history(prices: DataFrame) -> DataFrame:
    return sg.signal_documents(sg.weekly_scores(prices))
