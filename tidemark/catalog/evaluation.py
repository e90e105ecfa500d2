"""Queries of models, positions, profit and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import panel as cp
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, sig, with_
from tidemark.catalog.timeseries import bars
from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import rounded, significant
from tidemark.functions.ranks import average_rank
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import portfolio as pf
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf
from tidemark.plans import jobs

HORIZONS = (5, 21, 63)
RUNS = ("EqualWeight", "MomentumRank", "MeanReversion")


# ── out-of-sample predictions of the ranking baselines ──────────────────────
def ranking_ctes(h: int) -> str:
    x = "" if h == 5 else f"_{h}"
    if h != 5:
        cte(f"label{x}", f"SELECT asset, date, ln(lead(close, {h}) {ct.W} / close) AS target FROM bars", "bars")
        cte(f"axis{x}", f"""
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx FROM (
  SELECT date FROM feat JOIN label{x} USING (asset, date)
  WHERE ret_5d IS NOT NULL AND mom_21d IS NOT NULL AND target IS NOT NULL
  GROUP BY 1 HAVING count(*) = 5)""", "feat", f"label{x}")
    target = "target_5d" if h == 5 else "target"
    cte(f"rk_test{x}", f"""
SELECT f.asset, f.date, CAST(floor((a.idx - {504 + h}) / 252) AS INTEGER) AS fold_id, ret_5d, mom_21d,
       {target} AS realized
FROM axis{x} a JOIN feat f ON f.date = a.date JOIN label{x} l ON l.date = f.date AND l.asset = f.asset
WHERE a.idx >= {504 + h} AND a.idx < {504 + h} + 252 * floor(((SELECT count(*) FROM axis{x}) - {504 + h}) / 252)""",
        f"axis{x}", "feat", f"label{x}")
    cte(f"rk_preds{x}", " UNION ALL ".join(
        f"SELECT '{m}' AS run_id, fold_id, date, asset, {p} AS pred, realized FROM rk_test{x}"
        for m, p in zip(RUNS, ("0.0::DOUBLE", "mom_21d", "-ret_5d"))), f"rk_test{x}")
    return x


for _h in HORIZONS:
    ranking_ctes(_h)


def rk_test(s, d, h=5):
    df = ts.forward_log_return(ts.own_features(bars(s, d)), h)
    keep = wf.complete_dates(df, ["ret_5d", "mom_21d", "target"], 5)
    df = df.join(keep, ["date"], "left_semi")
    ax = wf.date_axis(df)
    fd = wf.folds(wf.axis_counts(ax), wf.Splitter(504, 252, h))
    dates = wf.date_folds(ax, fd).where("part = 'test'")
    return wf.assign(df, dates).withColumn("realized", F.col("target"))


def rk_preds(s, d, h=5):
    """All baseline runs from one pass: each test row carries every model."""
    t = rk_test(s, d, h)
    runs = F.array(*[F.struct(F.lit(m).alias("run_id"), p.alias("pred")) for m, p in zip(
        RUNS, (F.lit(0.0), F.col("mom_21d"), -F.col("ret_5d")))])
    return cut_lineage(t.select(
        "fold_id", "date", "asset", "realized", F.explode(runs).alias("m")).select(
        "m.run_id", "fold_id", "date", "asset", "m.pred", "realized"))


PRED_COLS = ("run_id", "fold_id", "date", "asset", "pred", "realized")


def _model(name, sql, fn):
    @query(name, with_("rk_test", f"""
SELECT asset, date, fold_id, '{sql[0]}' AS model, {rnd(f'{sql[1]} AS pred|realized')} FROM rk_test"""))
    def _(s, d):
        return rounded(fn(rk_test(s, d)), 8, "asset", "date", "fold_id", "model", "pred", "realized")


_model("m01_random_walk", ("RandomWalk", "0.0::DOUBLE"), md.random_walk)
_model("m04_equal_weight", ("EqualWeight", "0.0::DOUBLE"), md.equal_weight)
_model("m05_momentum_rank", ("MomentumRank", "mom_21d"), md.momentum_rank)
_model("m06_mean_reversion", ("MeanReversion", "-ret_5d"), md.mean_reversion)

# ── single-series predictions ───────────────────────────────────────────────
cte("sa_rows", """
SELECT asset, date, ret_5d, mom_21d, target_5d AS target,
       row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS idx
FROM feat JOIN label USING (asset, date) WHERE dist_ma_60 IS NOT NULL AND vol_21d IS NOT NULL
  AND ret_21d IS NOT NULL AND target_5d IS NOT NULL""", "feat", "label")
cte("sa_folds", """
SELECT asset, CAST(k AS INTEGER) AS fold_id, 504 + 252 * k AS train_hi, 509 + 252 * k AS test_lo,
       761 + 252 * k AS test_hi
FROM (SELECT asset, count(*) AS n FROM sa_rows GROUP BY 1), range(0, 1000) t(k)
WHERE 761 + 252 * k <= n""", "sa_rows")
cte("sa_stats", """
SELECT f.asset, fold_id, avg(target) AS train_mean, stddev_pop(mom_21d) AS train_sd
FROM sa_folds f JOIN sa_rows r ON r.asset = f.asset AND idx < train_hi GROUP BY 1, 2""",
    "sa_folds", "sa_rows")
cte("sa_test", """
SELECT r.*, f.fold_id, train_mean, CASE WHEN train_sd = 0 THEN 1.0 ELSE train_sd END AS train_sd
FROM sa_folds f JOIN sa_rows r ON r.asset = f.asset AND idx >= test_lo AND idx < test_hi
JOIN sa_stats s ON s.asset = f.asset AND s.fold_id = f.fold_id""", "sa_folds", "sa_rows", "sa_stats")
SA = {"RandomWalk": "0.0::DOUBLE", "Drift": "train_mean", "Momentum": "sign(mom_21d) * train_sd",
      "Reversal": "-ret_5d"}
cte("sa_preds", " UNION ALL ".join(
    f"SELECT '{m}:' || asset AS run_id, '{m}' AS model, asset, fold_id, date, {p} AS pred, target AS realized "
    f"FROM sa_test" for m, p in SA.items()), "sa_test")


def sa_rows(s, d):
    df = ts.forward_log_return(ts.own_features(bars(s, d)), 5)
    df = df.dropna(subset=["dist_ma_60", "vol_21d", "ret_21d", "target"])
    ax = wf.date_axis(df, "asset")
    fd = wf.folds(wf.axis_counts(ax, "asset"), wf.Splitter(504, 252, 5), "asset")
    return wf.assign(df, wf.date_folds(ax, fd, "asset"), "asset")


def sa_preds(s, d):
    rows = sa_rows(s, d)
    stats = md.fold_statistics(rows, "mom_21d", "asset")
    test = rows.where("part = 'test'").join(stats, ["asset", "fold_id"])
    sd = F.when(F.col("train_sd") == 0, 1.0).otherwise(F.col("train_sd"))
    preds = (F.lit(0.0), F.col("train_mean"), F.signum("mom_21d") * sd, -F.col("ret_5d"))
    runs = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred"))
                     for m, p in zip(SA, preds)])
    df = test.select("asset", "fold_id", "date", F.col("target").alias("realized"),
                     F.explode(runs).alias("m"))
    return cut_lineage(df.select(F.concat_ws(":", "m.model", "asset").alias("run_id"), "m.model",
                                 "asset", "fold_id", "date", "m.pred", "realized"))


@query("m02_drift", with_("sa_test", f"""
SELECT asset, date, fold_id, {rnd('train_mean AS pred')} FROM sa_test"""))
def _(s, d):
    rows = sa_rows(s, d)
    df = md.drift(rows.where("part = 'test'"), md.fold_statistics(rows, "mom_21d", "asset"), "asset")
    return rounded(df, 8, "asset", "date", "fold_id", "pred")


@query("m03_momentum", with_("sa_test", f"""
SELECT asset, date, fold_id, {rnd('sign(mom_21d) * train_sd AS pred')} FROM sa_test"""))
def _(s, d):
    rows = sa_rows(s, d)
    df = md.momentum(rows.where("part = 'test'"), md.fold_statistics(rows, "mom_21d", "asset"),
                     "mom_21d", "asset")
    return rounded(df, 8, "asset", "date", "fold_id", "pred")


@query("m12_relevance", with_("rk_test", f"""
SELECT asset, date, CAST(row_number() OVER (PARTITION BY date ORDER BY realized, asset) - 1 AS INTEGER)
  AS relevance FROM rk_test"""))
def _(s, d):
    return md.relevance(rk_test(s, d)).select("asset", "date", "relevance")


@query("m13_group_sizes", with_("bars", "SELECT date, count(*) AS n_rows FROM bars GROUP BY 1"))
def _(s, d):
    return md.group_sizes(bars(s, d))


def _ndcg(k: int) -> str:
    return f"""round(sum(CASE WHEN pos <= {k} THEN (pow(2, rel) - 1) / log2(pos + 1) END)
  / sum(CASE WHEN ideal <= {k} THEN (pow(2, rel) - 1) / log2(ideal + 1) END), 8) + 0.0 AS ndcg_{k}"""


cte("rel", """
SELECT *, row_number() OVER (PARTITION BY run_id, date ORDER BY realized, asset) - 1 AS rel,
  row_number() OVER (PARTITION BY run_id, date ORDER BY pred DESC, asset) AS pos FROM rk_preds""", "rk_preds")
cte("rel2", "SELECT *, row_number() OVER (PARTITION BY run_id, date ORDER BY rel DESC) AS ideal FROM rel", "rel")


@query("m14_ndcg", with_("rel2", f"SELECT run_id, date, {_ndcg(3)}, {_ndcg(5)} FROM rel2 GROUP BY 1, 2"))
def _(s, d):
    p = rk_preds(s, d)
    return rounded(mt.ndcg(p, 3).join(mt.ndcg(p, 5), ["run_id", "date"]), 8)


# ── positions and profit of the ranking runs ────────────────────────────────
BPS = 3.0
LEGS = 4
RW = "OVER (PARTITION BY run_id, asset ORDER BY date)"


def positions_cte(name: str, source: str, n: int, wins: str = "short") -> None:
    lo = f"row_number() OVER (PARTITION BY run_id, date ORDER BY pred, asset) <= {n}"
    hi = f"row_number() OVER (PARTITION BY run_id, date ORDER BY pred DESC, asset DESC) <= {n}"
    order = f"WHEN {lo} THEN -1.0 WHEN {hi} THEN 1.0" if wins == "short" else \
        f"WHEN {hi} THEN 1.0 WHEN {lo} THEN -1.0"
    cte(name, f"""
SELECT *, CAST(CASE WHEN stddev_pop(pred) OVER (PARTITION BY run_id, date) < 1e-12 THEN 0.0 {order} ELSE 0.0 END
  AS DOUBLE) AS pos FROM {source}""", source)


positions_cte("pos2", "rk_preds", 2)
positions_cte("pos3", "rk_preds", 3)
positions_cte("pos3_long", "rk_preds", 3, "long")
cte("steps", f"""
SELECT run_id, date, sum(pos * realized) / {LEGS} AS gross, sum(abs(pos - prev)) AS moved FROM (
  SELECT *, coalesce(lag(pos) {RW}, 0) AS prev FROM pos2) GROUP BY 1, 2""", "pos2")
cte("pnl", f"SELECT *, moved / {LEGS} * {BPS / 1e4}::DOUBLE AS cost, gross - moved / {LEGS} * {BPS / 1e4}::DOUBLE"
    " AS net FROM steps", "steps")


def book2(p):
    return pf.long_short_book(p, 2, 2)


def steps2(p):
    return pf.book_steps(book2(p), pf.run_dates(p))


def pnl2(p):
    return pf.book_pnl(steps2(p), LEGS, BPS)


cte("smooth", f"""
SELECT run_id, fold_id, date, asset, realized, avg(pred) OVER (PARTITION BY run_id, asset ORDER BY date
  ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS pred FROM rk_preds""", "rk_preds")


@query("p01_smooth_predictions", with_("smooth", f"SELECT run_id, date, asset, {rnd('pred')} FROM smooth"))
def _(s, d):
    return rounded(pf.smooth_predictions(rk_preds(s, d), 21), 8, "run_id", "date", "asset", "pred")


@query("p02_long_short_positions", with_("pos2", "SELECT run_id, date, asset, pos FROM pos2"))
def _(s, d):
    p = rk_preds(s, d)
    return pf.dense_positions(p, book2(p)).select("run_id", "date", "asset", "pos")


@query("p02_overlap_short_wins", with_("pos3", "SELECT run_id, date, asset, pos FROM pos3 WHERE pos <> 0"))
def _(s, d):
    return pf.long_short_book(rk_preds(s, d), 3, 3).select("run_id", "date", "asset", "pos")


@query("p02_overlap_long_wins", with_("pos3_long", "SELECT run_id, date, asset, pos FROM pos3_long WHERE pos <> 0"))
def _(s, d):
    return pf.long_short_book(rk_preds(s, d), 3, 3, short_wins=False).select(
        "run_id", "date", "asset", "pos")


cte("wide_preds", f"""
SELECT 'wide' AS run_id, date, asset, -ret_1d AS pred, nx AS realized FROM (
  SELECT *, lead(ret_1d) {ct.W} AS nx FROM wide_ret) WHERE ret_1d IS NOT NULL AND nx IS NOT NULL""", "wide_ret")
positions_cte("wide_pos", "wide_preds", 3)


def wide_preds(s, d):
    """Weekly reversal over every supplier: the universe grows with the data."""
    df = ts.lagged_returns(ct.wide_bars(s, d), (1,))
    df = df.withColumn("realized", F.lead("ret_1d", 1).over(ts.hist()))
    return df.dropna(subset=["ret_1d", "realized"]).select(
        F.lit("wide").alias("run_id"), "date", "asset", (-F.col("ret_1d")).alias("pred"), "realized")


@query("p02_book_wide_universe", with_("wide_pos", "SELECT run_id, date, asset, pos FROM wide_pos WHERE pos <> 0"))
def _(s, d):
    return pf.long_short_book(wide_preds(s, d), 3, 3).select("run_id", "date", "asset", "pos")


SW = "OVER (PARTITION BY run_id ORDER BY date)"


@query("p03_sign_positions", with_("sa_preds", """
SELECT run_id, date, coalesce(sign(pred), 0)::DOUBLE AS pos FROM sa_preds"""))
def _(s, d):
    return pf.sign_positions(sa_preds(s, d)).select("run_id", "date", "pos")


cte("scaled", """
SELECT *, CASE WHEN z IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, z)) END AS pos FROM (
  SELECT *, pred / nullif(stddev_pop(pred) OVER (PARTITION BY run_id), 0) AS z FROM sa_preds)""", "sa_preds")


@query("p04_scaled_positions", with_("scaled", f"SELECT run_id, date, {rnd('pos')} FROM scaled"))
def _(s, d):
    return rounded(pf.scaled_positions(sa_preds(s, d)), 8, "run_id", "date", "pos")


cte("sa_pos", "SELECT *, coalesce(sign(pred), 0)::DOUBLE AS pos FROM sa_preds", "sa_preds")
cte("sa_turn", f"SELECT *, abs(pos - coalesce(lag(pos) {SW}, 0)) AS turnover FROM sa_pos", "sa_pos")
cte("sa_pnl", "SELECT *, pos * realized - turnover * 0.0005::DOUBLE AS net FROM sa_turn", "sa_turn")


def sa_pnl(s, d):
    return pf.series_pnl(pf.sign_positions(sa_preds(s, d)), 5.0)


@query("p05_turnover", with_("sa_turn", f"SELECT run_id, date, {rnd('turnover')} FROM sa_turn"))
def _(s, d):
    return rounded(sa_pnl(s, d), 8, "run_id", "date", "turnover")


@query("p06_series_pnl", with_("sa_pnl", f"SELECT run_id, date, {rnd('net')} FROM sa_pnl"))
def _(s, d):
    return rounded(sa_pnl(s, d), 8, "run_id", "date", "net")


@query("p07_book_pnl", with_("pnl", f"SELECT run_id, date, {rnd('gross cost net')} FROM pnl"))
def _(s, d):
    return rounded(pnl2(rk_preds(s, d)), 8, "run_id", "date", "gross", "cost", "net")


VOL_SQL = f"""
SELECT run_id, date, {{cols}} FROM vt"""
VOL_EXTRA = f"""
st AS (
  SELECT run_id, date, row_number() {SW} AS seq, sum(pos * realized) AS g,
         count(CASE WHEN pos <> 0 AND prev = pos THEN 1 END) AS kept, count(CASE WHEN pos <> 0 AND prev = -pos THEN 1 END) AS flip,
         count(CASE WHEN pos <> 0 AND prev = 0 THEN 1 END) AS new, count(CASE WHEN pos = 0 AND prev <> 0 THEN 1 END) AS gone
  FROM (SELECT *, coalesce(lag(pos) {RW}, 0) AS prev FROM pos2) GROUP BY 1, 2),
sc AS (SELECT st.*, 0.0::DOUBLE AS z FROM st),
vt AS (
  SELECT run_id, date, seq, 1.0::DOUBLE AS s, (kept + 2 * flip + new + gone)::DOUBLE AS moved,
         g / {LEGS} - (new)::DOUBLE / {LEGS} * {BPS / 1e4}::DOUBLE AS net,
         [g / {LEGS} - (new)::DOUBLE / {LEGS} * {BPS / 1e4}::DOUBLE] AS hist
  FROM sc WHERE seq = 1
  UNION ALL
  SELECT run_id, date, seq, s, moved, s * g / {LEGS} - moved / {LEGS} * {BPS / 1e4}::DOUBLE,
         list_append(hist[-20:], s * g / {LEGS} - moved / {LEGS} * {BPS / 1e4}::DOUBLE)
  FROM (SELECT *, kept * abs(s - prev_s) + flip * (s + prev_s) + new * s + gone * prev_s AS moved FROM (
    SELECT sc.run_id, sc.date, sc.seq, sc.g, sc.kept, sc.flip, sc.new, sc.gone, vt.s AS prev_s, vt.hist,
      CASE WHEN len(vt.hist) < 21 THEN 1.0::DOUBLE
           WHEN list_aggregate(vt.hist, 'stddev_pop') * sqrt(252) < 1e-8 THEN 2.0::DOUBLE
           ELSE least(2.0, 0.1::DOUBLE / (list_aggregate(vt.hist, 'stddev_pop') * sqrt(252))) END AS s
    FROM vt JOIN sc ON sc.run_id = vt.run_id AND sc.seq = vt.seq + 1)))"""


@query("p08_vol_targeting", with_("pos2", f"""
SELECT run_id, date, {rnd('net|s AS vol_scale', 6)} FROM vt""", recursive=True, extra=VOL_EXTRA))
def _(s, d):
    df = pf.vol_targeted_pnl(steps2(rk_preds(s, d)), LEGS, BPS)
    return rounded(df, 6, "run_id", "date", "net", "vol_scale")


cte("lsr", """
SELECT run_id, date, sum(pos * realized) / nullif(sum(abs(pos)), 0) AS ls_return,
       max(realized) - min(realized) AS spread FROM pos2 GROUP BY 1, 2""", "pos2")


@query("p09_gross_return", with_("lsr", f"SELECT run_id, date, {rnd('ls_return')} FROM lsr"))
def _(s, d):
    p = rk_preds(s, d)
    return rounded(pf.gross_return(book2(p), pf.run_dates(p)), 8, "run_id", "date", "ls_return")


@query("p10_spread_capture", with_("lsr", f"""
SELECT run_id, date, {rnd('ls_return / nullif(spread, 0) AS capture')} FROM lsr"""))
def _(s, d):
    p = rk_preds(s, d)
    return rounded(pf.spread_capture(p, book2(p)), 8, "run_id", "date", "capture")


@query("p11_mean_turnover", with_("steps", f"""
SELECT run_id, {rnd('avg(moved) / 5 AS turnover')} FROM steps GROUP BY 1"""))
def _(s, d):
    return rounded(pf.mean_turnover(pnl2(rk_preds(s, d)), 5), 8)


@query("p12_daily_net", with_("sa_pnl", f"SELECT run_id, date, {rnd('coalesce(net, 0) AS net')} FROM sa_pnl"))
def _(s, d):
    return rounded(pf.daily_net(pf.sign_positions(sa_preds(s, d)), 5.0), 8, "run_id", "date", "net")


@query("p13_equity_curve", with_("pnl", f"""
SELECT run_id, date, {sig(f'product(1 + net) {SW}', 'equity')} FROM pnl"""))
def _(s, d):
    return significant(pf.equity_curve(pnl2(rk_preds(s, d))).select("run_id", "date", "equity"),
                       "equity")


cte("rev", f"""
SELECT asset, date, ln(close / lag(close, 5) {ct.W}) AS mom FROM bars
QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) = 1""", "bars")


@query("p15_reversal_score", with_("rev", f"""
SELECT asset, date, {rnd('mom AS recent_mom|coalesce(-mom, 0) AS pred')} FROM rev"""))
def _(s, d):
    return rounded(pf.reversal_score(bars(s, d)), 8)


@query("p14_live_ranking", with_("rev", """
SELECT asset, CAST(row_number() OVER (ORDER BY -mom DESC, asset) AS INTEGER) AS rank,
  CASE row_number() OVER (ORDER BY -mom DESC, asset) WHEN 1 THEN 'LONG' WHEN 5 THEN 'SHORT' ELSE 'FLAT' END AS position
FROM rev"""))
def _(s, d):
    return pf.live_ranking(pf.reversal_score(bars(s, d))).select("asset", "rank", "position")


cte("last_vol", "SELECT max_by(ewma_vol, date) AS vol FROM ewma GROUP BY asset", "ewma")


@query("p16_vol_regime", with_("last_vol", """
SELECT round(avg(vol), 8) AS avg_vol, CASE WHEN avg(vol) IS NULL THEN 'unknown' WHEN avg(vol) < 0.18 THEN 'low'
  WHEN avg(vol) > 0.3 THEN 'high' ELSE 'normal' END AS vol_regime FROM last_vol"""))
def _(s, d):
    return rounded(_regime(s, d), 8, "avg_vol", "vol_regime")


def _regime(s, d):
    v = ts.ewma_vol(ct.returns(s, d)).groupBy("asset").agg(F.max_by("ewma_vol", "date").alias("vol"))
    return pf.vol_regime(v)


@query("p17_vol_scale", with_("last_vol", """
SELECT round(least(2.0, greatest(0.0, 0.1::DOUBLE / avg(vol))), 8) AS vol_scale FROM last_vol"""))
def _(s, d):
    return rounded(_regime(s, d), 8, "vol_scale")


# ── metrics ─────────────────────────────────────────────────────────────────
CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


def ranks_cte(name: str, source: str, keys: str) -> None:
    def r(c: str) -> str:
        return (f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER "
                f"(PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE AS r_{c}")
    cte(name, f"SELECT *, {r('pred')}, {r('realized')} FROM {source}", source)


ranks_cte("sa_ranks", "sa_preds", "run_id")
ranks_cte("sa_fold_ranks", "sa_preds", "run_id, fold_id")
ranks_cte("rk_ranks", "rk_preds", "run_id, date")
ranks_cte("wide_ranks", "wide_preds", "run_id, date")
cte("a_ic", f"SELECT run_id, {CORR.format('pred', 'realized')} AS ic FROM sa_preds GROUP BY 1", "sa_preds")
cte("a_ric", f"SELECT run_id, {CORR.format('r_pred', 'r_realized')} AS rank_ic FROM sa_ranks GROUP BY 1", "sa_ranks")
cte("a_hit", """
SELECT run_id, avg(CASE WHEN pred <> 0 THEN CASE WHEN sign(pred) = sign(realized) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)
  AS hit_rate FROM sa_preds GROUP BY 1""", "sa_preds")
cte("a_cs", f"""
SELECT run_id, date, CASE WHEN count(*) >= 2 AND stddev_pop(pred) > 1e-12 AND stddev_pop(realized) > 1e-12
  THEN round({CORR.format('r_pred', 'r_realized')}, 12) END AS cs_ric FROM {{0}} GROUP BY 1, 2""".replace("{0}", "rk_ranks"), "rk_ranks")


@query("a01_information_coefficient", with_("a_ic", f"SELECT run_id, {rnd('ic')} FROM a_ic"))
def _(s, d):
    return rounded(mt.ic(sa_preds(s, d), "run_id"), 8)


@query("a02_rank_ic", with_("a_ric", f"SELECT run_id, {rnd('rank_ic')} FROM a_ric"))
def _(s, d):
    return rounded(mt.rank_ic(sa_preds(s, d), "run_id"), 8)


cte("a_ranks", "SELECT run_id, date, r_pred AS rank FROM sa_ranks", "sa_ranks")


@query("a02_split_ranks", with_("a_ranks", "SELECT run_id, date, rank FROM a_ranks"))
def _(s, d):
    df = average_rank(sa_preds(s, d), ["run_id"], "pred", "rank")
    return df.select("run_id", "date", F.col("rank").cast("double"))


@query("a03_directional_accuracy", with_("a_hit", f"SELECT run_id, {rnd('hit_rate')} FROM a_hit"))
def _(s, d):
    return rounded(mt.directional_accuracy(sa_preds(s, d), "run_id"), 8)


@query("a04_cs_rank_ic", with_("a_cs", f"SELECT run_id, date, {rnd('cs_ric')} FROM a_cs"))
def _(s, d):
    return rounded(mt.cs_ric(rk_preds(s, d)), 8)


@query("a04_cs_rank_ic_wide", with_("wide_ranks", f"""
SELECT run_id, date, {rnd(f'''CASE WHEN count(*) >= 2 AND stddev_pop(pred) > 1e-12 AND stddev_pop(realized) > 1e-12
  THEN round({CORR.format('r_pred', 'r_realized')}, 12) END AS cs_ric''')} FROM wide_ranks GROUP BY 1, 2"""))
def _(s, d):
    return rounded(mt.cs_ric(wide_preds(s, d).persist()), 8)


cte("a_cs_sum", """
SELECT run_id, avg(cs_ric) AS mean_cs_ric, stddev_samp(cs_ric) AS std_cs_ric,
  avg(CASE WHEN cs_ric > 0 THEN 1.0::DOUBLE WHEN cs_ric IS NOT NULL THEN 0.0::DOUBLE END) AS cs_ric_stability
FROM a_cs GROUP BY 1""", "a_cs")


@query("a05_cs_rank_ic_summary", with_("a_cs_sum", f"""
SELECT run_id, {rnd('mean_cs_ric std_cs_ric cs_ric_stability')} FROM a_cs_sum"""))
def _(s, d):
    return rounded(mt.cs_ric_summary(mt.cs_ric(rk_preds(s, d))), 8)


def sharpe_cte(name: str, source: str, h: int) -> None:
    """Sharpe block of every h-th row of (run_id, date, net)."""
    cte(f"{name}_sub", f"SELECT * FROM {source} QUALIFY (row_number() {SW} - 1) % {h} = 0", source)
    cte(f"{name}_curve", f"SELECT *, product(1 + net) {SW} AS curve FROM {name}_sub", f"{name}_sub")
    cte(f"{name}_dd", f"SELECT *, curve / max(curve) {SW} - 1 AS dd FROM {name}_curve", f"{name}_curve")
    cte(name, f"""
SELECT *, CASE WHEN ann_vol > 1e-12 THEN ann_return / ann_vol END AS sharpe FROM (
  SELECT run_id, avg(net) * {252 / h}::DOUBLE AS ann_return, stddev_pop(net) * sqrt({252 / h}::DOUBLE) AS ann_vol,
         min(dd) AS max_drawdown FROM {name}_dd GROUP BY 1)""", f"{name}_dd")


sharpe_cte("rk_sharpe", "pnl", 5)
sharpe_cte("sa_sharpe", "sa_pnl", 5)


@query("a06_every_hth_row", with_("rk_sharpe_sub", f"SELECT run_id, date, {rnd('net')} FROM rk_sharpe_sub"))
def _(s, d):
    return rounded(mt.every_hth(pnl2(rk_preds(s, d)), 5), 8, "run_id", "date", "net")


@query("a07_sharpe", with_("rk_sharpe", f"SELECT run_id, {rnd('ann_return ann_vol sharpe', 6)} FROM rk_sharpe"))
def _(s, d):
    return rounded(mt.sharpe_stats(pnl2(rk_preds(s, d)), 5), 6, "run_id", "ann_return", "ann_vol", "sharpe")


@query("a08_max_drawdown", with_("rk_sharpe", f"SELECT run_id, {rnd('max_drawdown')} FROM rk_sharpe"))
def _(s, d):
    return rounded(mt.sharpe_stats(pnl2(rk_preds(s, d)), 5), 8, "run_id", "max_drawdown")


cte("sa_stats_all", """
SELECT run_id, ann_return, ann_vol, sharpe, max_drawdown, turnover, hit_rate
FROM sa_sharpe JOIN (SELECT run_id, avg(turnover) AS turnover FROM sa_pnl GROUP BY 1) USING (run_id)
JOIN a_hit USING (run_id)""", "sa_sharpe", "sa_pnl", "a_hit")


@query("a09_strategy_stats", with_("sa_stats_all", f"""
SELECT run_id, {sig('max_drawdown', 'max_drawdown')},
  {rnd('ann_return ann_vol sharpe turnover hit_rate', 6)} FROM sa_stats_all"""))
def _(s, d):
    df = significant(mt.strategy_stats(sa_pnl(s, d), 5), "max_drawdown")
    return rounded(df, 6, "run_id", "ann_return", "ann_vol", "sharpe", "turnover", "hit_rate") \
        .join(df.select("run_id", "max_drawdown"), "run_id")


cte("sa_fold_m", f"""
SELECT run_id, fold_id, count(*) AS test_rows,
  CASE WHEN count(*) >= 3 THEN {CORR.format('pred', 'realized')} END AS ic,
  CASE WHEN count(*) >= 3 THEN {CORR.format('r_pred', 'r_realized')} END AS rank_ic,
  avg(CASE WHEN pred <> 0 THEN CASE WHEN sign(pred) = sign(realized) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS hit_rate
FROM sa_fold_ranks GROUP BY 1, 2""", "sa_fold_ranks")


@query("a10_fold_metrics", with_("sa_fold_m", f"""
SELECT run_id, fold_id, test_rows, {rnd('ic rank_ic hit_rate', 6)} FROM sa_fold_m"""))
def _(s, d):
    return rounded(mt.fold_metrics(sa_preds(s, d), "run_id"), 6, "run_id", "fold_id", "test_rows",
                   "ic", "rank_ic", "hit_rate")


cte("sa_run_m", """
SELECT run_id, ic AS pooled_ic, rank_ic AS pooled_rank_ic, mean_ic, mean_rank_ic, mean_hit_rate, ic_stability
FROM a_ic JOIN a_ric USING (run_id) JOIN (
  SELECT run_id, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, avg(hit_rate) AS mean_hit_rate,
    avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic IS NOT NULL THEN 0.0::DOUBLE END) AS ic_stability
  FROM sa_fold_m GROUP BY 1) USING (run_id)""", "a_ic", "a_ric", "sa_fold_m")
RUN_M = "pooled_ic pooled_rank_ic mean_ic mean_rank_ic mean_hit_rate ic_stability"


def sa_runs(s, d):
    p = sa_preds(s, d)
    return mt.run_metrics(p, mt.fold_metrics(p, "run_id"))


@query("a11_run_metrics", with_("sa_run_m", f"SELECT run_id, {rnd(RUN_M, 6)} FROM sa_run_m"))
def _(s, d):
    return rounded(sa_runs(s, d), 6, "run_id", *RUN_M.split())


@query("a12_comparison_table", with_("sa_run_m sa_stats_all", f"""
SELECT run_id, {rnd('pooled_ic pooled_rank_ic mean_ic', 4)}, {rnd('ic_stability sharpe', 2)},
  {rnd('ann_return max_drawdown turnover hit_rate', 3)} FROM sa_run_m JOIN sa_stats_all USING (run_id)"""))
def _(s, d):
    return mt.comparison_table(sa_runs(s, d), mt.strategy_stats(sa_pnl(s, d), 5))


def ranking_table_for(p, h: int):
    return jobs.evaluate(p, 5, h, BPS, n_legs=2).table


def ranking_table_cte(x: str, h: int) -> None:
    """All expressions of a comparison table over ``rk_preds<x>``."""
    if x:
        ranks_cte(f"rk_ranks{x}", f"rk_preds{x}", "run_id, date")
        cte(f"a_cs{x}", CTE_CS.replace("rk_ranks", f"rk_ranks{x}"), f"rk_ranks{x}")
        cte(f"a_cs_sum{x}", CTE_SUM.replace("FROM a_cs ", f"FROM a_cs{x} "), f"a_cs{x}")
        positions_cte(f"pos2{x}", f"rk_preds{x}", 2)
        cte(f"steps{x}", CTE_STEPS.replace("FROM pos2)", f"FROM pos2{x})"), f"pos2{x}")
        cte(f"pnl{x}", CTE_PNL.replace("FROM steps", f"FROM steps{x}"), f"steps{x}")
        sharpe_cte(f"rk_sharpe{x}", f"pnl{x}", h)
        cte(f"lsr{x}", CTE_LSR.replace("FROM pos2 ", f"FROM pos2{x} "), f"pos2{x}")
    cte(f"rk_table{x}", f"""
SELECT n.run_id, n_folds, {rnd('mean_cs_ric std_cs_ric', 4)}, {rnd('cs_ric_stability', 3)}, {rnd('sharpe', 2)},
  {rnd('ann_return max_drawdown capture turnover', 3)}
FROM (SELECT run_id, count(DISTINCT fold_id) AS n_folds FROM rk_preds{x} GROUP BY 1) n
JOIN a_cs_sum{x} USING (run_id) JOIN rk_sharpe{x} USING (run_id)
JOIN (SELECT run_id, avg(ls_return / nullif(spread, 0)) AS capture FROM lsr{x} GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, avg(moved) / 5 AS turnover FROM steps{x} GROUP BY 1) USING (run_id)""",
        f"rk_preds{x}", f"a_cs_sum{x}", f"rk_sharpe{x}", f"lsr{x}", f"steps{x}")


from tidemark.catalog.sql import CTE  # noqa: E402

CTE_CS, CTE_SUM, CTE_STEPS, CTE_PNL, CTE_LSR = (
    CTE[n][1] for n in ("a_cs", "a_cs_sum", "steps", "pnl", "lsr"))
for _h in HORIZONS:
    ranking_table_cte("" if _h == 5 else f"_{_h}", _h)
cte("rk_preds_avg", "SELECT run_id || '_avg21' AS run_id, fold_id, date, asset, pred, realized FROM smooth", "smooth")
ranking_table_cte("_avg", 5)
for _h in HORIZONS[1:]:
    cte(f"rk_preds_avg_{_h}", f"""
SELECT run_id || '_avg21' AS run_id, fold_id, date, asset, realized, avg(pred) OVER (PARTITION BY run_id, asset ORDER BY date
  ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS pred FROM rk_preds_{_h}""", f"rk_preds_{_h}")
    ranking_table_cte(f"_avg_{_h}", _h)


@query("a13_ranking_table", with_("rk_table", "SELECT * FROM rk_table"))
def _(s, d):
    return ranking_table_for(rk_preds(s, d), 5)


W63 = "OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


@query("a14_rolling_ic", with_("sa_preds", f"""
SELECT run_id, date, {rnd(f'''CASE WHEN count(*) {W63} >= 31 AND stddev_pop(pred) {W63} >= 1e-12
  AND stddev_pop(realized) {W63} >= 1e-12 THEN covar_pop(pred, realized) {W63}
  / nullif(stddev_pop(pred) {W63} * stddev_pop(realized) {W63}, 0) END AS rolling_ic''', 6)} FROM sa_preds
WHERE run_id IN (SELECT run_id FROM sa_preds GROUP BY 1 HAVING stddev_pop(pred) >= 1e-12)"""))
def _(s, d):
    return rounded(mt.rolling_ic(sa_preds(s, d)), 6, "run_id", "date", "rolling_ic")


@query("a15_fold_dates", with_("sa_preds", """
SELECT run_id, fold_id, min(date) AS first_date, max(date) AS last_date FROM sa_preds GROUP BY 1, 2"""))
def _(s, d):
    return mt.fold_dates(sa_preds(s, d), "run_id")


cte("verdict_in", """
SELECT split_part(run_id, ':', 1) AS model, split_part(run_id, ':', 2) AS series, pooled_ic, ic_stability, sharpe
FROM sa_run_m JOIN sa_sharpe USING (run_id)""", "sa_run_m", "sa_sharpe")


@query("a16_verdict", with_("verdict_in", """
SELECT v.series, v.model, CASE WHEN abs(v.pooled_ic) > 0.05 OR v.sharpe > 2.5 THEN 'leakage'
  WHEN v.sharpe > d.sharpe AND v.ic_stability > 0.5 AND v.model = 'Reversal' THEN 'edge' ELSE 'none' END AS verdict
FROM verdict_in v JOIN verdict_in d ON d.series = v.series AND d.model = 'Drift'"""))
def _(s, d):
    t = sa_runs(s, d).join(mt.sharpe_stats(sa_pnl(s, d), 5, False), "run_id").select(
        F.split_part("run_id", F.lit(":"), F.lit(1)).alias("model"),
        F.split_part("run_id", F.lit(":"), F.lit(2)).alias("series"), "pooled_ic", "ic_stability", "sharpe")
    return mt.verdict(t).select("series", "model", "verdict")


@query("a17_leakage_flags", with_("rk_table", """
SELECT run_id, 'cs_ric' AS flag, mean_cs_ric AS value FROM rk_table WHERE abs(mean_cs_ric) > 0.15
UNION ALL SELECT run_id, 'sharpe', sharpe FROM rk_table WHERE sharpe > 2.5"""))
def _(s, d):
    return mt.leakage_flags(ranking_table_for(rk_preds(s, d), 5))


cte("sweep", " UNION ALL ".join(
    f"SELECT run_id AS model, {h} AS horizon, sharpe, mean_cs_ric, turnover FROM rk_table{'' if h == 5 else f'_{h}'}"
    for h in HORIZONS), "rk_table", "rk_table_21", "rk_table_63")


def sweep(s, d):
    out = None
    for h in HORIZONS:
        t = ranking_table_for(rk_preds(s, d, h), h).select(
            F.col("run_id").alias("model"), F.lit(h).alias("horizon"), "sharpe", "mean_cs_ric", "turnover")
        out = t if out is None else out.unionByName(t)
    return out


def _piv(v: str) -> str:
    return f"SELECT model, {', '.join(f'max(CASE WHEN horizon = {h} THEN {v} END) AS h{h}' for h in HORIZONS)} FROM sweep GROUP BY 1"


@query("a18_sweep_matrix", with_("sweep", _piv("sharpe")))
def _(s, d):
    return mt.sweep_matrix(sweep(s, d), "sharpe")


@query("a19_best_config", with_("sweep", """
SELECT model, horizon, sharpe FROM sweep WHERE sharpe IS NOT NULL ORDER BY sharpe DESC, model DESC, horizon DESC LIMIT 1"""))
def _(s, d):
    return mt.best_config(sweep(s, d))


cte("blend_legs", """
SELECT a.date, a.net AS a, b.net AS b FROM pnl a JOIN pnl b ON b.date = a.date
WHERE a.run_id = 'MeanReversion' AND b.run_id = 'MomentumRank'""", "pnl")
cte("blend", """
SELECT printf('%.2f', w) AS run_id, date, w * a + (1 - w) * b AS net
FROM blend_legs, (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE), (0.0::DOUBLE)) t(w)""", "blend_legs")
sharpe_cte("blend_sharpe", "blend", 63)


@query("a20_blend_sweep", with_("blend_sharpe", f"""
SELECT run_id AS weight, {rnd('ann_return ann_vol max_drawdown sharpe sharpe_raw', 6)} FROM blend_sharpe JOIN (
  SELECT run_id, avg(net) * sqrt(252.0::DOUBLE) / nullif(stddev_pop(net), 0) AS sharpe_raw FROM blend GROUP BY 1) USING (run_id)"""))
def _(s, d):
    df = mt.blend_sweep(pnl2(rk_preds(s, d)), "MeanReversion", "MomentumRank", (1, .75, .5, .25, 0))
    return rounded(df, 6, "weight", "ann_return", "ann_vol", "max_drawdown", "sharpe", "sharpe_raw")


@query("a21_pnl_correlation", with_("pnl", f"""
SELECT {rnd(CORR.format('a', 'b') + ' AS pnl_corr')}, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS common,
  count(CASE WHEN b IS NULL THEN 1 END) AS dropped_first, count(CASE WHEN a IS NULL THEN 1 END) AS dropped_second
FROM (SELECT a.net AS a, b.net AS b FROM (SELECT * FROM pnl WHERE run_id = 'MeanReversion') a
  FULL JOIN (SELECT * FROM pnl WHERE run_id = 'MomentumRank') b ON b.date = a.date)"""))
def _(s, d):
    return rounded(mt.pnl_correlation(pnl2(rk_preds(s, d)), "MeanReversion", "MomentumRank"), 8)


SMOOTH_EXTRA = """
rv AS (
  SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) AS seq, list(rank ORDER BY asset) AS ranks,
         list(asset ORDER BY asset) AS assets FROM (
    SELECT run_id, date, asset, CAST(row_number() OVER (PARTITION BY run_id, date ORDER BY pred DESC, asset DESC) AS INTEGER)
      AS rank FROM rk_preds) GROUP BY 1, 2),
sm AS (
  SELECT run_id, date, seq, ranks, assets, ranks AS held, date AS held_at FROM rv WHERE seq = 1
  UNION ALL
  SELECT rv.run_id, rv.date, rv.seq, rv.ranks, rv.assets,
    CASE WHEN list_max(list_transform(list_zip(rv.ranks, sm.held), lambda x: abs(x[1] - x[2]))) >= 2 THEN rv.ranks ELSE sm.held END,
    CASE WHEN list_max(list_transform(list_zip(rv.ranks, sm.held), lambda x: abs(x[1] - x[2]))) >= 2 THEN rv.date ELSE sm.held_at END
  FROM sm JOIN rv ON rv.run_id = sm.run_id AND rv.seq = sm.seq + 1)"""


@query("a22_rank_smoothing", with_("rk_preds", """
SELECT run_id, date, unnest(assets) AS asset, unnest(ranks) AS rank, unnest(held) AS held_rank, held_at = date AS adopted FROM sm""",
                                  recursive=True, extra=SMOOTH_EXTRA))
def _(s, d):
    return pf.smoothed_ranks(rk_preds(s, d), 2)


@query("a23_sweep_delta", with_("sweep", """
SELECT a.model, CAST(21 AS INTEGER) AS horizon, a.sharpe, b.sharpe AS sharpe_before, round(a.sharpe - b.sharpe, 8) + 0.0 AS delta
FROM sweep a JOIN sweep b ON b.model = a.model AND b.horizon = 5 WHERE a.horizon = 21"""))
def _(s, d):
    t = sweep(s, d)
    before = t.where("horizon = 5").withColumn("horizon", F.lit(21))
    return rounded(mt.sweep_delta(t.where("horizon = 21"), before), 8)


@query("a24_oos_series", with_("sa_preds", f"""
SELECT run_id, date, fold_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY fold_id, date) - 1 AS INTEGER) AS pos_in_run,
  {rnd('pred realized')} FROM sa_preds"""))
def _(s, d):
    return rounded(mt.oos_series(sa_preds(s, d)), 8, "run_id", "date", "fold_id", "pos_in_run", "pred",
                   "realized")
