"""Queries of the per-series building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.functions.expr import rounded
from tidemark.operators import timeseries as ts
from tidemark.sources import tables as tb

LATE = "MIDDLE EAST"
TARGETS = ("AFRICA", "AMERICA", "ASIA")
CONTEXT = ("EUROPE", LATE)
NAMES = {"EUROPE": "europe", LATE: "mideast"}
BASKET = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
PAIRS = {"AFRICA": LATE, "ASIA": "EUROPE"}
ALL = (*BASKET, LATE)
LEVELS = {"1-URGENT": "real", "2-HIGH": "infl", "5-LOW": "usd"}
CHANGE = {"3-MEDIUM": "nominal"}
SLOPE = ("3-MEDIUM", "4-NOT SPECIFIED")

W = "OVER (PARTITION BY asset ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, col: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({col}) {frame(n)} >= {need or n} THEN {agg}({col}) {frame(n)} END"


def feature_cte(name: str, source: str) -> None:
    """Own feature columns over a (asset, date, close) expression."""
    cte(f"{name}_r", f"""
SELECT asset, date, close, {', '.join(f'ln(close / lag(close, {k}) {W}) AS ret_{k}d' for k in (1, 5, 10, 21))}
FROM {source}""", source)
    cte(name, f"""
SELECT *, {', '.join(f'sqrt(252.0::DOUBLE) * ({full("stddev_samp", "ret_1d", n)}) AS vol_{n}d' for n in (5, 21))},
 {', '.join(f'{full("avg", "ret_1d", n)} AS mom_{n}d' for n in (10, 21))},
 {', '.join(f'(close - {full("avg", "close", n)}) / ({full("avg", "close", n)}) AS dist_ma_{n}' for n in (20, 60))}
FROM {name}_r""", f"{name}_r")


feature_cte("feat", "bars")


def bars(s, d):
    """Daily closes, kept after their first use: a panel reads them in many
    places, and the facts behind them should be scanned once."""
    return tb.daily_bars(s, d).select("asset", "date", "close").persist()


def wide_bars(s, d):
    """Weekly closes of every supplier, kept because panels pass over them twice."""
    return tb.supplier_bars(s, d).select("asset", "date", "close").persist()


def calendar(prices):
    return ts.trading_calendar(prices, "AFRICA")


@query("f01_log_returns", with_("feat", f"SELECT asset, date, {rnd('ret_1d AS ret')} FROM feat"))
def _(s, d):
    return rounded(ts.log_returns(bars(s, d)), 8, "asset", "date", "ret")


@query("f01_log_returns_hourly", with_("hourly_bars", f"""
SELECT asset, date, {rnd(f'ln(close / lag(close, 1) {W}) AS ret')} FROM hourly_bars"""))
def _(s, d):
    return rounded(ts.log_returns(tb.hourly_bars(s, d)), 8, "asset", "date", "ret")


RET = "ret_1d ret_5d ret_10d ret_21d"


@query("f02_lagged_returns", with_("feat", f"SELECT asset, date, {rnd(RET)} FROM feat"))
def _(s, d):
    return rounded(ts.lagged_returns(bars(s, d)), 8, "asset", "date", *RET.split())


@query("f03_rolling_volatility", with_("feat", f"SELECT asset, date, {rnd('vol_5d vol_21d')} FROM feat"))
def _(s, d):
    return rounded(ts.rolling_volatility(bars(s, d)), 8, "asset", "date", "vol_5d", "vol_21d")


@query("f04_rolling_momentum", with_("feat", f"SELECT asset, date, {rnd('mom_10d mom_21d')} FROM feat"))
def _(s, d):
    return rounded(ts.rolling_momentum(bars(s, d)), 8, "asset", "date", "mom_10d", "mom_21d")


@query("f05_distance_from_ma",
       with_("feat", f"SELECT asset, date, {rnd('dist_ma_20 dist_ma_60')} FROM feat"))
def _(s, d):
    return rounded(ts.distance_from_ma(bars(s, d)), 8, "asset", "date", "dist_ma_20", "dist_ma_60")


cte("on_cal", """
SELECT a.asset, cal.date,
       last_value(b.close IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY cal.date) AS close
FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN cal
LEFT JOIN bars b ON b.asset = a.asset AND b.date = cal.date""", "bars", "cal")
cte("ratios", f"""
SELECT p.pair, a.date, ln(a.close / b.close) AS ratio
FROM (VALUES ('AFRICA', '{LATE}'), ('ASIA', 'EUROPE')) p(pair, other)
JOIN on_cal a ON a.asset = p.pair JOIN on_cal b ON b.asset = p.other AND b.date = a.date""", "on_cal")


@query("f06_log_ratio", with_("ratios", f"SELECT pair, date, {rnd('ratio')} FROM ratios"))
def _(s, d):
    p = bars(s, d)
    return rounded(ts.pair_ratios(p, calendar(p), [(a, b, a) for a, b in PAIRS.items()]), 8,
                   "pair", "date", "ratio")


def _ctx(asset: str, name: str) -> str:
    return (f"last_value({name}_c IGNORE NULLS) {W} AS {name}_f")


cte("ctx_base", f"""
SELECT b.asset, b.date, e.close AS europe_c, m.close AS mideast_c FROM bars b
LEFT JOIN bars e ON e.asset = 'EUROPE' AND e.date = b.date
LEFT JOIN bars m ON m.asset = '{LATE}' AND m.date = b.date
WHERE b.asset IN {TARGETS}""", "bars")
cte("ctx_fill", f"SELECT asset, date, {_ctx('', 'europe')}, {_ctx('', 'mideast')} FROM ctx_base",
    "ctx_base")
cte("ctx_ret", f"""
SELECT asset, date, europe_f, mideast_f, ln(europe_f / lag(europe_f) {W}) AS europe_ret_1d,
       ln(mideast_f / lag(mideast_f) {W}) AS mideast_now FROM ctx_fill""", "ctx_fill")
cte("ctx", f"SELECT *, lag(mideast_now) {W} AS mideast_ret_1d FROM ctx_ret", "ctx_ret")


@query("f07_context_returns", with_("ctx", f"""
SELECT asset, date, {rnd('europe_ret_1d|mideast_now AS mideast_ret_1d')} FROM ctx"""))
def _(s, d):
    p = bars(s, d)
    df = ts.context_returns(p, p.where(F.col("asset").isin(*TARGETS)), CONTEXT, names=NAMES)
    return rounded(df, 8, "asset", "date", "europe_ret_1d", "mideast_ret_1d")


@query("f08_late_close_lag", with_("ctx", f"""
SELECT asset, date, {rnd('europe_ret_1d mideast_ret_1d')} FROM ctx"""))
def _(s, d):
    p = bars(s, d)
    df = ts.context_returns(p, p.where(F.col("asset").isin(*TARGETS)), CONTEXT, (LATE,), NAMES)
    return rounded(df, 8, "asset", "date", "europe_ret_1d", "mideast_ret_1d")


OWN = " ".join(ts.OWN_COLUMNS)
cte("price_block", f"""
SELECT f.*, c.europe_ret_1d, c.mideast_ret_1d, ln(europe_f / mideast_f) AS eu_me_ratio
FROM feat f JOIN ctx c USING (asset, date)""", "feat", "ctx")


@query("f09_price_feature_block", with_("price_block", f"""
SELECT asset, date, {rnd(OWN + ' europe_ret_1d mideast_ret_1d eu_me_ratio')} FROM price_block"""))
def _(s, d):
    df = ts.price_features(bars(s, d), TARGETS, CONTEXT, (LATE,), NAMES,
                           ("EUROPE", LATE, "eu_me_ratio"))
    return rounded(df, 8, "asset", "date", *ts.OWN_COLUMNS, "europe_ret_1d", "mideast_ret_1d",
                   "eu_me_ratio")


def aligned_cte(name: str, raw: str, key: str, cols: list[str], limit: int) -> None:
    over = f"OVER (PARTITION BY {key} ORDER BY date)"
    cte(f"{name}_u", f"""
SELECT k.{key}, d.date, {', '.join(f'r.{c}' for c in cols)}, d.is_cal
FROM (SELECT DISTINCT {key} FROM {raw}) k CROSS JOIN (
  SELECT date, max(is_cal) AS is_cal FROM (
    SELECT date, 1 AS is_cal FROM cal UNION ALL SELECT DISTINCT date, 0 FROM {raw}) GROUP BY 1) d
LEFT JOIN {raw} r ON r.{key} = k.{key} AND r.date = d.date
WHERE d.is_cal = 1 OR r.{key} IS NOT NULL""", raw, "cal")
    cte(f"{name}_n", f"SELECT *, row_number() {over} AS rn FROM {name}_u", f"{name}_u")
    cte(f"{name}_f", f"SELECT {key}, date, is_cal, " + ", ".join(
        f"CASE WHEN rn - last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {over} "
        f"<= {limit} THEN last_value({c} IGNORE NULLS) {over} END AS {c}" for c in cols)
        + f" FROM {name}_n", f"{name}_n")
    cte(name, f"SELECT * EXCLUDE (is_cal) FROM {name}_f WHERE is_cal = 1", f"{name}_f")


aligned_cte("macro_al", "macro", "series_id", ["value"], 5)
WS = "OVER (PARTITION BY series_id ORDER BY date)"
cte("macro_lag", f"SELECT series_id, date, lag(value) {WS} AS value FROM macro_al", "macro_al")
cte("macro_chg", f"SELECT *, value - lag(value) {WS} AS chg, value - lag(value, 21) {WS} AS chg_21 "
    "FROM macro_lag", "macro_lag")


@query("f10_align_to_calendar",
       with_("macro_al", f"SELECT series_id, date, {rnd('value', 7)} FROM macro_al"))
def _(s, d):
    df = ts.align_to_calendar(tb.macro_series(s, d), calendar(bars(s, d)))
    return rounded(df, 7, "series_id", "date", "value")


@query("f11_lag_series",
       with_("macro_lag", f"SELECT series_id, date, {rnd('value', 7)} FROM macro_lag"))
def _(s, d):
    df = ts.align_to_calendar(tb.macro_series(s, d), calendar(bars(s, d)))
    return rounded(ts.lag_series(df), 7, "series_id", "date", "value")


@query("f12_daily_change",
       with_("macro_chg", f"SELECT series_id, date, {rnd('chg chg_21', 7)} FROM macro_chg"))
def _(s, d):
    df = ts.lag_series(ts.align_to_calendar(tb.macro_series(s, d), calendar(bars(s, d))))
    df = df.withColumns({"chg": ts.difference("value", 1), "chg_21": ts.difference("value", 21)})
    return rounded(df, 7, "series_id", "date", "chg", "chg_21")


def _pick(series: str, col: str, name: str) -> str:
    return f"max(CASE WHEN series_id = '{series}' THEN {col} END) AS {name}"


cte("macro_wide", "SELECT date, " + ", ".join(
    [_pick(k, "value", f"{v}_level") + ", " + _pick(k, "chg", f"{v}_chg_1d")
     for k, v in LEVELS.items()] + [_pick(k, "chg", f"{v}_chg_1d") for k, v in CHANGE.items()])
    + f""", max(CASE WHEN series_id = '{SLOPE[0]}' THEN value END)
 - max(CASE WHEN series_id = '{SLOPE[1]}' THEN value END) AS slope
FROM macro_chg GROUP BY 1""", "macro_chg")
WD = "OVER (ORDER BY date)"
W252 = "OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
cte("macro_block", f"""
SELECT *, slope - lag(slope, 21) {WD} AS slope_chg_21d,
       CASE WHEN count(slope) {W252} = 252 THEN (slope - avg(slope) {W252})
            / nullif(stddev_samp(slope) {W252}, 0) END AS slope_zscore
FROM macro_wide""", "macro_wide")
MACRO_COLS = [c for v in LEVELS.values() for c in (f"{v}_level", f"{v}_chg_1d")] + \
    ["nominal_chg_1d", "slope", "slope_chg_21d", "slope_zscore"]


def macro_features(s, d, cal):
    return ts.macro_block(tb.macro_series(s, d), cal, LEVELS, CHANGE, SLOPE)


@query("f13_curve_slope",
       with_("macro_block", f"SELECT date, {rnd('slope slope_chg_21d', 7)} FROM macro_block"))
def _(s, d):
    return rounded(macro_features(s, d, calendar(bars(s, d))), 7, "date", "slope", "slope_chg_21d")


@query("f14_trailing_zscore", with_("feat", f"""
SELECT asset, date, {rnd(f'''CASE WHEN count(close) {frame(252)} = 252 THEN
  (close - avg(close) {frame(252)}) / nullif(stddev_samp(close) {frame(252)}, 0) END AS z''', 6)} FROM feat"""))
def _(s, d):
    return rounded(bars(s, d).withColumn("z", ts.zscore("close", 252, "asset")), 6,
                   "asset", "date", "z")


@query("f15_macro_block", with_("macro_block", f"""
SELECT date, {rnd(' '.join(MACRO_COLS), 7)} FROM macro_block"""))
def _(s, d):
    return rounded(macro_features(s, d, calendar(bars(s, d))), 7, "date", *MACRO_COLS)


cte("bm", f"""
SELECT asset, date, ln(lag(close, 21) {W} / lag(close, 252) {W}) AS basis_momentum
FROM on_cal""", "on_cal")


@query("f16_basis_momentum",
       with_("bm", f"SELECT asset, date, {rnd('basis_momentum')} FROM bm"))
def _(s, d):
    p = bars(s, d)
    return rounded(ts.basis_momentum(ts.on_calendar(p, calendar(p))), 8, "asset", "date",
                   "basis_momentum")


cte("carry", "SELECT pair AS asset, date, lag(ratio) OVER (PARTITION BY pair ORDER BY date) "
    "AS carry_proxy FROM ratios", "ratios")


@query("f17_carry_proxy", with_("carry", f"SELECT asset, date, {rnd('carry_proxy')} FROM carry"))
def _(s, d):
    p = bars(s, d)
    return rounded(ts.carry_proxy(p, calendar(p), PAIRS), 8, "asset", "date", "carry_proxy")


CARRY = "basis_momentum rel_basis_momentum carry_proxy carry_proxy_chg_21d rel_carry_proxy"
cte("carry_block", f"""
SELECT u.asset, cal.date,
  CASE WHEN u.asset = 'NOWHERE' THEN 0.0::DOUBLE ELSE b.basis_momentum END AS basis_momentum,
  CASE WHEN u.asset = 'NOWHERE' THEN 0.0::DOUBLE ELSE b.basis_momentum - avg(b.basis_momentum)
     OVER (PARTITION BY cal.date) END AS rel_basis_momentum,
  CASE WHEN u.asset NOT IN {tuple(PAIRS)} THEN 0.0::DOUBLE ELSE c.carry_proxy END AS carry_proxy,
  CASE WHEN u.asset NOT IN {tuple(PAIRS)} THEN 0.0::DOUBLE ELSE c.carry_proxy - lag(c.carry_proxy, 21)
     OVER (PARTITION BY u.asset ORDER BY cal.date) END AS carry_proxy_chg_21d,
  CASE WHEN u.asset NOT IN {tuple(PAIRS)} THEN 0.0::DOUBLE ELSE c.carry_proxy - avg(c.carry_proxy)
     OVER (PARTITION BY cal.date) END AS rel_carry_proxy
FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('NOWHERE')) u(asset) CROSS JOIN cal
LEFT JOIN bm b ON b.asset = u.asset AND b.date = cal.date
LEFT JOIN carry c ON c.asset = u.asset AND c.date = cal.date""", "bm", "carry")


@query("f18_carry_block", with_("carry_block", f"SELECT asset, date, {rnd(CARRY)} FROM carry_block"))
def _(s, d):
    p = bars(s, d)
    return rounded(ts.carry_block(p, (*BASKET, "NOWHERE"), calendar(p), PAIRS), 8,
                   "asset", "date", *CARRY.split())


cte("cot_net", "SELECT *, release_date AS date, mm_long - mm_short AS mm_net FROM cot", "cot")
F52 = frame(52)
cte("cot_weekly", f"""
SELECT asset, date, mm_net, mm_net - lag(mm_net) {W} AS mm_net_chg,
  CASE WHEN count(mm_net) {F52} >= 26 THEN least(1.0, greatest(0.0, (mm_net - min(mm_net) {F52})
    / nullif(max(mm_net) {F52} - min(mm_net) {F52}, 0))) END AS mm_net_pct,
  mm_long / nullif(mm_long + mm_short, 0) AS mm_long_ratio, prod_long - prod_short AS prod_net,
  oi / nullif(lag(oi) {W}, 0) - 1 AS oi_chg_pct
FROM cot_net""", "cot_net")
aligned_cte("cot_al", "cot_weekly", "asset", list(ts.COT_COLUMNS), 10)
cte("cot_block", "SELECT u.asset, cal.date, " + ", ".join(f"x.{c}" for c in ts.COT_COLUMNS) + """
FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST')) u(asset) CROSS JOIN cal
LEFT JOIN (SELECT asset, date, """ + ", ".join(f"lag({c}) {W} AS {c}" for c in ts.COT_COLUMNS)
    + " FROM cot_al) x ON x.asset = u.asset AND x.date = cal.date", "cot_al")
COTS = " ".join(ts.COT_COLUMNS)


@query("f19_positioning_weekly",
       with_("cot_weekly", f"SELECT asset, date, {rnd(COTS, 6)} FROM cot_weekly"))
def _(s, d):
    return rounded(ts.positioning_weekly(tb.positioning(s, d)), 6, "asset", "date", *ts.COT_COLUMNS)


@query("f20_range_position",
       with_("cot_weekly", f"SELECT asset, date, {rnd('mm_net_pct', 6)} FROM cot_weekly"))
def _(s, d):
    return rounded(ts.positioning_weekly(tb.positioning(s, d)), 6, "asset", "date", "mm_net_pct")


@query("f21_positioning_daily",
       with_("cot_block", f"SELECT asset, date, {rnd(COTS, 6)} FROM cot_block"))
def _(s, d):
    df = ts.positioning_daily(tb.positioning(s, d), ALL, calendar(bars(s, d)))
    return rounded(df, 6, "asset", "date", *ts.COT_COLUMNS)


@query("f21_positioning_absent_asset", with_("cot_block", f"""
SELECT * FROM (SELECT asset, date, {rnd(COTS, 6)} FROM cot_block WHERE asset = 'ASIA' UNION ALL
SELECT 'NOWHERE', date, {', '.join('NULL' for _ in ts.COT_COLUMNS)} FROM cal)"""))
def _(s, d):
    df = ts.positioning_daily(tb.positioning(s, d), ("ASIA", "NOWHERE"), calendar(bars(s, d)))
    return rounded(df, 6, "asset", "date", *ts.COT_COLUMNS)


@query("f22_seasonal", with_("cal", f"""SELECT date, {rnd(
    'sin(2 * pi() * month(date) / 12) AS month_sin|cos(2 * pi() * month(date) / 12) AS month_cos')} FROM cal"""))
def _(s, d):
    return rounded(ts.seasonal(calendar(bars(s, d))), 8, "date", "month_sin", "month_cos")


cte("label", f"SELECT asset, date, ln(lead(close, 1) {W} / close) AS target_1d, "
    f"ln(lead(close, 5) {W} / close) AS target_5d FROM bars", "bars")


@query("f23_forward_log_return",
       with_("label", f"SELECT asset, date, {rnd('target_1d target_5d')} FROM label"))
def _(s, d):
    df = ts.forward_log_return(ts.forward_log_return(bars(s, d), 1, "target_1d"), 5, "target_5d")
    return rounded(df, 8, "asset", "date", "target_1d", "target_5d")


cte("shifted", "SELECT asset, date, close - 1000 AS close FROM bars", "bars")


@query("f23_non_positive_closes",
       with_("shifted", f"SELECT asset, date, {rnd('close', 8)} FROM shifted WHERE close <= 0"))
def _(s, d):
    return rounded(ts.non_positive_closes(bars(s, d).withColumn("close", F.col("close") - 1000)), 8)


@query("f24_label_positive_only", with_("shifted", f"""
SELECT asset, date, {rnd('ln(nx / c) AS target')} FROM (
  SELECT asset, date, CASE WHEN close > 0 THEN close END AS c,
         lead(CASE WHEN close > 0 THEN close END, 5) {W} AS nx FROM shifted)"""))
def _(s, d):
    p = bars(s, d).withColumn("close", F.col("close") - 1000)
    return rounded(ts.forward_log_return(p, 5), 8, "asset", "date", "target")


cte("ret0", "SELECT asset, date, ret_1d AS ret FROM feat_r WHERE ret_1d IS NOT NULL", "feat_r")
cte("ewma_i", f"SELECT *, row_number() {W} - 1 AS i FROM ret0", "ret0")
def returns(s, d):
    return ts.log_returns(bars(s, d)).where(F.col("ret").isNotNull()).select("asset", "date", "ret")


def ewma_sql(lam: str, rest: str) -> str:
    return f"""
SELECT asset, date, ret, CASE WHEN i > 0 THEN sqrt(252 * pow({lam}::DOUBLE, i - 1) * sum(
   CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE {rest}::DOUBLE END * ret * ret * pow({lam}::DOUBLE, -i))
   OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS ewma_vol
FROM ewma_i"""


cte("ewma", ewma_sql("0.94", "0.06"), "ewma_i")
cte("ewma_slow", ewma_sql("0.995", "0.005"), "ewma_i")


@query("f25_ewma_vol_slow", with_("ewma_slow", f"SELECT asset, date, {rnd('ewma_vol')} FROM ewma_slow"))
def _(s, d):
    return rounded(ts.ewma_vol(returns(s, d), 0.995), 8, "asset", "date", "ewma_vol")


@query("f25_ewma_vol", with_("ewma", f"SELECT asset, date, {rnd('ewma_vol')} FROM ewma"))
def _(s, d):
    return rounded(ts.ewma_vol(returns(s, d)), 8, "asset", "date", "ewma_vol")


cte("rvol", f"""SELECT asset, date, ewma_vol, sqrt(252.0::DOUBLE) * ({full('stddev_samp', 'ret', 21, 10)})
 AS realized_vol FROM ewma""", "ewma")


@query("f26_realized_vol", with_("rvol", f"SELECT asset, date, {rnd('realized_vol')} FROM rvol"))
def _(s, d):
    return rounded(ts.realized_vol(returns(s, d)), 8, "asset", "date", "realized_vol")


@query("f27_vol_forecast_corr", with_("rvol", """
SELECT asset, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN covar_pop(ewma_vol, realized_vol)
  / nullif(stddev_pop(ewma_vol) * stddev_pop(realized_vol), 0) END, 6) + 0.0 AS vol_corr
FROM rvol WHERE ewma_vol IS NOT NULL AND realized_vol IS NOT NULL GROUP BY 1"""))
def _(s, d):
    df = ts.realized_vol(ts.ewma_vol(returns(s, d)))
    return rounded(ts.vol_forecast_corr(df, "ewma_vol"), 6, "asset", "n", "vol_corr")


GARCH_EXTRA = f"""
ser AS (SELECT asset, date, i, 10000 * ret * ret AS x FROM ewma_i),
refit AS (
  SELECT s.asset, k * 63 + 250 AS start, (SELECT avg(x) FROM ser p WHERE p.asset = s.asset AND p.i < k * 63 + 250) AS m
  FROM (SELECT asset, count(*) AS n FROM ser GROUP BY 1) s, range(0, 1000) r(k) WHERE k * 63 + 250 < n),
grid(g, a, b) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(ts.GARCH_GRID))}),
lik AS (
  SELECT asset, start, g, a, b, m * (1 - a - b) AS w, m AS s2, 0.0::DOUBLE AS ll, 0 AS t FROM refit, grid
  UNION ALL
  SELECT l.asset, start, g, a, b, w, w + a * x + b * s2, ll - (ln(s2) + x / s2), t + 1
  FROM lik l JOIN ser s ON s.asset = l.asset AND s.i = l.t WHERE l.t < l.start),
best AS (SELECT * FROM lik WHERE t = start QUALIFY row_number() OVER (PARTITION BY asset, start ORDER BY ll DESC, g) = 1),
fc AS (
  SELECT asset, start, a, b, w, s2, t FROM best
  UNION ALL
  SELECT f.asset, start, a, b, w, w + a * x + b * s2, t + 1
  FROM fc f JOIN ser s ON s.asset = f.asset AND s.i = f.t WHERE f.t + 1 < f.start + 63)"""


@query("f28_garch_vol", with_("ewma_i", """
SELECT s.asset, s.date, a AS alpha, b AS beta, round(sqrt(s2 * 252) / 100, 6) + 0.0 AS garch_vol
FROM ser s LEFT JOIN fc ON fc.asset = s.asset AND fc.t = s.i""", recursive=True, extra=GARCH_EXTRA))
def _(s, d):
    return rounded(ts.garch_vol(returns(s, d)), 6)


@query("f28_garch_fitted", with_("ret0", """
SELECT asset, count(*) AS n_rows, CAST(ceil((count(*) - 250) / 63.0) AS BIGINT) AS n_refits, true AS above_grid, true AS stationary
FROM ret0 GROUP BY 1"""))
def _(s, d):
    """Every refit is at least as likely as the grid's best point, and stationary."""
    v = ts.fitted_garch_vol(returns(s, d))
    done = v.where(~F.isnan("garch_vol"))
    flags = done.groupBy("asset").agg(F.count_distinct("log_lik").alias("n_refits"), F.bool_and(
        F.col("log_lik") >= F.col("grid_log_lik")).alias("above_grid"), F.bool_and(F.col("alpha") + F.col("beta") < 1).alias("stationary"))
    return v.groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows")).join(flags, "asset")


cte("asof_d", "SELECT DISTINCT asset, CAST(date_trunc('week', date) AS DATE) + 5 AS as_of FROM bars", "bars")
cte("asof_n", f"SELECT asset, date, close, lead(close, 5) {W} AS fwd FROM bars", "bars")


@query("f29_forward_return_asof", with_("asof_d asof_n", f"""
SELECT a.asset, a.as_of, p.date AS price_date, {rnd('ln(p.fwd / p.close) AS fwd_ret')}
FROM asof_d a ASOF LEFT JOIN asof_n p ON p.asset = a.asset AND p.date <= a.as_of"""))
def _(s, d):
    p = bars(s, d)
    sat = p.select("asset", F.date_add(F.to_date(F.date_trunc("week", "date")), 5).alias("as_of"))
    return rounded(ts.forward_return_asof(p, sat), 8)


@query("f30_business_days", with_("bars", f"""
SELECT asset, date, {rnd(f'ln(close / lag(close) {W}) AS ret')} FROM bars WHERE isodow(date) < 6"""))
def _(s, d):
    return rounded(ts.log_returns(ts.business_days(bars(s, d))), 8, "asset", "date", "ret")
