"""Queries of cross-sectional features, the panel and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.catalog.timeseries import BASKET, LATE, OWN, PAIRS, bars, calendar
from tidemark.functions.expr import rounded
from tidemark.operators import panel as pn
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf
from tidemark.sources import tables as tb

SPEC = pn.PanelSpec(
    ranked=BASKET, context=(LATE,), late=(LATE,), horizon=5,
    ratio_pairs=(("AFRICA", "ASIA", "af_as_ratio"), ("AMERICA", "EUROPE", "am_eu_ratio")),
    carry_pairs=PAIRS, macro_levels={"1-URGENT": "real", "5-LOW": "usd"},
    macro_changes={"3-MEDIUM": "nominal"}, names=ct.NAMES)
IN4 = str(BASKET)

ct.feature_cte("cfeat", "on_cal")
CROSS = " ".join(f"rel_{c}" for c in pn.CROSS)
cte("cross4", "SELECT asset, date, " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY date) AS rel_{c}" for c in pn.CROSS)
    + f" FROM cfeat WHERE asset IN {IN4}", "cfeat")


@query("x01_own_on_calendar", with_("cfeat", f"SELECT asset, date, {rnd(OWN)} FROM cfeat"))
def _(s, d):
    p = bars(s, d)
    return rounded(pn.own_on_calendar(p, calendar(p)), 8, "asset", "date", *ts.OWN_COLUMNS)


@query("x02_relative_to_basket", with_("cross4", f"SELECT asset, date, {rnd(CROSS)} FROM cross4"))
def _(s, d):
    p = bars(s, d)
    df = pn.cross_features(p.where(F.col("asset").isin(*BASKET)), calendar(p))
    return rounded(df, 8, "asset", "date", *CROSS.split())


cte("wide_ret", f"SELECT asset, date, close, ln(close / lag(close) {ct.W}) AS ret_1d FROM supplier_bars",
    "supplier_bars")


@query("x02_relative_wide_universe", with_("wide_ret", f"""
SELECT asset, date, {rnd('ret_1d - avg(ret_1d) OVER (PARTITION BY date) AS rel_ret_1d')} FROM wide_ret"""))
def _(s, d):
    df = ts.lagged_returns(ct.wide_bars(s, d), (1,))
    return rounded(ts.relative_to_basket(df, ("ret_1d",)), 8, "asset", "date", "rel_ret_1d")


cte("ratio_cols", """
SELECT a.date, ln(a.close / b.close) AS af_as_ratio, ln(c.close / e.close) AS am_eu_ratio
FROM on_cal a JOIN on_cal b ON b.date = a.date AND b.asset = 'ASIA'
JOIN on_cal c ON c.date = a.date AND c.asset = 'AMERICA'
JOIN on_cal e ON e.date = a.date AND e.asset = 'EUROPE' WHERE a.asset = 'AFRICA'""", "on_cal")


@query("x03_ratio_columns",
       with_("ratio_cols", f"SELECT date, {rnd('af_as_ratio am_eu_ratio')} FROM ratio_cols"))
def _(s, d):
    p = bars(s, d)
    return rounded(pn.ratio_columns(p, calendar(p), SPEC.ratio_pairs), 8)


@query("x04_relative_positioning", with_("cot_block", f"""
SELECT asset, date, {rnd('mm_net_pct - avg(mm_net_pct) OVER (PARTITION BY date) AS rel_mm_net_pct|'
                         'mm_net_chg - avg(mm_net_chg) OVER (PARTITION BY date) AS rel_mm_net_chg', 6)}
FROM cot_block"""))
def _(s, d):
    daily = ts.positioning_daily(tb.positioning(s, d), ct.ALL, calendar(bars(s, d)))
    return rounded(pn.cross_positioning(daily), 6)


HOT = "is_africa is_america is_asia"


@query("x05_one_hot", with_("bars", f"""
SELECT DISTINCT asset, {', '.join(f"CASE WHEN asset = '{h[3:].upper()}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {h}"
                                  for h in HOT.split())} FROM bars WHERE asset IN {IN4}"""))
def _(s, d):
    df = bars(s, d).where(F.col("asset").isin(*BASKET)).select("asset").distinct()
    return pn.one_hot(df, BASKET)


cte("panel_all", f"""
SELECT f.asset, f.date, {', '.join('f.' + c for c in ts.OWN_COLUMNS)}, c.mideast_ret_1d,
  {', '.join('x.' + c for c in CROSS.split())}, b.basis_momentum, b.rel_basis_momentum,
  CASE WHEN cal.date IS NOT NULL THEN sin(2 * pi() * month(f.date) / 12) END AS month_sin,
  CASE WHEN cal.date IS NOT NULL THEN cos(2 * pi() * month(f.date) / 12) END AS month_cos,
  r.af_as_ratio, r.am_eu_ratio, m.real_level, m.real_chg_1d, m.usd_level, m.usd_chg_1d, m.nominal_chg_1d,
  k.carry_proxy, k.carry_proxy_chg_21d, k.rel_carry_proxy,
  {', '.join(f"CASE WHEN f.asset = '{h[3:].upper()}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {h}" for h in HOT.split())},
  l.target_5d AS target
FROM feat f JOIN ctx4 c USING (asset, date) JOIN label l USING (asset, date)
LEFT JOIN cal ON cal.date = f.date
LEFT JOIN cross4 x ON x.asset = f.asset AND x.date = f.date
LEFT JOIN (SELECT asset, date, basis_momentum, basis_momentum - avg(basis_momentum)
   OVER (PARTITION BY date) AS rel_basis_momentum FROM bm WHERE asset IN {IN4}) b
  ON b.asset = f.asset AND b.date = f.date
LEFT JOIN ratio_cols r ON r.date = f.date LEFT JOIN macro_block m ON m.date = f.date
LEFT JOIN carry_block k ON k.asset = f.asset AND k.date = f.date
WHERE f.asset IN {IN4}""", "feat", "ctx4", "label", "cal", "cross4", "bm", "ratio_cols",
    "macro_block", "carry_block")
cte("ctx4_base", f"""
SELECT b.asset, b.date, m.close AS c FROM bars b LEFT JOIN bars m ON m.asset = '{LATE}' AND m.date = b.date
WHERE b.asset IN {IN4}""", "bars")
cte("ctx4_fill", f"SELECT asset, date, last_value(c IGNORE NULLS) {ct.W} AS f FROM ctx4_base", "ctx4_base")
cte("ctx4_now", f"SELECT asset, date, ln(f / lag(f) {ct.W}) AS r FROM ctx4_fill", "ctx4_fill")
cte("ctx4", f"SELECT asset, date, lag(r) {ct.W} AS mideast_ret_1d FROM ctx4_now", "ctx4_now")
PANEL = (OWN.split() + ["mideast_ret_1d"] + CROSS.split() + ["basis_momentum", "rel_basis_momentum",
         "month_sin", "month_cos", "af_as_ratio", "am_eu_ratio", "real_level", "real_chg_1d",
         "usd_level", "usd_chg_1d", "nominal_chg_1d", "carry_proxy", "carry_proxy_chg_21d",
         "rel_carry_proxy"] + HOT.split())
cte("panel", f"""
SELECT * FROM panel_all WHERE date IN (
  SELECT date FROM panel_all GROUP BY 1 HAVING count(CASE WHEN
    {' AND '.join(f'{c} IS NOT NULL' for c in PANEL + ['target'])} THEN 1 END) = 4)""", "panel_all")


def features(s, d):
    return pn.feature_table(bars(s, d), tb.macro_series(s, d), SPEC)


def panel(s, d):
    return pn.pooled_panel(bars(s, d), tb.macro_series(s, d), SPEC)


@query("x06_feature_table", with_("panel_all", f"SELECT asset, date, {rnd(' '.join(PANEL), 7)} FROM panel_all"))
def _(s, d):
    return rounded(features(s, d), 7, "asset", "date", *PANEL)


@query("x07_complete_case_panel",
       with_("panel", f"SELECT asset, date, {rnd(' '.join(PANEL) + ' target', 7)} FROM panel"))
def _(s, d):
    return rounded(panel(s, d), 7, "asset", "date", *PANEL, "target")


@query("x08_uneven_dates", with_("bars", """
SELECT date, count(*) AS count FROM bars GROUP BY 1 HAVING count(*) <> 5"""))
def _(s, d):
    return pn.uneven_dates(bars(s, d), 5)


@query("x09_short_histories", with_("bars", """
SELECT asset, count(*) AS n_rows FROM bars GROUP BY 1 HAVING count(*) < 2450"""))
def _(s, d):
    return pn.short_histories(bars(s, d), 2450)


@query("x10_asset_order", with_("bars", """
SELECT asset, CAST(row_number() OVER (ORDER BY asset) AS INTEGER) AS pos FROM (SELECT DISTINCT asset FROM bars)"""))
def _(s, d):
    return pn.asset_order(bars(s, d))


MATRIX = OWN.split() + ["mideast_ret_1d", "real_level", "real_chg_1d", "usd_level", "usd_chg_1d",
                        "nominal_chg_1d"]
cte("matrix", f"""
SELECT f.asset, f.date, f.close, {', '.join('f.' + c for c in ts.OWN_COLUMNS)}, c.mideast_ret_1d,
  m.real_level, m.real_chg_1d, m.usd_level, m.usd_chg_1d, m.nominal_chg_1d
FROM feat f JOIN ctx4 c USING (asset, date) LEFT JOIN macro_block m ON m.date = f.date
WHERE f.asset = 'AMERICA'""", "feat", "ctx4", "macro_block")


def matrix(s, d):
    p = bars(s, d)
    macro = ts.macro_block(tb.macro_series(s, d), calendar(p), SPEC.macro_levels,
                           SPEC.macro_changes)
    return pn.target_matrix(p, macro, "AMERICA", (LATE,), (LATE,), ct.NAMES)


@query("x11_target_matrix", with_("matrix", f"SELECT date, {rnd(' '.join(MATRIX), 7)} FROM matrix"))
def _(s, d):
    return rounded(matrix(s, d), 7, "date", *MATRIX)


@query("x11_calendar_mismatch", with_("bars", """
SELECT date, 'missing' AS problem FROM bars WHERE asset = 'ASIA'
  AND date NOT IN (SELECT date FROM bars WHERE asset = 'AFRICA')
UNION ALL SELECT date, 'extra' FROM bars WHERE asset = 'AFRICA'
  AND date NOT IN (SELECT date FROM bars WHERE asset = 'ASIA')"""))
def _(s, d):
    p = bars(s, d)
    return pn.calendar_mismatch(p.where(F.col("asset") == "AFRICA"), p, "ASIA")


@query("x12_trim_nulls", with_("matrix label", f"""
SELECT m.date, {rnd(' '.join(MATRIX) + ' target_5d', 7)} FROM matrix m JOIN label USING (asset, date)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MATRIX + ['target_5d'])}"""))
def _(s, d):
    label = ts.forward_log_return(bars(s, d), 5, "target_5d").drop("close")
    df = matrix(s, d).join(label, ["asset", "date"]).dropna(subset=[*MATRIX, "target_5d"])
    return rounded(df, 7, "date", *MATRIX, "target_5d")


@query("x13_null_summary", with_("matrix", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"min(CASE WHEN {c} IS NOT NULL THEN date END) AS first_valid FROM matrix" for c in MATRIX)))
def _(s, d):
    return pn.null_summary(matrix(s, d), MATRIX)


@query("x14_latest_rows", with_("panel_all", f"""
SELECT asset, date, {rnd(' '.join(PANEL), 7)} FROM panel_all
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in OWN.split() + ['mideast_ret_1d'])}
QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) = 1"""))
def _(s, d):
    df = pn.latest_rows(features(s, d), (*ts.OWN_COLUMNS, "mideast_ret_1d"))
    return rounded(df, 7, "asset", "date", *PANEL)


@query("x15_feature_date", with_("panel_all", f"""
SELECT max(date) AS feature_date FROM panel_all
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in OWN.split() + ['mideast_ret_1d'])}"""))
def _(s, d):
    df = pn.latest_rows(features(s, d), (*ts.OWN_COLUMNS, "mideast_ret_1d"))
    return pn.feature_date(df)


@query("x16_align_columns", with_("feat", f"""
SELECT date, asset, {rnd('mom_21d ret_5d')}, CAST(NULL AS DOUBLE) AS positioning FROM feat"""))
def _(s, d):
    df = pn.align_columns(ts.own_features(bars(s, d)), ["mom_21d", "positioning", "ret_5d"])
    return rounded(df, 8)


# ── folds ────────────────────────────────────────────────────────────────────
SP = wf.Splitter(min_train=504, test_size=252, embargo=5)
cte("axis", """
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx FROM (
  SELECT date FROM feat JOIN label USING (asset, date)
  WHERE ret_5d IS NOT NULL AND mom_21d IS NOT NULL AND target_5d IS NOT NULL
  GROUP BY 1 HAVING count(*) = 5)""", "feat", "label")
cte("folds_all", """
SELECT CAST(k AS INTEGER) AS fold_id, 0 AS train_lo, CAST(504 + 252 * k AS INTEGER) AS train_hi,
       CAST(509 + 252 * k AS INTEGER) AS test_lo, CAST(761 + 252 * k AS INTEGER) AS test_hi
FROM range(0, 1000) t(k) WHERE 761 + 252 * k <= (SELECT count(*) FROM axis)""", "axis")
cte("date_folds", """
SELECT date, idx, fold_id, CASE WHEN idx >= test_lo AND idx < test_hi THEN 'test' ELSE 'train' END AS part
FROM axis JOIN folds_all ON (idx >= train_lo AND idx < train_hi) OR (idx >= test_lo AND idx < test_hi)""",
    "axis", "folds_all")


def ranking_rows(s, d):
    """Own features and 5-step label on dates complete for all five assets."""
    df = ts.forward_log_return(ts.own_features(bars(s, d)), 5)
    keep = wf.complete_dates(df, ["ret_5d", "mom_21d", "target"], 5)
    return df.join(keep, ["date"], "left_semi")


def axis(s, d):
    return wf.date_axis(ranking_rows(s, d))


def fold_table(ax, sp=SP):
    return wf.folds(wf.axis_counts(ax), sp)


def dates(s, d):
    ax = axis(s, d)
    return wf.date_folds(ax, fold_table(ax))


@query("w01_folds", with_("folds_all", "SELECT * FROM folds_all"))
def _(s, d):
    return fold_table(axis(s, d))


@query("w02_rolling_window", with_("folds_all", """
SELECT * REPLACE (CAST(greatest(0, train_hi - 600) AS INTEGER) AS train_lo) FROM folds_all"""))
def _(s, d):
    return fold_table(axis(s, d), wf.Splitter(504, 252, 5, train_window=600))


@query("w03_last_splits", with_("folds_all", """
SELECT * FROM folds_all QUALIFY row_number() OVER (ORDER BY fold_id DESC) <= 3"""))
def _(s, d):
    return fold_table(axis(s, d), SP.last(3))


@query("w04_years_to_rows", with_("folds_all", "SELECT fold_id, train_hi, test_hi FROM folds_all"))
def _(s, d):
    return fold_table(axis(s, d), wf.Splitter.from_years(2, 1, embargo=5)).select(
        "fold_id", "train_hi", "test_hi")


@query("w05_assign_folds", with_("date_folds feat", f"""
SELECT f.asset, f.date, fold_id, part, {rnd('ret_5d')} FROM feat f JOIN date_folds d ON d.date = f.date"""))
def _(s, d):
    rows = ranking_rows(s, d)
    ax = wf.date_axis(rows)
    df = wf.assign(rows, wf.date_folds(ax, fold_table(ax)))
    return rounded(df, 8, "asset", "date", "fold_id", "part", "ret_5d")


@query("w06_fold_count", with_("folds_all", "SELECT count(*) AS n_folds FROM folds_all"))
def _(s, d):
    return fold_table(axis(s, d)).agg(F.count(F.lit(1)).alias("n_folds"))


cte("fold_audit", """
SELECT fold_id, max(CASE WHEN part = 'train' THEN idx END) AS last_train,
       min(CASE WHEN part = 'test' THEN idx END) AS first_test FROM date_folds GROUP BY 1""", "date_folds")


@query("w07_embargo_audit", with_("fold_audit", """
SELECT fold_id, last_train, first_test, first_test - last_train - 1 AS gap,
       last_train + 5 < first_test AS clean FROM fold_audit"""))
def _(s, d):
    return wf.audit_folds(dates(s, d), 5)


cte("sa_axis", "SELECT asset, date, CAST(row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS INTEGER)"
    " AS idx FROM bars", "bars")
cte("sa_all_folds", """
SELECT asset, CAST(k AS INTEGER) AS fold_id, CAST(40 + 252 * k AS INTEGER) AS train_hi,
       CAST(45 + 252 * k AS INTEGER) AS test_lo, CAST(297 + 252 * k AS INTEGER) AS test_hi
FROM (SELECT asset, count(*) AS n FROM bars GROUP BY 1), range(0, 1000) t(k) WHERE 297 + 252 * k <= n""", "bars")


@query("w08_train_sizes", with_("sa_axis sa_all_folds feat label", """
SELECT a.asset, fold_id, count(CASE WHEN dist_ma_60 IS NOT NULL AND target_5d IS NOT NULL THEN 1 END) AS train_rows,
       count(CASE WHEN dist_ma_60 IS NOT NULL AND target_5d IS NOT NULL THEN 1 END) >= 2 AS used
FROM sa_axis a JOIN sa_all_folds f ON f.asset = a.asset AND idx < train_hi
JOIN feat ON feat.asset = a.asset AND feat.date = a.date
JOIN label l ON l.asset = a.asset AND l.date = a.date GROUP BY 1, 2"""))
def _(s, d):
    rows = ts.forward_log_return(ts.own_features(bars(s, d)), 5)
    ax = wf.date_axis(rows, "asset")
    fd = wf.folds(wf.axis_counts(ax, "asset"), wf.Splitter(40, 252, 5), "asset")
    return wf.train_sizes(wf.assign(rows, wf.date_folds(ax, fd, "asset"), "asset"),
                          ["dist_ma_60", "target"], "asset")


@query("w09_complete_test_dates", with_("feat", """
SELECT date FROM feat WHERE mom_21d IS NOT NULL AND ret_5d IS NOT NULL GROUP BY 1 HAVING count(*) = 5"""))
def _(s, d):
    return wf.complete_dates(ts.own_features(bars(s, d)), ["mom_21d", "ret_5d"], 5)


def _tail(keys: str, min_val: int) -> str:
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return (f"CASE WHEN idx < count(*) {over} - greatest({min_val}, floor(count(*) {over} * 0.15::DOUBLE)) - 5 "
            f"THEN 'fit' WHEN idx >= count(*) {over} - greatest({min_val}, floor(count(*) {over} * 0.15::DOUBLE)) "
            f"THEN 'val' ELSE 'gap' END AS part")


@query("w10_time_tail_rows", with_("sa_axis", f"SELECT asset, date, idx, {_tail('asset', 20)} FROM sa_axis"))
def _(s, d):
    return wf.time_tail(wf.date_axis(bars(s, d), "asset"), "asset")


@query("w11_time_tail_dates", with_("axis", f"SELECT date, idx, {_tail('', 10)} FROM axis"))
def _(s, d):
    return wf.time_tail(axis(s, d), min_val=10)


@query("w12_oos_dates", with_("date_folds", "SELECT date, idx, fold_id FROM date_folds WHERE part = 'test'"))
def _(s, d):
    return wf.oos_dates(dates(s, d))
