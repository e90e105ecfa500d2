"""Cross-sectional features and assembly of the (date, asset) panel."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import col_safe
from tidemark.operators import timeseries as ts
from tidemark.operators.walkforward import complete_dates

CROSS = ("mom_10d", "mom_21d", "vol_21d", "dist_ma_20", "dist_ma_60")
KEYS = ("date", "asset")


@dataclass(frozen=True)
class PanelSpec:
    """What a panel is made of; one spec serves training and live scoring."""

    ranked: tuple[str, ...]
    context: tuple[str, ...] = ()
    late: tuple[str, ...] = ()
    ref_asset: str | None = None
    horizon: int = 5
    ratio_pairs: tuple[tuple[str, str, str], ...] = ()
    carry_pairs: dict[str, str] = field(default_factory=dict)
    macro_levels: dict[str, str] = field(default_factory=dict)
    macro_changes: dict[str, str] = field(default_factory=dict)
    macro_slope: tuple[str, str] | None = None
    names: dict[str, str] = field(default_factory=dict)

    @property
    def reference(self) -> str:
        return self.ref_asset or self.ranked[0]


def own_on_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Own features recomputed on the common calendar."""
    return ts.own_features(ts.on_calendar(prices, calendar))


def cross_features(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    df = ts.relative_to_basket(own_on_calendar(prices, calendar), CROSS)
    return df.select("asset", "date", *[f"rel_{c}" for c in CROSS])


def ratio_columns(prices: DataFrame, calendar: DataFrame,
                  pairs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Date-keyed ratio columns, the same for every asset."""
    pairs = list(pairs)
    long = ts.pair_ratios(prices, calendar, pairs)
    return long.groupBy("date").agg(*[
        F.max(F.when(F.col("pair") == n, F.col("ratio"))).alias(n) for _, _, n in pairs])


def cross_positioning(daily: DataFrame) -> DataFrame:
    df = ts.relative_to_basket(daily, ("mm_net_pct", "mm_net_chg"))
    return df.select("asset", "date", "rel_mm_net_pct", "rel_mm_net_chg")


def one_hot(df: DataFrame, assets: Sequence[str]) -> DataFrame:
    """N-1 indicator columns; the last asset in sorted order is the reference."""
    def name(a: str) -> str:
        return "is_" + a.translate({ord(c): None for c in "=^- "}).lower()
    return df.withColumns({name(a): F.when(F.col("asset") == a, 1.0).otherwise(0.0)
                           for a in sorted(assets)[:-1]})


def feature_table(prices: DataFrame, macro: DataFrame | None, spec: PanelSpec,
                  cot: DataFrame | None = None) -> DataFrame:
    """Every feature of every ranked asset on its own dates, no rows dropped.

    One shuffle by asset serves own, calendar and carry windows; blocks that
    depend on the date alone are joined as small date-keyed tables. The calendar
    is checkpointed: every block refers to it, and as a stored leaf it keeps the
    plan short."""
    prices = cut_lineage(prices)
    ranked = prices.where(F.col("asset").isin(list(spec.ranked)))
    cal = cut_lineage(ts.trading_calendar(prices, spec.reference))
    own = ts.price_features(prices, spec.ranked, spec.context, spec.late, spec.names)
    grid = ts.basis_momentum(own_on_calendar(ranked, cal))
    rel = ts.relative_to_basket(grid, (*CROSS, "basis_momentum"))
    rel = rel.select("asset", "date", *[f"rel_{c}" for c in CROSS], "basis_momentum",
                     "rel_basis_momentum")
    by_date = ts.seasonal(cal.select("date"))
    if spec.ratio_pairs:
        by_date = by_date.join(ratio_columns(prices, cal, spec.ratio_pairs), "date", "left")
    if macro is not None and (spec.macro_levels or spec.macro_changes or spec.macro_slope):
        by_date = by_date.join(ts.macro_block(macro, cal, spec.macro_levels, spec.macro_changes,
                                              spec.macro_slope), "date", "left")
    if spec.carry_pairs:
        rel = ts.with_carry(rel, prices, spec.ranked, cal, spec.carry_pairs)
    df = own.join(rel, ["asset", "date"], "left").join(by_date, ["date"], "left")
    if cot is not None:
        daily = ts.positioning_daily(cot, spec.ranked, cal)
        df = (df.join(daily, ["asset", "date"], "left")
              .join(cross_positioning(daily), ["asset", "date"], "left"))
    return one_hot(df, spec.ranked)


def pooled_panel(prices: DataFrame, macro: DataFrame | None, spec: PanelSpec,
                 cot: DataFrame | None = None) -> DataFrame:
    """Features and label, kept on dates where all ranked assets are complete."""
    feats = feature_table(prices, macro, spec, cot)
    label = ts.forward_log_return(
        prices.where(F.col("asset").isin(list(spec.ranked))).select("asset", "date", "close"),
        spec.horizon)
    # Read twice, for the date test and for the rows: stored once instead.
    df = cut_lineage(feats.drop("close").join(label.drop("close"), ["asset", "date"]))
    cols = [c for c in df.columns if c not in KEYS]
    keep = complete_dates(df, cols, len(spec.ranked))
    return df.join(keep, ["date"], "left_semi").select(*KEYS, *cols)


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in (*KEYS, "target", "idx")]


def asset_order(panel: DataFrame) -> DataFrame:
    w = Window.orderBy("asset")
    return panel.select("asset").distinct().select("asset", F.row_number().over(w).alias("pos"))


def uneven_dates(panel: DataFrame, n_assets: int) -> DataFrame:
    """Integrity check: dates that do not hold exactly ``n_assets`` rows."""
    return panel.groupBy("date").count().where(F.col("count") != n_assets)


def short_histories(prices: DataFrame, at_least: int = 2000) -> DataFrame:
    return (prices.groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") < at_least))


def target_matrix(prices: DataFrame, macro_features: DataFrame, target: str,
                  context: Sequence[str] = (), late: Iterable[str] = (),
                  names: dict[str, str] | None = None) -> DataFrame:
    """Single-target matrix: price block left-joined with macro columns."""
    own = ts.price_features(prices, [target], context, late, names)
    return own.join(macro_features, "date", "left")


def calendar_mismatch(matrix: DataFrame, prices: DataFrame, target: str) -> DataFrame:
    """Dates on one side only, or held twice: must be empty for a sound matrix."""
    want = prices.where(F.col("asset") == target).select("date")
    have = matrix.select("date")
    twice = have.groupBy("date").count().where("count > 1").select("date")
    return (want.exceptAll(have.distinct()).withColumn("problem", F.lit("missing"))
            .unionByName(have.distinct().exceptAll(want).withColumn("problem", F.lit("extra")))
            .unionByName(twice.withColumn("problem", F.lit("duplicate"))))


def null_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: null rows and first date with a value."""
    long = df.select("date", *columns).unpivot("date", list(columns), "column", "value")
    return long.groupBy("column").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min(F.when(F.col("value").isNotNull(), F.col("date"))).alias("first_valid"))


def latest_rows(features: DataFrame, price_columns: Sequence[str]) -> DataFrame:
    """Scoring row per asset: its last date with all price columns present;
    nulls elsewhere are tolerated and counted."""
    ok = features.dropna("any", subset=list(price_columns))
    cols = [c for c in features.columns if c != "asset"]
    last = ok.groupBy("asset").agg(F.max_by(F.struct(*cols), "date").alias("r"))
    return last.select("asset", *[F.col(f"r.{c}").alias(c) for c in cols])


def feature_date(latest: DataFrame) -> DataFrame:
    return latest.agg(F.max("date").alias("feature_date"))


def align_columns(df: DataFrame, training: Sequence[str]) -> DataFrame:
    """Exactly the training columns: absent ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[c for c in KEYS if c in have], *[
        F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in training])


def column_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", col_safe("asset"))
