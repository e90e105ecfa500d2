"""Positions, turnover, profit and volatility targeting.

A book is kept sparse: only held assets have rows. Flat assets add nothing to
profit, and a change of the book shows as an entry, a flip or an exit, so cost
needs a window over the held rows and never the whole date x asset matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import ANNUAL, by, clip, n_long_short, safe_div
from tidemark.functions.ranks import extremes, row_rank

RUN_DATE = ("run_id", "date")
FLAT = 1e-12


def smooth_predictions(preds: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``window`` predictions per asset, over fold borders;
    shorter at the start of the run."""
    w = by("run_id", "asset").rowsBetween(-(window - 1), Window.currentRow)
    return preds.withColumn("pred", F.avg("pred").over(w))


def long_short_book(preds: DataFrame, n_long: int, n_short: int,
                    short_wins: bool = True) -> DataFrame:
    """Held assets per run and date with ``pos`` +1 / -1. A date whose
    predictions hardly differ holds nothing. Ties go by asset name."""
    told = (preds.groupBy(*RUN_DATE).agg(F.stddev_pop("pred").alias("_sd"))
            .where(F.col("_sd") >= FLAT).select(*RUN_DATE))
    picks = extremes(preds, RUN_DATE, "pred", "asset", n_long, n_short)
    side = F.min("side") if short_wins else F.max("side")
    extra = [c for c in preds.columns if c not in (*RUN_DATE, "asset")]
    book = picks.groupBy(*RUN_DATE, "asset").agg(
        side.alias("pos"), *[F.first(c).alias(c) for c in extra])
    return book.join(told, list(RUN_DATE), "left_semi")


def dense_positions(preds: DataFrame, book: DataFrame) -> DataFrame:
    """Every asset's position, flat ones 0.0."""
    keys = [*RUN_DATE, "asset"]
    return (preds.join(book.select(*keys, "pos"), keys, "left")
            .withColumn("pos", F.coalesce("pos", F.lit(0.0))))


def run_dates(preds: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("date")
    return preds.select(*RUN_DATE).distinct().withColumn("seq", F.row_number().over(w))


def book_steps(book: DataFrame, dates: DataFrame) -> DataFrame:
    """Per run and date: gross profit of unit positions and how many assets were
    kept, flipped, entered and left."""
    held = book.join(dates, list(RUN_DATE))
    w = Window.partitionBy("run_id", "asset").orderBy("seq")
    follows = F.lag("seq").over(w) == F.col("seq") - 1
    stays = F.lead("seq").over(w) == F.col("seq") + 1
    held = held.withColumns({
        "_prev": F.when(follows, F.lag("pos").over(w)).otherwise(F.lit(0.0)),
        "_exit": ~F.coalesce(stays, F.lit(False))})
    event = F.array(
        F.struct(F.col("seq").alias("seq"), (F.col("pos") * F.col("realized")).alias("gross"),
                 F.col("_prev").alias("prev"), F.col("pos").alias("pos")),
        F.struct((F.col("seq") + 1).alias("seq"), F.lit(0.0).alias("gross"),
                 F.col("pos").alias("prev"), F.lit(0.0).alias("pos")))
    events = held.select("run_id", F.explode(
        F.when(F.col("_exit"), event).otherwise(F.slice(event, 1, 1))).alias("e"))
    events = events.select("run_id", "e.*")

    def n(cond):
        return F.count_if(cond)
    p, q = F.col("pos"), F.col("prev")
    steps = events.groupBy("run_id", "seq").agg(
        F.sum("gross").alias("gross"),
        n((p != 0) & (q == p)).alias("n_kept"), n((p != 0) & (q == -p)).alias("n_flip"),
        n((p != 0) & (q == 0)).alias("n_new"), n((p == 0) & (q != 0)).alias("n_left"))
    return dates.join(steps, ["run_id", "seq"], "left").fillna(
        0, subset=["gross", "n_kept", "n_flip", "n_new", "n_left"])


def moved() -> F.Column:
    """Sum of absolute position changes of an unscaled step."""
    return F.col("n_new") + F.col("n_left") + 2 * F.col("n_flip")


def book_pnl(steps: DataFrame, legs: int, cost_bps: float) -> DataFrame:
    """Net profit per unit of gross exposure; cost on the change of the book."""
    gross, cost = F.col("gross") / legs, moved() / legs * (cost_bps / 1e4)
    return steps.select(*RUN_DATE, gross.alias("gross"), cost.alias("cost"),
                        (gross - cost).alias("net"), F.lit(1.0).alias("vol_scale"),
                        moved().cast("double").alias("moved"))


def vol_targeted_pnl(steps: DataFrame, legs: int, cost_bps: float, target: float = 0.10,
                     max_leverage: float = 2.0, lookback: int = 21) -> DataFrame:
    """Net profit with positions scaled by target over trailing volatility of the
    scaled net profit itself. The feedback is sequential, so each run is folded
    in date order; its input is one row of six numbers per date, and runs go in
    parallel."""
    if not 0 < target < 1 or max_leverage <= 0 or lookback < 2:
        raise ValueError("target in (0,1), max_leverage > 0 and lookback >= 2 are required")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fold_run(pdf.sort_values("seq"), legs, cost_bps / 1e4, target, max_leverage,
                         lookback)
    return steps.groupBy("run_id").applyInPandas(
        fold, "run_id string, date date, gross double, cost double, net double, "
              "vol_scale double, moved double")


def _fold_run(pdf: pd.DataFrame, legs: int, rate: float, target: float, cap: float,
              lookback: int) -> pd.DataFrame:
    import numpy as np
    net, scale, cost, moved = [], [], [], []
    prev = 0.0
    for g, kept, flip, new, left in zip(pdf.gross, pdf.n_kept, pdf.n_flip, pdf.n_new, pdf.n_left):
        s = 1.0
        if len(net) >= lookback:
            vol = float(np.std(net[-lookback:])) * ANNUAL
            s = cap if vol < 1e-8 else min(max(target / vol, 0.0), cap)
        m = kept * abs(s - prev) + flip * (s + prev) + new * s + left * prev
        moved.append(m)
        cost.append(m / legs * rate)
        net.append(s * g / legs - cost[-1])
        scale.append(s)
        prev = s
    return pd.DataFrame({"run_id": pdf.run_id, "date": pdf.date,
                         "gross": np.array(scale) * pdf.gross / legs, "cost": cost, "net": net,
                         "vol_scale": scale, "moved": moved})


def mean_turnover(pnl: DataFrame, n_assets: int) -> DataFrame:
    """Reported turnover: change of the book over the number of assets."""
    return pnl.groupBy("run_id").agg((F.avg("moved") / n_assets).alias("turnover"))


def gross_return(book: DataFrame, dates: DataFrame) -> DataFrame:
    """Gross long-short return per unit held; null on flat dates."""
    r = book.groupBy(*RUN_DATE).agg(
        safe_div(F.sum(F.col("pos") * F.col("realized")), F.sum(F.abs("pos"))).alias("ls_return"))
    return dates.select(*RUN_DATE).join(r, list(RUN_DATE), "left")


def spread_capture(preds: DataFrame, book: DataFrame) -> DataFrame:
    """Share of the day's best-minus-worst spread that the book caught."""
    spread = preds.groupBy(*RUN_DATE).agg(
        (F.max("realized") - F.min("realized")).alias("spread"))
    r = gross_return(book, spread)
    return spread.join(r, list(RUN_DATE)).withColumn(
        "capture", safe_div("ls_return", F.nullif("spread", F.lit(0.0))))


# ── single series ───────────────────────────────────────────────────────────
def sign_positions(preds: DataFrame) -> DataFrame:
    return preds.withColumn("pos", F.coalesce(F.signum("pred"), F.lit(0.0)))


def scaled_positions(preds: DataFrame) -> DataFrame:
    """pred / its standard deviation over the run, clipped to [-1, 1]."""
    sd = preds.groupBy("run_id").agg(F.stddev_pop("pred").alias("_sd"))
    pos = clip(safe_div("pred", F.nullif("_sd", F.lit(0.0))), -1.0, 1.0)
    return (preds.join(sd, "run_id").withColumn("pos", F.coalesce(pos, F.lit(0.0))).drop("_sd"))


def series_pnl(positions: DataFrame, cost_bps: float) -> DataFrame:
    """Turnover against the row before (flat at first) and net profit."""
    w = by("run_id")
    turn = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    df = positions.withColumn("turnover", turn)
    return df.withColumn("net", F.col("pos") * F.col("realized")
                         - F.col("turnover") * (cost_bps / 1e4))


def daily_net(positions: DataFrame, cost_bps: float) -> DataFrame:
    """Net profit with unrealised rows counted as zero."""
    df = series_pnl(positions, cost_bps)
    return df.withColumn("net", F.coalesce("net", F.lit(0.0)))


def equity_curve(pnl: DataFrame) -> DataFrame:
    w = by("run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pnl.withColumn("equity", F.product(1.0 + F.col("net")).over(w))


# ── live ranking ────────────────────────────────────────────────────────────
def reversal_score(prices: DataFrame, k: int = 5) -> DataFrame:
    """(asset, date, pred): minus the last k-step return; 0.0 without history."""
    w = by("asset")
    df = prices.where(F.col("close").isNotNull()).withColumn(
        "mom", F.log(safe_div("close", F.lag("close", k).over(w))))
    last = df.groupBy("asset").agg(F.max_by(F.struct("date", "mom"), "date").alias("r"))
    return last.select("asset", F.col("r.date").alias("date"), F.col("r.mom").alias("recent_mom"),
                       F.coalesce(-F.col("r.mom"), F.lit(0.0)).alias("pred"))


def live_ranking(scores: DataFrame, *keys: str) -> DataFrame:
    """Rank 1..N by prediction; top legs LONG, bottom legs SHORT, rest FLAT. On
    overlap LONG wins. Legs follow the size of the universe per key."""
    df = row_rank(scores, keys, [-F.col("pred"), "asset"], "rank")
    sizes = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(sizes, list(keys)) if keys else df.withColumn("_n", sizes.scalar())
    legs = n_long_short(F.col("_n"))
    return df.withColumn("position", F.when(F.col("rank") <= legs, "LONG")
                         .when(F.col("rank") > F.col("_n") - legs, "SHORT")
                         .otherwise("FLAT")).drop("_n")


def vol_regime(vols: DataFrame, vol: str = "vol", target: float = 0.10) -> DataFrame:
    """Mean volatility of the latest rows, its regime and the static scale."""
    v = F.col("avg_vol")
    regime = F.when(v.isNull(), "unknown").when(v < 0.18, "low").when(v > 0.30, "high") \
        .otherwise("normal")
    scale = F.when(v > 1e-6, clip(safe_div(F.lit(target), v), 0.0, 2.0)).otherwise(F.lit(1.0))
    return vols.agg(F.avg(vol).alias("avg_vol")).withColumns(
        {"vol_regime": regime, "vol_scale": scale})


# ── smoothing by rank moves ─────────────────────────────────────────────────
def first_far(r: np.ndarray, k: int) -> np.ndarray:
    """For each place, the first later one whose value is k or more away; the length
    if there is none. Minima and maxima of blocks of 1, 2, 4, ... rows are laid out
    once; every place then skips the largest block that stays within reach, from long
    to short: a few arrays for each doubling, whatever the length."""
    r = np.asarray(r)
    n = len(r)
    low, high = [r], [r]
    while 2 << len(low) - 1 <= n:
        half = 1 << len(low) - 1
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
        high.append(np.maximum(high[-1][:-half], high[-1][half:]))
    at = np.arange(1, n + 1)
    for level in range(len(low) - 1, -1, -1):
        inside = np.flatnonzero(at + (1 << level) <= n)
        block = at[inside]
        near = (high[level][block] - r[inside] < k) & (r[inside] - low[level][block] < k)
        at[inside[near]] += 1 << level
    return at


def smoothed_ranks(preds: DataFrame, k: int) -> DataFrame:
    """Hold the last adopted ranks until some asset moved by at least ``k``.

    (run_id, date, asset, rank, held_rank, adopted). "Some asset moved" is a
    minimum over assets, so no rank vector of the universe is ever formed: each
    asset finds, on its own series, the first later date on which it is k ranks
    away; the earliest of these per date is where ranks adopted then give way;
    and a run follows that chain over its dates."""
    up = row_rank(preds, RUN_DATE, ["pred", "asset"], "_up")
    sizes = preds.groupBy(*RUN_DATE).agg(F.count(F.lit(1)).alias("_n"))
    ranked = up.join(sizes, list(RUN_DATE)).withColumn(
        "rank", (F.col("_n") + 1 - F.col("_up")).cast("int")).drop("_n", "_up")

    def first_moves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r, d = pdf["rank"].to_numpy(), pdf["date"].to_numpy()
        at = first_far(r, k)
        return pd.DataFrame({"run_id": pdf["run_id"], "date": d, "until": [d[j] if j < len(d) else None for j in at]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        held, give_way, out = None, None, []
        for d, u in zip(pdf["date"], pdf["until"]):
            if held is None or d == give_way:
                held, give_way = d, u
            out.append(held)
        return pd.DataFrame({"run_id": pdf["run_id"], "date": pdf["date"], "held_at": out})
    until = (ranked.select("run_id", "asset", "date", "rank").groupBy("run_id", "asset")
             .applyInPandas(first_moves, "run_id string, date date, until date")
             .groupBy(*RUN_DATE).agg(F.min("until").alias("until")))
    held = until.groupBy("run_id").applyInPandas(chain, "run_id string, date date, held_at date")
    past = ranked.select("run_id", F.col("date").alias("held_at"), "asset",
                         F.col("rank").alias("held_rank"))
    return (ranked.join(held, list(RUN_DATE)).join(past, ["run_id", "held_at", "asset"])
            .withColumn("adopted", F.col("held_at") == F.col("date"))
            .select(*RUN_DATE, "asset", "rank", "held_rank", "adopted"))
