"""Weekly signal documents: scores, ranking, nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.portfolio import live_ranking
from tidemark.operators.timeseries import lagged_returns


def weekly_scores(prices: DataFrame, k: int = 5) -> DataFrame:
    """Reversal score of each asset at its last bar of every week; ``date`` is
    the Friday that ends it, ``feature_date`` the latest bar used by the week. A week
    in which some asset ended earlier than others is marked reconstructed."""
    df = lagged_returns(prices, (k,))
    friday = F.next_day(F.date_sub("date", 1), "FRI")
    last = df.groupBy("asset", friday.alias("date")).agg(
        F.max(F.struct("date", f"ret_{k}d")).alias("r"))
    rows = last.select("asset", "date", F.col("r.date").alias("bar_date"),
                       F.coalesce(-F.col(f"r.ret_{k}d"), F.lit(0.0)).alias("pred"))
    dates = rows.groupBy("date").agg(
        F.max("bar_date").alias("feature_date"),
        (F.min("bar_date") < F.max("bar_date")).alias("reconstructed"))
    return rows.join(dates, "date")


def signal_documents(scores: DataFrame, horizon: int = 5, model: str = "MeanReversion") -> DataFrame:
    """One document per date with its rankings, best first. The array holds the
    ranked universe, which is a configured list."""
    r = live_ranking(scores, "date")
    item = F.struct(F.col("rank"), F.col("asset").alias("ticker"), F.col("asset").alias("mt5"),
                    F.col("position"), F.round("pred", 6).alias("predicted_return"))
    docs = r.groupBy("date").agg(F.max("feature_date").alias("feature_date"),
                                 F.bool_or("reconstructed").alias("reconstructed"),
                                 F.sort_array(F.collect_list(item)).alias("rankings"))
    return docs.select("date", "feature_date", F.lit(horizon).alias("horizon"),
                       F.lit(model).alias("model_name"),
                       "reconstructed", "rankings")


