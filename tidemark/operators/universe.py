"""Asset universes as dimension rows: (universe, role, asset, pos, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import n_long_short


def flatten_groups(groups: DataFrame) -> DataFrame:
    """Ranked assets in group order: rows (grp, grp_pos, members array)."""
    return groups.select("grp", "grp_pos", F.posexplode("members").alias("pos", "asset"))


def ordered_union(lists: DataFrame) -> DataFrame:
    """Distinct assets of several ordered lists (list_no, pos, asset), each kept
    at its first place."""
    first = lists.groupBy("asset").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    w = Window.orderBy("at", "asset")     # over distinct assets
    return first.select("asset", F.row_number().over(w).alias("pos"))


def with_role(universe: DataFrame, role: str) -> DataFrame:
    return universe.where(F.col("role") == role).select("universe", "asset", "pos")


def price_list(universe: DataFrame, name: str) -> DataFrame:
    """Ranked then context assets of one universe, without repeats."""
    u = universe.where(F.col("universe") == name)
    lists = u.select(F.when(F.col("role") == "ranked", 1).otherwise(2).alias("list_no"), "pos",
                     "asset")
    return ordered_union(lists)


def cost_bps(names: DataFrame, costs: DataFrame, default: float) -> DataFrame:
    """Cost per universe with the global value as fallback."""
    return names.join(costs, "universe", "left").select(
        "universe", F.coalesce("cost_bps", F.lit(default)).alias("cost_bps"))


def late_close_assets(universe: DataFrame) -> DataFrame:
    return universe.where("late_close").select("asset").distinct()


def legs_per_side(universe: DataFrame) -> DataFrame:
    n = universe.where(F.col("role") == "ranked").groupBy("universe").agg(
        F.count(F.lit(1)).alias("n_assets"))
    return n.withColumn("n_legs", n_long_short(F.col("n_assets")))


def display_names(df: DataFrame, names: DataFrame, asset: str = "asset") -> DataFrame:
    """Readable name, the label itself where none is known."""
    return df.join(names, asset, "left").withColumn("name", F.coalesce("name", F.col(asset)))


def fingerprint(*fields: Column) -> Column:
    """First 8 hex digits of an md5 over the given fields as JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*fields))), 1, 8)
