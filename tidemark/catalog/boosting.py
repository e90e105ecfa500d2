"""Queries of boosted trees, with SQL that grows the same trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from tidemark.catalog import evaluation as ev
from tidemark.catalog import jobs as cj
from tidemark.catalog import timeseries as ct
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.functions.cluster import cut_lineage
from tidemark.functions.expr import rounded
from tidemark.operators import boosting as bo
from tidemark.operators import metrics as mt
from tidemark.operators import panel as pn
from tidemark.operators import timeseries as ts
from tidemark.operators import walkforward as wf

ROUNDS, DEPTH, STEP, REG, LEAF = 6, 3, 0.3, 0.1, 20


# ── the algorithm as SQL ────────────────────────────────────────────────────
def _ranked(value: str, keys: str) -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n"


def bins_cte(x: str, rows: str, keys: Sequence[str], features: Sequence[str]) -> None:
    """``{x}_bins``: rows with their feature bins by the fit rows' quantiles."""
    k = ", ".join(keys)
    cte(f"{x}_long", f"""
SELECT {k}, date, asset, part, unnest(range({len(features)})) AS j, unnest([{', '.join(features)}]) AS v FROM {rows}""", rows, stored=True)
    cte(f"{x}_edges", f"""
SELECT {k}, j, list(v ORDER BY i) AS e FROM (SELECT {k}, j, v, {_ranked('v', f'{k}, j')} FROM {x}_long WHERE part = 'fit') r
JOIN (SELECT unnest(range(1, {bo.BINS})) AS i) ON rn = greatest(1, ceil(i / {bo.BINS}.0::DOUBLE * n)) GROUP BY {k}, j""", f"{x}_long", stored=True)
    cte(f"{x}_bins", f"""
SELECT {k}, date, asset, part, list(len(list_filter(e, lambda z: v > z)) ORDER BY j) AS b
FROM {x}_long JOIN {x}_edges USING ({k}, j) GROUP BY {k}, date, asset, part""", f"{x}_long", f"{x}_edges", stored=True)


def rounds_ctes(x: str, keys: Sequence[str], gradient: Callable[[str], str], leaf: str, ranked: str = "") -> None:
    """From ``{x}_s0`` (keys, date, asset, part, b, score, …) to ``{x}_s{ROUNDS}``.
    ``leaf`` is the aggregate of a leaf, ``ranked`` more columns it needs."""
    k = ", ".join(keys)
    for r in range(ROUNDS):
        s, at = f"{x}_s{r}", f"{x}_{r}_0"
        cte(at, gradient(s), s, stored=True)
        for level in range(DEPTH):
            to = f"{x}_{r}_{level + 1}"
            cte(f"{at}_best", f"""
SELECT {k}, leaf, max_by(struct_pack(f := f, v := v), (gain, -f, -v)) AS s FROM (
  SELECT {k}, leaf, f, v, nl, na, CAST(printf('%.{bo.DIGITS}e', gl * gl / (hl + {REG}) + (ga - gl) * (ga - gl) / (ha - hl + {REG})
         - ga * ga / (ha + {REG})) AS DOUBLE) AS gain FROM (
    SELECT {k}, leaf, f, v, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER w AS ga, sum(h) OVER w AS ha, sum(n) OVER w AS na
    FROM (SELECT {k}, leaf, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
      SELECT {k}, leaf, g, h, unnest(range(len(b))) AS f, unnest(b) AS v FROM {at} WHERE part = 'fit') GROUP BY {k}, leaf, f, v)
    WINDOW w AS (PARTITION BY {k}, leaf, f), u AS (PARTITION BY {k}, leaf, f ORDER BY v ROWS UNBOUNDED PRECEDING)))
WHERE nl >= {LEAF} AND na - nl >= {LEAF} AND gain > 1e-12 GROUP BY {k}, leaf""", at, stored=True)
            cte(to, f"""
SELECT a.* REPLACE (a.leaf * 2 + CASE WHEN coalesce(b[s.f + 1] > s.v, false) THEN 1 ELSE 0 END AS leaf)
FROM {at} a LEFT JOIN {at}_best USING ({k}, leaf)""", at, f"{at}_best", stored=True)
            at = to
        cte(f"{x}_{r}_v", f"SELECT {k}, leaf, {leaf} AS val FROM (SELECT *{ranked} FROM {at} WHERE part = 'fit') GROUP BY {k}, leaf", at, stored=True)
        cte(f"{x}_s{r + 1}", f"""
SELECT a.* EXCLUDE (g, h, leaf) REPLACE (score + {STEP} * coalesce(val, 0) AS score) FROM {at} a LEFT JOIN {x}_{r}_v USING ({k}, leaf)""",
            at, f"{x}_{r}_v", stored=True)


def chosen_cte(x: str, keys: Sequence[str], loss: str, group: str = "") -> None:
    """``{x}_preds``: test rows after the round of least loss on val rows. ``loss``
    reads (keys, round, y, s, …); ``group`` wraps the union of val rows before it."""
    k = ", ".join(keys)
    states = [f"{x}_s{r + 1}" for r in range(ROUNDS)]
    cte(f"{x}_val", " UNION ALL ".join(f"SELECT *, {r} AS round, score AS s FROM {s} WHERE part = 'val'" for r, s in enumerate(states)), *states)
    cte(f"{x}_best", f"""
SELECT {k}, min_by(round, (round(loss, 10), round)) AS best FROM (SELECT {k}, round, {loss} AS loss FROM {group or f'{x}_val'}
GROUP BY {k}, round) GROUP BY {k}""", f"{x}_val")
    cte(f"{x}_preds", f"""
SELECT {k}, date, asset, score AS pred, y AS realized FROM (""" + " UNION ALL ".join(
        f"SELECT {k}, date, asset, score, y, {r} AS round FROM {s} WHERE part = 'test'" for r, s in enumerate(states)) + f"""
) LEFT JOIN {x}_best USING ({k}) WHERE round = coalesce(best, {ROUNDS - 1})""", *states, f"{x}_best")


def boost_ctes(x: str, rows: str, keys: Sequence[str], features: Sequence[str], objectives: dict[str, float | None]) -> None:
    """Squared-error and pinball models over ``rows`` (keys, date, asset, part, y, …)."""
    own, k = [*keys, "model"], ", ".join([*keys, "model"])
    bins_cte(x, rows, keys, features)
    models = ", ".join(f"('{m}', {'NULL' if q is None else q}::DOUBLE)" for m, q in objectives.items())
    at_rank = "max(CASE WHEN rn = greatest(1, ceil(q * n)) THEN {} END)"
    cte(f"{x}_start", f"""
SELECT {k}, CASE WHEN max(q) IS NULL THEN avg(y) ELSE {at_rank.format('y')} END AS score FROM (
  SELECT *, {_ranked('y', k)} FROM {rows}, (VALUES {models}) m(model, q) WHERE part = 'fit') GROUP BY {k}""", rows, stored=True)
    cte(f"{x}_s0", f"""
SELECT {', '.join(f'r.{c}' for c in keys)}, m.model, q, r.date, r.asset, r.part, y, b, score FROM {rows} r
JOIN {x}_bins b ON {' AND '.join(f'b.{c} = r.{c}' for c in keys)} AND b.date = r.date AND b.asset = r.asset AND b.part = r.part
CROSS JOIN (VALUES {models}) m(model, q)
JOIN {x}_start s ON s.model = m.model AND {' AND '.join(f's.{c} = r.{c}' for c in keys)}""", rows, f"{x}_bins", f"{x}_start", stored=True)
    gradient = ("SELECT *, CASE WHEN q IS NULL THEN y - score ELSE q - CASE WHEN y < score THEN 1 ELSE 0 END END AS g, 1.0::DOUBLE AS h, "
                "0 AS leaf FROM {}")
    leaf = f"CASE WHEN max(q) IS NULL THEN sum(g) / (sum(h) + {REG}) ELSE {at_rank.format('y - score')} END"
    rounds_ctes(x, own, gradient.format, leaf, f", {_ranked('y - score', f'{k}, leaf')}")
    chosen_cte(x, own, "avg(CASE WHEN q IS NULL THEN (y - s) * (y - s) ELSE greatest(q * (y - s), (q - 1) * (y - s)) END)")


def _gain(rel: str) -> str:
    return f"(pow(2.0::DOUBLE, {rel} - n + 1) - pow(2.0::DOUBLE, 1.0 - n))"


def _ideal(top: int) -> str:
    return " + ".join(f"CASE WHEN n > {p} THEN (pow(2.0::DOUBLE, {-p}) - pow(2.0::DOUBLE, 1.0 - n)) / log2({p + 2}.0::DOUBLE) ELSE 0 END" for p in range(top))


def listwise_ctes(x: str, rows: str, keys: Sequence[str], features: Sequence[str], at: int = 3) -> None:
    k = ", ".join(keys)
    bins_cte(x, rows, keys, features)
    cte(f"{x}_s0", f"""
SELECT {k}, date, asset, part, y, CASE WHEN part <> 'test' THEN row_number() OVER (PARTITION BY {k}, part, date ORDER BY y, asset) - 1 END AS rel,
  count(*) OVER (PARTITION BY {k}, part, date) AS n, b, 0.0::DOUBLE AS score FROM {rows} JOIN {x}_bins USING ({k}, date, asset, part)""",
        rows, f"{x}_bins", stored=True)
    disc = f"CASE WHEN {{0}} <= {bo.TOP} THEN 1.0::DOUBLE / log2({{0}} + 1) ELSE 0 END"

    def gradient(s: str) -> str:
        return f"""
SELECT s.*, g, h, 0 AS leaf FROM {s} s LEFT JOIN (
  SELECT {k}, date, asset, sum(up * rho * delta) AS g, sum(rho * (1 - rho) * delta) AS h FROM (
    SELECT {', '.join(f'a.{c}' for c in keys)}, a.date, a.asset, CASE WHEN a.rel > t.rel THEN 1.0 ELSE -1.0 END AS up,
      1.0::DOUBLE / (1.0 + exp(CASE WHEN a.rel > t.rel THEN 1.0 ELSE -1.0 END * (a.score - t.score))) AS rho,
      abs({_gain('a.rel').replace(' n ', ' a.n ').replace(' n)', ' a.n)')} - {_gain('t.rel').replace(' n ', ' a.n ').replace(' n)', ' a.n)')})
        * abs({disc.format('a.place')} - {disc.format('t.place')}) / ({_ideal(bo.TOP).replace('n >', 'a.n >').replace('- n)', '- a.n)')}) AS delta
    FROM (SELECT *, row_number() OVER (PARTITION BY {k}, date ORDER BY score DESC, asset) AS place FROM {s} WHERE part = 'fit') a
    JOIN (SELECT *, row_number() OVER (PARTITION BY {k}, date ORDER BY score DESC, asset) AS place FROM {s} WHERE part = 'fit') t
      ON {' AND '.join(f'a.{c} = t.{c}' for c in keys)} AND a.date = t.date AND a.asset <> t.asset AND least(a.place, t.place) <= {bo.TOP})
  GROUP BY {k}, date, asset) USING ({k}, date, asset)"""
    rounds_ctes(x, keys, gradient, f"sum(g) / (sum(h) + {REG})")
    val = f"""(SELECT {k}, date, round, sum({_gain('rel')} / log2(place + 1)) / max({_ideal(at)}) AS ndcg FROM (
  SELECT *, row_number() OVER (PARTITION BY {k}, date, round ORDER BY s DESC, asset) AS place FROM {x}_val) WHERE place <= {at}
  GROUP BY {k}, date, round)"""
    chosen_cte(x, keys, "-avg(ndcg)", val)


# ── rows of the panel with folds split for early stopping ───────────────────
FEATURES = cj.FEATURES
cte("bt_panel", f"""
SELECT f.asset, f.date, {', '.join('f.' + c for c in FEATURES)}, target_5d AS y FROM axis JOIN feat f USING (date)
JOIN label l ON l.asset = f.asset AND l.date = f.date WHERE {' AND '.join(f'f.{c} IS NOT NULL' for c in FEATURES)} AND target_5d IS NOT NULL""",
    "axis", "feat", "label", stored=True)
cte("bt_dates", """
WITH a AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bt_panel)),
f AS (SELECT date, idx, k AS fold_id, 504 + 252 * k AS hi, hi - greatest(10, floor(hi * 0.15::DOUBLE)) AS start
      FROM a, range(0, 1000) t(k) WHERE 761 + 252 * k <= n)
SELECT date, CAST(fold_id AS INTEGER) AS fold_id, CASE WHEN idx >= 509 + 252 * fold_id AND idx < 761 + 252 * fold_id THEN 'test'
  WHEN idx >= hi THEN NULL WHEN start - 5 < 20 OR idx < start - 5 THEN 'fit' WHEN idx >= start THEN 'val' END AS part FROM f""", "bt_panel")
cte("bt_rows", "SELECT p.*, fold_id, part FROM bt_panel p JOIN bt_dates USING (date) WHERE part IS NOT NULL", "bt_panel", "bt_dates", stored=True)
boost_ctes("gb", "bt_rows", ["fold_id"], FEATURES, {"BoostedTrees": None})
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
boost_ctes("pin", "bt_rows", ["fold_id"], FEATURES, QUANTILES)
listwise_ctes("lst", "bt_rows", ["fold_id"], FEATURES)


def panel_parts(s, d):
    p = cut_lineage(cj.panel(s, d))
    ax = wf.date_axis(p)
    return cut_lineage(bo.fold_parts(p, wf.date_folds(ax, wf.folds(wf.axis_counts(ax), cj.SP))))


HOW = {"rounds": ROUNDS, "depth": DEPTH, "step": STEP, "reg": REG, "min_leaf": LEAF}


@query("m09_boosted_trees", with_("gb_preds", f"SELECT model AS run_id, fold_id, date, asset, {rnd('pred realized', 8)} FROM gb_preds"))
def _(s, d):
    out = bo.boost(panel_parts(s, d), ["fold_id"], FEATURES, {"BoostedTrees": None}, **HOW)
    return rounded(out.withColumnRenamed("model", "run_id"), 8, "run_id", "fold_id", "date", "asset", "pred", "realized")


@query("m10_pinball_trees", with_("pin_preds", f"SELECT fold_id, model, date, asset, {rnd('pred realized', 8)} FROM pin_preds"))
def _(s, d):
    return rounded(bo.boost(panel_parts(s, d), ["fold_id"], FEATURES, QUANTILES, **HOW), 8)


@query("m11_listwise_trees", with_("lst_preds", f"SELECT fold_id, date, asset, {rnd('pred realized', 8)} FROM lst_preds"))
def _(s, d):
    return rounded(bo.listwise(panel_parts(s, d), ["fold_id"], FEATURES, **HOW), 8)


# ── live scoring: a model on all labelled rows, applied to each asset's last row ──
_full = " AND ".join(f"f.{c} IS NOT NULL" for c in FEATURES)
_cols = ", ".join("f." + c for c in FEATURES)
cte("live_train", f"""
SELECT f.asset, f.date, {_cols}, target_5d AS y FROM feat f JOIN label l ON l.asset = f.asset AND l.date = f.date
WHERE {_full} AND target_5d IS NOT NULL""", "feat", "label", stored=True)
cte("live_last", f"""
SELECT f.asset, f.date, {_cols} FROM feat f WHERE {_full} QUALIFY row_number() OVER (PARTITION BY f.asset ORDER BY f.date DESC) = 1""", "feat")
cte("live_rows", """
WITH a AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM live_train)),
p AS (SELECT date, CASE WHEN start - 5 < 20 OR idx < start - 5 THEN 'fit' WHEN idx >= start THEN 'val' END AS part FROM (
  SELECT *, n - greatest(10, floor(n * 0.15::DOUBLE)) AS start FROM a))
SELECT 0 AS k, part, t.* FROM live_train t JOIN p USING (date) WHERE part IS NOT NULL
UNION ALL SELECT 0, 'test', * FROM live_train
UNION ALL SELECT 0, 'test', *, NULL FROM live_last""", "live_train", "live_last", stored=True)
boost_ctes("live", "live_rows", ["k"], FEATURES, {"BoostedTrees": None})


def live_scores(s, d):
    """(date, asset, pred, realized) of all labelled rows, and of the latest rows,
    whose label is null, by a model of all labelled rows."""
    feats = cut_lineage(ts.own_features(ct.bars(s, d)))
    train = ts.forward_log_return(feats, 5).dropna(subset=[*FEATURES, "target"]).select("asset", "date", *FEATURES, "target")
    last = pn.latest_rows(feats, FEATURES).select("asset", "date", *FEATURES, F.lit(None).cast("double").alias("target"))
    dates = wf.date_axis(train).withColumns({"fold_id": F.lit(0), "part": F.lit("train")})
    cols = ["asset", "date", *FEATURES, "target", F.lit("test").alias("part")]
    rows = bo.fold_parts(train, dates).select(*cols[:-1], "part").unionByName(train.unionByName(last).select(*cols))
    return bo.boost(cut_lineage(rows.withColumn("k", F.lit(0))), ["k"], FEATURES, {"BoostedTrees": None}, **HOW)


@query("m15_train_on_all", with_("live_preds", f"""
SELECT 'all' AS run_id, {rnd(ev.CORR.format('pred', 'realized') + ' AS ic')}, count(*) AS n_rows FROM live_preds WHERE realized IS NOT NULL"""))
def _(s, d):
    fit = live_scores(s, d).where("realized IS NOT NULL").withColumn("run_id", F.lit("all"))
    n = fit.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(mt.ic(fit, "run_id").join(n, "run_id"), 8)


@query("m16_score_latest", with_("live_preds", f"""
SELECT asset, {rnd('pred')} FROM live_preds WHERE realized IS NULL UNION ALL SELECT 'NOWHERE', 0.0::DOUBLE"""))
def _(s, d):
    want = s.createDataFrame([(a,) for a in (*ct.ALL, "NOWHERE")], "asset string")
    got = live_scores(s, d).where("realized IS NULL").select("asset", "pred")
    return rounded(want.join(got, "asset", "left").withColumn("pred", F.coalesce("pred", F.lit(0.0))), 8)
