"""Queries of the trade ledger, reconciliation and live report, and universes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog.evaluation import CORR
from tidemark.catalog.registry import query
from tidemark.catalog.sql import cte, rnd, with_
from tidemark.catalog.timeseries import bars
from tidemark.functions.expr import rounded
from tidemark.operators import ledger as lg
from tidemark.operators import signals as sg
from tidemark.operators import universe as un
from tidemark.sources import tables as tb

BUY, SELL = "DEAL_TYPE_BUY", "DEAL_TYPE_SELL"
cte("deals", f"""
SELECT account, position_id, symbol, volume, price, commission, CASE WHEN side = 'buy' THEN '{BUY}' ELSE '{SELL}' END AS type,
  'DEAL_ENTRY_IN' AS entry_type, open_date AS time, 0.0::DOUBLE AS profit, 0.0::DOUBLE AS swap FROM trades
UNION ALL SELECT account, position_id, symbol, volume, price, commission, CASE WHEN side = 'buy' THEN '{SELL}' ELSE '{BUY}' END,
  'DEAL_ENTRY_OUT', close_date, profit, swap FROM trades WHERE close_date IS NOT NULL
UNION ALL SELECT o_orderpriority, NULL, NULL, NULL, NULL, NULL, 'DEAL_TYPE_BALANCE', NULL, CAST(o_orderdate AS DATE), o_totalprice, NULL
FROM orders""", "trades")


@query("l01_deals_to_trades", with_("deals", f"""
SELECT account, position_id, lower(min(symbol)) AS symbol, min(volume) AS volume,
  max(CASE WHEN entry_type = 'DEAL_ENTRY_IN' THEN time END) AS open_time,
  CASE max(CASE WHEN entry_type = 'DEAL_ENTRY_IN' THEN type END) WHEN '{BUY}' THEN 'buy' WHEN '{SELL}' THEN 'sell' END AS side,
  max(CASE WHEN entry_type = 'DEAL_ENTRY_OUT' THEN time END) AS close_time,
  {rnd("sum(CASE WHEN entry_type = 'DEAL_ENTRY_OUT' THEN profit END) AS profit", 2)},
  {rnd("max_by(price, time) FILTER (entry_type = 'DEAL_ENTRY_IN') AS open_price|max_by(price, time) FILTER (entry_type = 'DEAL_ENTRY_OUT') AS close_price", 9)},
  CASE WHEN max(CASE WHEN entry_type = 'DEAL_ENTRY_OUT' THEN time END) IS NULL THEN 'still_open;' ELSE '' END
    || printf('swap=%.2f;commission=%.2f', sum(swap), sum(commission)) AS note
FROM deals WHERE type IN ('{BUY}', '{SELL}') AND position_id IS NOT NULL GROUP BY 1, 2"""))
def _(s, d):
    df = lg.deals_to_trades(tb.deals(s, d))
    return rounded(df, 9)                                             # the operator rounds money to cents


cte("open_pos", "SELECT *, floor(price / 100) - volume * 100 AS float_pnl FROM trades WHERE close_date IS NULL",
    "trades")


@query("l02_floating_pnl", with_("open_pos", f"""
SELECT account, {rnd('sum(float_pnl) AS floating_pnl', 2)} FROM open_pos GROUP BY 1"""))
def _(s, d):
    return rounded(lg.floating_pnl(tb.snapshots(s, d)), 2)


# ── signals ─────────────────────────────────────────────────────────────────
cte("wk", """
SELECT asset, week_end AS date, date AS bar_date, coalesce(-ret_5d, 0) AS pred
FROM (SELECT *, CAST(date + ((12 - isodow(date)) % 7)::INTEGER AS DATE) AS week_end FROM feat_r)
QUALIFY row_number() OVER (PARTITION BY asset, week_end ORDER BY bar_date DESC) = 1""",
    "feat_r")
cte("sig", """
SELECT asset, date, bar_date, max(bar_date) OVER (PARTITION BY date) AS feature_date, pred,
  row_number() OVER (PARTITION BY date ORDER BY -pred, asset) AS rank, count(*) OVER (PARTITION BY date) AS n FROM wk""", "wk")
cte("sig_pos", """
SELECT *, CASE WHEN rank = 1 THEN 'LONG' WHEN rank = n THEN 'SHORT' ELSE 'FLAT' END AS position,
  bool_or(bar_date < feature_date) OVER (PARTITION BY date) AS reconstructed FROM sig""", "sig")
cte("target", """
SELECT date, asset AS symbol, CASE position WHEN 'LONG' THEN 'buy' ELSE 'sell' END AS side
FROM sig_pos WHERE position <> 'FLAT'""", "sig_pos")
cte("held", """
SELECT d.date, t.symbol, max_by(t.side, (t.open_time, t.position_id)) AS side
FROM (SELECT DISTINCT date FROM sig_pos) d JOIN trades t
  ON t.open_date <= d.date AND (t.close_date IS NULL OR t.close_date > d.date) GROUP BY 1, 2""", "sig_pos", "trades")


def signals(s, d):
    return sg.signal_documents(sg.weekly_scores(bars(s, d))).persist()


@query("l03_target_book", with_("target", "SELECT * FROM target"))
def _(s, d):
    return lg.target_book(signals(s, d))


@query("l04_actual_book", with_("open_pos", """
SELECT account, symbol, max_by(side, position_id) AS side FROM open_pos GROUP BY 1, 2"""))
def _(s, d):
    return lg.actual_book(tb.snapshots(s, d))


@query("l05_book_at_instant", with_("held", "SELECT * FROM held"))
def _(s, d):
    return lg.book_at(tb.trades(s, d), signals(s, d).select("date"))


cte("books", """
SELECT coalesce(t.date, h.date) AS date, coalesce(t.symbol, h.symbol) AS symbol, t.side AS target, h.side AS actual
FROM target t FULL JOIN held h ON h.date = t.date AND h.symbol = t.symbol""", "target", "held")


def _listed(cond: str, name: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {cond} THEN symbol END, ',' ORDER BY symbol), '—') AS {name}"


cte("fid", f"""
SELECT *, missing = '—' AND extra = '—' AND wrong_dir = '—' AS ok FROM (
  SELECT date, {_listed('target IS NOT NULL AND actual IS NULL', 'missing')},
    {_listed('target IS NULL AND actual IS NOT NULL', 'extra')}, {_listed('target <> actual', 'wrong_dir')}
  FROM books GROUP BY 1)""", "books")


def fidelity(s, d):
    return lg.fidelity_table(signals(s, d), tb.trades(s, d))


@query("l06_fidelity", with_("fid", "SELECT * FROM fid"))
def _(s, d):
    return fidelity(s, d)


@query("l07_plan_orders", with_("books", """
SELECT date, symbol, 'close' AS action, actual AS side FROM books WHERE actual IS NOT NULL AND (target IS NULL OR target <> actual)
UNION ALL SELECT date, symbol, 'open', target FROM books WHERE target IS NOT NULL AND (actual IS NULL OR target <> actual)"""))
def _(s, d):
    sig = signals(s, d)
    return lg.plan_orders(lg.book_at(tb.trades(s, d), sig.select("date")), lg.target_book(sig))


@query("l08_rebalance_diff", with_("sig_pos target", """
SELECT * FROM (
  WITH ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM sig_pos)),
  old AS (SELECT ds.date, t.symbol, t.side FROM ds JOIN target t ON t.date = ds.prev_date)
  SELECT coalesce(n.date, o.date) AS date, coalesce(n.symbol, o.symbol) AS symbol, o.side AS old_side, n.side AS new_side,
    CASE WHEN o.side IS NULL THEN 'open' WHEN n.side IS NULL THEN 'close' WHEN o.side <> n.side THEN 'flip' ELSE 'unchanged' END AS change
  FROM target n FULL JOIN old o ON o.date = n.date AND o.symbol = n.symbol)"""))
def _(s, d):
    return lg.rebalance_diff(signals(s, d))


SAFE = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
IN_SAFE = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"


@query("l09_guard_violations", with_("target sig_pos open_pos", f"""
SELECT 'signal_outside_universe' AS rule, symbol AS subject, count(*) AS n FROM target WHERE symbol NOT IN {IN_SAFE} GROUP BY 2
UNION ALL SELECT 'too_many_positions', CAST(date AS VARCHAR), 1 FROM target GROUP BY date HAVING count(*) > 1
UNION ALL SELECT 'stale_signal', CAST(date AS VARCHAR), 1 FROM (SELECT DISTINCT date FROM sig_pos) WHERE date <> DATE '2000-01-07'
UNION ALL SELECT 'foreign_position', account || ':' || symbol, count(*) FROM open_pos WHERE symbol NOT IN {IN_SAFE} GROUP BY 2
UNION ALL SELECT 'off_size_position', account || ':' || symbol, count(*) FROM open_pos WHERE abs(volume - 0.25::DOUBLE) > 1e-9 GROUP BY 2"""))
def _(s, d):
    return lg.guard_violations(signals(s, d), tb.snapshots(s, d), SAFE, dt.date(2000, 1, 7), 0.25,
                               max_positions=1)


@query("l10_post_trade_check", with_("fid", """
SELECT date, CASE WHEN ok THEN 'verified' ELSE 'mismatch' END AS status FROM fid"""))
def _(s, d):
    return lg.post_trade_check(fidelity(s, d))


def receipts(s, d):
    return tb.trades(s, d).where("note = 'fumble' AND side = 'sell' AND symbol = 'AFRICA'").select(
        F.col("open_date").alias("signal_date"))


@query("l11_not_done", with_("sig_pos trades", """
SELECT DISTINCT date FROM sig_pos WHERE date NOT IN (
  SELECT open_date FROM trades WHERE note = 'fumble' AND side = 'sell' AND symbol = 'AFRICA')"""))
def _(s, d):
    return lg.not_done(signals(s, d), receipts(s, d)).select("date")


@query("l12_next_rebalance", with_("bars", """
SELECT d.date, (SELECT list(x ORDER BY x)[6] FROM (SELECT CAST(d.date + k AS DATE) AS x FROM range(0, 20) t(k)
   WHERE isodow(d.date + CAST(k AS INTEGER)) < 6)) AS next_rebalance FROM (SELECT DISTINCT date FROM bars) d""".replace(
    "d.date + k AS DATE", "d.date + CAST(k AS INTEGER) AS DATE")))
def _(s, d):
    return lg.next_rebalance(bars(s, d).select("date").distinct())


cte("sig_fwd", """
SELECT g.date, g.feature_date, g.asset, round(g.pred, 6) AS pred, g.position, g.reconstructed, ln(p.fwd / p.close) AS realized
FROM sig_pos g ASOF LEFT JOIN asof_n p ON p.asset = g.asset AND p.date <= g.feature_date""", "sig_pos", "asof_n")
cte("sig_rank", """
SELECT *, CASE position WHEN 'LONG' THEN realized WHEN 'SHORT' THEN -realized END AS sr,
  CASE WHEN realized IS NOT NULL THEN rank() OVER (PARTITION BY date, realized IS NULL ORDER BY pred)
    + (count(*) OVER (PARTITION BY date, realized IS NULL, pred) - 1) / 2.0::DOUBLE END AS rp,
  CASE WHEN realized IS NOT NULL THEN rank() OVER (PARTITION BY date, realized IS NULL ORDER BY realized)
    + (count(*) OVER (PARTITION BY date, realized IS NULL, realized) - 1) / 2.0::DOUBLE END AS rr FROM sig_fwd""", "sig_fwd")
cte("ic_tab", f"""
SELECT date, count(realized) AS n_pairs, count(CASE WHEN sr > 0 THEN 1 END) AS hits, count(sr) AS n_active,
  avg(sr) - 0.0006::DOUBLE AS paper_ret_net, count(CASE WHEN position <> 'FLAT' AND realized IS NULL THEN 1 END) = 0 AS complete,
  bool_or(reconstructed) AS reconstructed, round({CORR.format('rp', 'rr')}, 12) AS cs_ric,
  count(CASE WHEN sr > 0 THEN 1 END)::DOUBLE / nullif(count(sr), 0) AS hit_rate
FROM sig_rank GROUP BY 1 HAVING count(realized) >= 3""", "sig_rank")


def ic(s, d):
    return lg.ic_table(signals(s, d), bars(s, d), min_pairs=3)


@query("l13_ic_table", with_("ic_tab", f"""
SELECT date, n_pairs, hits, n_active, complete, reconstructed, {rnd('paper_ret_net cs_ric hit_rate')} FROM ic_tab"""))
def _(s, d):
    return rounded(ic(s, d), 8)


# ── realised profit ─────────────────────────────────────────────────────────
cte("closed", "SELECT * FROM trades WHERE profit IS NOT NULL AND close_date IS NOT NULL", "trades")
cte("daily_p", """
SELECT close_date AS date, symbol, sum(profit) AS profit FROM closed GROUP BY 1, 2
UNION ALL SELECT close_date, 'TOTAL', sum(profit) FROM closed GROUP BY 1""", "closed")
cte("pnl_ts", """
SELECT s.symbol, d.date, sum(coalesce(p.profit, 0)) OVER (PARTITION BY s.symbol ORDER BY d.date) AS cum
FROM (SELECT DISTINCT symbol FROM daily_p) s CROSS JOIN (
  SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily_p) d
LEFT JOIN daily_p p ON p.symbol = s.symbol AND p.date = d.date""", "daily_p")
cte("weekly", """
SELECT symbol, week_end, cum, cum - coalesce(lag(cum) OVER (PARTITION BY symbol ORDER BY week_end), 0) AS net FROM (
  SELECT symbol, CAST(date + ((12 - isodow(date)) % 7)::INTEGER AS DATE) AS week_end, max_by(cum, date) AS cum
  FROM pnl_ts GROUP BY 1, 2)""", "pnl_ts")


def pnl(s, d):
    return lg.pnl_timeseries(tb.trades(s, d)).persist()


@query("l14_pnl_timeseries", with_("pnl_ts", f"SELECT symbol, date, {rnd('cum', 2)} FROM pnl_ts"))
def _(s, d):
    return rounded(lg.pnl_timeseries(tb.trades(s, d)), 2)


@query("l15_weekly_pnl", with_("weekly", f"""
SELECT week_end, {rnd('cum net', 2)} FROM weekly WHERE symbol = 'TOTAL'"""))
def _(s, d):
    return rounded(lg.weekly_pnl(pnl(s, d).where("symbol = 'TOTAL'")), 2, "week_end", "cum", "net")


@query("l16_weekly_pair_pnl", with_("weekly", f"""
SELECT symbol, week_end, {rnd('net', 2)} FROM weekly WHERE symbol <> 'TOTAL'"""))
def _(s, d):
    return rounded(lg.weekly_pair_pnl(pnl(s, d)), 2, "symbol", "week_end", "net")


@query("l17_pair_pnl", with_("closed", f"SELECT symbol, {rnd('sum(profit) AS pnl', 2)} FROM closed GROUP BY 1"))
def _(s, d):
    return rounded(lg.pair_pnl(tb.trades(s, d)), 2)


@query("l18_pair_stats", with_("closed", f"""
SELECT symbol, {rnd('sum(profit) AS pnl', 2)}, count(*) AS n_trades, count(CASE WHEN profit > 0 THEN 1 END) AS n_wins
FROM closed GROUP BY 1"""))
def _(s, d):
    return rounded(lg.pair_stats(tb.trades(s, d)), 2)


@query("l19_current_positions", with_("sig_pos open_pos", f"""
SELECT g.asset AS symbol, CASE g.position WHEN 'LONG' THEN 'BUY' ELSE 'SELL' END AS side,
  round(round(g.pred, 6), 9) + 0.0 AS predicted_return, {rnd('o.price AS open_price|o.float_pnl AS floating_pnl', 9)}
FROM sig_pos g LEFT JOIN (SELECT * FROM open_pos QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position_id DESC) = 1) o
  ON o.symbol = g.asset
WHERE g.position <> 'FLAT' AND g.date = (SELECT max(date) FROM sig_pos)"""))
def _(s, d):
    return rounded(lg.current_positions(signals(s, d), tb.snapshots(s, d)), 9)


cte("acc", """
SELECT o_orderpriority AS account, 2000.0::DOUBLE AS start_balance,
  CASE WHEN o_orderpriority = '5-LOW' THEN min(CAST(o_orderdate AS DATE)) + 400 END AS active_from FROM orders GROUP BY 1
UNION ALL SELECT DISTINCT 'idle-' || o_orderstatus, 1970.37::DOUBLE, CAST(NULL AS DATE) FROM orders""")


@query("l20_account_stats", with_("acc trades", f"""
SELECT a.account, start_balance, {rnd('coalesce(sum(profit), 0) AS closed_pnl', 2)}, count(profit) AS n_trades,
  count(CASE WHEN t.account IS NOT NULL AND close_date IS NULL THEN 1 END) AS n_open
FROM acc a LEFT JOIN trades t ON t.account = a.account GROUP BY 1, 2"""))
def _(s, d):
    return rounded(lg.account_stats(tb.accounts(s, d), tb.trades(s, d)), 2, "account",
                   "start_balance", "closed_pnl", "n_trades", "n_open")


@query("l21_trade_stats", with_("closed", f"""
SELECT n_closed, n_winners, {rnd('win_rate avg_win avg_loss', 6)},
  round(win_rate * avg_win + (1 - win_rate) * avg_loss, 6) + 0.0 AS expectancy,
  b.s AS best_symbol, b.p AS best_profit, w.s AS worst_symbol, w.p AS worst_profit FROM (
  SELECT count(*) AS n_closed, count(CASE WHEN profit > 0 THEN 1 END) AS n_winners,
    count(CASE WHEN profit > 0 THEN 1 END)::DOUBLE / nullif(count(*), 0) AS win_rate,
    coalesce(avg(CASE WHEN profit > 0 THEN profit END), 0) AS avg_win,
    coalesce(avg(CASE WHEN profit <= 0 THEN profit END), 0) AS avg_loss,
    max(struct_pack(p := profit, s := symbol)) AS b, min(struct_pack(p := profit, s := symbol)) AS w FROM closed)"""))
def _(s, d):
    return rounded(lg.trade_stats(tb.trades(s, d)), 6)


@query("l22_noted_trades", with_("closed", f"""
SELECT count(*) AS n, {rnd('coalesce(sum(profit), 0) AS pnl', 2)} FROM closed WHERE contains(note, 'fumble')"""))
def _(s, d):
    return rounded(lg.noted(tb.trades(s, d), "fumble"), 2)


cte("ic_sum", """
SELECT count(*) AS n_weeks, min(date) AS window_from, max(date) AS window_to, avg(cs_ric) AS mean_ric,
  CASE WHEN count(*) > 1 THEN stddev_samp(cs_ric) / sqrt(count(*)) END AS se_ric,
  count(CASE WHEN cs_ric > 0 THEN 1 END) AS pos_weeks, coalesce(sum(paper_ret_net), 0) AS paper_total FROM ic_tab""", "ic_tab")


@query("l23_ic_summary", with_("ic_sum", f"""
SELECT n_weeks, window_from, window_to, pos_weeks, {rnd('mean_ric se_ric paper_total')} FROM ic_sum"""))
def _(s, d):
    return rounded(lg.ic_summary(ic(s, d)), 8)


@query("l24_unscored_signals", with_("sig_pos ic_tab bars", """
SELECT DISTINCT date, (SELECT max(date) FROM bars) AS prices_through FROM sig_pos WHERE date NOT IN (SELECT date FROM ic_tab)"""))
def _(s, d):
    p = bars(s, d)
    return lg.unscored(signals(s, d), ic(s, d)).withColumn(
        "prices_through", p.agg(F.max("date")).scalar())


@query("l25_wallet", with_("closed open_pos", f"""
SELECT {rnd('c AS closed_pnl|f AS floating_pnl|c + f AS total_pnl|2000 + c + f AS wallet_value', 2)}
FROM (SELECT coalesce(sum(profit), 0) AS c FROM closed), (SELECT coalesce(sum(float_pnl), 0) AS f FROM open_pos)"""))
def _(s, d):
    return rounded(lg.wallet(tb.trades(s, d), lg.floating_pnl(tb.snapshots(s, d)), 2000.0), 2)


DRAW = "CAST('0x' || substr(md5(path || ':' || week || ':7'), 1, 12) AS BIGINT)"
cte("fan", f"""
SELECT path, week, 2000 + sum(net) OVER (PARTITION BY path ORDER BY week) AS value
FROM (SELECT path, week, {DRAW} % (SELECT count(*) FROM weekly WHERE symbol = 'TOTAL') AS i
      FROM range(0, 4000) a(path), range(1, 13) b(week)) s
JOIN (SELECT row_number() OVER (ORDER BY week_end) - 1 AS i, net FROM weekly WHERE symbol = 'TOTAL') o ON o.i = s.i""", "weekly")


@query("l26_project_wallet", with_("fan", f"""
SELECT week, {', '.join(f'round(quantile_cont(value, 0.{q}), 4) + 0.0 AS p{q}' for q in (10, 50, 90))} FROM fan GROUP BY 1
UNION ALL SELECT 0, 2000.0, 2000.0, 2000.0"""))
def _(s, d):
    return rounded(lg.project_wallet(lg.weekly_pnl(pnl(s, d).where("symbol = 'TOTAL'")), 2000.0), 4)


@query("l27_skill_call", with_("ic_sum", """
SELECT n_weeks, CASE WHEN mean_ric - 2 * se_ric > 0 THEN 'above chance' WHEN mean_ric + 2 * se_ric < 0 THEN 'below chance'
  ELSE 'too early' END AS call FROM ic_sum"""))
def _(s, d):
    return lg.skill_call(lg.ic_summary(ic(s, d))).select("n_weeks", "call")


@query("l28_wallet_curve", with_("pnl_ts", f"""
SELECT date, {rnd('2000 + cum AS wallet', 2)} FROM pnl_ts WHERE symbol = 'TOTAL'"""))
def _(s, d):
    return rounded(lg.wallet_curve(pnl(s, d), 2000.0), 2)


@query("l29_active_trades", with_("acc trades", """
SELECT t.account, t.position_id, t.open_date FROM trades t LEFT JOIN acc a ON a.account = t.account
WHERE a.active_from IS NULL OR t.open_date >= a.active_from"""))
def _(s, d):
    return lg.active_trades(tb.trades(s, d), tb.accounts(s, d)).select("account", "position_id", "open_date")


@query("l29_reconstructed_weeks", with_("sig_pos", "SELECT DISTINCT date FROM sig_pos WHERE reconstructed"))
def _(s, d):
    return lg.reconstructed_weeks(signals(s, d))


@query("l30_recent_weeks", with_("weekly", f"""
SELECT week_end, CAST(row_number() OVER (ORDER BY week_end DESC) AS INTEGER) AS ago, {rnd('net', 2)} FROM weekly
WHERE symbol = 'TOTAL' QUALIFY row_number() OVER (ORDER BY week_end DESC) <= 16"""))
def _(s, d):
    return rounded(lg.recent_weeks(pnl(s, d)), 2)


@query("l30_last_week_movers", with_("weekly", f"""
SELECT symbol, {rnd('net', 2)} FROM weekly WHERE symbol <> 'TOTAL' AND week_end = (SELECT max(week_end) FROM weekly)"""))
def _(s, d):
    return rounded(lg.last_week_movers(pnl(s, d)), 2)


@query("l31_fidelity_summary", with_("fid", """
SELECT count(CASE WHEN ok THEN 1 END) AS n_clean, count(*) AS n_all FROM fid"""))
def _(s, d):
    return lg.fidelity_summary(fidelity(s, d))


# ── universes ───────────────────────────────────────────────────────────────
cte("uni", """
SELECT r_name AS universe, CASE WHEN coalesce(n_sup, 0) >= 4 THEN 'ranked' ELSE 'context' END AS role, n_name AS asset,
  n_nationkey AS pos, coalesce(n_sup, 0) >= 6 AS late_close,
  CASE WHEN r_regionkey < 3 THEN (r_regionkey + 3)::DOUBLE END AS cost_bps
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_sup FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
uni = tb.universe_rows


@query("u01_flatten_groups", """
SELECT r_name AS grp, n_name AS asset, r_regionkey AS grp_pos,
  CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(s, d):
    n, r = tb.table(s, d, "nation"), tb.table(s, d, "region")
    groups = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(
        F.col("r_name").alias("grp"), F.col("r_regionkey").alias("grp_pos")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))),
                    lambda x: x["n_name"]).alias("members"))
    return un.flatten_groups(groups)


@query("u02_ordered_union", """
SELECT asset, CAST(row_number() OVER (ORDER BY list_no, pos, asset) AS INTEGER) AS pos FROM (
  SELECT asset, list_no, pos FROM (
    SELECT n_name AS asset, 1 AS list_no, n_nationkey AS pos FROM nation JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT r_name, 2, r_regionkey FROM region UNION ALL SELECT n_name, 3, n_nationkey FROM nation)
  QUALIFY row_number() OVER (PARTITION BY asset ORDER BY list_no, pos) = 1)""")
def _(s, d):
    n, r, sup = (tb.table(s, d, t) for t in ("nation", "region", "supplier"))
    one = n.join(sup, n.n_nationkey == sup.s_nationkey)
    lists = one.select(F.lit(1).alias("list_no"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("asset")) \
        .unionByName(r.select(F.lit(2).alias("list_no"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("asset"))) \
        .unionByName(n.select(F.lit(3).alias("list_no"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("asset")))
    return un.ordered_union(lists)


@query("u03_role_list", with_("uni", "SELECT universe, asset, pos FROM uni WHERE role = 'ranked'"))
def _(s, d):
    return un.with_role(uni(s, d), "ranked")


@query("u04_price_list", with_("uni", """
SELECT asset, CAST(row_number() OVER (ORDER BY role DESC, pos, asset) AS INTEGER) AS pos FROM uni WHERE universe = 'ASIA'"""))
def _(s, d):
    return un.price_list(uni(s, d), "ASIA")


@query("u05_cost_bps", with_("uni", """
SELECT universe, coalesce(max(cost_bps), 5.0) AS cost_bps FROM uni GROUP BY 1"""))
def _(s, d):
    u = uni(s, d)
    known = u.where("cost_bps IS NOT NULL").select("universe", "cost_bps").distinct()
    return un.cost_bps(u.select("universe").distinct(), known, 5.0)


@query("u06_late_close_assets", with_("uni", "SELECT DISTINCT asset FROM uni WHERE late_close"))
def _(s, d):
    return un.late_close_assets(uni(s, d))


@query("u07_legs_per_side", with_("uni", """
SELECT universe, count(*) AS n_assets, CASE WHEN count(*) >= 9 THEN 3 WHEN count(*) >= 6 THEN 2 ELSE 1 END AS n_legs
FROM uni WHERE role = 'ranked' GROUP BY 1"""))
def _(s, d):
    return un.legs_per_side(uni(s, d))


@query("u08_column_labels", """
SELECT DISTINCT '^' || p_brand || '=' || p_type AS asset,
  lower(replace(replace(replace('^' || p_brand || '=' || p_type, '=', ''), '^', ''), '-', '')) AS label FROM part""")
def _(s, d):
    from tidemark.operators.panel import column_label
    df = tb.table(s, d, "part").select(F.concat(F.lit("^"), "p_brand", F.lit("="), "p_type").alias("asset"))
    return column_label(df.distinct())


@query("u09_display_names", with_("uni", """
SELECT universe, asset, CASE WHEN role = 'ranked' THEN universe || ' ' || asset ELSE asset END AS name FROM uni"""))
def _(s, d):
    u = uni(s, d)
    names = u.where("role = 'ranked'").select("asset", F.concat_ws(" ", "universe", "asset").alias("name"))
    return un.display_names(u.select("universe", "asset"), names)


@query("u10_fingerprint", with_("uni", """
SELECT universe, substring(md5(to_json(struct_pack(assets := list(asset ORDER BY asset), horizon := 5, seed := 42))), 1, 8)
  AS run_tag FROM uni GROUP BY 1"""))
def _(s, d):
    u = uni(s, d).groupBy("universe").agg(F.sort_array(F.collect_list("asset")).alias("assets"))
    return u.select("universe", un.fingerprint(F.col("assets"), F.lit(5).alias("horizon"),
                                               F.lit(42).alias("seed")).alias("run_tag"))
