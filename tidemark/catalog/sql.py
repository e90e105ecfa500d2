"""Composable DuckDB text: named common table expressions and their order."""

from __future__ import annotations

import re

CTE: dict[str, tuple[tuple[str, ...], str]] = {}
#: Expressions that are used several times each, one on top of the other.
STORED: set[str] = set()


def cte(name: str, body: str, *needs: str, stored: bool = False) -> None:
    CTE[name] = (needs, body.strip())
    if stored:
        STORED.add(name)


def _order(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    for dep in CTE[name][0]:
        _order(dep, seen)
    seen.append(name)


def over_other(source: str, other: str, suffix: str, *targets: str) -> None:
    """Repeat what ``targets`` need from ``source`` on, reading ``other`` instead; the
    copies carry the suffix."""
    names: list[str] = []
    for t in targets:
        _order(t, names)
    new = {source: other}
    for n in names:
        if any(d in new for d in CTE[n][0]):
            new[n] = n + suffix
    swap = re.compile(r"\b(" + "|".join(map(re.escape, new)) + r")\b")
    for n in list(new)[1:]:
        needs, body = CTE[n]
        cte(new[n], swap.sub(lambda m: new[m[1]], body), *[new.get(d, d) for d in needs], stored=n in STORED)


def with_(needs: str, body: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` every named expression (and what it needs), then ``body``."""
    names: list[str] = []
    for n in needs.split():
        _order(n, names)
    parts = [f"{n} AS {'MATERIALIZED ' if n in STORED else ''}(\n{CTE[n][1]}\n)" for n in names]
    if extra:
        parts.append(extra.strip())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()


def rnd(cols: str, digits: int = 8) -> str:
    """``round`` list: each item is ``name`` or ``expr AS name`` (split by |)."""
    out = []
    for item in cols.split("|") if "|" in cols or " AS " in cols else cols.split():
        item = item.strip()
        expr, _, name = item.rpartition(" AS ")
        if not expr:
            expr, name = item, item
        out.append(f"round({expr}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


def sig(col: str, name: str) -> str:
    """Ten significant digits."""
    return f"CAST(printf('%.9e', {col}) AS DOUBLE) AS {name}"


# ── base panels ──────────────────────────────────────────────────────────────
def _bars(asset: str, date: str, joins: str = "") -> str:
    return f"""
SELECT {asset} AS asset, {date} AS date,
       min(struct_pack(a := l_orderkey * 8 + l_linenumber, b := l_extendedprice / l_quantity)).b AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close,
       sum(l_quantity) AS volume
FROM lineitem {joins} GROUP BY 1, 2"""


_SUP = """JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey"""
cte("bars", _bars("r_name", "CAST(l_shipdate AS DATE)", _SUP))
cte("flag_bars", _bars("l_returnflag || l_linestatus",
                       "CAST(date_trunc('week', l_shipdate) AS DATE)"))
cte("supplier_bars", _bars("'S' || CAST(l_suppkey AS VARCHAR)",
                           "CAST(date_trunc('week', l_shipdate) AS DATE)"))
cte("hourly_bars", """
SELECT event_type AS asset, date_trunc('hour', ts) AS date, 
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS close
FROM events GROUP BY 1, 2""")
cte("macro", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
       CASE WHEN count(*) >= 2 THEN
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) END AS value
FROM orders GROUP BY 1, 2""")
cte("cot", f"""
SELECT r_name AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS report_date,
       coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0.0) AS mm_long,
       coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0.0) AS mm_short,
       coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0.0) AS prod_long,
       coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0.0) AS prod_short,
       sum(l_quantity) AS oi,
       CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS release_date
FROM lineitem {_SUP} GROUP BY 1, 2, 8""")
cte("trades", f"""
SELECT o_orderpriority AS account, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS position_id, r_name AS symbol,
       CASE WHEN l_returnflag = 'A' THEN 'sell' ELSE 'buy' END AS side,
       round(l_quantity / 100, 2) AS volume,
       least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS open_date,
       CASE WHEN NOT (l_linestatus = 'O' AND greatest(o_orderdate, l_shipdate) >= DATE '1998-06-01')
            THEN greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS close_date,
       CASE WHEN NOT (l_linestatus = 'O' AND greatest(o_orderdate, l_shipdate) >= DATE '1998-06-01')
            THEN floor(CAST(round(l_extendedprice * 100) AS BIGINT)
                * (5 - CAST(round(l_discount * 100) AS BIGINT)) / 10000.0::DOUBLE) / 100 END AS profit,
       CAST(least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS TIMESTAMP)
         + to_seconds((l_orderkey * 8 + l_linenumber) % 86340) AS open_time,
       CASE WHEN close_date IS NOT NULL THEN CAST(close_date AS TIMESTAMP)
         + to_seconds((l_orderkey * 8 + l_linenumber) % 86340) END AS close_time,
       CASE WHEN l_discount >= 0.1::DOUBLE THEN 'fumble' ELSE 'swap=0.00' END AS note,
       l_extendedprice / l_quantity AS price, 0.0 - l_discount AS swap, 0.0 - l_quantity / 100 AS commission, l_orderkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey {_SUP}""")
cte("cal", """
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT date FROM bars WHERE asset = 'AFRICA')""", "bars")
