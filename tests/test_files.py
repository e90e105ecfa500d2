import datetime as dt
import json

import pytest
from tests.helpers import day
from tests.test_ledger import signal

from tidemark.operators import panel
from tidemark.sources import files as fs
from tidemark.sources.files import SIGNAL_SCHEMA


def test_one_missing_series_fails_the_load(spark, walk):
    assert fs.load_all(spark, ["A", "B"], walk, "asset").select("asset").distinct().count() == 2
    with pytest.raises(ValueError, match="NOPE"):
        fs.load_all(spark, ["A", "NOPE"], walk, "asset")


def test_first_signal_of_a_date_stays(spark, tmp_path):
    path = str(tmp_path / "signals")
    fs.write_signals(signal(spark, (day(0), [("A", "LONG")])), path)
    fs.write_signals(signal(spark, (day(0), [("B", "LONG")]), (day(7), [("C", "LONG")])), path)
    got = {r.date: r.rankings[0].ticker for r in fs.read_signals(spark, path).collect()}
    assert got == {day(0): "A", day(7): "C"}


def test_pretty_documents(spark, tmp_path):
    doc = {"date": "2026-11-13", "feature_date": "2026-11-12", "horizon": 5,
           "rankings": [{"ticker": "EURUSD=X", "mt5": "EURUSD", "position": "LONG",
                         "predicted_return": 0.01, "rank": 1}]}
    (tmp_path / "signal_a.json").write_text(json.dumps(doc, indent=2))
    r = fs.read_documents(spark, str(tmp_path), SIGNAL_SCHEMA, pretty=True).first()
    assert r.date == dt.date(2026, 11, 13) and r.rankings[0].mt5 == "EURUSD"


def test_trade_files_bind_by_header(spark, tmp_path):
    (tmp_path / "history_77.csv").write_text(
        "# a remark\n# another\nopen_time,symbol,side,volume,open_price,close_time,close_price,profit,note\n"
        "2026-09-11 15:38:29,audjpy,buy,0.01,110.22,2026-10-02 17:13:25,109.675,-3.45,x\n"
        "2026-10-05 09:00:01,eurusd,sell,0.01,1.1,,,,\n")
    acc = spark.createDataFrame([("77", dt.date(2026, 10, 1))], "account string, active_from date")
    got = fs.read_trades(spark, str(tmp_path), acc, r"history_(\w+)\.csv").collect()
    assert [(r.account, r.symbol, r.open_time, r.open_price, r.close_time, r.profit, r.note) for r in got] == [
        ("77", "EURUSD", dt.datetime(2026, 10, 5, 9, 0, 1), 1.1, None, None, "")]
    r = fs.read_trades(spark, str(tmp_path), None, r"history_(\w+)\.csv").where("side = 'buy'").first()
    assert (r.close_time, r.close_price, r.profit, r.note) == (dt.datetime(2026, 10, 2, 17, 13, 25), 109.675, -3.45, "x")


def test_trade_files_of_days_and_of_unknown_columns(spark, tmp_path):
    old, bad = tmp_path / "old", tmp_path / "bad"
    old.mkdir(), bad.mkdir()
    (old / "h_1.csv").write_text("open_date,symbol,side,volume,close_date,profit,note\n2026-09-11,a,buy,0.01,2026-10-02,-3.45,x\n")
    r = fs.read_trades(spark, str(old), None, r"h_(\w+)\.csv").first()
    assert (r.open_date, r.close_date, r.profit, r.open_price) == (dt.date(2026, 9, 11), dt.date(2026, 10, 2), -3.45, None)
    (bad / "h_1.csv").write_text("open_time,symbol,side,weight\n2026-09-11,a,buy,1\n")
    with pytest.raises(ValueError, match="weight"):
        fs.read_trades(spark, str(bad), None, r"h_(\w+)\.csv")


def test_each_trade_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "h_1.csv").write_text("# x\nopen_time,symbol,side,volume,profit\n2026-09-11,a,buy,0.01,-3.45\n")
    (tmp_path / "h_2.csv").write_text("side,note,symbol,open_date\nsell,\"n, with comma\",b,2026-09-12\n\nbuy,,c,2026-09-13\n")
    got = sorted((r.account, r.symbol, r.side, r.profit, r.note) for r in fs.read_trades(spark, str(tmp_path), None, r"h_(\w+)\.csv").collect())
    assert got == [("1", "A", "buy", -3.45, ""), ("2", "B", "sell", None, "n, with comma"), ("2", "C", "buy", None, "")]


def test_a_broken_write_is_never_read(spark, tmp_path):
    root, day_a, day_b = str(tmp_path), day(0), day(9)

    def table(v):
        return lambda: spark.createDataFrame([(v,)], "v long")

    def broken():
        spark.createDataFrame([(0,)], "v long").write.parquet(f"{root}/data/half")
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        fs.keyed_matrix(spark, root, broken, "T", day_a, day_b)
    assert fs.keyed_matrix(spark, root, table(1), "T", day_a, day_b).first().v == 1
    assert fs.keyed_matrix(spark, root, table(2), "T", day_a, day_b).first().v == 1        # stored
    assert fs.keyed_matrix(spark, root, table(3), "T", day_a, day(10)).first().v == 3      # another key
    assert fs.keyed_matrix(spark, root, table(4), "T", day_a, day_b, force=True).first().v == 4
    half = tmp_path / "matrix"
    table(7)().write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert fs.cached(spark, str(half), table(8)).first().v == 8


def test_newest_snapshot_reads_one_folder(spark, tmp_path):
    for k, d in enumerate(("2020-01-31", "2020-02-29")):
        spark.createDataFrame([("A", float(k))], "asset string, close double").write.parquet(f"{tmp_path}/snapshot_date={d}")
    df = fs.latest_snapshot(spark, str(tmp_path))
    assert [r.close for r in df.collect()] == [1.0] and len(df.inputFiles()) == 1 or all("02-29" in f for f in df.inputFiles())
    assert df.first().snapshot_date == dt.date(2020, 2, 29)


def test_later_trade_of_a_day_wins(spark):
    from tidemark.operators import ledger as lg
    rows = [("9", "S", "buy", day(0), dt.datetime.combine(day(0), dt.time(9)), None),
            ("10", "S", "sell", day(0), dt.datetime.combine(day(0), dt.time(10)), None)]
    t = spark.createDataFrame(rows, "position_id string, symbol string, side string, open_date date, "
                                    "open_time timestamp_ntz, close_date date")
    assert lg.book_at(t, spark.createDataFrame([(day(1),)], "date date")).first().side == "sell"


def test_date_column_fallbacks(spark):
    assert "Report_Date" in str(fs.report_date(["x", fs.DATE_OLD]))
    assert "my_date" in str(fs.report_date(["As_of_Date", "YYMMDD_date", "my_date"]))
    with pytest.raises(ValueError):
        fs.report_date(["x"])


def test_complete_case_and_one_hot(spark, walk):
    spec = panel.PanelSpec(ranked=("A", "B", "C"), context=("D",), late=("D",), horizon=5)
    p = panel.pooled_panel(walk, None, spec)
    assert panel.uneven_dates(p, 3).count() == 0 and p.count() > 0
    assert p.dropna().count() == p.count()
    hot = {tuple(r) for r in p.select("asset", "is_a", "is_b").distinct().collect()}
    assert hot == {("A", 1.0, 0.0), ("B", 0.0, 1.0), ("C", 0.0, 0.0)}
    assert "target" not in panel.feature_columns(p)


def test_a_missing_row_drops_its_date_for_all(spark, walk):
    spec = panel.PanelSpec(ranked=("A", "B"), horizon=1)
    gone = walk.where(f"not (asset = 'B' and date = '{day(300)}')")
    dates = {r.date for r in panel.pooled_panel(gone, None, spec).select("date").distinct().collect()}
    assert day(300) not in dates and day(299) in dates and day(301) in dates


def test_trade_lines_are_not_shuffled_by_file_or_account(spark, tmp_path):
    (tmp_path / "account=a").mkdir()
    (tmp_path / "account=a" / "t.csv").write_text("open_time,symbol,side\n2020-01-01,X,buy\n")
    accounts = spark.createDataFrame([("a", None)], "account string, active_from date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = fs.read_trades(spark, str(tmp_path), accounts)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and got.count() == 1
