import pytest
from tests.helpers import day

from tidemark.operators import audit
from tidemark.operators import walkforward as wf


def table(spark, n, sp):
    return [tuple(r) for r in wf.folds(spark.createDataFrame([(n,)], "n bigint"), sp)
            .orderBy("fold_id").collect()]


def test_exactly_one_fold_when_n_just_fits(spark):
    sp = wf.Splitter(100, 50, 5)
    assert table(spark, 155, sp) == [(0, 0, 100, 105, 155)]
    assert table(spark, 154, sp) == []


def test_expanding_rolling_and_last_splits(spark):
    assert table(spark, 300, wf.Splitter(100, 50, 5)) == [
        (0, 0, 100, 105, 155), (1, 0, 150, 155, 205), (2, 0, 200, 205, 255)]
    assert [r[1] for r in table(spark, 300, wf.Splitter(100, 50, 5, train_window=80))] == [20, 70, 120]
    assert [r[0] for r in table(spark, 300, wf.Splitter(100, 50, 5, n_splits=2))] == [1, 2]


def test_bad_sizes_are_refused():
    for bad in ((0, 5, 1), (5, 0, 1), (5, 5, -1)):
        with pytest.raises(ValueError):
            wf.Splitter(*bad)


def test_assignment_gap_and_integrity(spark):
    p = spark.createDataFrame([(day(i), a) for i in range(120) for a in "XY"], "date date, asset string")
    ax = wf.date_axis(p)
    dates = wf.date_folds(ax, wf.folds(wf.axis_counts(ax), wf.Splitter(40, 20, 5)))
    for r in wf.audit_folds(dates, 5).collect():
        assert r.gap == 5 and r.clean
    assert not wf.audit_folds(dates, 6).first().clean
    ok = audit.fold_integrity(wf.assign(p, dates), 2)
    assert ok.where("n_mixed > 0 or n_short > 0").count() == 0
    assert audit.label_overlap(dates, 5).where("n_overlap > 0").count() == 0
    assert audit.label_overlap(dates, 9).where("n_overlap > 0").count() > 0


def test_time_tail(spark):
    ax = spark.range(200).selectExpr("cast(id as int) as idx")
    n = {r.part: r["count"] for r in wf.time_tail(ax).groupBy("part").count().collect()}
    assert n == {"fit": 165, "gap": 5, "val": 30}
    short = wf.time_tail(spark.range(44).selectExpr("cast(id as int) as idx"))
    assert {r.part for r in short.collect()} == {"fit"}
