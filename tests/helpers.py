"""Dates shared by the tests."""
import datetime as dt

DAY0 = dt.date(2020, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)
