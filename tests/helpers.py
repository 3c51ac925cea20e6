"""Small panels for the tests."""

import datetime as dt

from shelfpace.sources.schemas import PANEL

START = dt.date(2021, 2, 1)  # a Monday


def day(n):
    return START + dt.timedelta(days=n)


def row(sku, n, sold=1.0, minutes=1440.0, price=10.0, currency="X", listing="A", payment="F", logistic="long"):
    return (sku, None if n is None else day(n), sold, minutes, price, currency, listing, payment, logistic)


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def by(df, *keys):
    """Rows as dicts, keyed by one or more columns."""
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        out[k[0] if len(k) == 1 else k] = r.asDict()
    return out
