"""Rows of a Spark result and of an oracle, made comparable."""

import decimal
import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(relation):
    names = sorted(relation.columns)
    order = [relation.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)
