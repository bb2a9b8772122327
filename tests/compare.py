"""Rows of Spark and DuckDB in one form, in any order."""

import math

import pandas as pd


def _one(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(df):
    return sorted(tuple(x[:-2] if x.endswith(".0") else x for x in map(_one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
