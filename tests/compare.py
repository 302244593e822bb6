"""Rows of Spark and DuckDB frames in a form that compares."""

import pandas as pd


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        v = int(v)
    return repr(v)


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def same(spark_frame, other) -> None:
    a, b = spark_frame.toPandas(), other
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert ra == rb, (sorted(set(ra) - set(rb))[:3], sorted(set(rb) - set(ra))[:3])
