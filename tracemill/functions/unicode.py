"""Unicode normal forms, which no built-in expression has."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folded(v):
    if isinstance(v, str):
        return unicodedata.normalize("NFKC", v)
    if isinstance(v, dict):
        return {k: _folded(x) for k, x in v.items()}
    if isinstance(v, tuple):  # entries of a map
        return (v[0], _folded(v[1]))
    return v if v is None or isinstance(v, float) else [_folded(x) for x in v]


def _text(c: str, kind: str) -> Column:
    """Everything in a column that may hold characters outside ASCII, as one text."""
    col = F.col(f"`{c}`")
    if kind == "string":
        return F.coalesce(col, F.lit(""))
    values = F.map_values(col) if kind.startswith("map") else col
    return F.coalesce(F.array_join(values, ""), F.lit(""))


def with_nfkc(df: DataFrame, *columns: str) -> DataFrame:
    """df with its string, array<string> and map<string,string> columns in NFKC (of a map its values). Nulls stay.

    ASCII text is in normal form already, so only rows with other characters go through Python, as Arrow batches.
    """
    kinds = dict(df.dtypes)
    other = reduce(lambda a, b: a | b, (_text(c, kinds[c]).rlike("[^\\x00-\\x7F]") for c in columns))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{c: pdf[c].map(_folded) for c in columns})

    return df.where(~other).unionByName(df.where(other).mapInPandas(run, df.schema))
