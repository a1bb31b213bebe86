"""Tests as columns: Arrow-batched functions over counts and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pedlake.functions import special

_C = str | Column


def _by_distinct(f, *cols: pd.Series) -> pd.Series:
    """f over the distinct rows of a batch: counts repeat a lot."""
    frame = pd.concat([c.reset_index(drop=True) for c in cols], axis=1, keys=range(len(cols)))
    seen: dict[tuple, float] = {}
    out = []
    for row in frame.itertuples(index=False, name=None):
        if row not in seen:
            seen[row] = float("nan") if any(pd.isna(x) for x in row) else f(*map(int, row))
        out.append(seen[row])
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def _hwe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return _by_distinct(special.hwe_exact_p, a, b, c)


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _by_distinct(special.fisher_exact_p, a, b, c, d)


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _t2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.t_sf2(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _norm2(z: pd.Series) -> pd.Series:
    return pd.Series(2 * special.norm_sf(np.abs(z.to_numpy(float))))


@F.pandas_udf(DoubleType())
def _quantile(p: pd.Series) -> pd.Series:
    return pd.Series(special.norm_quantile(p.to_numpy(float)))


def _null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def hwe_exact(n0: _C, n1: _C, n2: _C) -> Column:
    return _null(_hwe(n0, n1, n2))


def fisher_exact(a: _C, b: _C, c: _C, d: _C) -> Column:
    return _null(_fisher(a, b, c, d))


def chi2_p(x: _C, df: int | Column) -> Column:
    """Upper tail of chi-square; null stays null."""
    return _null(_chi2(x, F.lit(float(df)) if isinstance(df, int) else df))


def t_p(t: _C, df: _C) -> Column:
    """Two-sided p-value of a t statistic."""
    return _null(_t2(t, df))


def z_p(z: _C) -> Column:
    """Two-sided p-value of a normal statistic."""
    return _null(_norm2(z))


def norm_quantile(p: _C) -> Column:
    return _quantile(p)
