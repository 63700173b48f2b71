"""Tails of distributions as columns, for figures that are merged already: a row for each source, group or pair.

Spark has no such functions. The module travels to the tasks with its functions, so executors need not have it.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import distributions

# Return types below are types, not texts, which would need a session at import.
for _module in (distributions, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def _by_row(f, *columns: pd.Series) -> pd.Series:
    """f of each row; null where a value is null or the degrees of freedom, which come last, are not positive."""
    rows = zip(*columns)
    return pd.Series([None if any(pd.isna(v) for v in row) or row[-1] <= 0 else f(*map(float, row)) for row in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_row(distributions.t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_row(distributions.t_quantile, p, dof)


@F.pandas_udf(T.DoubleType())
def _chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _by_row(distributions.chi_square_tail, x, dof)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|); null without degrees of freedom."""
    return _t_two_sided(t.cast("double"), dof.cast("double"))


def t_quantile(p: float, dof: Column) -> Column:
    """The t with P(T <= t) = p; null without degrees of freedom."""
    return _t_quantile(F.lit(float(p)), dof.cast("double"))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X >= x); null without degrees of freedom."""
    return _chi_square_tail(x.cast("double"), dof.cast("double"))


def with_interval(summary: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds low and high, the confidence interval of a mean by Student's t, to rows with n, mean and sd."""
    half = t_quantile((1 + level) / 2, F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return summary.withColumn("_half", half).withColumns({"low": F.col("mean") - F.col("_half"), "high": F.col("mean") + F.col("_half")}).drop("_half")
