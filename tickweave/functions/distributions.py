"""Tail probabilities for small result tables (one row per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by quadrature of the density in the angle θ = atan(t/√df)."""
    if any(v is None or math.isnan(v) for v in (t, df)):
        return math.nan
    theta = math.atan(abs(t) / math.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(200)
    half = (math.pi / 2 - theta) / 2
    angles = theta + half * (nodes + 1)
    log_scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    values = np.exp(log_scale + (df - 1) * np.log(np.maximum(np.cos(angles), 1e-300)))
    return min(1.0, float(2 * half * np.dot(weights, values)))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_student_tail(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(v / math.sqrt(2))) if v is not None and not math.isnan(v) else math.nan for v in z], dtype="float64")
