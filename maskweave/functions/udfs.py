"""Vectorized per-value helpers (Arrow batches); kept tiny and off the hot path."""

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from maskweave.functions.patterns import PatternError, rule_regex


def _valid(p):
    if p is None:
        return True
    try:
        rule_regex(p)
        return True
    except (PatternError, ValueError):
        return False


@pandas_udf(BooleanType())
def pattern_is_valid(patterns: pd.Series) -> pd.Series:
    """JavaScript-syntax check of rule patterns (the translator's own checks)."""
    return patterns.map(_valid)
