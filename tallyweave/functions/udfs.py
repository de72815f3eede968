"""The functions that Spark has no name for: NFKC, in the JVM, and similarity, as a vectorised UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nfkc(text: Column) -> Column:
    """Compatibility forms replaced and letters composed, by the ICU library that Spark itself uses for
    collations; null stays null."""
    return F.when(text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one row of the table at a time in the bits of a number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the share of both texts' characters that a longest common subsequence holds."""
    return pd.Series([200.0 * common_length(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""))])


def may_reach(a: Column, b: Column, threshold: int) -> Column:
    """Cheap test inside the JVM that no pair with indel_ratio >= threshold fails: the edit distance is at most the
    number of characters outside a common subsequence."""
    most = F.floor((100 - threshold) * (F.length(a) + F.length(b)) / 100).cast("int")
    return F.levenshtein(a, b) <= most
