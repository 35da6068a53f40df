"""The three scalars Spark has no built-in for, as Arrow-batched functions.

Callers pass null for every row that a built-in test has already decided, so Python only does
real work on the few rows left.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers need not have the package installed: these functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.DoubleType())
def zlib_ratio(text: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        raw = s.encode("utf-8")
        return len(zlib.compress(raw, 6)) / len(raw) if raw else 1.0

    return text.map(one, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    out = [
        None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
        for a, b in zip(left, right)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text):
    """Unicode compatibility form; ASCII rows never reach Python's normaliser."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))
