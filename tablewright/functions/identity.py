"""When are two renderings the same value?"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = re.compile(r"\s+")

_IDENTITY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("is_clean", T.BooleanType()),
        T.StructField("is_title", T.BooleanType()),
    ]
)


@F.pandas_udf(_IDENTITY)
def identity(values: pd.Series) -> pd.DataFrame:
    """Identity key and tidiness of each value.

    Spark has no Unicode case folding (``Straße`` = ``STRASSE``) and its
    ``initcap`` splits on blanks only, so this one step runs in Python.  It only
    ever sees distinct values of columns with a small vocabulary.
    """
    tidy = values.map(lambda v: _BLANKS.sub(" ", v.strip()))
    return pd.DataFrame(
        {
            "key": tidy.map(str.casefold),
            "is_clean": tidy == values,
            "is_title": values.map(str.title) == values,
        }
    )


@F.pandas_udf(T.StringType())
def compact_number(values: pd.Series) -> pd.Series:
    """Histogram edge label: two decimals, whole numbers bare, six digits."""

    def label(v: float) -> str:
        short = round(v, 2)
        return str(int(short)) if short == int(short) else f"{short:g}"

    return values.map(label)
