"""Path keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed Unicode; Spark has no normaliser. Null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def path_key(path: Column) -> Column:
    """One spelling of a path: composed, forward slashes, lower case."""
    return F.lower(F.translate(nfc(path), "\\", "/"))


def hash_set(hashes: Column) -> Column:
    """A set of hashes in one spelling: lower case, distinct, sorted; null is the empty set."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: h.isNotNull()), lambda h: F.lower(h))))
