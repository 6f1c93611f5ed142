"""Random identifiers."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _new(rows: pd.Series) -> pd.Series:
    def one() -> str:
        n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
        return "".join(ALPHABET[n >> 5 * k & 31] for k in range(25, -1, -1))

    return pd.Series([one() for _ in rows], dtype="object")


def ulid(anchor: Column) -> Column:
    """A new ULID for each row (48 bits of time, 80 random bits); ``anchor`` is any column. Write it once: it differs each time."""
    return F.pandas_udf(_new, StringType()).asNondeterministic()(anchor)
