"""Unicode normal forms: the one text function that Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, batch by batch; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")
