"""Column-name clean-up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.numbers import quoted

UNNAMED = re.compile(r"Unnamed: \d+")


def clean_names(df: DataFrame) -> DataFrame:
    """Strip names and leave out index columns that were saved without a name."""
    kept = [(c, c.strip()) for c in df.columns if not UNNAMED.fullmatch(c.strip())]
    return df.select(*[quoted(c).alias(name) for c, name in kept])
