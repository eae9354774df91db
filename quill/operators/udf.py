"""The one Python hook: a batched map over Arrow record batches.

Everything else in the library is built-in expressions; this exists for
user functions that have no Spark equivalent (the reference's batched
``map`` with a user function and extra keyword arguments).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, **kwargs) -> DataFrame:
    """Apply ``fn(batch, **kwargs) -> DataFrame`` to every Arrow batch of every
    partition (``mapInPandas``); the output must match ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b, **kwargs)

    return df.mapInPandas(run, schema)


def word_count(batch: pd.DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 1) -> pd.DataFrame:
    """Number of whitespace-separated words of at least ``min_chars`` characters (0 for a null text).

    One text's words are listed at a time; with ``str.count`` the heap of a worker grew with the texts it had seen."""
    words = re.compile(rf"\S{{{int(min_chars)},}}")
    found = batch[text].map(lambda t: len(words.findall(t)), na_action="ignore")
    return pd.DataFrame({id_col: batch[id_col], "n_words": pd.to_numeric(found).fillna(0).astype("int64")})
