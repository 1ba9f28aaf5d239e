"""What a text costs in the caller's units, for the operators that weigh texts.

A counter is a function from a column of texts to a column of whole numbers. The
operators call it beside their other expressions, so a built-in one stays within
generated code and a pandas UDF runs in Arrow batches. A null text costs null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, runs of digits, and every other character that is neither a blank nor a control character.
PIECE = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]"


def pieces(text: Column) -> Column:
    """The number of pieces of a text, built-in: near to what a subword vocabulary would count."""
    return F.regexp_count(text, F.lit(PIECE))


def counted(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A Python counter of one text as a pandas UDF. It has to give the same number for the same text."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return F.pandas_udf(batch, "bigint")


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokens(path: str) -> Callable[[Column], Column]:
    """Token counts by a vocabulary file of ``tokenizers`` that every worker can read; each reads it once."""

    def batch(texts: pd.Series) -> pd.Series:
        found = _vocabulary(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([None if t is None else len(f.ids) for t, f in zip(texts, found)], dtype="Int64")

    return F.pandas_udf(batch, "bigint")
