"""Token length by a caller's tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_length(text: Column, factory: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Tokens per text. ``factory`` runs once per task and returns a function from
    a list of texts to their token counts; a null text has none."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = factory()
        for texts in batches:
            yield pd.Series(count(texts.fillna("").tolist()), dtype="int32")

    return run(text)
