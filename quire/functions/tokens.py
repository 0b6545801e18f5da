"""Token counts by a real tokeniser, in place of the stand-in of four characters a token."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf


def counter(load: Callable[[], Callable[[str], Sequence]]) -> Callable[[Column | str], Column]:
    """load gives an encoder; each Python worker calls it once. Texts are counted by Arrow batches; null has no tokens."""
    held: list[Callable[[str], Sequence]] = []

    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return texts.map(lambda t: len(held[0](t)) if t else 0)

    return lambda c: count(F.col(c) if isinstance(c, str) else c)


def from_file(path: str) -> Callable[[Column | str], Column]:
    """A counter by a tokenizers file."""

    def load():
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        return lambda text: encoder.encode(text, add_special_tokens=False).ids

    return counter(load)
