"""An embedding that needs no model: words hashed into a vector. A stand-in of our own where none is given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 256
_WORD = re.compile(r"\w+")


def vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Unit vector of the words' counts (square roots) at hashed places, with hashed signs; zeros without words."""
    out = np.zeros(dims, np.float32)
    count: dict[str, int] = {}
    for word in _WORD.findall((text or "").lower()):
        count[word] = count.get(word, 0) + 1
    for word, n in count.items():
        h = crc32(word.encode("utf-8", "surrogatepass"))
        out[h % dims] += n**0.5 if h >> 31 else -(n**0.5)
    size = float(np.sqrt((out.astype(float) ** 2).sum()))
    return out / size if size else out


def hashed(dims: int = DIMS) -> Callable[[Column], Column]:
    """An embed function: a text column to an array of floats."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: vector(t, dims))

    return run
