"""Text embedders: any callable from a list of texts to a matrix of vectors."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]

# Fixed value: width of the stored vectors.
STORED_WIDTH = 1536


class HashedWords:
    """Deterministic stand-in for a language model: counts of words hashed into
    ``width`` slots, scaled to unit length. A text without words gives zeros."""

    def __init__(self, width: int = STORED_WIDTH):
        self.width = width
        self.slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        import hashlib

        slot = self.slots.get(word)
        if slot is None:
            if len(self.slots) >= 100_000:
                self.slots.clear()
            slot = self.slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.width
        return slot

    def __call__(self, texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.width))
        for row, text in enumerate(texts):
            words = re.findall("[a-z0-9]+", text.lower())
            if words:
                counts = np.bincount([self._slot(w) for w in words], minlength=self.width)
                out[row] = counts / np.sqrt(float(np.dot(counts, counts)))
        return out


def embed(text: Column, make_embedder: Callable[[], Embedder], batch: int = 256) -> Column:
    """Vectors for a text column. The embedder is made once per task, not per row;
    ``make_embedder`` travels to the workers, the model itself does not."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for texts in parts:
            rows = []
            for start in range(0, len(texts), batch):
                chunk = texts.iloc[start : start + batch].fillna("").tolist()
                rows.extend(np.asarray(embedder(chunk), dtype=np.float32))
            yield pd.Series(rows, index=texts.index)

    return run(text)
