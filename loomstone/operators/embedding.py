"""The seam of an embedding model: texts to vectors in batches, a model loaded once a task."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import spread

Model = Callable[[Sequence[str]], np.ndarray]
DIMENSIONS, BATCH = 256, 64
_WORD = re.compile(r"\w+")


def hashed_words(dimensions: int = DIMENSIONS) -> Model:
    """The model used where there is none: words of the whole text hashed to places with a sign, damped counts, unit length; a text without words is zero."""

    def model(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for k, text in enumerate(texts):
            words, counts = np.unique(_WORD.findall(text.lower()), return_counts=True)
            for w, n in zip(words.tolist(), counts.tolist(), strict=True):
                h = zlib.crc32(w.encode())
                out[k, h % dimensions] += (1 if h >> 31 else -1) * np.log1p(n)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return model


def embed(docs: DataFrame, load: Callable[[], Model] = hashed_words, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, chars: int | None = None) -> DataFrame:
    """(id, vector) of every text.

    ``load`` makes the model where it runs; it is asked for ``batch`` texts at a time, the
    longest first within an Arrow batch, so that texts of one call are of like lengths.
    ``chars`` is what a model can take of a text, all if None.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            texts = [(t or "")[:chars] for t in pdf["text"]]
            order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                vectors = model([texts[k] for k in own])
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[own], "vector": list(np.asarray(vectors, dtype=np.float64))})

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(d).mapInPandas(run, f"id {dict(d.dtypes)['id']}, vector array<double>")
