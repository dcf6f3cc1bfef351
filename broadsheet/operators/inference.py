"""Model inference as a pluggable stage: tiles in, labels out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_maximum(scores: Column) -> Column:
    """Class index of the highest score, the first among equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def predicted(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], schema: str = "page long, x0 long, y0 long, h long, w long, labels binary") -> DataFrame:
    """Apply a model to tiles (page, x0, y0, h, w, pixels as bytes). ``load`` runs once a task; the model maps h x w to h x w x classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = [np.argmax(model(np.frombuffer(p, np.uint8).reshape(h, w)), -1).astype(np.uint8).tobytes() for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"], strict=True)]
            yield pdf[["page", "x0", "y0", "h", "w"]].assign(labels=out)

    return tiles.mapInPandas(run, schema)


def tile_confusion(tiles: DataFrame, n_classes: int) -> DataFrame:
    """(doc, truth, pred as bytes) to confusion counts: one bincount a tile, then a plain sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, t, p in zip(pdf["doc"], pdf["truth"], pdf["pred"], strict=True):
                code = np.frombuffer(t, np.uint8).astype(int) * n_classes + np.frombuffer(p, np.uint8)
                n = np.bincount(code, minlength=n_classes * n_classes)
                rows += [(doc, int(i) // n_classes, int(i) % n_classes, int(n[i])) for i in np.flatnonzero(n)]
            yield pd.DataFrame(rows, columns=["doc", "truth", "pred", "n"])

    return tiles.mapInPandas(run, "doc long, truth int, pred int, n long").groupBy("doc", "truth", "pred").agg(F.sum("n").alias("n"))
