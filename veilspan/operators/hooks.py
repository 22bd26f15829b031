"""Hooks for detectors that need a model: off by default, and no model comes with the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id {kind}, block_id string, category string, original_value string, start int, end int, confidence double, method string, description string, ord int"
#: A detector: from a text to category, start, end, confidence of what it finds.
Detector = Callable[[str], Iterable[tuple[str, int, int, float]]]


def model_detections(blocks: DataFrame, make: Callable[[], Detector], method: str) -> DataFrame:
    """Detections of a model over blocks; make() runs once in each task, and texts come in Arrow batches."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = make()
        for f in frames:
            out = []
            for doc_id, block_id, text in zip(f["doc_id"], f["block_id"], f["text"], strict=True):
                out += [(doc_id, block_id, c, (text or "")[s:e], s, e, conf, method, "", i) for i, (c, s, e, conf) in enumerate(detect(text or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "block_id", "category", "original_value", "start", "end", "confidence", "method", "description", "ord"])

    return blocks.select("doc_id", "block_id", "text").mapInPandas(rows, SCHEMA.format(kind=blocks.schema["doc_id"].dataType.simpleString()))
