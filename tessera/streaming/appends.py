"""Appending label batches from a stream: every micro-batch is one append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dataset import Dataset, load_dataset, save_dataset
from ..plans.append import Raster, append_dataset


def append_stream(labels: DataFrame, json_path: str, images_dir: str, raster: Raster, window_bounds: list[tuple[int, int]], **attributes) -> DataStreamWriter:
    """A writer that appends each non-empty batch of a streaming label table to the dataset at `json_path`.

    The file is replaced in one step after a batch, so a batch that fails leaves the dataset as it was.
    """

    def one(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        dataset: Dataset = load_dataset(batch.sparkSession, json_path)
        save_dataset(append_dataset(dataset, images_dir, raster, window_bounds, batch, **attributes), json_path)

    return labels.writeStream.foreachBatch(one)
