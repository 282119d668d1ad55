"""A dataset: four tables and an info record, and how appends number and version them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import next_version
from ..schemas import TABLES
from ..sources import coco_json


@dataclass
class Dataset:
    spark: SparkSession
    info: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Tables whose number of rows is known from how they were made.
    sizes: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def __post_init__(self):
        for name, schema in TABLES.items():
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], schema)
                self.sizes[name] = (self.tables[name], 0)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def count(self, name: str) -> int:
        of, n = self.sizes.get(name, (None, 0))
        return n if of is self.tables[name] else self.tables[name].count()


def create_dataset(spark: SparkSession, description: str, contributor: str, version: str = "0.0.0", date_created: datetime | None = None) -> Dataset:
    when = date_created or datetime.now()
    return Dataset(spark, {"version": version, "year": when.year, "description": description, "contributor": contributor, "date_created": when})


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    info, tables = coco_json.read(spark, path)
    if isinstance(info.get("date_created"), str):
        info["date_created"] = datetime.fromisoformat(info["date_created"])
    return Dataset(spark, info, tables)


def save_dataset(dataset: Dataset, path: str) -> None:
    """Write the dataset; from then on its tables are those of the file, so nothing is computed again from what it was built on
    (which may be the very file that was replaced)."""
    coco_json.write(path, dataset.info, dataset.tables)
    dataset.tables = coco_json.tables_of(coco_json.document(dataset.spark, path))


def source_of(dataset: Dataset, source_path: str) -> tuple[int, bool]:
    """The id of a source, and whether it is new; two sources of one path are an error."""
    found = dataset.sources.filter(F.col("file_name") == source_path).select("id").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"the dataset has several sources {source_path}")
    return (found[0]["id"], False) if found else (dataset.count("sources") + 1, True)


def used_dir(dataset: Dataset, images_dir: str) -> bool:
    parent = F.regexp_replace("file_name", "/[^/]*$", "")
    return bool(dataset.images.filter(parent == images_dir.rstrip("/")).limit(1).count())


def version_after(dataset: Dataset, source_path: str, images_dir: str) -> tuple[str, int, bool]:
    """(version, source id, whether the source is new) of an append."""
    source_id, new = source_of(dataset, source_path)
    return next_version(dataset.info["version"], new, not used_dir(dataset, images_dir)), source_id, new
