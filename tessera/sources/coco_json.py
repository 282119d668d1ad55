"""COCO JSON: the five tables of a dataset in one document."""

from __future__ import annotations

import json
import os
import tempfile
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANNOTATIONS, CATEGORIES, IMAGES, INFO, SOURCES

DOCUMENT = f"info struct<{', '.join(x.strip().replace(' ', ':', 1) for x in INFO.replace('timestamp_ntz', 'string').split(','))}>"
FIELDS = {"images": IMAGES, "annotations": ANNOTATIONS, "categories": CATEGORIES, "sources": SOURCES}


def struct_type(schema: str) -> str:
    """A column list as an array of structs, dates as text."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    inner = ",".join(f"{f.name}:{f.dataType.simpleString().replace('timestamp_ntz', 'string')}" for f in fields)
    return f"array<struct<{inner}>>"


def document_schema() -> str:
    return ", ".join([DOCUMENT, *(f"{name} {struct_type(s)}" for name, s in FIELDS.items())])


def iso(when: Column) -> Column:
    """A date as text: seconds, and a fraction only where there is one."""
    text = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(text.endswith(".000000"), F.substring(text, 1, 19)).otherwise(text)


def document(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a document."""
    return spark.read.schema(document_schema() + ", _corrupt_record string").option("multiLine", True).json(path)


def tables_of(whole: DataFrame) -> dict[str, DataFrame]:
    tables = {}
    for name in FIELDS:
        rows = whole.select(F.explode(name).alias("r")).select("r.*")
        if "date_captured" in rows.columns:
            rows = rows.withColumn("date_captured", F.col("date_captured").cast("timestamp_ntz"))
        tables[name] = rows
    return tables


def read(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(info, tables); unknown keys are dropped, missing required parts are an error."""
    whole = document(spark, path)
    first = whole.select("info").first()
    if first is None or first["info"] is None:
        raise ValueError(f"{path} is not a dataset: it has no info")
    info = first["info"].asDict() | {"version": first["info"]["version"] or "0.0.0"}
    tables = tables_of(whole)
    required = {"images": ["source_id", "date_captured"], "annotations": ["segmentation"]}
    for name, columns in required.items():
        missing = tables[name].filter(" OR ".join(f"{c} IS NULL" for c in columns)).limit(1).count()
        if missing:
            raise ValueError(f"{path}: some {name} lack {' or '.join(columns)}; only run-length masks and images with a source are read")
    for name in ("images", "annotations", "sources"):
        row = tables[name].agg(F.count("*"), F.max("id")).first()
        if row[0] and row[0] != row[1]:
            warnings.warn(f"{path}: ids of {name} are not 1..{row[0]}; new ids count from the number of rows", stacklevel=2)
    return info, tables


def table_json(df: DataFrame, name: str) -> DataFrame:
    """One JSON object per row, in id order, with fields in the model's order."""
    for column, kind in df.dtypes:
        if kind.startswith("timestamp"):
            df = df.withColumn(column, iso(F.col(column)))
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(FIELDS[name]).fields]
    return df.sort("id").select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j"))


def joined(batches):
    """A batch's rows as one text, so that the driver passes on a few large pieces instead of every row."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([", ".join(batch.column(0).to_pylist())], pa.string())], names=["j"])


def write(path: str, info: dict, tables: dict[str, DataFrame]) -> None:
    """Stream the tables partition by partition into a file beside `path`, then put it in its place in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, draft = tempfile.mkstemp(dir=folder, suffix=".json")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            when = info.get("date_created")
            head = {k: info.get(k) for k in ("version", "year", "description", "contributor")} | {"date_created": when.isoformat() if hasattr(when, "isoformat") else when}
            out.write('{"info": ' + json.dumps(head, ensure_ascii=False))
            for name in FIELDS:
                out.write(f', "{name}": [')
                pieces = table_json(tables[name], name).mapInArrow(joined, "j string")
                for i, row in enumerate(pieces.toLocalIterator(prefetchPartitions=True)):
                    out.write((", " if i else "") + row["j"])
                out.write("]")
            out.write("}")
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise
