"""Command line: new, copy, add."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession

from .operators.dataset import create_dataset, load_dataset, save_dataset
from .plans.append import append_dataset
from .sources.geotiff import open_raster
from .sources.vector import read_labels


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Turn labelled rasters into COCO datasets.")
    commands = top.add_subparsers(dest="command", required=True)
    new = commands.add_parser("new", help="create an empty dataset")
    new.add_argument("json_path")
    copy = commands.add_parser("copy", help="copy a dataset, asking for new metadata")
    copy.add_argument("source_json")
    copy.add_argument("dest_json")
    copy.add_argument("--update-meta", action=argparse.BooleanOptionalAction, default=True)
    add = commands.add_parser("add", help="append the labels of a raster to a dataset")
    for name in ("image_path", "labels_path", "json_path", "output_dir"):
        add.add_argument(name)
    add.add_argument("width", type=int)
    add.add_argument("height", type=int)
    add.add_argument("--tile-format", choices=("png", "jpg"), default="jpg")
    for name in ("id-attribute", "name-attribute", "super-attribute"):
        add.add_argument(f"--{name}", f"--{name.replace('-', '_')}", dest=name.replace("-", "_"))
    return top


def existing(path: str) -> str:
    if not os.path.exists(path):
        raise SystemExit(f"{path} does not exist")
    return os.path.abspath(path)


def main(args: list[str] | None = None, ask: Callable[[str], str] = input, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if o.command == "new":
        path = os.path.abspath(o.json_path)
        save_dataset(create_dataset(spark, ask("Dataset description: "), ask("Dataset contributor: ")), path)
        print(f"Created {path}")
    elif o.command == "copy":
        dataset, path = load_dataset(spark, existing(o.source_json)), os.path.abspath(o.dest_json)
        if o.update_meta:
            # An empty answer keeps what is there.
            for key in ("version", "description", "contributor"):
                dataset.info[key] = ask(f"Dataset {key} ({dataset.info[key]}): ") or dataset.info[key]
            dataset.info["date_created"] = datetime.now()
            dataset.info["year"] = dataset.info["date_created"].year
        save_dataset(dataset, path)
        print(f"Copied to {path}")
    else:
        image, labels, path, out = map(existing, (o.image_path, o.labels_path, o.json_path, o.output_dir))
        dataset = load_dataset(spark, path)
        table, srid = read_labels(spark, labels)
        dataset = append_dataset(dataset, out, open_raster(spark, image), [(o.width, o.height)], table, o.id_attribute, o.name_attribute, o.super_attribute, label_srid=srid, suffix=o.tile_format)
        save_dataset(dataset, path)
        print(f"Added to {path}, now version {dataset.info['version']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
