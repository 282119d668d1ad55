"""Schemas of the data model: a star of annotations over images, categories and sources."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
#: parts -> rings -> points; the first ring of a part is its shell, the others are holes; rings are closed.
GEOMETRY = f"array<array<array<{POINT}>>>"

INFO = "version string, year int, description string, contributor string, date_created timestamp_ntz"
IMAGES = "id bigint, width int, height int, file_name string, source_id bigint, date_captured timestamp_ntz"
SEGMENTATION = "struct<size:array<int>,counts:string>"
ANNOTATIONS = f"id bigint, image_id bigint, category_id bigint, segmentation {SEGMENTATION}, area double, bbox array<int>, iscrowd int"
CATEGORIES = "id bigint, name string, supercategory string"
SOURCES = "id bigint, file_name string, date_captured timestamp_ntz"
TABLES = {"images": IMAGES, "annotations": ANNOTATIONS, "categories": CATEGORIES, "sources": SOURCES}
