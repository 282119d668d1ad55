"""Dataset versions: MAJOR.MINOR.PATCH."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r"(0|[1-9]\d*)"
FORM = re.compile(rf"{PART}\.{PART}\.{PART}(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?")
METHODS = ("patch", "minor", "major")


def bump(version: str, method: str) -> str:
    """The next version; lower parts start at 0 again.  A malformed version is reported before an unknown method."""
    found = FORM.fullmatch(version)
    if not found:
        raise ValueError(f"{version!r} is not a semantic version")
    if method not in METHODS:
        raise ValueError(f"bump method must be one of {METHODS}, not {method!r}")
    major, minor, patch = map(int, found.groups()[:3])
    if method == "patch":
        return f"{major}.{minor}.{patch + 1}"
    return f"{major}.{minor + 1}.0" if method == "minor" else f"{major + 1}.0.0"


def bump_column(version: Column, method: Column) -> Column:
    """The same as an expression over MAJOR.MINOR.PATCH strings; null for an unknown method."""
    part = [F.split(version, r"\.")[i].cast("bigint") for i in range(3)]
    return (
        F.when(method == "patch", F.concat_ws(".", part[0], part[1], part[2] + 1))
        .when(method == "minor", F.concat_ws(".", part[0], part[1] + 1, F.lit(0)))
        .when(method == "major", F.concat_ws(".", part[0] + 1, F.lit(0), F.lit(0)))
    )


def next_version(version: str, new_source: bool, new_dir: bool) -> str:
    """An append: patch for a known source, minor for a new one; then major if the image folder was never used."""
    version = bump(version, "minor" if new_source else "patch")
    return bump(version, "major") if new_dir else version
