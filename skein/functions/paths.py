"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.schema import ROOT


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, top: str = ROOT) -> Column:
    """The folder of a path; ``top`` of one without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, F.lit(top)).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))
