"""Orders of strings as people expect them, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graph import written

DEFAULT_LIMIT = 500
# Limits of a command line.
COMMAND_LIMITS = {"nodes": 100, "edges": 100, "relationships": 100, "symbols": 100, "search": 20, "task-map": 8, "path_depth": 6, "paths": 5}


def collated(column: Column | str) -> Column:
    return F.collate(F.col(column) if isinstance(column, str) else column, "UNICODE")


def sort_by(df: DataFrame, keys: list[tuple[str, str]], defaults: list[str], tie: str | None = None) -> DataFrame:
    """By (field, 'asc' or 'desc') keys, then by the default fields that aren't among them, then by ``tie``."""
    order, kinds = [], dict(df.dtypes)
    for field, way in [*keys, *((d, "asc") for d in defaults if d not in {k for k, _ in keys})]:
        if field not in kinds:
            continue
        c = F.col(field)
        if kinds[field].startswith("array"):
            c = F.concat_ws("\x00", c)
        c = collated(c) if kinds[field] == "string" or kinds[field].startswith("array") else c
        order.append(c.desc() if way == "desc" else c.asc())
    if tie and tie in kinds:
        order.append(F.col(tie))
    return df.orderBy(*order) if order else df


def whole(value, default: int, least: int = 0) -> int:
    return default if not isinstance(value, (int, float)) or value != value or abs(value) == float("inf") else max(least, int(value))


def page(df: DataFrame, offset=0, limit=DEFAULT_LIMIT) -> DataFrame:
    return df.offset(whole(offset, 0)).limit(whole(limit, DEFAULT_LIMIT))


def page_info(total: int, offset=0, limit=DEFAULT_LIMIT) -> dict:
    offset, limit = whole(offset, 0), whole(limit, DEFAULT_LIMIT)
    returned = max(0, min(limit, total - offset))
    more = returned > 0 and offset + returned < total
    return {"offset": offset, "limit": limit, "returned": returned, "total": total, "nextOffset": offset + returned if more else None}


def page_row(df: DataFrame, offset=0, limit=DEFAULT_LIMIT) -> DataFrame:
    """The page's metadata as one row: offset, limit, returned, total, next_offset."""
    offset, limit = whole(offset, 0), whole(limit, DEFAULT_LIMIT)
    out = df.agg(F.count("*").alias("total")).select(F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"), "total")
    out = out.withColumn("returned", F.greatest(F.lit(0), F.least("limit", F.col("total") - F.col("offset"))))
    end = F.col("offset") + F.col("returned")
    return out.withColumn("next_offset", F.when((F.col("returned") > 0) & (end < F.col("total")), end))


class Pages:
    """An ordered report, written once with the place of each row, and the pages that are cut from it.

    A sorted table's partitions are ranges, so a row's place is its partition's number and its own within it. The counts of
    the partitions (as many as Spark sorts into, at most the shuffle partitions) tell which places a page has; a test of
    places reaches the scan, where the bounds of row groups leave out what lies before and behind. No task holds what the
    page skips, and no page sorts the report again."""

    def __init__(self, df: DataFrame):
        self.columns, at = df.columns, F.col("_at")
        self.rows = written(df.withColumn("_at", F.monotonically_increasing_id()), "pages")
        found = self.rows.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        self.parts = [(r["part"] << 33, r["n"]) for r in found]
        self.total = sum(n for _, n in self.parts)

    def page(self, offset=0, limit=DEFAULT_LIMIT) -> DataFrame:
        skip, left, test = whole(offset, 0), whole(limit, DEFAULT_LIMIT), F.lit(False)
        for first, n in self.parts:
            here = min(left, n - skip) if skip < n else 0
            if here > 0:
                test = test | F.col("_at").between(first + skip, first + skip + here - 1)
                left -= here
            skip = max(0, skip - n)
        return self.rows.where(test).orderBy("_at").select(*self.columns)

    def info(self, offset=0, limit=DEFAULT_LIMIT) -> dict:
        return page_info(self.total, offset, limit)


def paged(df: DataFrame, offset=0, limit=DEFAULT_LIMIT) -> tuple[DataFrame, dict]:
    """A page of an ordered report, and its metadata; the report is made once."""
    pages = Pages(df)
    return pages.page(offset, limit), pages.info(offset, limit)
