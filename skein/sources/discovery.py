"""Discovery of a workspace's files: a listing in tasks, level by level, or by git; what is excluded; texts and their counts."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.graph import written
from skein.functions.glob import matches_any
from skein.functions.ordering import collated
from skein.functions.paths import ancestors, extension

MOST_FILES, MOST_BYTES = 1_000, 1 << 20
# What is left out by default, with this package's own folder.
EXCLUDED = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/.git/**", "**/.skein/**", "**/.turbo", "**/.turbo/**",
    "**/.worktrees", "**/.worktrees/**", "**/coverage/**", "**/.DS_Store", "**/*.min.js", "**/*.bundle.js", "**/*.map",
)


_LISTED = "path string, folder boolean, size long, mtime double"
#: Names of folders that are never entered.
NEVER = frozenset(p.split("/")[1] for p in EXCLUDED if p.endswith("/**"))


def entries(root: str, folder: str) -> list[tuple[str, bool, int | None, float]]:
    """What is in a folder below ``root``: path, whether it is a folder, size, mtime in milliseconds; nothing if it can't be
    read. Links to folders aren't followed, folders that are never entered aren't listed."""
    out = []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for x in found:
                path = f"{folder}/{x.name}" if folder else x.name
                try:
                    if x.is_dir(follow_symlinks=False):
                        if x.name not in NEVER:
                            out.append((path, True, None, x.stat().st_mtime * 1000))
                    elif x.is_file():
                        out.append((path, False, x.stat().st_size, x.stat().st_mtime * 1000))
                except OSError:  # gone meanwhile
                    continue
    except OSError:
        return out
    return out


def walked(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), folder, size and mtime of all below a folder that executors reach.

    A level of the tree is a table of folders that tasks list; what they find is written and the folders in it are the next
    level, so no list of paths passes through the driver and a level is as wide as the cluster. (Spark's own listing leaves
    out names that begin with a dot or an underscore, and folders without files.)"""
    root = root.removeprefix("file://").rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for folder in frame["path"] for row in entries(root, folder)]
            yield pd.DataFrame(rows, columns=["path", "folder", "size", "mtime"]).astype(object).where(lambda d: d.notna(), None)

    level, out = spark.createDataFrame([("",)], "path string"), None
    while out is None or not level.isEmpty():
        found = written(level.mapInPandas(run, _LISTED), "listed")
        out = found if out is None else out.union(found)
        level = found.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
    return out


def listed(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, size and mtime of the files, and the content if asked for."""
    files = walked(spark, root).where("not folder").select("path", "size", "mtime")
    return with_content(files, root) if content else files


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds the bytes of each file below ``root``, a folder that executors reach; null for one that can't be read."""

    def read(path: str) -> bytes | None:
        try:
            with open(os.path.join(root, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[read(p) for p in frame["path"]])

    kinds = ", ".join(f"{c} {t}" for c, t in files.dtypes)
    return files.mapInPandas(run, f"{kinds}, content binary")


def git_listed(spark: SparkSession, root: str) -> DataFrame:
    """Paths that git tracks, or would but for being new."""
    said = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True)
    paths = sorted({p for p in said.stdout.decode("utf-8", "surrogateescape").split("\0") if p})
    return spark.createDataFrame([(p,) for p in paths], "path string")


def git_ignored(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Those of the paths that git ignores."""
    said = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(paths).encode(), capture_output=True, check=False)
    return spark.createDataFrame([(p,) for p in said.stdout.decode().split("\0") if p], "path string")


def git_ignored_folders(spark: SparkSession, root: str) -> DataFrame:
    """The topmost folders that git ignores, one row for each however much is in it."""
    said = subprocess.run(["git", "-C", root, "ls-files", "-z", "--others", "--ignored", "--exclude-standard", "--directory"], capture_output=True, check=True)
    paths = sorted(p[:-1] for p in said.stdout.decode("utf-8", "surrogateescape").split("\0") if p.endswith("/"))
    return spark.createDataFrame([(p,) for p in paths], "path string")


def included_by_default(path: Column) -> Column:
    return ~matches_any(path, list(EXCLUDED), "full")


def included(include: Sequence[str] = (), exclude: Sequence[str] = (), extensions: Sequence[str] = ()) -> Column:
    path = F.col("path")
    keep = ~matches_any(path, [*EXCLUDED, *exclude], "full")
    if include and "**/*" not in include:
        keep = keep & matches_any(path, list(include), "full")
    return keep & extension(path).isin(*extensions) if extensions else keep


def below(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths that are in ``folders`` (path) or lie below one of them: an equi-join on their prefixes."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_up"))
    return up.join(folders.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()


def discovered(files: DataFrame, include=(), exclude=(), extensions=(), ignored: DataFrame | None = None, most: int = MOST_FILES) -> tuple[DataFrame, dict]:
    """The first ``most`` eligible files in order of path, and totals: found, eligible, ignored, limited."""
    marked = files.withColumn("_keep", included(include, exclude, extensions))
    if ignored is not None:
        out = below(files, ignored).withColumn("_ignored", F.lit(True))
        marked = marked.join(out, "path", "left").withColumn("_ignored", F.coalesce("_ignored", F.lit(False)))
    else:
        marked = marked.withColumn("_ignored", F.lit(False))
    n = marked.agg(F.count("*").alias("found"), F.count_if(F.expr("_keep and not _ignored")).alias("eligible"), F.count_if("_ignored").alias("ignored")).first().asDict()
    kept = marked.where("_keep and not _ignored").drop("_keep", "_ignored").orderBy(collated("path")).limit(most)
    return kept, {**n, "limited": n["eligible"] > most}


def folders(files: DataFrame) -> DataFrame:
    """Every folder above a file."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def eligible_folders(listing: DataFrame, eligible: DataFrame, candidates: DataFrame) -> DataFrame:
    """path of the listed folders that have an eligible file somewhere below, or no candidate file at all: a folder of which
    every candidate was left out is left out too."""
    every = listing.where("folder").select("path")
    full, fit = (folders(df.select("path")) for df in (candidates, eligible))
    return every.join(full, "path", "left_anti").unionByName(every.join(fit, "path", "left_semi"))


def texts(files: DataFrame) -> DataFrame:
    """path and content of the files (path, content as bytes) that are texts of at most 1 MiB, without NUL."""
    text = F.decode("content", "UTF-8")
    out = files.where(F.octet_length("content") <= MOST_BYTES).select("path", text.alias("content"))
    return out.where(~F.col("content").contains("\x00"))


def scanned(files: DataFrame, hashes: DataFrame) -> tuple[DataFrame, Observation]:
    """path, content, content_hash and changed of the texts among ``files`` (path, content as bytes), and the counts scanned,
    skipped and changed, which are known once the texts have been read.

    Skipped is what can't be read, is longer than 1 MiB or holds a NUL; changed is what has another hash than in ``hashes``
    (path, content_hash), or none there."""
    text = F.decode("content", "UTF-8")
    fit = F.coalesce((F.octet_length("content") <= MOST_BYTES) & ~text.contains("\x00"), F.lit(False))
    old = hashes.select("path", F.col("content_hash").alias("_before"))
    out = files.withColumns({"_fit": fit, "content_hash": F.sha2("content", 256)}).join(old, "path", "left")
    out = out.withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("_before")))
    seen = Observation()
    counts = [F.count_if("_fit").alias("scanned"), F.count_if(~F.col("_fit")).alias("skipped"), F.count_if(F.col("_fit") & F.col("changed")).alias("changed")]
    out = out.observe(seen, *counts)
    return out.where("_fit").select("path", text.alias("content"), "content_hash", "changed"), seen


def with_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))
