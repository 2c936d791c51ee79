"""What a change of files asks for: which imports resolve otherwise, whose facts are the same, who depends on what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import traverse

#: What the resolution of a relation depends on, besides the files that there are.
ASKS = ("plugin_id", "from_file", "specifier", "imported")


def suffixes(path: Column) -> Column:
    """A path's ends at its slashes, each also without extension."""
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    bare = F.transform(ends, lambda e: F.regexp_replace(e, r"(?<=[^/])\.[^./]*\z", ""))
    return F.array_distinct(F.concat(ends, bare))


def names(paths: DataFrame) -> DataFrame:
    """path and name: each path under itself, and under ``*/`` and each of its ends."""
    ends = F.transform(suffixes(F.col("path")), lambda e: F.concat(F.lit("*/"), e))
    return paths.select("path", F.explode(F.concat(F.array("path"), ends)).alias("name"))


def _asking(relations: DataFrame) -> DataFrame:
    return relations.withColumn("imported", F.col("metadata")["importedName"])


def candidates(relations: DataFrame, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """The reverse candidate table: path, rank and what asks for it, a row for each path that a relation would try.

    ``rules`` give the paths of a plugin's relations, best first. Relations of other plugins name a file by its path, its
    end, or its name without extension: they try ``*/`` and that."""
    asks = _asking(relations).where("specifier is not null").select(*ASKS, "metadata").dropDuplicates(list(ASKS))
    wanted = F.regexp_replace(F.regexp_replace("specifier", r"^res://", ""), r"^\./", "")
    tried = F.array(F.concat(F.lit("*/"), wanted))
    for plugin, rule in rules.items():
        tried = F.when(F.col("plugin_id") == plugin, rule()).otherwise(tried)
    return asks.select(*ASKS, F.posexplode(tried).alias("rank", "path")).where("path is not null").select("path", "rank", *ASKS)


def resolved(relations: DataFrame, tried: DataFrame, paths: DataFrame) -> DataFrame:
    """``relations`` with resolved_path: of what each would try (``tried``, as ``candidates`` gives it) the first that is one of
    ``paths`` (path), of several files with one end the least."""
    wanted = tried.select(F.col("path").alias("name")).distinct()
    known = names(paths).join(wanted, "name", "left_semi").groupBy("name").agg(F.min("path").alias("_path"))
    hit = tried.withColumnRenamed("path", "name").join(known, "name")
    best = hit.groupBy(*ASKS).agg(F.min_by("_path", "rank").alias("_best")).select(*[F.col(c).alias(f"_{c}") for c in ASKS], "_best")
    out = _asking(relations.drop("resolved_path"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ASKS]
    return out.join(best, same[0] & same[1] & same[2] & same[3], "left").withColumnRenamed("_best", "resolved_path").drop("imported", *[f"_{c}" for c in ASKS])


def asked_again(tried: DataFrame, moved: DataFrame) -> DataFrame:
    """Of a reverse candidate table what asks for an added or removed path (``moved``, path), and so may resolve otherwise.

    Only the moved paths' names are looked up; nothing else is resolved again."""
    return tried.join(names(moved).select(F.col("name").alias("path")), "path", "left_semi").select(*ASKS).distinct()


def fact_digests(facts: DataFrame) -> DataFrame:
    """file and digest of its facts, in whatever order they come: the sum of the hashes of the rows, and their number."""
    row = F.xxhash64(F.to_json(F.struct(*[c for c in facts.columns if c != "file"])))
    digest = F.concat_ws(":", F.count("*"), F.sum(row.cast("decimal(38,0)")))
    return facts.groupBy("file").agg(digest.alias("digest"))


def with_same_facts(before: DataFrame, now: DataFrame) -> DataFrame:
    """path of those files whose digest (path, fact_digest) is the same in both tables; no facts count as a digest too."""
    then = before.select("path", F.coalesce("fact_digest", F.lit("")).alias("_then"))
    return now.join(then, "path").where(F.coalesce("fact_digest", F.lit("")) == F.col("_then")).select("path")


def reaches(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """path of the files whose links may name a symbol of the changed files (path): those with a relation to one of them, or
    to a file that re-exports from one, at any number of steps."""
    through = relations.where("kind = 'reexport' and resolved_path is not null").select(F.col("from_file").alias("src"), F.col("resolved_path").alias("dst"))
    seen = changed.select(F.col("path").alias("id"))
    if not through.isEmpty():
        seen = traverse.dependents(through, seen)
    return relations.join(seen, F.col("resolved_path") == F.col("id"), "left_semi").select(F.col("from_file").alias("path")).distinct()
