"""The graph cache: Parquet tables in buckets of files, and numbered states that name the buckets in force."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import ancestors
from skein.graph import Graph
from skein.schema import CANDIDATE, EDGE, FILE, GRAM, NODE, RELATION, SCHEMA_VERSION, SYMBOL
from skein.sources.discovery import included_by_default

#: ``open`` holds the relations that lead to no known file or package, ``candidates`` what each relation would resolve to,
#: ``grams`` what the text of each file holds.
TABLES = {"files": FILE, "nodes": NODE, "symbols": SYMBOL, "edges": EDGE, "relations": RELATION, "open": RELATION, "candidates": CANDIDATE, "grams": GRAM}


def fingerprints(text: DataFrame) -> DataFrame:
    """path, content_hash and size of texts (path, content)."""
    content = F.coalesce("content", F.lit(""))
    return text.select("path", F.sha2(content, 256).alias("content_hash"), F.octet_length(content).cast("long").alias("size"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change (added, changed, removed) between two tables of fingerprints; sizes are compared before hashes."""
    a = before.select("path", F.col("content_hash").alias("_h"), F.col("size").alias("_s"))
    both = now.join(a, "path", "full")
    change = F.when(F.col("_h").isNull(), "added").when(F.col("content_hash").isNull(), "removed").when((F.col("size") != F.col("_s")) | (F.col("content_hash") != F.col("_h")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def patched(table: DataFrame, gone: DataFrame, new: DataFrame | None, key: str = "path") -> DataFrame:
    """A table without the rows of the keys in ``gone``, plus ``new`` rows."""
    out = table.join(gone.select(key).distinct(), key, "left_anti")
    return out if new is None else out.unionByName(new)


def violations(graph: Graph) -> DataFrame:
    """Counts of broken references: edge ends that are no nodes, and repeated node keys."""
    ids = graph.nodes.select(F.col("id").alias("_id"))
    src = graph.edges.join(ids, F.col("src") == F.col("_id"), "left_anti")
    dst = graph.edges.join(ids, F.col("dst") == F.col("_id"), "left_anti")
    twice = ids.groupBy("_id").count().where("count > 1")
    out = [(df.agg(F.count("*").alias("violations")), name) for df, name in ((src, "edge_source"), (dst, "edge_target"), (twice, "node_key"))]
    rows = [df.select(F.lit(name).alias("check"), "violations") for df, name in out]
    return rows[0].union(rows[1]).union(rows[2])


def below(paths: DataFrame, gone: DataFrame) -> DataFrame:
    """Paths that are in ``gone`` (path) or lie below one of its folders."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_up"))
    return up.join(gone.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()


def pending(changes: DataFrame, indexed_at: float | None) -> DataFrame:
    """Of changed files (path, mtime in milliseconds; null where unknown) those that the last index doesn't cover."""
    out = changes.where(included_by_default(F.col("path")))
    return out if indexed_at is None else out.where(F.col("mtime").isNull() | (F.col("mtime") > indexed_at))


#: Buckets of files; a patch writes those anew that hold a file of the patch, the others stay as they are.
BUCKETS = 64


class Overtaken(RuntimeError):
    """Another writer has committed since this one read the cache."""


class GraphCache:
    """Tables under ``folder``, in buckets by the file that a row belongs to (candidates by the path that would be tried).

    A save or patch writes buckets under a new name, then its state aside, and renames that to the next number, which
    must not exist yet: that is the moment from which readers see them, and of two writers the later one fails. A writer
    that dies leaves buckets and a state that no one reads. State files and buckets are never changed or deleted by it, so
    a reader keeps what it has begun with (``vacuum`` deletes old ones)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    @staticmethod
    def key(table: str) -> Column:
        """The file that a row belongs to."""
        return {
            "files": F.col("path"), "nodes": F.coalesce("symbol_file", "id"), "symbols": F.col("file_path"),
            "edges": F.substring_index("src", "#", 1), "relations": F.col("from_file"), "open": F.col("from_file"), "candidates": F.col("from_file"), "grams": F.col("path"),
        }[table]

    @staticmethod
    def place(table: str) -> Column:
        """What a row's bucket goes by."""
        return F.col("path") if table == "candidates" else GraphCache.key(table)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._files()
        return [x.getPath().getName() for x in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []

    def state(self) -> dict | None:
        """The state of the highest number that is written to its end."""
        for n in sorted(self._numbers(), reverse=True):
            said = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/state-{n}").collect())
            try:
                return {**json.loads(said), "number": n}
            except ValueError:  # written in place by a writer that died
                continue
        return None

    def _numbers(self) -> list[int]:
        return [int(n.removeprefix("state-")) for n in self._names(self.folder) if n.startswith("state-")]

    def load(self) -> dict[str, DataFrame]:
        """The tables; empty ones where nothing is saved or the schema version is another."""
        state = self.state()
        if state is None or state["schema"] != SCHEMA_VERSION:
            return {t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}
        return {t: self._read(state, t) for t in TABLES}

    def _read(self, state: dict, table: str, buckets: set[int] | None = None) -> DataFrame:
        at = state["tables"].get(table, {})
        paths = [f"{self.folder}/{version}/{table}/bucket={b}" for b, version in at.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def _write(self, table: str, df: DataFrame, version: str) -> dict[str, str]:
        fields = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields]
        out = df.select(*fields).withColumn("bucket", self._bucket(self.place(table)))
        out = out.repartition("bucket")
        if table == "grams":  # a search asks for a few grams of all files: bounds of row groups leave out the others
            out = out.sortWithinPartitions("bucket", "gram")
        out.write.partitionBy("bucket").parquet(f"{self.folder}/{version}/{table}")
        return {n.removeprefix("bucket="): version for n in self._names(f"{self.folder}/{version}/{table}") if n.startswith("bucket=")}

    def _commit(self, before: dict | None, version: str, tables: dict, meta: dict) -> str:
        """Make a state the one in force, unless another than ``before`` is by now. Its number is past all names, those of
        unfinished states too; the rename fails if another writer has taken it."""
        path, fs = self._files()
        if (self.state() or {}).get("version") != (before or {}).get("version"):
            raise Overtaken("the cache has changed")
        number = max(self._numbers(), default=0) + 1
        aside = path(f"{self.folder}/.state-{version}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "version": version, "tables": tables, "meta": meta}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without overwriting
        try:
            context.rename(aside, path(f"{self.folder}/state-{number}"), never)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            raise Overtaken("the cache has changed") from e
        return version

    def save(self, expect: str | None = None, meta: dict | None = None, **tables: DataFrame) -> str:
        """Replace the tables given, keep the others; ``expect``: the version that must still be in force."""
        state, version = self.state(), uuid.uuid4().hex
        if expect is not None and (state or {}).get("version") != expect:
            raise Overtaken("the cache has changed")
        same = state is not None and state["schema"] == SCHEMA_VERSION
        now = dict(state["tables"]) if same else {}
        for name, df in tables.items():
            now[name] = self._write(name, df, version)
        return self._commit(state, version, now, {**(state["meta"] if same else {}), **(meta or {})})

    def patch(self, gone: DataFrame, meta: dict | None = None, stale: DataFrame | None = None, gone_files: DataFrame | None = None, gone_grams: DataFrame | None = None, only: set[str] = frozenset(TABLES), expect: str | None = None, **new: DataFrame) -> str:
        """Drop what belongs to the files of ``gone`` (path) and add rows; only the buckets that these are in are written.

        ``stale`` are the candidates (path) that the files had, as their buckets go by other paths; ``gone_files``: what
        the table of files drops, if that is more; ``gone_grams``: files whose text is another or gone; ``only``: the tables to patch, the others stay as they are; ``expect``: the
        version that must still be in force."""
        state, version = self.state(), uuid.uuid4().hex
        if expect is not None and (state or {}).get("version") != expect:
            raise Overtaken("the cache has changed")
        if state is None or state["schema"] != SCHEMA_VERSION:
            return self.save(meta=meta, **new)
        now = {t: dict(v) for t, v in state["tables"].items()}
        for name in (t for t in TABLES if t in only):
            more = new.get(name)
            other = {"files": gone_files, "grams": gone_grams}.get(name)
            files = (gone if other is None else other).select("path").distinct()
            own = self.buckets_of(files) if name != "candidates" else self.buckets_of(stale) if stale is not None else set()
            own = own | (self.buckets_of(more.select(self.place(name).alias("path"))) if more is not None else set())
            rest = patched(self._read(state, name, own).withColumn("_key", self.key(name)), files.withColumnRenamed("path", "_key"), None, "_key").drop("_key")
            rest = rest if more is None else rest.unionByName(more, allowMissingColumns=True).select(*rest.columns)
            written_ = self._write(name, rest, version)
            now[name] = {**{b: v for b, v in now.get(name, {}).items() if int(b) not in own}, **written_}
        return self._commit(state, version, now, {**state["meta"], **(meta or {})})

    def buckets_of(self, paths: DataFrame) -> set[int]:
        """The buckets of paths (path), at most ``buckets`` numbers."""
        return {r[0] for r in paths.select(self._bucket(F.col("path"))).distinct().collect()}

    def at(self, table: str, paths: DataFrame) -> DataFrame:
        """Rows of a table whose place is one of ``paths`` (path); only their buckets are read."""
        state = self.state()
        if state is None or state["schema"] != SCHEMA_VERSION:
            return self.spark.createDataFrame([], TABLES[table])
        wanted = paths.select(F.col("path").alias("_place")).distinct()
        return self._read(state, table, self.buckets_of(paths)).withColumn("_place", self.place(table)).join(wanted, "_place", "left_semi").drop("_place")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete states but the last ``keep``, and the versions that none of these names; returns the versions deleted."""
        path, fs = self._files()
        names = self._names(self.folder)
        numbers = sorted(self._numbers())
        live = set()
        for n in numbers[-keep:]:
            try:
                state = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/state-{n}").collect()))
            except ValueError:
                continue
            live |= {v for t in state["tables"].values() for v in t.values()} | {state["version"]}
        if not live:
            return []
        gone = [n for n in names if len(n) == 32 and n not in live]
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.folder}/state-{n}"), False)
        for n in gone:
            fs.delete(path(f"{self.folder}/{n}"), True)
        return gone

    def counts(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.load().items()}

    def status(self, now: DataFrame | None = None, **signatures: str) -> tuple[str, list[str]]:
        """'missing', 'stale' or 'fresh', and why; ``now`` are the fingerprints of the files as they are, ``signatures`` those
        of the plugins and settings, held against what the last index noted."""
        state = self.state()
        if state is None:
            return "missing", ["never-indexed"]
        if not any(state["tables"].values()) or not set(self._names(self.folder)) & {v for t in state["tables"].values() for v in t.values()}:
            return "missing", ["graph-cache-missing"]
        reasons = []
        if state["schema"] == SCHEMA_VERSION and now is not None and not changed(self.load()["files"], now).isEmpty():
            reasons.append("pending-changed-files")
        reasons += [f"{name}-signature-changed" for name, value in signatures.items() if state["meta"].get(name) != value]
        if state["schema"] != SCHEMA_VERSION:
            reasons.append("analysis-version-changed")
        return ("stale", reasons) if reasons else ("fresh", [])
