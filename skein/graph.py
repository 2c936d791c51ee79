"""A property graph as two DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import edge_id


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a new folder serves if driver and executors are one process; on a cluster that is an error, as
    executors don't see each other's disks. Tables are left to whoever clears that folder: a lazy plan may still read them."""
    out = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not out:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        out = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(out)
    return out.rstrip("/")


#: Spark's setting by which the shuffle files of an execution go as soon as it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files, which would else stay until the driver's memory is next cleared. So the
    steps of a query share the disk one after the other."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in ``folder``."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """A table written in as many buckets of ``by`` as there are shuffle partitions, sorted in them: joins and aggregates
    on ``by`` read it as it lies. It is entered in the session's catalogue, and its files are where ``written`` puts them."""
    return Bucketed(df, by, name).table()


class Bucketed:
    """A bucketed table to which rows may be added."""

    def __init__(self, df: DataFrame, by: str, name: str, lies: bool = False):
        """``lies``: rows already come from a task for each bucket, and aren't shuffled again."""
        self.spark, self.by = df.sparkSession, by
        self.name = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = f"{folder(self.spark)}/{self.name}"
        self.add(df, lies)

    def add(self, df: DataFrame, lies: bool = False) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # one file a bucket: rows come from as many tasks as there are buckets
        rows = df if lies else df.repartition(n, self.by)
        with freed(self.spark):
            rows.write.bucketBy(n, self.by).sortBy(self.by).format("parquet").option("path", self.path).mode("append").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def transform(self, step: Callable[..., Graph], *args, **kwargs) -> Graph:
        return step(self, *args, **kwargs)

    def closed(self) -> Graph:
        """Without edges that lack an end among the nodes."""
        return Graph(self.nodes, closed(self.edges, self.nodes))

    def settled(self, name: str = "graph") -> Graph:
        """Both tables written once, so that steps which read them several times don't repeat the work before."""
        return Graph(written(self.nodes, f"{name}-nodes"), written(self.edges, f"{name}-edges"))

    def persist(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist())


def slim(edges: DataFrame) -> DataFrame:
    """Edges without the ids that say just their ends and kind, which would be joined and shuffled once more in each row;
    ``full`` makes these again. _said marks ids that say something else, and these stay."""
    said = ~F.col("id").eqNullSafe(edge_id(F.col("src"), F.col("dst"), F.col("kind")))
    return edges.withColumn("_said", said).withColumn("id", F.when(F.col("_said"), F.col("id")))


def full(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", F.when(F.col("_said"), F.col("id")).otherwise(edge_id(F.col("src"), F.col("dst"), F.col("kind")))).drop("_said")


def firsts(edges: DataFrame) -> DataFrame:
    """The first edge of each id, by ord.

    An edge that its id says whole goes through the shuffle as its id and the lengths of its ends."""
    rest = [c for c in edges.columns if c not in ("id", "src", "dst", "kind", "ord")]
    plain = F.col("id").eqNullSafe(edge_id(F.col("src"), F.col("dst"), F.col("kind"))) & F.col("id").isNotNull()
    for c in rest:
        plain = plain & F.col(c).isNull()
    lengths = F.when(plain, F.shiftleft(F.length("src").cast("long"), 32) + F.length("dst"))
    other = F.when(~plain, F.struct("src", "dst", "kind", *rest))
    out = edges.groupBy("id").agg(F.min_by(lengths, "ord").alias("_n"), F.min_by(other, "ord").alias("_e"), F.min("ord").alias("ord"))
    a = F.shiftright("_n", 32).cast("int")
    b = F.col("_n").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    said = {"src": F.substring("id", F.lit(1), a), "dst": F.substring("id", a + 3, b), "kind": F.substring("id", a + b + 4, F.length("id"))}
    value = {c: F.when(F.col("_n").isNotNull(), said[c]).otherwise(F.col(f"_e.{c}")) for c in said}
    return out.select(*[value[c].alias(c) if c in value else F.col(c) if c in ("id", "ord") else F.col(f"_e.{c}").alias(c) for c in edges.columns])


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes: two semi-joins."""
    ids = nodes.select(F.col("id").alias("_id"))
    whole = {"id", "src", "dst", "kind"} <= set(edges.columns)
    out = slim(edges) if whole else edges
    out = out.join(ids, F.col("src") == ids._id, "left_semi").join(ids, F.col("dst") == ids._id, "left_semi")
    return full(out).select(*edges.columns) if whole else out


def with_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_file and dst_file, the files that contain their ends (the end itself if it is no symbol)."""
    of = nodes.where("symbol_file is not null").select(F.col("id").alias("_id"), F.col("symbol_file").alias("_file"))
    out = edges
    # an end's file is known as soon as it is met, so where the end itself isn't asked for the next join doesn't carry it
    for end in ("src", "dst"):
        out = out.join(of, F.col(end) == F.col("_id"), "left").withColumn(f"{end}_file", F.coalesce("_file", end)).drop("_id", "_file")
    return out


def file_edges(graph: Graph) -> DataFrame:
    """Edges between files: ends moved to the containing files, loops dropped, ids made anew."""
    out = with_files(graph.edges, graph.nodes).where("src_file <> dst_file")
    out = out.withColumn("src", F.col("src_file")).withColumn("dst", F.col("dst_file")).drop("src_file", "dst_file")
    return out.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("kind")))


#: Rows of a partition that a task may hold at once.
HELD = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` in partitions by ``by``, more than the shuffle partitions if these would get over ``HELD`` of about ``rows`` rows.

    What a task holds for an aggregate on ``by`` then doesn't grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // HELD)), *by)


def closed_files(graph: Graph, shown: DataFrame) -> DataFrame:
    """``file_edges`` both of whose ends are among the nodes ``shown``. One table tells an end's file and that this is shown,
    so that edges are joined once at each end."""
    inside = graph.nodes.where("symbol_file is not null").select(F.col("id").alias("_id"), F.col("symbol_file").alias("_file"))
    inside = inside.join(shown.select(F.col("id").alias("_shown")), F.col("_file") == F.col("_shown"), "left_semi")
    own = shown.where("symbol_file is null").select(F.col("id").alias("_id"), F.col("id").alias("_file"))
    # written between the ends: what the first one's join shuffled goes before the second's
    places, out = written(inside.union(own), "shown-places"), graph.edges.drop("id")
    for end in ("src", "dst"):
        out = out.join(places, F.col(end) == F.col("_id")).withColumn(end, F.col("_file")).drop("_id", "_file")
        out = written(out, "half-shown") if end == "src" else out
    return out.where("src <> dst").withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("kind"))).select(*graph.edges.columns)
