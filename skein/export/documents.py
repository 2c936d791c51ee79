"""Exports of a graph as rows of JSON or Markdown, ready for ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ordering import collated
from skein.functions.style import legend_ids
from skein.graph import Graph
from skein.operators.scope import node_type
from skein.plans.reports import grouped


def edge_rows(graph: Graph, legend: dict[str, str]) -> DataFrame:
    """A JSON line an edge in order, with the ids of the legend's rules (id to pattern) that fit and its sources by id."""
    sources = F.array_sort("sources")
    return graph.edges.orderBy(collated("id")).select(F.to_json(F.struct("id", F.col("src").alias("from"), F.col("dst").alias("to"), "kind", legend_ids(legend).alias("legendIds"), sources.alias("sources"))).alias("value"))


def json_rows(graph: Graph) -> DataFrame:
    """A JSON line a node, then one a pair of nodes, each in order."""
    n = graph.nodes.orderBy(collated("id")).select(F.lit("node").alias("part"), F.to_json(F.struct("id", "label", node_type().alias("nodeType"), F.col("file_size").alias("fileSize"))).alias("value"))
    e = grouped(graph.edges).orderBy(collated("from"), collated("to")).select(F.lit("edge").alias("part"), F.to_json(F.struct("from", "to", F.col("edge_types").alias("edgeTypes"))).alias("value"))
    return n.union(e)


def summary(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("totalNodes"))
    return n.join(F.broadcast(graph.edges.agg(F.count("*").alias("totalEdges"))))


def markdown_rows(graph: Graph) -> DataFrame:
    """A section a file with what it leads to; path is the order."""
    links = grouped(graph.edges).select(F.col("from").alias("id"), F.concat(F.lit("- `"), "to", F.lit("` ("), F.array_join("edge_types", ", "), F.lit(")")).alias("line"))
    links = links.groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    files = graph.nodes.where("symbol_file is null").join(links, "id", "left")
    body = F.concat(F.lit("## "), "id", F.lit("\n\n"), F.coalesce(F.array_join("lines", "\n"), F.lit("_none_")), F.lit("\n"))
    return files.select(F.col("id").alias("path"), body.alias("value")).orderBy(collated("path"))


def symbol_export(nodes: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Each file with how many symbols it declares and in how many relations it stands."""
    s = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))
    ends = F.array_distinct(F.array_compact(F.array("from_file", "to_file")))
    r = relations.select(F.explode(ends).alias("path")).groupBy("path").agg(F.count("*").alias("relations"))
    out = nodes.where("symbol_file is null").select(F.col("id").alias("path")).join(s, "path", "left").join(r, "path", "left")
    return out.na.fill(0, ["symbols", "relations"]).orderBy(collated("path"))


def envelope(command: str, rows: DataFrame, page: dict | None = None) -> DataFrame:
    """One JSON text a row, with the command that it answers."""
    fields = [F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct(*rows.columns).alias("data")]
    if page:
        fields.append(F.from_json(F.lit(__import__("json").dumps(page)), "offset int, limit int, returned int, total int, nextOffset int").alias("page"))
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))
