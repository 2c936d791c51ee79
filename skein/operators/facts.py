"""Facts of an analysis before they become a graph: which of them count, under which names and types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ranks import ranked
from skein.operators.scope import NodeType


def of_active_plugins(facts: DataFrame, active: list[str]) -> DataFrame:
    """Facts that no plugin claims, or an active one; ``plugin_id`` is a column or a key of the metadata."""
    plugin = F.col("plugin_id") if "plugin_id" in facts.columns else F.col("metadata")["pluginId"]
    return facts.where(plugin.isNull() | plugin.isin(*active))


def of_files(symbols: DataFrame, relations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the files (path): their symbols, and relations that start in one and lead to one or to no known file.

    A relation leads to its target file, its resolved path, or the file of the symbol that it names, in this order."""
    allowed = files.select(F.col("path").alias("_file")).distinct()
    named = symbols.select(F.col("id").alias("_id"), F.col("file_path").alias("_of"))
    out = relations.join(allowed, F.col("from_file") == F.col("_file"), "left_semi")
    out = out.join(named, F.coalesce("to_file", "resolved_path").isNull() & (F.col("to_symbol") == F.col("_id")), "left")
    out = out.withColumn("_target", F.nullif(F.coalesce("to_file", "resolved_path", "_of"), F.lit("")))
    out = out.join(allowed, F.col("_target") == F.col("_file"), "left").where("_target is null or _file is not null")
    return symbols.join(allowed, F.col("file_path") == F.col("_file"), "left_semi"), out.select(*relations.columns)


def without_symbols(relations: DataFrame) -> DataFrame:
    """Relations for a cache that keeps no symbols: those with a symbol end lose it, or go if nothing else is left.

    A file's own ``contains`` goes, as does a relation that leads nowhere but to a symbol."""
    ends = F.coalesce("from_symbol", "to_symbol").isNotNull()
    own = (F.col("kind") == "contains") & (F.coalesce("resolved_path", "to_file") == F.col("from_file"))
    leads = F.coalesce("to_file", "resolved_path", "to_node").isNotNull()
    kept = relations.where(~ends | (~F.coalesce(own, F.lit(False)) & leads))
    bare = {c: F.lit(None).cast(dict(relations.dtypes)[c]) for c in ("from_symbol", "to_symbol")}
    return kept.withColumns(bare)


def relative(value: Column, root: str) -> Column:
    """A path or id below the workspace root, with forward slashes, without the root; others only change their slashes."""
    plain, top = F.replace(value, F.lit("\\"), F.lit("/")), root.replace("\\", "/").removesuffix("/") + "/"
    return F.when(plain.startswith(top), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)


def stored_type(fallback: Column, types: tuple[NodeType, ...]) -> Column:
    """The node type under which a symbol (kind, plugin_id, language, plugin_kind) is stored.

    Only a generic fallback gives way: to the first type of the symbol's plugin that fits, else to ``symbol:<kind>``
    (``variable:plain`` for a variable) if there is such a type."""
    kind = F.col("kind")
    exact = F.when(kind == "variable", "variable:plain").otherwise(F.concat(F.lit("symbol:"), kind))
    out = F.when(exact.isin(*[t.id for t in types]), exact).otherwise(fallback)
    for t in reversed([t for t in types if t.source and t.parent]):
        tests = [F.col("plugin_id") == t.source]
        if t.kinds:
            tests.append(kind.isin(*t.kinds))
        tests += [F.col(c) == v for c, v in (("language", t.language), ("plugin_kind", t.plugin_kind)) if v]
        out = F.when(reduce(lambda a, b: a & b, tests), F.lit(t.id)).otherwise(out)
    return F.when(fallback.isin("symbol", "variable"), out).otherwise(fallback)


_IDENTITY = ("file_path", "name", "kind", "signature")


def paired(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and node_id: symbols of one identity (file, name, kind, signature) are paired with its nodes in their order."""
    def counted(df: DataFrame) -> DataFrame:
        df = df.withColumn("signature", F.coalesce("signature", F.lit("")))
        return ranked(df, list(_IDENTITY), ["ord"]).withColumnRenamed("nth", "_nth").drop("of")

    own = nodes.select(F.col("id").alias("node_id"), F.col("symbol_file").alias("file_path"), F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"), "signature", "ord")
    both = counted(symbols.select("id", *_IDENTITY, "ord")).drop("ord").join(counted(own).drop("ord"), [*_IDENTITY, "_nth"])
    return both.select("id", "node_id")


def difference(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with side ('before' or 'now'), as often as they are missing in the other."""
    gone, new = before.exceptAll(now), now.exceptAll(before)
    return gone.withColumn("side", F.lit("before")).unionByName(new.withColumn("side", F.lit("now")))


def endpoint_nodes(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, node_type and label of edge ends that are no nodes: files if ``files`` (path) has them, else symbols."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(nodes.select("id"), "id", "left_anti")
    known = files.select(F.col("path").alias("_path")).distinct()
    ends = ends.join(known, F.col("id") == F.col("_path"), "left")
    return ends.select("id", F.when(F.col("_path").isNotNull(), "file").otherwise("symbol").alias("node_type"), F.element_at(F.split("id", "/"), -1).alias("label"))
