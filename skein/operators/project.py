"""From analysis facts to a graph: connections, targets, symbols, namespaces, re-exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ordering import collated
from skein.functions.paths import ancestors, basename
from skein.graph import Bucketed, Graph, bucketed, written
from skein.operators.visible import _node_rows, merge_edges
from skein.schema import EDGE, NODE, edge_id, package_id

#: Kinds whose targets are followed through re-exports.
FOLLOWS = ("call", "event", "inherit", "reference")


def connections(relations: DataFrame) -> DataFrame:
    """Relations as connections of files: reexport counts as import; facts inside one file that lack a symbol go."""
    inside = F.coalesce(F.col("to_file"), F.col("resolved_path")) == F.col("from_file")
    partial = inside & (F.col("from_symbol").isNull() != F.col("to_symbol").isNull())
    kind = F.when(F.col("kind") == "reexport", "import").otherwise(F.col("kind"))
    return relations.where(~F.coalesce(partial, F.lit(False))).withColumn("kind", kind)


def with_targets(links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds target: a resolved path that is a known file; for an unresolved specifier its package; others go."""
    known = files.select(F.col("path").alias("_path")).distinct()
    goal = F.coalesce("resolved_path", "to_file")
    out = links.withColumn("_goal", goal).join(known, F.col("_goal") == F.col("_path"), "left")
    target = F.when(F.col("_goal").isNotNull(), F.col("_path")).otherwise(package_id(F.col("specifier")))
    return out.withColumn("target", target).where("target is not null").drop("_goal", "_path")


def _source():
    name = F.concat_ws(":", "plugin_id", "source_id")
    return F.array(F.struct(name.alias("id"), F.col("plugin_id"), F.col("source_id"), F.col("source_id").alias("label")))


def connection_edges(links: DataFrame) -> DataFrame:
    """Merged edges of connections with a target."""
    e = links.where("from_file <> target").select(
        edge_id(F.col("from_file"), F.col("target"), F.col("kind"), F.col("type"), F.col("variant")).alias("id"),
        F.col("from_file").alias("src"), F.col("target").alias("dst"), "kind", _source().cast(EDGE["sources"].dataType).alias("sources"), "ord",
    )
    return merge_edges(e)


def file_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the files (path, size) and of the packages that edges lead to."""
    base = F.element_at(F.split("path", "/"), -1)
    known = {"id": F.col("path"), "label": base, "node_type": F.lit("file"), "file_size": F.when(F.col("size") >= 0, F.col("size")), "ord": F.xxhash64("path")}
    out = files.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])
    pkg = edges.where(F.col("dst").startswith("pkg:")).select(F.col("dst").alias("id")).distinct()
    pkg = _node_rows(pkg, "package", out).withColumn("label", F.substring("id", 5, 1_000_000))
    return out.unionByName(pkg)


def folder_nodes(folders: DataFrame, nodes: DataFrame, ignored: DataFrame) -> DataFrame:
    """id, label and ignored of listed folders (path) that no node's path implies, and of those that are in ``ignored``
    (path) or below one of its folders, implied or not."""
    paths = folders.where("path <> ''").select("path").distinct()
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_up"))
    out = up.join(ignored.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    implied = nodes.select(F.explode(ancestors(F.col("id"))).alias("path")).distinct()
    rest = paths.join(out, "path", "left_anti").join(implied, "path", "left_anti").withColumn("ignored", F.lit(False))
    return out.unionByName(rest).select(F.col("path").alias("id"), basename(F.col("path")).alias("label"), "ignored")


def graph_of(relations: DataFrame, files: DataFrame, paths: DataFrame | None = None) -> Graph:
    """File and package nodes of the files (path, size) and the edges of the relations, which lead to any of ``paths``."""
    edges = connection_edges(with_targets(connections(relations), files if paths is None else paths))
    return Graph(file_nodes(files, edges), edges)


def containment(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """``contains`` edges from files to their symbols, unless an explicit relation contains the symbol."""
    named = relations.where("kind = 'contains' and to_symbol is not null").select(F.col("to_symbol").alias("id")).distinct()
    out = symbols.join(named, "id", "left_anti")
    return out.select(edge_id(F.col("file_path"), F.col("id"), F.lit("contains")).alias("id"), F.col("file_path").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), "ord")


def symbol_edges(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges of relations with a symbol at an end; ids by ``canonical`` (id, canonical_id), else the file."""
    a, b = canonical.select(F.col("id").alias("_a"), F.col("canonical_id").alias("_ca")), canonical.select(F.col("id").alias("_b"), F.col("canonical_id").alias("_cb"))
    r = relations.where("from_symbol is not null or to_symbol is not null")
    r = r.join(a, F.col("from_symbol") == F.col("_a"), "left").join(b, F.col("to_symbol") == F.col("_b"), "left")
    r = r.withColumn("src", F.coalesce("_ca", "from_file")).withColumn("dst", F.coalesce("_cb", "to_file")).where("dst is not null")
    e = r.select(edge_id(F.col("src"), F.col("dst"), F.col("kind")).alias("id"), "src", "dst", "kind", _source().cast(EDGE["sources"].dataType).alias("sources"), "ord")
    return merge_edges(e)


def incoming_includes(relations: DataFrame) -> DataFrame:
    """path and n: the ``include`` relations that lead to each file."""
    path = F.coalesce("to_file", "resolved_path").alias("path")
    return relations.where("kind = 'include'").groupBy(path).agg(F.count("*").alias("n")).where("path is not null")


def canonical_namespaces(symbols: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of each namespace's declarations the one that stands for it: headers first, then most included, then shortest path.

    ``incoming`` has path and n; ties go by collation."""
    header = F.col("file_path").rlike(r"[^/]\.(?:h|hh|hpp|hxx)\z")
    out = symbols.where("kind = 'namespace'").join(incoming.select(F.col("path").alias("file_path"), "n"), "file_path", "left")
    score = F.when(header, 10_000).otherwise(0) + F.coalesce("n", F.lit(0))
    # an aggregate, so the declarations of a very common name are compared before they meet
    best = F.min_by(F.struct(*symbols.columns), F.struct(-score, F.length("file_path"), collated("file_path"), "file_path"))
    return out.groupBy(F.col("name").alias("_name")).agg(best.alias("_best")).select("_best.*")


def target_name():
    """The name that a relation (metadata, specifier) asks its target file for: a member, what was imported by name, else
    the specifier."""
    said = lambda key: F.nullif(F.col("metadata")[key], F.lit(""))
    imported = said("importedName")
    return F.coalesce(said("memberName"), F.when(~imported.isin("*", "default"), imported), F.nullif(F.col("specifier"), F.lit("")))


def unique_targets(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relations (ord) and the one symbol of the named name in the target file, where there is just one."""
    one = symbols.groupBy("file_path", "name").agg(F.min("id").alias("target_symbol"), F.count("*").alias("n")).where("n = 1").drop("n")
    r = relations.where("to_symbol is null and to_file is not null").withColumn("name", target_name())
    return r.join(one.withColumnRenamed("file_path", "to_file"), ["to_file", "name"]).select("ord", "target_symbol")


def _asked(front: DataFrame, by: str) -> DataFrame:
    """``front`` dealt as a ``Bucketed`` table is by ``by``, so that a join with it leaves the table where it lies."""
    return front.repartition(int(front.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def through_reexports(wanted: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """ord and symbol for each wanted (ord, file, name), following ``exports`` (file, name, to_file, to_name) to the end.

    A null name in exports passes every name on; only a single result counts. What is followed are the distinct (file, name)
    that are asked for, however many rows ask: first forth, a step of exports at a time, until no new ones are found; then the
    symbols found go back over the steps, as one symbol or as null for several. Of each (file, name) this changes twice at
    most, so cycles end. Exports lie in buckets of their file and steps in buckets of their target: a round shuffles what is
    new in it alone."""
    own = written(symbols.select(F.col("file_path").alias("file"), "name", F.col("id").alias("symbol")), "reexports-own")
    declared = own.select("file", "name").distinct()
    key = ["file", "name"]
    exports = exports.where("file is not null and to_file is not null").select("file", F.col("name").alias("_name"), "to_file", "to_name")
    exports = bucketed(exports, "file", "exports")
    wanted = written(wanted.select("ord", *key).where("file is not null and name is not null").distinct(), "reexports-wanted")

    # forth
    front = written(wanted.select(*key).distinct(), "reexports")
    seen, steps = Bucketed(front, "file", "reexports-seen"), []
    while not front.isEmpty():
        # a file that declares the name hides what it re-exports
        on = front.join(declared, key, "left_anti")
        step = _asked(on, "file").join(exports, "file").where("_name is null or _name = name")
        step = step.select(*key, "to_file", F.when(F.col("_name").isNull(), F.col("name")).otherwise(F.coalesce("to_name", "name")).alias("to_name"))
        step = written(step, "reexports-step")
        steps.append(step)
        ends = step.select(F.col("to_file").alias("file"), F.col("to_name").alias("name"))
        front = written(_asked(ends, "file").distinct().join(seen.table(), key, "left_anti"), "reexports")
        seen.add(front)

    # back
    steps = bucketed(reduce(DataFrame.union, steps), "to_file", "reexports-steps") if steps else None
    front = own.where("symbol is not null").join(seen.table(), key, "left_semi").groupBy(*key).agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("_most"))
    front = written(front.select(*key, F.when(F.col("symbol") == F.col("_most"), F.col("symbol")).alias("symbol")), "reexports-found")
    found = Bucketed(front, "file", "reexports-symbols")
    while steps is not None and not front.isEmpty():
        at = _asked(front.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), "symbol"), "to_file")
        new = _asked(at.join(steps, ["to_file", "to_name"]).select(*key, "symbol"), "file")
        known = _one_symbol(found.table()).withColumnRenamed("symbol", "_symbol").withColumn("_known", F.lit(True))
        new = _one_symbol(new).join(known, key, "left").where("_known is null or (_symbol is not null and not (symbol <=> _symbol))")
        front = written(new.select(*key, F.when(F.col("_known").isNull(), F.col("symbol")).alias("symbol")), "reexports-found")
        found.add(front)
    return _one_symbol(wanted.join(found.table(), key).select("ord", "symbol"), "ord").where("symbol is not null")


def _one_symbol(found: DataFrame, *key: str) -> DataFrame:
    """The symbol of each key where there is but one, else null; null stands for several in ``found`` too."""
    key = key or ("file", "name")
    out = found.groupBy(*key).agg(F.min("symbol").alias("_a"), F.max("symbol").alias("_b"), F.count_if(F.col("symbol").isNull()).alias("_n"))
    return out.select(*key, F.when((F.col("_n") == 0) & (F.col("_a") == F.col("_b")), F.col("_a")).alias("symbol"))


def with_target_symbols(relations: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """``relations`` with to_symbol, and to_file moved to the file that declares it, where a relation names just one symbol:
    in the file that it leads to, or for ``FOLLOWS`` behind what that file re-exports (``exports``: relations of this kind).

    A file that declares the name hides what it re-exports."""
    rows = written(relations.withColumn("_row", F.monotonically_increasing_id()), "named-relations")
    asking = rows.where("to_symbol is null and to_file is not null")
    own = asking.withColumn("ord", F.col("_row"))
    direct = unique_targets(own, symbols).select(F.col("ord").alias("_row"), F.col("target_symbol").alias("_symbol"))
    wanted = own.where(F.col("kind").isin(*FOLLOWS)).select("ord", F.col("to_file").alias("file"), target_name().alias("name")).where("name is not null")
    hidden = symbols.select(F.col("file_path").alias("file"), "name").distinct()
    passed = exports.where("kind = 'reexport' and resolved_path is not null")
    passed = passed.select(F.col("from_file").alias("file"), F.col("metadata")["localName"].alias("name"), F.col("resolved_path").alias("to_file"), F.col("metadata")["importedName"].alias("to_name"))
    wanted = wanted.join(hidden, ["file", "name"], "left_anti").join(passed.select("file").distinct(), "file", "left_semi")
    found = direct.union(through_reexports(wanted, passed, symbols).select(F.col("ord").alias("_row"), F.col("symbol").alias("_symbol")))
    found = found.join(symbols.select(F.col("id").alias("_symbol"), F.col("file_path").alias("_file")).distinct(), "_symbol")
    out = rows.join(found, "_row", "left").withColumn("to_symbol", F.coalesce("to_symbol", "_symbol")).withColumn("to_file", F.coalesce("_file", "to_file"))
    return out.select(*relations.columns)
