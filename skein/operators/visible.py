"""The visible graph: scope, structural projection, filter, search, orphans, collapse, in this order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.glob import matches, matches_any
from skein.functions.paths import ancestors, basename, parent
from skein.graph import Graph, closed, firsts, full, slim, written
from skein.operators.ranks import ranked
from skein.operators.scope import Scope, apply_scope, node_type
from skein.schema import ROOT, edge_id


def _nests(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        edge_id(F.col("src"), F.col("dst"), F.lit("nests")).alias("id"), "src", "dst", F.lit("nests").alias("kind"),
        F.lit(None).cast("array<struct<id:string,plugin_id:string,source_id:string,label:string>>").alias("sources"),
        F.xxhash64("src", "dst").alias("ord"),
    )


def _node_rows(ids: DataFrame, kind: str, like: DataFrame) -> DataFrame:
    """Rows of ``like``'s columns for the ids in column ``id``."""
    known = {"id": F.col("id"), "label": F.when(F.col("id") == ROOT, F.col("id")).otherwise(basename(F.col("id"))), "node_type": F.lit(kind), "ord": F.xxhash64("id")}
    return ids.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in like.dtypes])


def package_roots(files: DataFrame) -> DataFrame:
    """Folders with a manifest: root ('.' for the top)."""
    return files.where(basename(F.col("id")) == "package.json").select(F.when(parent(F.col("id")) == ROOT, ".").otherwise(parent(F.col("id"))).alias("root")).distinct()


def nearest_package(files: DataFrame, roots: DataFrame) -> DataFrame:
    """id and root: the deepest package root above each file, found by an equi-join on its folders."""
    up = files.select("id", F.explode(F.concat(F.array(F.lit(".")), ancestors(F.col("id")))).alias("root"))
    up = up.join(roots, "root")
    depth = F.when(F.col("root") == ".", 0).otherwise(F.length("root"))
    return up.groupBy("id").agg(F.max_by("root", depth).alias("root"))


def structural(graph: Graph, scope: Scope, source: Graph | None = None, whole: bool = False) -> Graph:
    """Folder and workspace-package nodes with ``nests`` edges, if the scope shows them.

    Folders come from all files of ``source``, the graph before scope; edges lead only to visible files. ``whole``: edges of the
    graph have both ends among its nodes, or are looked at later, so that only the new ones are looked at here."""
    folders, packages = scope.nodes.get("folder", False), scope.nodes.get("package", False)
    if not folders and not packages:
        return graph
    source = source or graph
    is_file = node_type() == "file"
    files, visible = source.nodes.where(is_file), graph.nodes.where(is_file)
    nodes, pairs = graph.nodes, []
    if folders:
        paths = files.select(F.explode(ancestors(F.col("id"))).alias("id"))
        own = source.nodes.where(node_type() == "folder").select(F.explode(F.concat(ancestors(F.col("id")), F.array("id"))).alias("id"))
        top = files.where(~F.col("id").contains("/")).select(F.lit(ROOT).alias("id")).limit(1)
        paths = paths.union(own).union(top).distinct()
        nodes = nodes.unionByName(_node_rows(paths.join(graph.nodes.select("id"), "id", "left_anti"), "folder", nodes))
        pairs.append(paths.where(F.col("id") != ROOT).union(visible.select("id")).select(parent(F.col("id")).alias("src"), F.col("id").alias("dst")))
    if packages:
        roots = package_roots(files)
        named = roots.select(F.concat(F.lit("pkg:workspace:"), "root").alias("id"))
        nodes = nodes.unionByName(_node_rows(named, "package", graph.nodes))
        near = nearest_package(visible, roots)
        pairs.append(near.select(F.concat(F.lit("pkg:workspace:"), "root").alias("src"), F.col("id").alias("dst")))
    edges = graph.edges
    if scope.edges.get("nests", True):
        nests = reduce(DataFrame.unionByName, [_nests(p) for p in pairs])
        edges = edges.unionByName(closed(nests, nodes) if whole else nests)
    return Graph(nodes, edges if whole else closed(edges, nodes))


def filter_patterns(graph: Graph, patterns: list[str], dialect: str = "classes") -> Graph:
    """Drop nodes whose id or symbol's file matches a pattern, and edges that match one which may name edges."""
    if not patterns:
        return graph
    nodes = graph.nodes.where(~_hit(patterns, dialect))
    return Graph(nodes, _unnamed(closed(graph.edges, nodes), patterns, dialect))


def _hit(patterns: list[str], dialect: str) -> Column:
    return matches_any(F.col("id"), patterns, dialect) | F.coalesce(matches_any(F.col("symbol_file"), patterns, dialect), F.lit(False))


def _unnamed(edges: DataFrame, patterns: list[str], dialect: str) -> DataFrame:
    """Edges that match no pattern which may name edges."""
    direct = [p for p in patterns if "->" in p or "#" in p or ("*" not in p and "/" not in p)]
    for p in direct:
        plain = F.concat("src", F.lit("->"), "dst")
        forms = (F.col("id"), F.col("kind"), plain, F.concat(plain, F.lit("#"), F.col("kind")))
        edges = edges.where(~(matches(forms[0], p, dialect) | matches(forms[1], p, dialect) | matches(forms[2], p, dialect) | matches(forms[3], p, dialect)))
    return edges


_FIELDS = ("label", "id", "symbol_name", "symbol_kind", "plugin_kind", "signature", "symbol_file", "language", "source")


def _error(pattern: str) -> str | None:
    """What is wrong with an expression, by the engine that will run it."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError) as e:
        return str(e)
    return None


def search_test(query: str, match_case: bool = False, whole_word: bool = False, regex: bool = False) -> tuple[Column, str | None]:
    """A condition on nodes, and the error of an expression that isn't valid (nothing matches then)."""
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in _FIELDS])
    if regex or whole_word:
        pattern = query if regex else r"\b" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query) + r"\b"
        pattern = ("" if match_case else "(?iu)") + pattern
        error = _error(pattern)
        return (F.lit(False), error) if error else (text.rlike(pattern), None)
    return (text.contains(query) if match_case else F.lower(text).contains(query.lower())), None


def search(graph: Graph, query: str, **options) -> tuple[Graph, str | None]:
    if not query.strip():
        return graph, None
    test, error = search_test(query, **options)
    nodes = graph.nodes.where(test)
    return Graph(nodes, closed(graph.edges, nodes)), error


def filtered_search(graph: Graph, patterns: list[str], query: str, dialect: str = "classes", **options) -> tuple[Graph, str | None]:
    """``search`` in what ``filter_patterns`` leaves; edges meet the nodes that both leave once."""
    if not patterns:
        return search(graph, query, **options)
    test, error = search_test(query, **options) if query.strip() else (F.lit(True), None)
    nodes = graph.nodes.where(~_hit(patterns, dialect) & test)
    return Graph(nodes, closed(_unnamed(graph.edges, patterns, dialect), nodes)), error


def without_orphans(graph: Graph) -> Graph:
    """Nodes that have an edge; a loop counts."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("_end")).distinct()  # one pass over the edges
    return Graph(graph.nodes.join(ends, F.col("id") == F.col("_end"), "left_semi"), graph.edges)


def collapse(graph: Graph, folders: list[str], closing: bool = False) -> Graph:
    """Hide what lies below the collapsed folders; edges move to the topmost such folder and merge.

    ``closing``: edges that lack an end among the nodes go, which is seen where the folder of an end is looked up. Those of a whole
    graph are written after the first end, lest the shuffles for both take the disk at once."""
    if not folders:
        return graph.closed() if closing else graph
    nodes = graph.nodes
    chosen = nodes.where((node_type() == "folder") & F.col("id").isin(folders)).select(F.col("id").alias("_owner"))
    path = F.coalesce("symbol_file", "id")
    up = nodes.select("id", F.explode(F.concat(F.when(path.contains("/"), F.array()).otherwise(F.array(F.lit(ROOT))).cast("array<string>"), ancestors(path))).alias("_owner"))
    owner = up.join(F.broadcast(chosen), "_owner").where("id <> _owner").groupBy("id").agg(F.min_by("_owner", F.length("_owner")).alias("_owner"))
    owner = written(owner, "owners")  # read for nodes, counts and each end
    counts = owner.groupBy("_owner").agg(F.count("*").alias("_hidden"))
    shown = nodes.join(owner, "id", "left_anti")
    shown = shown.join(counts, F.col("id") == F.col("_owner"), "left").withColumn("hidden", F.coalesce("_hidden", F.lit(0)).cast("long")).drop("_owner", "_hidden")
    places = written(nodes.select("id").join(owner, "id", "left"), "places") if closing else owner
    edges, went = slim(graph.edges), F.lit(False)
    for end in ("src", "dst"):
        edges = edges.join(places.toDF("_id", "_to"), F.col(end) == F.col("_id"), "inner" if closing else "left")
        # an end that is moved replaces the one before it, which the next shuffle doesn't carry
        edges = edges.withColumn("_went", went | F.col("_to").isNotNull()).withColumn(end, F.coalesce("_to", end)).drop("_id", "_to")
        edges, went = written(edges, "half-collapsed") if closing and end == "src" else edges, F.col("_went")
    edges = edges.where(~went | (F.col("src") != F.col("dst")))
    return Graph(shown, merge_edges(full(edges.withColumn("_said", F.col("_said") & ~went)).select(*graph.edges.columns)))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each id: the first one's fields, and the sources of all, each source id once, in order of arrival.

    Sources are reduced to one row for each edge and source id before those of an edge meet, so an edge that is said very
    often costs no more than it has different sources. Edges without sources aren't among them."""
    each = edges.where("sources is not null").select("id", "ord", F.posexplode("sources").alias("_i", "_s")).where("_s is not null")
    at = F.struct("ord", "_i")
    one = each.groupBy("id", F.col("_s.id").alias("_source")).agg(F.min(at).alias("a"), F.min_by("_s", at).alias("s"))
    of = one.groupBy(F.col("id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("a", "s"))).alias("_f"))
    out = firsts(edges.select("id", "src", "dst", "kind", "ord")).join(of, F.col("id").eqNullSafe(F.col("_of")), "left")
    none = F.array().cast(dict(edges.dtypes)["sources"])
    return out.select("id", "src", "dst", "kind", F.coalesce(F.transform("_f", lambda x: x.s), none).alias("sources"), "ord")


@dataclass(frozen=True)
class View:
    scope: Scope = Scope()
    patterns: tuple[str, ...] = ()
    query: str = ""
    match_case: bool = False
    whole_word: bool = False
    regex: bool = False
    show_orphans: bool = True
    collapsed: tuple[str, ...] = ()


def visible(graph: Graph, view: View) -> tuple[Graph, str | None]:
    """The visible graph, and the error of a search expression.

    Each step reads nodes and edges several times, so what a step leaves is written before the next."""
    scoped = apply_scope(graph, view.scope)
    if any(view.scope.nodes.get(t, False) for t in ("folder", "package")):
        # these edges have both ends already, and nodes are read for each kind of structure
        scoped = Graph(written(scoped.nodes, "scoped-nodes"), scoped.edges)
    out, error = structural(scoped, view.scope, graph, whole=True).settled("shown"), None
    if view.patterns or view.query.strip():
        out, error = filtered_search(out, list(view.patterns), view.query, match_case=view.match_case, whole_word=view.whole_word, regex=view.regex)
        nodes = written(out.nodes, "found-nodes")
        out = Graph(nodes, written(out.edges, "found-edges"))
    if not view.show_orphans:
        out = without_orphans(out)
        out = Graph(written(out.nodes, "linked-nodes"), out.edges) if view.collapsed else out
    return collapse(out, list(view.collapsed)), error


def merge_nodes(*layers: DataFrame) -> DataFrame:
    """One row for each id over graphs in order: symbol fields win over none, later values fill what is missing."""
    rows = layers[0].withColumn("_layer", F.lit(0))
    for i, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.withColumn("_layer", F.lit(i)))
    order = F.struct(F.col("symbol_file").isNull(), "_layer", "ord")
    value = lambda c: F.min_by(c, F.struct(F.col(c).isNull(), order))
    return rows.groupBy("id").agg(*[(F.min("ord") if c == "ord" else value(c)).alias(c) for c in layers[0].columns if c != "id"])


def bidirectional(edges: DataFrame) -> DataFrame:
    """Pairs of opposite edges of the same suffix: a <= b, suffix, both (whether each direction is there)."""
    at = F.instr("id", "#")
    suffix = F.when(at > 0, F.expr("substring(id, instr(id, '#'))")).otherwise(F.concat(F.lit("#"), F.col("kind")))
    out = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), suffix.alias("suffix"), "src")
    # an edge comes from a or from b, so two flags tell whether both do; they are combined before the only shuffle
    there = out.groupBy("a", "b", "suffix").agg(F.bool_or(F.col("src") == F.col("a")).alias("_from_a"), F.bool_or(F.col("src") == F.col("b")).alias("_from_b"))
    return there.select("a", "b", "suffix", F.coalesce(F.col("_from_a") & F.col("_from_b") & (F.col("a") != F.col("b")), F.lit(False)).alias("both"))


def fan_out(edges: DataFrame, most: float = 0.5) -> DataFrame:
    """Edges with their curvature among those of their pair: evenly from -most to most, the last one at most."""

    def made(rows: DataFrame) -> DataFrame:
        return full(rows).withColumns({"_one": F.least("src", "dst"), "_other": F.greatest("src", "dst")})

    rows = ranked(slim(edges), ["_one", "_other"], ["ord", "id"], last="src", made=made)
    i, n = F.col("nth") - 1, F.col("of")
    bend = F.when(n == 1, F.lit(0.0)).when(i == n - 1, F.lit(most)).otherwise(-most + i * 2 * most / (n - 1))
    return rows.select(*edges.columns, F.when(F.col("src") == F.col("_last"), bend).otherwise(-bend).alias("curvature"))
