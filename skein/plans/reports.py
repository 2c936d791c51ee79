"""The reports on a graph: nodes, edges, relationships, symbols, overview. Each is one lazy plan (that of all edges
writes its pairs first) and returns all rows in order; ``ordering.page`` cuts a page from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.glob import matches
from skein.functions.ordering import collated, sort_by
from skein.graph import Graph, closed, closed_files, file_edges, with_files, written
from skein.operators.ranks import ranked
from skein.operators.scope import NodeType, Scope, _up, node_type
from skein.operators.visible import search, without_orphans
from skein.schema import uri_component


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (str, int, float)) else ""


def filter_test(df: DataFrame, filters: dict[str, dict]) -> Column:
    """AND over field -> {equals, includes, startsWith, endsWith, matches: value}; unknown fields read as ''.

    On arrays ``includes`` asks for a member, the others look at the members joined by blanks."""
    tests = [F.lit(True)]
    kinds = dict(df.dtypes)
    for field, ops in filters.items():
        kind = kinds.get(field, "string")
        value = F.col(field) if field in kinds else F.lit("")
        text = F.concat_ws(" ", value) if kind.startswith("array") else F.coalesce(value.cast("string"), F.lit(""))
        for op, wanted in ops.items():
            w = _text(wanted)
            tests.append({
                "equals": lambda: text == w,
                "includes": lambda: F.array_contains(value, w) if kind.startswith("array") else text.contains(w),
                "startsWith": lambda: text.startswith(w),
                "endsWith": lambda: text.endswith(w),
                "matches": lambda: matches(text, w),
            }[op]())
    return reduce(lambda a, b: a & b, tests)


def scoped(graph: Graph, node_types: list[str] | None = None, edge_types: list[str] | None = None, types: tuple[NodeType, ...] = (), project: bool = False) -> Graph:
    """Only the named node types (by default files) and edge types (by default all). 'symbol' means every symbol, any other
    type also the symbols that a definition at or below it matches; ``types`` adds definitions to the core's. ``project``: edges
    are first moved to the files of their ends."""
    wanted = node_types or ["file"]
    shown = node_type().isin(*wanted)
    if "symbol" in wanted:
        shown = shown | F.col("symbol_file").isNotNull()
    every = Scope(types=types).definitions()
    for t in every.values():
        if t.has_matcher and set(wanted) & set(_up(every, t.id)):
            shown = shown | t.fits()
    nodes = graph.nodes.where(shown)
    edges = graph.edges.where(F.col("kind").isin(*edge_types)) if edge_types is not None else graph.edges
    return Graph(nodes, closed_files(Graph(graph.nodes, edges), nodes) if project else closed(edges, nodes))


def observed(graph: Graph) -> DataFrame:
    """of ('node' or 'edge'), type and n of the types in use."""
    n = graph.nodes.groupBy(node_type().alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("of"), "type", "n")
    return n.union(graph.edges.groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("of"), "type", "n"))


def _looked(graph: Graph, query: str, show_orphans: bool) -> Graph:
    graph, _ = search(graph, query)
    return graph if show_orphans else without_orphans(graph)


def node_items(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("path"), node_type().alias("node_type"), F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"), F.col("symbol_file").alias("file_path"))


def nodes_report(graph: Graph, node_types=None, filters=None, query="", sort=(), show_orphans=True) -> DataFrame:
    graph = scoped(graph, node_types)
    items = node_items(graph.nodes)
    keep = items.where(filter_test(items, filters or {})).select(F.col("path").alias("id"))
    nodes = graph.nodes.join(keep, "id", "left_semi")
    graph = _looked(Graph(nodes, closed(graph.edges, nodes)), query, show_orphans)
    return sort_by(node_items(graph.nodes), list(sort), ["path"])


def grouped(edges: DataFrame) -> DataFrame:
    """from, to and the kinds between them, first seen first. Edges that lie by an end or by pairs aren't shuffled; others are dealt
    by pairs before, lest their texts be shuffled for each of the two aggregates."""
    kinds = edges.groupBy("src", "dst", "kind").agg(F.min("ord").alias("ord"))
    kinds = kinds.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("ord", "kind"))).alias("k"))
    return kinds.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.transform("k", lambda k: k.kind).alias("edge_types"))


#: Ids of a file and its symbols that a filter may list; more are joined.
FEW = 1_000


def _ends(edges: DataFrame, graph: Graph, src: str | None, dst: str | None, kind: str | None, expand: bool) -> DataFrame:
    if kind:
        edges = edges.where(F.col("kind") == kind)
    if not expand:
        for column, value in (("src", src), ("dst", dst)):
            if value is not None:
                edges = edges.where(F.col(column) == value)
        return edges
    for column, value in (("src", src), ("dst", dst)):
        if value is not None:
            # a file stands for itself and its symbols
            of = graph.nodes.where((F.col("symbol_file") == value) | (F.col("id") == value)).select(F.col("id").alias("_end"))
            few = [r[0] for r in of.limit(FEW + 1).collect()]
            if len(few) <= FEW:
                edges = edges.where(F.col(column).isin(few))
            else:
                edges = edges.join(of, F.col(column) == F.col("_end"), "left_semi")
    return edges


def edges_report(
    graph: Graph, src=None, dst=None, edge_type=None, node_types=None, edge_types=None, expand=False, project=False,
    filters=None, query="", sort=(), show_orphans=True,
) -> DataFrame:
    """Pairs and their kinds. ``expand``: a file selector means its symbols too; ``project``: report files only.

    The selectors come first, so the edges whose other ends are looked up are few."""
    edges = graph.edges.where(F.col("kind").isin(*edge_types)) if edge_types is not None else graph.edges
    graph = scoped(Graph(graph.nodes, _ends(edges, graph, src, dst, edge_type, expand)), node_types)
    edges = graph.edges
    items = edges.select("*", F.col("src").alias("from"), F.col("dst").alias("to"), F.col("kind").alias("edgeType"))
    edges = items.where(filter_test(items, filters or {})).select(*edges.columns)
    graph = _looked(Graph(graph.nodes, edges), query, show_orphans)
    edges = file_edges(graph) if project else graph.edges
    out = grouped(edges)
    if src is None and dst is None:
        # a sort runs what it sorts twice, first for the bounds of its ranges; of a whole graph that is written before
        out = written(out, "pairs")
    return sort_by(out, list(sort), ["from", "to", "edge_types"])


ALL_TYPES = ["file", "folder", "package", "symbol", "variable"]


def dependencies(graph: Graph, path: str) -> DataFrame:
    return edges_report(graph, src=path, node_types=ALL_TYPES, expand=True, project=True)


def dependents(graph: Graph, path: str) -> DataFrame:
    return edges_report(graph, dst=path, node_types=ALL_TYPES, expand=True, project=True)


def relationships(graph: Graph, relations: DataFrame, symbols: DataFrame, node_types=None, edge_types=None, project=False) -> DataFrame:
    """from, to, relationships (kind, plugin, source, symbols) and edge_types, for relations whose edge is visible.

    ``project``: edges are moved to the files of their ends, loops dropped, before it is asked what is visible. Visible edges are
    written, and relations with what they say of symbols. Then what is said of a pair is brought to one place once, for the test
    against the kinds of its edges and the three aggregates behind that."""
    pair = ["src", "dst"]
    # of edges that are asked about, the order of nests alone is told
    asked = Graph(graph.nodes, graph.edges.withColumn("ord", F.when(F.col("kind") == "nests", F.col("ord"))).drop("sources"))
    edges = written(scoped(asked, node_types, edge_types, project=project).edges.select(*pair, "kind", "ord"), "shown-edges")
    r = relations.select(F.coalesce("from_node", "from_file").alias("src"), F.coalesce("to_node", "to_file").alias("dst"), "kind", "plugin_id", F.when(F.col("plugin_id").isNotNull(), F.col("source_id")).alias("source_id"), F.coalesce("to_symbol", "from_symbol").alias("_symbol"), "ord")
    s = symbols.select(F.col("id").alias("_symbol"), "name", F.col("kind").alias("_kind"), "start_line", "end_line")
    r = r.where("dst is not null").join(s, "_symbol", "left").drop("_symbol")
    r = r.withColumn("_kind", F.when((F.col("kind") != "type-import") & (F.col("_kind") != ""), F.col("_kind")))
    r = written(r, "named-relations").unionByName(edges.where("kind = 'nests'"), allowMissingColumns=True).repartition(*pair)
    # kinds of a pair are few
    kinds = edges.groupBy(*[F.col(c).alias(f"_{c}") for c in pair]).agg(F.collect_set("kind").alias("_kinds"))
    r = r.join(kinds, (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")) & F.array_contains("_kinds", F.col("kind")), "left_semi")
    each = r.groupBy("src", "dst", "kind", "plugin_id", "source_id", "name", "_kind", "start_line", "end_line").agg(F.min("ord").alias("ord"))
    symbol = F.struct("ord", F.col("name"), F.col("_kind").alias("kind"), "start_line", "end_line")
    inner = each.groupBy("src", "dst", "kind", "plugin_id", "source_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), symbol))).alias("symbols"))
    plain = F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line")))
    one = F.struct(F.col("kind").alias("edge_type"), F.col("ord"), "plugin_id", "source_id", plain.alias("symbols"))
    out = inner.groupBy(F.col("src").alias("from"), F.col("dst").alias("to")).agg(F.array_sort(F.collect_list(one)).alias("relationships"))
    return out.withColumn("edge_types", F.transform("relationships", lambda x: x.edge_type))


def relationships_report(graph: Graph, relations: DataFrame, symbols: DataFrame, node_types=None, edge_types=None, filters=None, project=False) -> DataFrame:
    """``relationships`` in order."""
    out = relationships(graph, relations, symbols, node_types, edge_types, project)
    # written, as a sort runs what it sorts twice
    return sort_by(written(out.where(filter_test(out, filters or {})), "relationships"), [], ["from", "to"])


#: Columns of a symbol that come from its metadata, and their keys there.
METADATA = {"language": "language", "source": "source", "plugin_kind": "pluginKind"}


def symbols_report(graph: Graph, symbols: DataFrame, relations: DataFrame | None = None, file_path=None, related_from=None, related_to=None, edge_type=None, filters=None, query="") -> DataFrame:
    """Declarations, or with a relation filter the symbols that such relations name."""
    out = symbols
    if related_from or related_to or edge_type:
        r = relations
        for column, value in ((F.coalesce("from_node", "from_file"), related_from), (F.coalesce("to_node", "to_file"), related_to), (F.col("kind"), edge_type)):
            if value:
                r = r.where(column == value)
        ids = r.select(F.coalesce("to_symbol", "from_symbol").alias("id")).where("id is not null").distinct()
        out = out.join(ids, "id", "left_semi").withColumn("kind", F.when(F.col("kind") != "type", F.col("kind")))
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    has = "metadata" in out.columns
    extra = [(F.col("metadata")[key] if has else F.lit(None).cast("string")).alias(c) for c, key in METADATA.items()]
    out = out.select("id", "name", "kind", "file_path", "signature", "start_line", "end_line", *extra)
    out = out.where(filter_test(out, filters or {}))
    if query.strip():
        # eight fields between single blanks; a missing one leaves its place empty
        fields = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("id", "file_path", "name", "kind", "signature", *METADATA)])
        out = out.where(F.lower(fields).contains(query.lower()))
    return sort_by(out, [], ["file_path", "name", "kind", "id"])


def kind_rank(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 0).when(kind.isin("class", "interface", "type", "enum"), 1).when(kind.isin("constant", "variable"), 3).otherwise(2)


def overview_report(graph: Graph, symbols: DataFrame, target: str, contains: bool = True) -> dict[str, DataFrame] | None:
    """target, declared symbols, outgoing and incoming pairs, 25 each; None if nothing has that id."""
    found = graph.nodes.where(F.col("id") == target)
    row = found.first()
    if row is None:
        return None
    own, every = row["symbol_file"] is None, ALL_TYPES
    declared = symbols.where(F.col("file_path") == (target if own else "")).orderBy(kind_rank(F.col("kind")), collated("name"), collated("id"))
    sides = {}
    for side, end in (("outgoing", "src"), ("incoming", "dst")):
        edges = graph.edges.where((F.col("kind") != "contains") | ((F.col(end) == target) if contains else F.lit(False)))
        sides[side] = edges_report(Graph(graph.nodes, edges), **{end: target}, node_types=every, expand=own, project=own and not contains).limit(25)
    return {"target": node_items(found), "declared": declared.limit(25), **sides}


def symbols_of(nodes: DataFrame) -> DataFrame:
    """Symbol facts from a graph's symbol nodes."""
    return nodes.where("symbol_file is not null").select(
        "id", F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"), F.col("symbol_file").alias("file_path"), "signature",
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
        F.create_map(*[x for c, key in METADATA.items() for x in (F.lit(key), F.col(c))]).alias("metadata"), "ord",
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, either way; a loop makes a node its own neighbour."""
    # each pair once, whichever way, goes through the shuffle of texts; its ends are told apart behind it
    turned = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())
    pairs = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    return pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def link_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges at each visible node, both ends visible; every edge counts, a loop twice."""
    both = closed(edges, nodes)
    ends = both.select(F.col("src").alias("id")).union(both.select("dst"))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("links")), "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def node_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size by degree: three times the root of degree plus one, from 8 to 30."""
    out = nodes.select("id").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.withColumn("size", F.greatest(F.lit(8.0), F.least(F.lit(30.0), 3 * F.sqrt(F.col("degree") + 1))))


def file_sizes(nodes: DataFrame, low: float = 10.0, high: float = 30.0) -> DataFrame:
    """Size by the logarithm of the file's size between the graph's extremes; the middle where they are equal or unknown."""
    log = F.log1p(F.col("file_size").cast("double"))
    span = nodes.where("file_size is not null").agg(F.min(log).alias("_a"), F.max(log).alias("_b"))
    out = nodes.select("id", "file_size", log.alias("_v")).join(F.broadcast(span))
    scaled = low + (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low)
    flat = F.col("_v").isNull() | F.col("_a").isNull() | (F.col("_a") == F.col("_b"))
    return out.select("id", "file_size", F.when(flat, (low + high) / 2).otherwise(scaled).alias("size"))


def relation_counts(relations: DataFrame) -> DataFrame:
    """Relations of each file; one between a file and itself counts once."""
    ends = F.array_distinct(F.array_compact(F.array("from_file", "to_file")))
    return relations.select(F.explode(ends).alias("path")).groupBy("path").agg(F.count("*").alias("relations"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
    return out.union(edges.where(F.col("dst") == node).select("src")).distinct()


def edge_pairs(graph: Graph) -> DataFrame:
    """Pairs of files and the sorted kinds between them."""
    pairs = with_files(graph.edges, graph.nodes).where("src_file <> dst_file")
    return pairs.groupBy("src_file", "dst_file").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("edges"))


def occurrence_ids(symbols: DataFrame) -> DataFrame:
    """Canonical ids: the base (file, name, kind, encoded signature), and from the second of the same base on its number."""
    signature = F.when(F.col("signature") != "", F.concat(F.lit(":"), uri_component(F.col("signature"))))
    base = F.concat("file_path", F.lit("#"), "name", F.lit(":"), F.lower(F.trim("kind")), F.coalesce(signature, F.lit("")))
    out = ranked(symbols.withColumn("base", base), ["base"], ["ord", "id"]).drop("of")
    return out.withColumn("canonical_id", F.when(F.col("nth") > 1, F.concat("base", F.lit(":"), "nth")).otherwise(F.col("base")))
