"""The registered queries on the derived graph, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import style
from skein.functions.glob import matches, matches_any
from skein.functions.paths import ancestors
from skein.functions.ordering import Pages, page, sort_by
from skein.functions.text import SEARCH_STOP, tokens
from skein.graph import Graph, dealt, file_edges, written
from skein.operators import project, traverse, visible
from skein.operators.scope import Scope, apply_scope, in_scope, most_specific, projected
from skein.plans import reports, search, task_map
from skein.sources import cache, derived
from skein.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (derived.GRAPH_SQL + sql) if graph else sql
        return f

    return add


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def _first_file(spark, d) -> str:
    """The least file that has a symbol."""
    return derived.orders(spark, d).agg(F.min("file")).first()[0]


_FIRST = "(SELECT min(file) FROM ordr)"

# ------------------------------------------------------------------ pairs, filters, pages


@query('''SELECT src AS src_file, dst AS dst_file, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS edges FROM fedges GROUP BY 1, 2''')
def file_pairs(spark, d):
    return reports.edge_pairs(derived.graph(spark, d)).withColumn("kinds", _joined("kinds"))


@query('''SELECT src AS "from", dst AS "to", string_agg(kind, ',' ORDER BY o, kind) AS edge_types FROM (SELECT src, dst, kind, min(ord) AS o FROM edges GROUP BY ALL) GROUP BY 1, 2''')
def edge_group(spark, d):
    return reports.grouped(dealt(derived.edges(spark, d), derived.edges_at_most(spark, d), "src", "dst")).withColumn("edge_types", _joined("edge_types"))


_FILE_GROUP = '''SELECT src AS "from", dst AS "to", string_agg(kind, ',' ORDER BY o, kind) AS edge_types FROM (SELECT src, dst, kind, min(ord) AS o FROM fedges WHERE {} GROUP BY ALL) GROUP BY 1, 2'''


@query(_FILE_GROUP.format(f"src = {_FIRST}"))
def dependencies(spark, d):
    return reports.dependencies(derived.graph(spark, d), _first_file(spark, d)).withColumn("edge_types", _joined("edge_types"))


@query(_FILE_GROUP.format("dst = (SELECT min(id) FROM prt)"))
def dependents(spark, d):
    part = derived.parts(spark, d).agg(F.min("id")).first()[0]
    return reports.dependents(derived.graph(spark, d), part).withColumn("edge_types", _joined("edge_types"))


@query('''SELECT src AS "from", dst AS "to", string_agg(kind, ',' ORDER BY o, kind) AS edge_types FROM (SELECT src, dst, kind, min(ord) AS o FROM edges WHERE kind LIKE '%import%' GROUP BY ALL) GROUP BY 1, 2''')
def edges_filtered_includes(spark, d):
    out = reports.edges_report(derived.graph(spark, d), node_types=reports.ALL_TYPES, filters={"edgeType": {"includes": "import"}})
    return out.withColumn("edge_types", _joined("edge_types"))


@query("SELECT id AS path, 'file' AS node_type FROM nodes WHERE symbol_file IS NULL ORDER BY id LIMIT 50 OFFSET 100")
def nodes_by_path_page(spark, d):
    return page(reports.nodes_report(derived.graph(spark, d)), 100, 50).select("path", "node_type")


@query("""SELECT id AS path, node_type, row_number() OVER (ORDER BY id) AS place FROM (SELECT id, 'file' AS node_type FROM nodes WHERE symbol_file IS NULL)
    ORDER BY id LIMIT 75 OFFSET (SELECT count(*) // 2 FROM nodes WHERE symbol_file IS NULL)""")
def nodes_deep_page(spark, d):
    """A page from the middle of the report, with each row's place in it."""
    pages = Pages(reports.nodes_report(derived.graph(spark, d)))
    half = pages.total // 2
    out = pages.page(half, 75).select("path", "node_type", F.monotonically_increasing_id().alias("_i"))
    return out.select("path", "node_type", (F.row_number().over(Window.orderBy("_i")) + half).cast("long").alias("place"))


@query("SELECT id FROM nodes WHERE regexp_matches(id, '(?:^|/)r1/(?:.*/)?c[^/]*1$')")
def nodes_glob(spark, d):
    return derived.nodes(spark, d).where(matches(F.col("id"), "r1/**/c*1")).select("id")


@query("SELECT id FROM nodes WHERE regexp_matches(id, '(?:^|/)p[^/]*[1-3]$')")
def nodes_glob_classes(spark, d):
    return derived.nodes(spark, d).where(matches(F.col("id"), "p*[1-3]", "classes")).select("id")


@query("SELECT id FROM nodes WHERE regexp_full_match(id, 'part/[^/]*/p[^/]*(?:1|5)')")
def path_filter_minimatch(spark, d):
    return derived.nodes(spark, d).where(matches(F.col("id"), "part/*/p*{1,5}", "full")).select("id")


@query("SELECT id FROM nodes WHERE starts_with(id, 'supp/r1/') OR contains(id, '/supp/r1/') OR regexp_matches(id, '(?:^|/)n1[^/]*/c[^/]*$') OR id = 'p7' OR ends_with(id, '/p7')")
def nodes_any_glob(spark, d):
    return derived.nodes(spark, d).where(matches_any(F.col("id"), ["supp/r1/**", "n1*/c*", "p7"])).select("id")


# ------------------------------------------------------------------ scope and structure

_SCOPE = Scope(nodes={"variable": False, "symbol:class": False})
_VISIBLE = " , vis AS (SELECT * FROM nodes WHERE symbol_kind IS NULL OR symbol_kind IN ('function', 'method'))"
_PROJECTED = _VISIBLE + """
, place AS (SELECT n.id, CASE WHEN v.id IS NOT NULL THEN n.id ELSE f.id END AS to_ FROM nodes n LEFT JOIN vis v ON v.id = n.id LEFT JOIN vis f ON f.id = n.symbol_file),
 proj AS (SELECT e.src || '->' || e.dst || '#' || kind AS id, e.src, e.dst, kind, ord FROM edges e WHERE kind = 'contains'
  UNION ALL SELECT a.to_ || '->' || b.to_ || '#' || kind, a.to_, b.to_, kind, ord FROM edges e JOIN place a ON a.id = e.src JOIN place b ON b.id = e.dst
  WHERE kind <> 'contains' AND a.to_ IS NOT NULL AND b.to_ IS NOT NULL AND ((a.to_ = e.src AND b.to_ = e.dst) OR a.to_ <> b.to_))"""
_SPECIFIC = """
, ends AS (SELECT e.*, coalesce(a.symbol_file, e.src) AS sf, coalesce(b.symbol_file, e.dst) AS df,
   (CASE WHEN kind = 'type-import' THEN -1 ELSE 1 END) * ((a.symbol_file IS NOT NULL)::INT + (b.symbol_file IS NOT NULL)::INT) AS pref
   FROM {edges} e LEFT JOIN {nodes} a ON a.id = e.src LEFT JOIN {nodes} b ON b.id = e.dst),
 best AS (SELECT *, max(pref) OVER (PARTITION BY kind, sf, df) AS top FROM ends),
 spec AS (SELECT id, src, dst, kind, min(ord) AS ord FROM best WHERE kind = 'contains' OR pref = top GROUP BY ALL)"""


@query(_VISIBLE + "SELECT id FROM vis")
def scope_nodes(spark, d):
    return derived.nodes(spark, d).where(in_scope(_SCOPE)).select("id")


@query(_PROJECTED + "SELECT id, src, dst, kind, ord FROM proj")
def scope_edge_projection(spark, d):
    g = derived.graph(spark, d)
    return projected(g.edges, g.nodes, in_scope(_SCOPE)).select("id", "src", "dst", "kind", "ord")


@query(_SPECIFIC.format(edges="edges", nodes="nodes") + "SELECT id, src, dst, kind, ord FROM spec")
def most_specific_edges(spark, d):
    g = derived.graph(spark, d)
    return most_specific(g.edges, g.nodes).select("id", "src", "dst", "kind", "ord")


@query(_PROJECTED + _SPECIFIC.format(edges="proj", nodes="vis") + "SELECT id, src, dst, kind, ord FROM spec WHERE src IN (SELECT id FROM vis) AND dst IN (SELECT id FROM vis)")
def scope_edges(spark, d):
    return apply_scope(derived.graph(spark, d), _SCOPE).edges.select("id", "src", "dst", "kind", "ord")


_FOLDERS = """, parts_ AS (SELECT id, string_split(id, '/') AS p FROM nodes WHERE symbol_file IS NULL),
 folders AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS id FROM parts_, range(1, len(p)) t(i))"""


@query(_FOLDERS + "SELECT id FROM folders UNION ALL SELECT id FROM nodes")
def structural_folders(spark, d):
    return visible.structural(derived.graph(spark, d), Scope(nodes={"folder": True})).nodes.select("id")


_NESTS = """, nest AS (SELECT CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '(root)' END AS src, id AS dst FROM
   (SELECT id FROM folders UNION ALL SELECT id FROM nodes WHERE symbol_file IS NULL))"""


@query(_FOLDERS + _NESTS + "SELECT src || '->' || dst || '#nests' AS id, src, dst FROM nest WHERE src IN (SELECT id FROM folders)")
def structural_nests(spark, d):
    g = visible.structural(derived.graph(spark, d), Scope(nodes={"folder": True}))
    return g.edges.where("kind = 'nests'").select("id", "src", "dst")


@query(""", roots AS (SELECT DISTINCT array_to_string(string_split(id, '/')[1:2], '/') AS root FROM nodes WHERE symbol_file IS NULL
   UNION SELECT DISTINCT array_to_string(string_split(id, '/')[1:3], '/') FROM nodes WHERE symbol_file IS NULL AND id LIKE 'cust/r1/%')
 SELECT id, arg_max(root, length(root)) AS root FROM nodes JOIN roots ON starts_with(id, root || '/') WHERE symbol_file IS NULL GROUP BY id""")
def workspace_packages(spark, d):
    files = derived.nodes(spark, d).where("symbol_file is null")
    up = files.select("id", ancestors(F.col("id")).alias("a"))
    roots = up.select(F.get("a", F.lit(1)).alias("root")).union(up.where(F.col("id").startswith("cust/r1/")).select(F.get("a", F.lit(2)))).distinct()
    return visible.nearest_package(files, roots)


# ------------------------------------------------------------------ filter, search, orphans, collapse


@query(""", kept AS (SELECT * FROM nodes WHERE NOT (starts_with(id, 'cust/r1/') OR coalesce(starts_with(symbol_file, 'cust/r1/'), false)))
 SELECT id, src, dst, kind, ord FROM edges WHERE kind <> 'reference' AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def filter_patterns(spark, d):
    return visible.filter_patterns(derived.graph(spark, d), ["cust/r1/**", "reference"]).edges.select("id", "src", "dst", "kind", "ord")


_TEXT = "concat_ws(' ', label, id, symbol_name, symbol_kind, symbol_file)"


def _search(spark, d, q, **options):
    return visible.search(derived.graph(spark, d), q, **options)[0].nodes.select("id")


@query(f"SELECT id FROM nodes WHERE contains(lower({_TEXT}), 'brand12')")
def search_substring(spark, d):
    return _search(spark, d, "Brand12")


@query(f"SELECT id FROM nodes WHERE regexp_matches({_TEXT}, '(?i)\\bn1\\b')")
def search_word(spark, d):
    return _search(spark, d, "N1", whole_word=True)


@query(f"SELECT id FROM nodes WHERE regexp_matches({_TEXT}, 'o[0-9]+5:(class|method)')")
def search_regex(spark, d):
    return _search(spark, d, "o[0-9]+5:(class|method)", regex=True, match_case=True)


@query(""", f AS (SELECT * FROM nodes WHERE symbol_file IS NULL), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f))
 SELECT id FROM f WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def orphans(spark, d):
    return visible.without_orphans(reports.scoped(derived.graph(spark, d))).nodes.select("id")


_COLLAPSED = ("cust/r1", "cust/r1/n1", "part")
_OWN = """, own AS (SELECT id, CASE WHEN starts_with(coalesce(symbol_file, id), 'cust/r1/') THEN 'cust/r1' WHEN starts_with(id, 'part/') THEN 'part' END AS owner FROM nodes),
 moved AS (SELECT coalesce(a.owner, src) AS s, coalesce(b.owner, dst) AS t, kind, ord, a.owner IS NOT NULL OR b.owner IS NOT NULL AS mv FROM edges JOIN own a ON a.id = src JOIN own b ON b.id = dst)"""


@query(_OWN + "SELECT s || '->' || t || '#' || kind AS id, s AS src, t AS dst, kind, min(ord) AS ord FROM moved WHERE NOT mv OR s <> t GROUP BY ALL")
def collapse_folders(spark, d):
    # the chosen folders of this graph are the nodes 'cust/r1' and 'part' of its structural projection
    g = derived.graph(spark, d)
    shown = visible.structural(g, Scope(nodes={"folder": True}, edges={"nests": False}), whole=True)
    return visible.collapse(shown, list(_COLLAPSED), closing=True).edges.select("id", "src", "dst", "kind", "ord")


@query("""SELECT "id", min(ord) AS ord, count(*) AS n_edges, string_agg(DISTINCT st, ',' ORDER BY st) AS plugins FROM (
   SELECT src || '->' || dst || '#' || kind AS id, ord, l_linestatus AS st FROM line) GROUP BY 1""")
def merge_edges_sources(spark, d):
    r = derived.relations(spark, d)
    name = F.concat_ws(":", "plugin_id", "source_id")
    e = r.select(F.concat("from_symbol", F.lit("->"), "to_file", F.lit("#"), "kind").alias("id"), F.col("from_symbol").alias("src"), F.col("to_file").alias("dst"), "kind", F.array(F.struct(name.alias("id"), "plugin_id", "source_id", F.lit("line").alias("label"))).alias("sources"), "ord")
    n = e.groupBy("id").agg(F.count("*").alias("n_edges"))
    out = visible.merge_edges(e).join(n, "id")
    return out.select("id", "ord", "n_edges", F.array_join(F.array_sort(F.transform("sources", lambda s: s.plugin_id)), ",").alias("plugins"))


@query("""SELECT id, CASE WHEN ord % 2 = 0 AND (ord % 3 = 0 OR symbol_file IS NULL) THEN 'first ' || label ELSE label END AS label, CASE WHEN ord % 3 > 0 THEN symbol_kind END AS symbol_kind,
 CASE WHEN ord % 3 > 0 THEN symbol_file END AS symbol_file, CASE WHEN ord % 3 > 0 THEN file_size END AS file_size FROM nodes WHERE ord % 2 = 0 OR ord % 3 > 0""")
def merge_nodes(spark, d):
    # a first layer of every other node, bare of symbol fields and sizes, and a second one of two thirds of all
    n = derived.nodes(spark, d)
    bare = n.where("ord % 2 = 0").withColumn("label", F.concat(F.lit("first "), "label"))
    bare = bare.withColumns({c: F.lit(None).cast(t) for c, t in n.dtypes if c in ("symbol_kind", "symbol_file", "symbol_name", "file_size")})
    return visible.merge_nodes(bare, n.where("ord % 3 > 0")).select("id", "label", "symbol_kind", "symbol_file", "file_size")


# ------------------------------------------------------------------ traversals

_REACH = """ , und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""


@query(_REACH.replace("WITH", "") + f""", h0 AS (SELECT {_FIRST} AS id), h1 AS (SELECT DISTINCT b AS id FROM und, h0 WHERE a = h0.id),
 h2 AS (SELECT DISTINCT b AS id FROM und JOIN h1 ON a = h1.id), reach AS (SELECT id, 0 AS d FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)
 SELECT id, min(d) AS depth_level FROM reach GROUP BY id""")
def depth_graph(spark, d):
    return traverse.focus(derived.graph(spark, d), _first_file(spark, d), 2).nodes.select("id", "depth_level")


@query(_REACH + f""", h0 AS (SELECT {_FIRST} AS id), h1 AS (SELECT DISTINCT b AS id FROM und, h0 WHERE a = h0.id), ball AS (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT b FROM und JOIN h1 ON a = h1.id)
 SELECT id, src, dst, kind, ord FROM edges WHERE src IN (SELECT id FROM ball) AND dst IN (SELECT id FROM ball)""")
def k_hop_subgraph(spark, d):
    return traverse.neighbourhood(derived.graph(spark, d), _first_file(spark, d), 2).edges.select("id", "src", "dst", "kind", "ord")


@query(f""", h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = {_FIRST}), h2 AS (SELECT DISTINCT dst AS id FROM edges JOIN h1 ON src = h1.id),
 goal AS (SELECT min(dst) AS id FROM edges JOIN h2 ON src = h2.id WHERE dst LIKE 'supp/%')
 SELECT {_FIRST} || '>' || e1.dst || '>' || e2.dst || '>' || goal.id AS path FROM goal, (SELECT DISTINCT src, dst FROM edges) e1, (SELECT DISTINCT src, dst FROM edges) e2, (SELECT DISTINCT src, dst FROM edges) e3
 WHERE e1.src = {_FIRST} AND e2.src = e1.dst AND e3.src = e2.dst AND e3.dst = goal.id ORDER BY e1.dst, e2.dst LIMIT 5""")
def simple_paths(spark, d):
    g = derived.graph(spark, d)
    src = _first_file(spark, d)
    near = traverse.distances(g.edges, spark.createDataFrame([(src,)], "id string"), 3)
    goal = near.where(F.col("id").startswith("supp/")).agg(F.min("id")).first()[0]
    return traverse.paths(g.edges, src, goal, 6, 5)[0].select(F.array_join("path", ">").alias("path"))


@query(""", RECURSIVE_ AS (SELECT 1) SELECT DISTINCT id FROM (
  SELECT (SELECT min(id) FROM supp) AS id
  UNION ALL SELECT src FROM edges WHERE dst = (SELECT min(id) FROM supp)
  UNION ALL SELECT e2.src FROM edges e1 JOIN edges e2 ON e2.dst = e1.src WHERE e1.dst = (SELECT min(id) FROM supp)
  UNION ALL SELECT e3.src FROM edges e1 JOIN edges e2 ON e2.dst = e1.src JOIN edges e3 ON e3.dst = e2.src WHERE e1.dst = (SELECT min(id) FROM supp))""")
def reverse_reachability(spark, d):
    start = derived.suppliers(spark, d).agg(F.min("id").alias("id"))
    return traverse.dependents(derived.edges(spark, d), start)


@query("SELECT DISTINCT dst AS id FROM edges WHERE src = (SELECT min(id) FROM prt) UNION SELECT src FROM edges WHERE dst = (SELECT min(id) FROM prt)")
def neighbours(spark, d):
    return reports.neighbours(derived.edges(spark, d), derived.parts(spark, d).agg(F.min("id")).first()[0])


# ------------------------------------------------------------------ relationships, symbols, overview


@query("""SELECT src_file AS "from", dst AS "to", string_agg(DISTINCT kind, ',' ORDER BY kind) AS edge_types, count(DISTINCT (kind, l_linestatus)) AS n_relationships, count(DISTINCT (kind, l_linestatus, src)) AS n_symbols FROM line GROUP BY 1, 2""")
def relationships_grouped(spark, d):
    g = derived.graph(spark, d)
    relations = derived.relations(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("from_node", "to_node", "to_symbol")})
    out = reports.relationships(g, relations, reports.symbols_of(g.nodes), project=True)
    n = F.aggregate(F.transform("relationships", lambda r: F.size(r.symbols)), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.select("from", "to", F.array_join(F.array_sort(F.array_distinct("edge_types")), ",").alias("edge_types"), F.size("relationships").cast("long").alias("n_relationships"), n.alias("n_symbols"))
    # in the report's order; what is counted needn't be sorted
    return sort_by(written(out, "relationships"), [], ["from", "to"])


@query("SELECT id, label AS name, symbol_kind AS kind, symbol_file AS file_path FROM nodes WHERE symbol_kind = 'class' AND starts_with(symbol_file, 'cust/r2/')")
def symbols_declared(spark, d):
    s = reports.symbols_of(derived.nodes(spark, d))
    return reports.symbols_report(derived.graph(spark, d), s, filters={"kind": {"equals": "class"}, "file_path": {"startsWith": "cust/r2/"}}).select("id", "name", "kind", "file_path")


@query("SELECT DISTINCT src AS id, src_file AS file_path FROM line WHERE dst = (SELECT min(id) FROM prt) AND kind = 'call'")
def symbols_related(spark, d):
    g = derived.graph(spark, d)
    part = derived.parts(spark, d).agg(F.min("id")).first()[0]
    r = derived.relations(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("from_node", "to_node", "to_symbol")})
    return reports.symbols_report(g, reports.symbols_of(g.nodes), r, related_to=part, edge_type="call").select("id", "file_path")


@query(f"""SELECT * FROM (SELECT 'declared' AS side, id AS item FROM nodes WHERE symbol_file = {_FIRST} ORDER BY CASE WHEN symbol_kind IN ('function', 'method') THEN 0 WHEN symbol_kind = 'class' THEN 1 WHEN symbol_kind IN ('constant', 'variable') THEN 3 ELSE 2 END, label, id LIMIT 25)
 UNION ALL (SELECT 'outgoing', dst FROM (SELECT DISTINCT src, dst FROM edges WHERE src = {_FIRST} OR src IN (SELECT id FROM nodes WHERE symbol_file = {_FIRST})) ORDER BY src, dst LIMIT 25)""")
def overview_edges(spark, d):
    g = derived.graph(spark, d)
    out = reports.overview_report(g, reports.symbols_of(g.nodes), _first_file(spark, d))
    return out["declared"].select(F.lit("declared").alias("side"), F.col("id").alias("item")).union(out["outgoing"].select(F.lit("outgoing"), "to"))


@query("""SELECT id, CASE WHEN n > 1 THEN base || ':' || n ELSE base END AS canonical_id FROM (
  SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM (SELECT id, o_orderkey, file || '#' || kind || ':' || kind ||
   CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ':f(a%2C%20b)' ELSE ':g!%C3%A9~' || o_orderkey % 5 END AS base FROM ordr))""")
def canonical_symbol_ids(spark, d):
    # two thirds have a signature, which tells overloads apart
    n = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    signature = F.when(n % 3 == 1, "f(a, b)").when(n % 3 == 2, F.concat(F.lit("g!é~"), n % 5))
    s = reports.symbols_of(derived.nodes(spark, d)).withColumn("signature", signature).withColumn("name", F.col("kind"))
    return reports.occurrence_ids(s).select("id", "canonical_id")


@query("""SELECT name, file_path FROM (SELECT 'ns' || (l_suppkey % 50) AS name, prt.id AS file_path, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY n DESC, length(prt.id), prt.id) AS nth
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN prt ON p_partkey = l_partkey JOIN (SELECT dst, count(*) AS n FROM line WHERE kind = 'import' GROUP BY 1) i ON i.dst = prt.id) WHERE nth = 1""")
def canonical_namespace(spark, d):
    ps = derived.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    ps = ps.join(derived.parts(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    s = ps.select(F.concat(F.lit("ns"), (F.col("l_suppkey") % 50)).alias("name"), F.col("id").alias("file_path"), F.lit("namespace").alias("kind"))
    r = derived.relations(spark, d).withColumn("kind", F.when(F.col("kind") == "import", "include").otherwise(F.col("kind"))).withColumn("resolved_path", F.lit(None).cast("string"))
    return project.canonical_namespaces(s, project.incoming_includes(r)).select("name", "file_path")


@query("""WITH RECURSIVE chain AS (SELECT c_custkey AS ord, c_custkey AS f, 0 AS hops FROM customer WHERE c_custkey > 0 UNION ALL SELECT ord, f // 2, hops + 1 FROM chain WHERE f > 1)
 SELECT ord, 'f1#n' || max(hops) AS symbol FROM chain GROUP BY ord HAVING count(*) FILTER (WHERE f % 7 = 0) = 0""", graph=False)
def reexport_resolution(spark, d):
    # file k takes name n<i> from file k // 2 under the name n<i + 1>, down to file 1, which declares all; every fifth file
    # is also in a cycle that passes all names on; every seventh passes them to a file that declares all names as well
    c = derived.table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("k"))
    f = lambda x: F.concat(F.lit("f"), x.cast("long").cast("string"))
    k, i, null = F.col("k"), F.col("i"), F.lit(None).cast("string")
    steps = c.where("k > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40))))
    exports = steps.select(f(k).alias("file"), F.concat(F.lit("n"), "i").alias("name"), f(F.floor(k / 2)).alias("to_file"), F.concat(F.lit("n"), i + 1).alias("to_name"))
    loops = c.where("k > 1 and k % 5 = 0")
    g = F.concat(F.lit("g"), "k")
    exports = exports.union(loops.select(f(k), null, g, null)).union(loops.select(g, null, f(k), null))
    exports = exports.union(c.where("k % 7 = 0").select(f(k), null, F.lit("other"), null))
    every = spark.range(42).select(F.concat(F.lit("n"), "id").alias("name"))
    symbols = every.select(F.lit("f1").alias("file_path"), "name", F.concat(F.lit("f1#"), "name").alias("id")).union(every.select(F.lit("other"), "name", F.concat(F.lit("other#"), "name")))
    return project.through_reexports(c.select(k.alias("ord"), f(k).alias("file"), F.lit("n0").alias("name")), exports, symbols)


@query("""SELECT l.ord, o.sym AS target_symbol FROM line l JOIN (SELECT file, kind, min(id) AS sym FROM ordr GROUP BY 1, 2 HAVING count(*) = 1) o ON o.file = l.src_file AND o.kind = 'class'""")
def unique_target_symbol(spark, d):
    s = reports.symbols_of(derived.nodes(spark, d)).withColumn("name", F.col("kind"))
    r = derived.lines(spark, d).select("ord", F.col("src_file").alias("to_file"), F.lit(None).cast("string").alias("to_symbol"), F.create_map(F.lit("memberName"), F.lit("class")).alias("metadata"), F.lit("other").alias("specifier"))
    return project.unique_targets(r, s)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'site/' || page_id WHEN spec LIKE '/%' THEN NULL ELSE 'pkg:' || split_part(spec, '/', 1) END AS target
 FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS spec FROM pages) WHERE CASE WHEN page_id % 3 = 0 THEN page_id % 2 = 0 ELSE spec <> '' END""", graph=False)
def connection_targets(spark, d):
    # a third of the links is resolved, to a file that is known for even ids; the others name a package
    pages = derived.table(spark, d, "pages")
    path = F.concat(F.lit("site/"), "page_id")
    p = pages.select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("specifier"), F.when(F.col("page_id") % 3 == 0, path).alias("resolved_path"), F.lit(None).cast("string").alias("to_file"))
    return project.with_targets(p, pages.where("page_id % 2 = 0").select(path.alias("path"))).select("page_id", "target")


@query("SELECT src || '->' || dst || '#' || kind AS id, src, dst, kind, ord FROM fedges")
def file_endpoint_projection(spark, d):
    return file_edges(derived.graph(spark, d)).select("id", "src", "dst", "kind", "ord")


@query(""", und AS (SELECT src AS id, dst AS o FROM edges UNION SELECT dst, src FROM edges), dg AS (SELECT id, count(*) AS degree FROM und GROUP BY 1)
 SELECT id, coalesce(degree, 0) AS degree, round(greatest(8.0, least(30.0, 3 * sqrt(coalesce(degree, 0) + 1))), 6) AS size FROM nodes LEFT JOIN dg USING (id)""")
def degree_sizes(spark, d):
    g = derived.graph(spark, d)
    return reports.node_sizes(g.nodes, g.edges).withColumn("size", F.round("size", 6))


@query(""", span AS (SELECT min(ln(1 + file_size)) AS a, max(ln(1 + file_size)) AS b FROM nodes)
 SELECT id, file_size, round(CASE WHEN file_size IS NULL THEN 20.0 ELSE 10 + (ln(1 + file_size) - a) / (b - a) * 20 END, 6) AS size FROM nodes, span""")
def file_size_sizes(spark, d):
    return reports.file_sizes(derived.nodes(spark, d)).withColumn("size", F.round("size", 6))


@query("SELECT path, count(*) AS relations FROM (SELECT src_file AS path FROM line UNION ALL SELECT dst FROM line) GROUP BY 1")
def relation_counts_per_file(spark, d):
    return reports.relation_counts(derived.relations(spark, d))


@query(""", e AS (SELECT src, dst FROM edges WHERE kind = 'type-import' UNION ALL SELECT dst, src FROM edges WHERE kind = 'type-import' AND ord % 2 = 0)
 SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT src) = 2 AS "both" FROM e GROUP BY 1, 2""")
def bidirectional_edges(spark, d):
    e = derived.edges(spark, d).where("kind = 'type-import'").select("src", "dst", "kind", "ord")
    e = e.union(e.where("ord % 2 = 0").select("dst", "src", "kind", "ord")).withColumn("id", F.concat("src", F.lit("->"), "dst", F.lit("#"), "kind"))
    return visible.bidirectional(e).select("a", "b", "both")


# ------------------------------------------------------------------ text

_PATHS = "WITH t AS (SELECT 'src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents)"
_STOP = ", ".join(f"'{w}'" for w in SEARCH_STOP)


_TOKEN_SQL = r"regexp_extract_all(lower(regexp_replace(content, '([\p{Ll}\d])(\p{Lu})', '\1 \2', 'g')), '[\p{L}\d]+')"


@query(_PATHS + rf" SELECT w AS term, count(DISTINCT path) AS df FROM (SELECT path, unnest({_TOKEN_SQL}) AS w FROM t) WHERE length(w) > 1 AND w NOT IN ({_STOP}) GROUP BY 1", graph=False)
def doc_frequency(spark, d):
    t = derived.source_text(spark, d).select("path", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


@query(_PATHS + rf""", k AS (SELECT path, {_TOKEN_SQL} AS w FROM t)
 SELECT path, CAST(least(10, len(list_filter(w, lambda x: x = 'thing'))) + least(10, len(list_filter(w, lambda x: x = 'ention'))) AS BIGINT) AS score FROM k WHERE list_contains(w, 'thing') AND list_contains(w, 'ention')""", graph=False)
def phrase_rank(spark, d):
    return search.phrase_documents(derived.source_text(spark, d), "thing ention")


#: Lines of texts in which a pattern is found, as the search report shows them.
_LINES = _PATHS + r""", l AS (SELECT path, unnest(range(0, len(string_split(content, chr(10))))) AS n, unnest(string_split(content, chr(10))) AS said FROM t)
 SELECT path, CAST(n + 1 AS BIGINT) AS line, CAST(a + 1 AS BIGINT) AS "column", CASE WHEN length(said) <= 240 THEN said ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END)
   || substr(said, CAST(s + 1 AS BIGINT), CAST(least(length(said), s + CASE WHEN s > 0 THEN 238 ELSE 239 END) - s AS BIGINT)) || (CASE WHEN s + CASE WHEN s > 0 THEN 238 ELSE 239 END < length(said) THEN '…' ELSE '' END) END AS excerpt,
   CAST(CASE WHEN regexp_matches(lower(path), '(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)') THEN 3 WHEN regexp_matches(lower(path), '{words}') THEN 4 ELSE 6 END AS INT) AS "rank"
  FROM (SELECT *, greatest(0, least(a - 80, length(said) - 240)) AS s FROM (SELECT path, n, said, {at} - 1 AS a FROM l WHERE {found}))"""


def _found_lines(found):
    return found.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "excerpt", "rank")


@query(_LINES.format(words="lic|nse", at="instr(lower(said), regexp_extract(lower(said), 'lic.*nse'))", found="regexp_matches(lower(said), 'lic.*nse')"), graph=False)
def text_search_wildcard(spark, d):
    return _found_lines(search.text_matches(derived.source_text(spark, d), "lic*nse"))


@query(_LINES.format(words="apache", at="instr(lower(said), 'apache')", found="contains(lower(said), 'apache')"), graph=False)
def text_search_postings(spark, d):
    """The texts that hold a pattern's grams are found first; the lines of these alone are looked at."""
    text = derived.source_text(spark, d)
    near = search.holding(search.postings(text), "Apache")
    return _found_lines(search.text_matches(text.join(near, "path", "left_semi"), "Apache"))


@query(_LINES.format(words="license", at="instr(lower(said), 'license')", found="contains(lower(said), 'license')"), graph=False)
def text_search_lines(spark, d):
    return search.text_matches(derived.source_text(spark, d), "license").select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "excerpt", "rank")


@query("SELECT id, file_path, nth FROM (SELECT id, file AS file_path, row_number() OVER (PARTITION BY file ORDER BY 'o' || o_orderkey, id) AS nth FROM ordr) WHERE nth <= 3")
def top_symbols_per_file(spark, d):
    s = reports.symbols_of(derived.nodes(spark, d))
    return task_map.top_symbols(s, ["cleanup", "order"]).select("id", "file_path", F.col("nth").cast("long").alias("nth"))


def _documents(spark, d) -> tuple[Graph, DataFrame]:
    """Documents as files; those of a source link to those with the next number."""
    t = derived.source_text(spark, d)
    f = t.select(F.col("path").alias("id"), F.lit("file").alias("node_type"), F.lit(None).cast("string").alias("symbol_file"))
    n = derived.table(spark, d, "documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"))
    e = n.join(n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst")), "doc_id")
    e = e.select(F.col("path").alias("src"), "dst", F.lit("import").alias("kind"), F.concat("path", F.lit("->"), "dst", F.lit("#import")).alias("id"), F.col("doc_id").alias("ord"))
    return Graph(f, e), t


# ------------------------------------------------------------------ cache, changes, style


@query("SELECT 'src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS content_hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents", graph=False)
def content_hashes(spark, d):
    return cache.fingerprints(derived.source_text(spark, d))


@query("""SELECT 'src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change
 FROM documents WHERE CASE WHEN doc_id % 11 = 0 THEN doc_id % 7 <> 0 ELSE doc_id % 7 = 0 OR doc_id % 5 = 0 END""", graph=False)
def content_hash_changes(spark, d):
    every = cache.fingerprints(derived.source_text(spark, d)).withColumn("n", F.regexp_extract("path", r"doc_(\d+)", 1).cast("long"))
    before = every.where("n % 7 <> 0").withColumn("content_hash", F.when(F.col("n") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return cache.changed(before.drop("n"), every.where("n % 11 <> 0").drop("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'import') AS imports FROM edges WHERE NOT starts_with(src, 'cust/r1/') ")
def incremental_patch(spark, d):
    e = derived.edges(spark, d)
    gone = derived.customers(spark, d).where(F.col("id").startswith("cust/r1/")).select(F.col("id").alias("path"))
    return cache.patched(e.withColumn("path", F.substring_index("src", "#", 1)), gone, None).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "import").alias("imports"))


@query("""SELECT 'f' || user_id AS path, arg_max(CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END, (ts, event_id)) AS type, count(*) AS events FROM events GROUP BY 1""", graph=False)
def latest_change_per_path(spark, d):
    return live.coalesced(derived.changes(spark, d))


@query("""SELECT path, count(*) AS batches, max(n) AS largest FROM (SELECT path, s, count(*) AS n FROM (
  SELECT path, sum(g) OVER (PARTITION BY path ORDER BY ts, event_id) AS s FROM (SELECT 'f' || user_id AS path, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1""", graph=False)
def debounce_sessions(spark, d):
    s = live.sessions(derived.changes(spark, d), "6 hours")
    return s.groupBy("path").agg(F.count("*").alias("batches"), F.max("events").alias("largest"))


@query("""SELECT id, CASE WHEN regexp_matches(id, '(?:^|/)r1/[^/]*/c[^/]*$') THEN '#ff0000' WHEN symbol_kind = 'class' THEN '#00ff00' WHEN starts_with(id, 'part/') OR contains(id, '/part/') THEN '#0000ff' ELSE '#888888' END AS color FROM nodes""")
def legend_color(spark, d):
    rules = [style.Rule(pattern="r1/*/c*", color="#ff0000"), style.Rule(kind="class", color="#00ff00"), style.Rule(pattern="part/**", color="#0000ff")]
    return derived.nodes(spark, d).select("id", style.color(rules, "#888888").alias("color"))


@query("""SELECT 'f' || user_id AS id, arg_max(event_type, (value, event_id)) FILTER (WHERE event_type <> 'view') AS color, count(*) AS sections FROM events GROUP BY 1""", graph=False)
def decorations_merge(spark, d):
    e = derived.table(spark, d, "events").select(F.concat(F.lit("f"), "user_id").alias("id"), F.struct(F.col("value"), F.col("event_id")).alias("priority"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("color"), F.array("event_type").alias("tooltip"))
    return style.merged(e, ["color"]).select("id", "color", F.size("tooltip").cast("long").alias("sections"))


@query("SELECT 'edge_source' AS constraint_, count(*) AS violations FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE symbol_file IS NULL) UNION ALL SELECT 'edge_target', count(*) FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE symbol_file IS NULL) UNION ALL SELECT 'node_key', count(*) FROM (SELECT id FROM (SELECT id FROM nodes WHERE symbol_file IS NULL UNION ALL SELECT id FROM nodes WHERE symbol_file IS NULL AND ord % 4 = 0) GROUP BY id HAVING count(*) > 1)")
def fk_check(spark, d):
    g = derived.graph(spark, d)
    files = g.nodes.where("symbol_file is null")
    return cache.violations(Graph(files.unionByName(files.where("ord % 4 = 0")), g.edges)).withColumnRenamed("check", "constraint_")


@query("SELECT 'edge' AS \"of\", kind AS type, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'node', coalesce(node_type, 'file'), count(*) FROM nodes GROUP BY ALL")
def observed_types(spark, d):
    return reports.observed(derived.graph(spark, d))


@query("""SELECT id, round(CASE WHEN n = 1 THEN 0.0 ELSE (CASE WHEN i = n - 1 THEN 0.5 ELSE -0.5 + i * 1.0 / (n - 1) END) END * CASE WHEN src = l THEN 1 ELSE -1 END, 6) + 0.0 AS curvature, ord FROM (
  SELECT id, src, ord, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS n,
   last_value(src) OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM edges WINDOW w AS (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord, id))""")
def parallel_links(spark, d):
    return visible.fan_out(derived.edges(spark, d)).select("id", (F.round("curvature", 6) + 0.0).alias("curvature"), "ord")
