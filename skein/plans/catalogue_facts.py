"""More registered queries: facts before the graph, scopes, and the reports that iterate, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.export import documents
from skein.functions import style
from skein.functions.ordering import page_row
from skein.functions.text import TASK_STOP, query_tokens, roots
from skein.graph import Graph, dealt
from skein.operators import facts, project, refresh, traverse, visible
from skein.operators.scope import NodeType, Scope, expanded
from skein.operators.visible import View
from skein.plans import reports, search, task_map
from skein.plans.catalogue import _FIRST, _FOLDERS, _NESTS, _PATHS, _PROJECTED, _SPECIFIC, _documents, _first_file, _joined, query
from skein.sources import derived
from skein.streaming import live

# ------------------------------------------------------------------ the visible graph as a whole

_VIEW = View(
    scope=Scope(nodes={"folder": True, "variable": False, "symbol:class": False}, edges={"reference": False}),
    patterns=("cust/r1/**", "call"), query="2", show_orphans=False, collapsed=("cust/r2", "part"),
)
_SHOWN = (
    _PROJECTED
    + _SPECIFIC.format(edges="(SELECT * FROM proj WHERE kind <> 'reference')", nodes="vis")
    + _FOLDERS
    + _NESTS
    + """
, all_nodes AS (SELECT id, label, symbol_name, symbol_kind, symbol_file FROM vis UNION ALL SELECT id, regexp_extract(id, '[^/]*$'), NULL, NULL, NULL FROM folders),
 all_edges AS (SELECT id, src, dst, kind FROM spec UNION ALL SELECT src || '->' || dst || '#nests', src, dst, 'nests' FROM nest),
 found AS (SELECT *, coalesce(symbol_file, id) AS path FROM all_nodes WHERE id <> 'cust/r1' AND NOT starts_with(id, 'cust/r1/') AND NOT coalesce(starts_with(symbol_file, 'cust/r1/'), false)
   AND contains(concat_ws(' ', label, id, symbol_name, symbol_kind, symbol_file), '2')),
 kept AS (SELECT * FROM all_edges WHERE kind <> 'call' AND src IN (SELECT id FROM found) AND dst IN (SELECT id FROM found)),
 linked AS (SELECT * FROM found WHERE id IN (SELECT src FROM kept UNION SELECT dst FROM kept)),
 owner AS (SELECT id, CASE WHEN starts_with(path, 'cust/r2/') AND 'cust/r2' IN (SELECT id FROM linked) THEN 'cust/r2' WHEN starts_with(path, 'part/') AND 'part' IN (SELECT id FROM linked) THEN 'part' END AS owner FROM linked),
 gone AS (SELECT coalesce(a.owner, src) AS s, coalesce(b.owner, dst) AS t, kind, a.owner IS NOT NULL OR b.owner IS NOT NULL AS mv FROM kept JOIN owner a ON a.id = src JOIN owner b ON b.id = dst)"""
)


@query(_SHOWN + "SELECT DISTINCT s || '->' || t || '#' || kind AS id, s AS src, t AS dst, kind FROM gone WHERE NOT mv OR s <> t")
def visible_pipeline(spark, d):
    return visible.visible(derived.graph(spark, d), _VIEW)[0].edges.select("id", "src", "dst", "kind")


@query(_SHOWN + "SELECT id, (SELECT count(*) FROM owner h WHERE h.owner = o.id) AS hidden FROM owner o WHERE owner IS NULL")
def visible_pipeline_nodes(spark, d):
    return visible.visible(derived.graph(spark, d), _VIEW)[0].nodes.select("id", F.coalesce("hidden", F.lit(0)).cast("long").alias("hidden"))


@query("SELECT id FROM nodes WHERE regexp_matches(concat_ws(' ', label, id, symbol_name, symbol_kind, symbol_file), '(?i)n1/C[0-9]+#')")
def search_named_group(spark, d):
    # a named group as Java spells it; Python's engine would refuse it
    return visible.search(derived.graph(spark, d), r"(?<n>n1)/C\d+#", regex=True)[0].nodes.select("id")


# ------------------------------------------------------------------ scopes

_TYPES = (NodeType("plugin:shop:big", "symbol:function", kinds=("method",), file_path="cust/r3/**"), NodeType("plugin:shop:any", "plugin:shop:big", kinds=("class",), file_path="cust/r0/**"))


@query("""SELECT id FROM nodes WHERE symbol_kind IN ('function', 'method') OR starts_with(symbol_file, 'cust/r0/') AND symbol_kind = 'class'""")
def projected_types(spark, d):
    return reports.scoped(derived.graph(spark, d), ["symbol:function"], types=_TYPES).nodes.select("id")


@query("SELECT id, coalesce(node_type, 'file') AS type FROM nodes WHERE symbol_kind IN ('function', 'method') OR symbol_kind IS NULL")
def expanded_types(spark, d):
    # files, and the symbols that a question about methods covers
    names = expanded(["file", "symbol:method"])
    kinds = [t.removeprefix("symbol:") for t in names if t.startswith("symbol:")]
    n = derived.nodes(spark, d).where(F.col("symbol_kind").isNull() | F.col("symbol_kind").isin(kinds))
    return n.select("id", F.coalesce("node_type", F.lit("file")).alias("type"))


# ------------------------------------------------------------------ facts


def _relations(spark, d):
    """Relations of line items: a third leads to a file, a third to a resolved path, a third to an order's symbol."""
    r = derived.relations(spark, d).drop("from_symbol")
    part = F.col("ord") % 3
    return r.select(
        "kind", F.when(part > 0, F.col("plugin_id")).alias("plugin_id"), "source_id", "from_file", F.when(part == 0, F.col("to_file")).alias("to_file"),
        F.when(part == 1, F.col("to_file")).alias("resolved_path"), F.lit(None).cast("string").alias("to_node"),
        F.when(F.col("ord") % 2 == 0, F.concat("from_file", F.lit("#from"))).alias("from_symbol"),
        F.when(part == 2, F.concat("to_file", F.lit("#to"))).alias("to_symbol"), "ord",
    )


@query("SELECT ord FROM line WHERE ord % 3 = 0 OR l_linestatus = 'F'")
def active_plugin_facts(spark, d):
    return facts.of_active_plugins(_relations(spark, d), ["F"]).select("ord")


@query(""", ok AS (SELECT id FROM nodes WHERE symbol_file IS NULL AND ord % 10 < 7), sym AS (SELECT id || '#to' AS id, id AS file FROM prt WHERE p_partkey % 2 = 0)
 SELECT ord FROM line LEFT JOIN sym ON ord % 3 = 2 AND sym.id = dst || '#to' WHERE src_file IN (SELECT id FROM ok) AND (CASE WHEN ord % 3 = 2 THEN file IS NULL OR file IN (SELECT id FROM ok) ELSE dst IN (SELECT id FROM ok) END)""")
def facts_of_files(spark, d):
    # seven tenths of the files are allowed; every other part declares the symbol that relations name
    files = derived.nodes(spark, d).where("symbol_file is null and ord % 10 < 7").select(F.col("id").alias("path"))
    symbols = derived.parts(spark, d).where("p_partkey % 2 = 0").select(F.concat("id", F.lit("#to")).alias("id"), F.col("id").alias("file_path"))
    return facts.of_files(symbols, _relations(spark, d), files)[1].select("ord")


@query("SELECT ord, NULL AS from_symbol FROM line WHERE ord % 2 = 1 AND ord % 3 <> 2 OR ord % 2 = 0 AND ord % 3 <> 2")
def facts_without_symbols(spark, d):
    return facts.without_symbols(_relations(spark, d)).select("ord", "from_symbol")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://example.com/') THEN substr(url, 21) ELSE url END AS path FROM pages", graph=False)
def relative_paths(spark, d):
    said = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return derived.table(spark, d, "pages").select("page_id", facts.relative(said, "https:\\\\example.com/").alias("path"))


@query("""SELECT id, CASE WHEN symbol_kind = 'class' AND ord % 2 = 0 THEN 'plugin:shop:class' WHEN symbol_kind = 'variable' THEN 'variable:plain' WHEN symbol_kind IN ('function', 'method', 'class') THEN 'symbol:' || symbol_kind ELSE node_type END AS type
 FROM nodes WHERE symbol_kind IS NOT NULL""")
def stored_types(spark, d):
    types = (NodeType("symbol:function", "symbol"), NodeType("symbol:method", "symbol"), NodeType("symbol:class", "symbol"), NodeType("variable:plain", "variable"), NodeType("plugin:shop:class", "symbol", kinds=("class",), source="shop"))
    s = derived.nodes(spark, d).where("symbol_kind is not null").withColumn("kind", F.col("symbol_kind")).withColumn("plugin_id", F.when(F.col("ord") % 2 == 0, "shop"))
    return s.select("id", facts.stored_type(F.col("node_type"), types).alias("type"))


@query("""SELECT s.o_orderkey AS symbol, n.id AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY o_orderkey DESC) AS nth FROM ordr WHERE o_orderkey % 4 > 0) s
 JOIN (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY o_orderkey) AS nth FROM ordr) n ON n.file = s.file AND n.kind = s.kind AND n.nth = s.nth""")
def paired_symbols(spark, d):
    # all orders of a kind in a file are one identity; three quarters are facts, in the opposite order
    n = derived.nodes(spark, d).where("symbol_kind is not null").withColumn("symbol_name", F.lit("same"))
    key = F.regexp_extract("label", r"(\d+)", 1).cast("long")
    s = n.where(key % 4 > 0).select(key.alias("id"), F.col("symbol_file").alias("file_path"), F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"), "signature", (-F.col("ord")).alias("ord"))
    return facts.paired(s, n).select(F.col("id").alias("symbol"), "node_id")


@query("""SELECT 'before' AS side, c_custkey % 50 AS k, count(*) AS n FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 5 = 0 GROUP BY ALL UNION ALL SELECT 'now', c_custkey % 50, count(*) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 > 0 GROUP BY ALL""", graph=False)
def discovery_difference(spark, d):
    c = derived.table(spark, d, "customer").select("c_custkey")
    out = facts.difference(c.where("c_custkey % 7 > 0"), c.where("c_custkey % 5 > 0"))
    return out.groupBy("side", (F.col("c_custkey") % 50).alias("k")).agg(F.count("*").alias("n"))


@query(""", few AS (SELECT id FROM nodes WHERE ord % 3 > 0) SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM nodes WHERE symbol_file IS NULL) THEN 'file' ELSE 'symbol' END AS node_type
 FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM few)""")
def synthesised_endpoints(spark, d):
    n = derived.nodes(spark, d)
    files = n.where("symbol_file is null").select(F.col("id").alias("path"))
    return facts.endpoint_nodes(derived.edges(spark, d), n.where("ord % 3 > 0"), files).select("id", "node_type")


# ------------------------------------------------------------------ symbols, sizes, colours, pages


@query("""SELECT id, 'l' || o_orderkey % 3 AS language, CASE WHEN o_orderkey % 2 = 0 THEN 'shop' END AS source FROM ordr WHERE contains(lower(concat_ws(' ', id, file, 'o' || o_orderkey, kind, '', 'l' || o_orderkey % 3, CASE WHEN o_orderkey % 2 = 0 THEN 'shop' ELSE '' END, '')), 'class  l1 shop')""")
def symbol_fields(spark, d):
    key = F.regexp_extract("label", r"(\d+)", 1).cast("long")
    n = derived.nodes(spark, d).withColumn("language", F.concat(F.lit("l"), key % 3)).withColumn("source", F.when(key % 2 == 0, "shop"))
    s = reports.symbols_of(n)
    return reports.symbols_report(Graph(n, derived.edges(spark, d)), s, query="class  L1 Shop").select("id", "language", "source")


@query(""", v AS (SELECT id FROM nodes WHERE ord % 4 > 0), e AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)), n AS (SELECT id, count(*) AS links FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
 SELECT id, coalesce(links, 0) AS links FROM v LEFT JOIN n USING (id)""")
def link_degrees(spark, d):
    g = derived.graph(spark, d)
    return reports.link_degrees(g.edges, g.nodes.where("ord % 4 > 0"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '#' || upper(h) ELSE '#FFFFFF' END AS color FROM (SELECT event_id, lpad(CAST(user_id % 10 AS VARCHAR), 6, 'a1') AS h FROM events)""", graph=False)
def hex_colors(spark, d):
    # six digits with the sign are a colour; three, or none of it, or more, are not
    h = F.lpad((F.col("user_id") % 10).cast("string"), 6, "a1")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" #"), h)).when(F.col("event_id") % 4 == 1, h).when(F.col("event_id") % 4 == 2, F.concat(F.lit("#"), F.substring(h, 1, 3)))
    return derived.table(spark, d, "events").select("event_id", style.hex_color(said, "#FFFFFF").alias("color"))


@query("SELECT id, CASE WHEN coalesce(node_type, 'file') = 'variable' THEN '#111111' WHEN ord % 2 = 0 THEN '#222222' ELSE '#333333' END AS color FROM nodes")
def type_colors(spark, d):
    own = F.when(F.col("ord") % 2 == 0, "#222222").otherwise("")
    return derived.nodes(spark, d).select("id", style.type_color({"variable": "#111111", "route": "#444444"}, own, "#555555", "#666666", "#333333").alias("color"))


@query('SELECT CAST(100 AS BIGINT) AS "offset", CAST(50 AS BIGINT) AS "limit", count(*) AS total, CAST(least(50, count(*) - 100) AS BIGINT) AS returned, CAST(CASE WHEN count(*) > 150 THEN 150 END AS BIGINT) AS next_offset FROM nodes WHERE symbol_file IS NULL')
def page_metadata(spark, d):
    return page_row(reports.nodes_report(derived.graph(spark, d)), 100, 50)


@query("SELECT DISTINCT src || '->' || dst || '#' || kind AS id, concat_ws(',', CASE WHEN kind = 'call' THEN 'calls' END, CASE WHEN regexp_matches(dst, '^part/Brand1[0-9]/p[^/]*5$') AND kind = 'call' THEN 'some' END) AS legends FROM edges")
def edge_legends(spark, d):
    e = derived.edges(spark, d).select("id", "src", "dst", "kind")
    out = e.select("id", F.array_join(style.legend_ids({"calls": "call", "some": "**->part/Brand1[0-9]/p*5#call"}), ",").alias("legends"))
    return dealt(out, derived.edges_at_most(spark, d), "id").distinct()


@query("SELECT kind, count(*) AS n, CASE kind WHEN 'call' THEN '#111111' WHEN 'import' THEN '#222222' ELSE '#999999' END AS color FROM edges GROUP BY ALL")
def edge_colors(spark, d):
    e = derived.edges(spark, d).select("kind", style.edge_color({"call": "#111111", "import": "#222222", "c*l": "#333333"}, "#999999").alias("color"))
    return e.groupBy("kind", "color").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[^./]\\.html$') THEN '#E34C26' ELSE '#A1A1AA' END AS color FROM pages", graph=False)
def file_colors(spark, d):
    p = derived.table(spark, d, "pages").withColumn("id", F.upper("url"))
    return p.select("page_id", style.extension_color({".html": "#E34C26", ".js": "#F1E05A"}, "#A1A1AA").alias("color"))


@query(""", und AS (SELECT src AS id, dst AS o FROM edges UNION SELECT dst, src FROM edges), dg AS (SELECT id, count(*) AS degree FROM und GROUP BY 1)
 SELECT id, CAST(floor(least(8 + 3 * sqrt(degree), 30.0) * 10 + 0.5) AS BIGINT) AS diameter FROM dg""")
def canvas_diameters(spark, d):
    return reports.degrees(derived.edges(spark, d)).select("id", style.canvas_diameter(F.col("degree")).cast("long").alias("diameter"))


@query(""", parts_ AS (SELECT DISTINCT regexp_replace(id, '/[^/]*$', '') AS id FROM cust), listed AS (SELECT id FROM parts_ UNION SELECT id || '/empty' FROM parts_ UNION SELECT 'new' )
 SELECT id, starts_with(id, 'cust/r2/n') AS ignored FROM listed WHERE NOT (id IN (SELECT id FROM parts_) AND NOT starts_with(id, 'cust/r2/n'))""")
def folder_nodes(spark, d):
    # folders of customers, each with an empty one below, and one more; those of a region are ignored
    own = derived.customers(spark, d).select(F.substring_index("id", "/", 3).alias("path")).distinct()
    listed = own.union(own.select(F.concat("path", F.lit("/empty")))).union(own.select(F.lit("new")))
    out = project.folder_nodes(listed, derived.nodes(spark, d), own.where(F.col("path").startswith("cust/r2/")))
    return out.select("id", "ignored")


@query("SELECT f.id AS path, coalesce(s.n, 0) AS symbols, coalesce(r.n, 0) AS relations FROM nodes f LEFT JOIN (SELECT file, count(*) AS n FROM ordr GROUP BY 1) s ON s.file = f.id LEFT JOIN (SELECT path, count(*) AS n FROM (SELECT src_file AS path FROM line UNION ALL SELECT dst FROM line) GROUP BY 1) r ON r.path = f.id WHERE symbol_file IS NULL")
def symbol_export(spark, d):
    n = derived.nodes(spark, d)
    return documents.symbol_export(n, reports.symbols_of(n), derived.relations(spark, d))


# ------------------------------------------------------------------ paths with expansion and projection

@query(f""", h1 AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE symbol_file = {_FIRST})), goal AS (SELECT min(dst) AS id FROM h1)
 SELECT DISTINCT {_FIRST} || '>' || goal.id AS path FROM goal""")
def projected_paths(spark, d):
    # from a file to a part that only its symbols lead to
    g = derived.graph(spark, d)
    bare = Graph(g.nodes, g.edges.where("kind <> 'contains'"))
    first = _first_file(spark, d)
    inside = g.nodes.where(F.col("symbol_file") == first).select(F.col("id").alias("src"))
    goal = bare.edges.join(inside, "src", "left_semi").agg(F.min("dst")).first()[0]
    out, _ = traverse.path_report(bare, first, goal, 4, 3, expand=True, project=True)
    return out.where(F.size("path") == 2).select(F.array_join("path", ">").alias("path"))


@query(f""", h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = {_FIRST}), goal AS (SELECT DISTINCT dst AS id FROM edges WHERE dst LIKE 'supp/%'), e AS (SELECT DISTINCT src, dst FROM edges)
 SELECT {_FIRST} || '>' || e1.dst || '>' || e2.dst || '>' || e3.dst AS path FROM e e1, e e2, e e3 WHERE e1.src = {_FIRST} AND e2.src = e1.dst AND e3.src = e2.dst AND e3.dst IN (SELECT id FROM goal)
 ORDER BY e1.dst, e2.dst, e3.dst LIMIT 40""")
def paths_within_budget(spark, d):
    # from a file to any supplier there are more paths than are asked for
    g = derived.graph(spark, d)
    goal = derived.suppliers(spark, d).select("id").join(g.edges.select(F.col("dst").alias("id")), "id", "left_semi")
    found, complete = traverse.paths(g.edges, _first_file(spark, d), goal, 3, 40)
    return found.where(F.lit(not complete)).select(F.array_join("path", ">").alias("path"))


# ------------------------------------------------------------------ changes of files


_BATCHES = """WITH RECURSIVE e AS (SELECT 'f' || user_id AS root, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS path, ts, event_id,
   row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id) AS i FROM (SELECT user_id, event_type, date_trunc('millisecond', ts) AS ts, event_id FROM events)),
 b AS (SELECT root, path, root AS type, ts, event_id, i, ts AS first, 1 AS k FROM e WHERE i = 1
   UNION ALL SELECT e.root, e.path, e.root, e.ts, e.event_id, e.i, CASE WHEN e.ts < least(b.ts + INTERVAL 6 HOUR, b.first + INTERVAL 24 HOUR) THEN b.first ELSE e.ts END,
     CASE WHEN e.ts < least(b.ts + INTERVAL 6 HOUR, b.first + INTERVAL 24 HOUR) THEN b.k ELSE b.k + 1 END FROM b JOIN e ON e.root = b.root AND e.i = b.i + 1) """


@query(_BATCHES + """SELECT root, epoch_ms(start) AS start, epoch_ms(flush) AS flush, path, arg_max(type, (ts, event_id)) AS type, count(*) AS events FROM (
 SELECT root, path, type, ts, event_id, first AS start, flush FROM b JOIN (SELECT root AS r, k AS kk, max(least(b.ts + INTERVAL 6 HOUR, b.first + INTERVAL 24 HOUR)) AS flush FROM b GROUP BY 1, 2) f ON f.r = b.root AND f.kk = b.k) t GROUP BY root, t.start, t.flush, path""",
 graph=False)
def debounced_batches(spark, d):
    # six hours of quiet, a day at most
    e = derived.changes(spark, d).select(F.col("path").alias("root"), F.col("type").alias("path"), F.col("path").alias("type"), "ts", "event_id")
    return live.batches(e, 6 * 3_600_000, 24 * 3_600_000).withColumns({c: F.unix_millis(c) for c in ("start", "flush")})


_ARRIVALS = """, asks AS (SELECT o_orderkey AS k, file AS f, 'f' || o_orderkey % 97 AS spec FROM ordr),
 tried AS (SELECT k, f, spec, i AS nth, 'part/x' || (o % 40) || '/' || spec AS path FROM (SELECT k, f, spec, unnest(range(0, 3)) AS i, k + 13 * unnest(range(0, 3)) AS o FROM asks)),
 every AS (SELECT DISTINCT path FROM tried), old AS (SELECT path FROM every WHERE ascii(right(path, 1)) % 3 <> 0), new AS (SELECT path FROM every WHERE ascii(right(path, 1)) % 4 <> 1),
 a AS (SELECT k, arg_min(path, nth) AS target FROM tried JOIN old USING (path) GROUP BY k), b AS (SELECT k, arg_min(path, nth) AS target FROM tried JOIN new USING (path) GROUP BY k)
 SELECT k, a.target AS before, b.target AS now FROM asks LEFT JOIN a USING (k) LEFT JOIN b USING (k) WHERE a.target IS DISTINCT FROM b.target"""


@query(_ARRIVALS)
def arrivals_and_departures(spark, d):
    # orders import by three paths in turn; some paths go, others come: only what would try them is resolved again
    o = derived.orders(spark, d).select(F.col("o_orderkey").alias("ord"), F.col("file").alias("from_file"), F.concat(F.lit("f"), F.col("o_orderkey") % 97).alias("specifier"))
    links = o.select("ord", F.lit("shop").alias("plugin_id"), F.concat("from_file", F.lit("/"), "ord").alias("from_file"), "specifier", F.create_map(F.lit("importedName"), F.col("ord").cast("string")).alias("metadata"))
    at = lambda i: F.concat(F.lit("part/x"), (F.col("metadata")["importedName"].cast("long") + 13 * i) % 40, F.lit("/"), F.col("specifier"))
    rules = {"shop": lambda: F.array(*[at(i) for i in range(3)])}
    tried = refresh.candidates(links, rules)
    every = tried.select("path").distinct()
    last = F.ascii(F.substring("path", -1, 1))
    old, new = every.where(last % 3 != 0), every.where(last % 4 != 1)
    before = refresh.resolved(links, tried, old)
    moved = facts.difference(old, new).select("path")
    asked = refresh.asked_again(tried, moved)
    again = links.join(asked.select("from_file").distinct(), "from_file", "left_semi")
    now = refresh.resolved(again, refresh.candidates(again, rules), new).select("ord", F.col("resolved_path").alias("now"))
    out = before.select("ord", F.col("resolved_path").alias("before")).join(now, "ord")
    return out.where(~F.col("before").eqNullSafe(F.col("now"))).withColumnRenamed("ord", "k")


@query("""SELECT id AS path FROM prt WHERE id NOT IN (SELECT dst FROM line WHERE ord % 1000 = 7)""")
def files_of_equal_facts(spark, d):
    # each part's facts are the line items that lead to it; some have another kind now, all come in another order
    lines = derived.lines(spark, d).select(F.col("dst").alias("file"), "src", "kind", "ord")
    changed = lines.withColumn("kind", F.when(F.col("ord") % 1000 == 7, "other").otherwise(F.col("kind"))).repartition(7, "ord")
    parts = derived.parts(spark, d).select(F.col("id").alias("path"))
    digest = lambda df: parts.join(refresh.fact_digests(df), F.col("path") == F.col("file"), "left").select("path", F.col("digest").alias("fact_digest"))
    return refresh.with_same_facts(digest(lines), digest(changed))


# ------------------------------------------------------------------ iterations: PageRank, task map


def _ranks_sql(steps: int = 20) -> str:
    """Common table expressions r0 to r<steps> from ``links`` (src, dst, w) and ``start0`` (id, weight)."""
    out = """, outw AS MATERIALIZED (SELECT src, sum(w) AS s FROM links GROUP BY 1 HAVING sum(w) > 0), share AS MATERIALIZED (SELECT l.src, dst, w / s AS p FROM links l JOIN outw USING (src)),
 start AS MATERIALIZED (SELECT id, CASE WHEN t > 0 THEN weight / t ELSE 1.0 / n END AS b, id NOT IN (SELECT src FROM outw) AS dangling FROM start0, (SELECT sum(weight) AS t, count(*) AS n FROM start0)),
 r0 AS MATERIALIZED (SELECT id, b AS r FROM start)"""
    for i in range(steps):
        out += f""",
 r{i + 1} AS MATERIALIZED (SELECT s.id, (0.15 + 0.85 * coalesce((SELECT sum(r) FROM r{i} JOIN start USING (id) WHERE dangling), 0)) * b + 0.85 * coalesce(g, 0) AS r FROM start s
   LEFT JOIN (SELECT dst AS id, sum(r * p) AS g FROM r{i} JOIN share ON src = id GROUP BY 1) USING (id))"""
    return out


@query(""", lk AS (SELECT src, dst, CASE WHEN kind IN ('call', 'reference') THEN 3.0 WHEN kind = 'type-import' THEN 1.0 ELSE 2.0 END AS w FROM fedges WHERE kind <> 'contains'),
 links AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM lk UNION ALL SELECT dst, src, w FROM lk) GROUP BY 1, 2),
 start0 AS MATERIALIZED (SELECT id, CAST(file_size AS DOUBLE) AS weight FROM nodes WHERE symbol_file IS NULL)""" + _ranks_sql() + """ SELECT id, round(r, 9) AS "rank" FROM r20""")
def pagerank_20(spark, d):
    g = derived.graph(spark, d)
    files = g.nodes.where("symbol_file is null").select("id", F.col("file_size").cast("double").alias("weight"))
    out = task_map.file_ranks(g, files)
    return out.select("id", F.round("rank", 9).alias("rank"))


def _forms(term: str) -> str:
    """A pattern of the words that are forms of a term's roots."""
    each = []
    for r in roots(term):
        verb = f"{r}d|{r[:-1]}ing" if r[-1] == "e" else f"{r}(?:ed|ing)" if r[-1] in "aiou" else f"{r}{r[-1]}?(?:ed|ing)"
        each.append(f"{r}s?|{verb}")
    return "|".join(each)


def _lexical_sql(question: str) -> str:
    """Common table expressions up to ``lex`` (path, score, matched), for questions of at most 16 terms."""
    terms = query_tokens(question, 3, TASK_STOP)
    plain = lambda c: rf"' ' || regexp_replace(lower(regexp_replace({c}, '([\p{{Ll}}\d])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\d]+', ' ', 'g') || ' '"
    hit = ", ".join(f"CASE WHEN regexp_matches(p, ' ({_forms(t)}) ') THEN 4 WHEN regexp_matches(t, ' ({_forms(t)}) ') THEN 1 ELSE 0 END AS h{i}" for i, t in enumerate(terms))
    used = ", ".join(f"count(*) FILTER (WHERE h{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN d{i} > 0 THEN h{i} * (ln((n + 1.0) / (d{i} + 1)) + 1) ELSE 0 END" for i in range(len(terms)))
    matched = "concat_ws(',', " + ", ".join(f"CASE WHEN h{i} > 0 THEN '{t}' END" for i, t in enumerate(terms)) + ")"
    return (
        f", norm AS (SELECT path, {plain('path')} AS p, {plain('content')} AS t FROM t), hits AS MATERIALIZED (SELECT path, {hit} FROM norm), used AS (SELECT count(*) AS n, {used} FROM hits)"
        f", lex AS MATERIALIZED (SELECT path, {score} AS score, {matched} AS matched FROM hits, used)"
    )


_QUESTION = "thing ention license during shining token"


@query(_PATHS + _lexical_sql(_QUESTION) + " SELECT path, round(score, 9) AS score, matched FROM lex", graph=False)
def lexical_score(spark, d):
    g, t = _documents(spark, d)
    out, _ = task_map.lexical(task_map.documents(g, t), _QUESTION)
    return out.select("path", F.round("score", 9).alias("score"), _joined("matched"))


_TASK = "apache license thing ention"
_TASK_SQL = (
    _PATHS
    + _lexical_sql(_TASK)
    + """, num AS (SELECT doc_id, 'src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source FROM documents),
 pair AS (SELECT a.path AS src, b.path AS dst FROM num a JOIN num b ON b.doc_id = a.doc_id + 1 WHERE a.path <> b.path),
 links AS MATERIALIZED (SELECT src, dst, sum(2.0) AS w FROM (SELECT * FROM pair UNION ALL SELECT dst, src FROM pair) GROUP BY 1, 2),
 start0 AS MATERIALIZED (SELECT path AS id, score AS weight FROM lex)"""
    + _ranks_sql()
    + """, near AS (SELECT path FROM lex WHERE score > 0 UNION SELECT dst FROM links JOIN lex ON src = path WHERE score > 0),
 both_ AS MATERIALIZED (SELECT path, score AS lexical, r, matched, greatest(max(score) OVER (), 1.0) AS ms, greatest(max(r) OVER (), 1.0 / count(*) OVER ()) AS mr FROM lex JOIN r20 ON path = id),
 sc AS (SELECT path, matched, lexical, lexical / ms * 0.85 + r / mr * 0.15 AS score, 'src/' || string_split(path, '/')[2] AS area FROM both_ WHERE path IN (SELECT path FROM near)),
 turn AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY lexical > 0 DESC, score DESC, lexical DESC, path) AS turn FROM sc),
 top AS (SELECT area, lexical AS fl, score AS fs FROM turn WHERE turn = 1),
 shown AS MATERIALIZED (SELECT path, score, matched FROM turn JOIN top USING (area) ORDER BY turn, fl > 0 DESC, fs DESC, fl DESC, area LIMIT 20)"""
)


@query(_TASK_SQL + " SELECT path, round(score, 6) AS score, matched FROM shown", graph=False)
def task_map_report(spark, d):
    g, t = _documents(spark, d)
    out, _ = task_map.task_map(g, t, _TASK, 20)
    return out.select("path", F.round("score", 6).alias("score"), _joined("matched"))


@query(_TASK_SQL + """ SELECT src AS "from", dst AS "to", 'import' AS edge_types FROM pair WHERE src IN (SELECT path FROM shown) AND dst IN (SELECT path FROM shown) ORDER BY src, dst LIMIT 12""", graph=False)
def task_map_relationships(spark, d):
    g, t = _documents(spark, d)
    out, _ = task_map.task_map(g, t, _TASK, 20)
    shown = [r["path"] for r in out.select("path").collect()]  # at most 20
    return task_map.map_relationships(g, shown).withColumn("edge_types", _joined("edge_types"))


# ------------------------------------------------------------------ search

_LINES = """, l AS (SELECT path, unnest(range(0, len(string_split(content, chr(10))))) AS n, unnest(string_split(content, chr(10))) AS said FROM t),
 m AS (SELECT *, greatest(0, least(a - 80, length(said) - 240)) AS s FROM (SELECT path, n, said, instr(lower(said), '{word}') - 1 AS a FROM l WHERE contains(lower(said), '{word}'))),
 texts AS (SELECT 'text' AS type, path AS id, CAST(n + 1 AS BIGINT) AS line, CAST(a + 1 AS BIGINT) AS "column", CASE WHEN length(said) <= 240 THEN said ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END)
   || substr(said, CAST(s + 1 AS BIGINT), CAST(least(length(said), s + CASE WHEN s > 0 THEN 238 ELSE 239 END) - s AS BIGINT)) || (CASE WHEN s + CASE WHEN s > 0 THEN 238 ELSE 239 END < length(said) THEN '…' ELSE '' END) END AS excerpt,
   CASE WHEN length('{word}') < 3 THEN 6 WHEN regexp_matches(lower(path), '(^|[^\\p{{L}}\\p{{N}}_]){word}([^\\p{{L}}\\p{{N}}_]|$)') THEN 3 WHEN contains(lower(path), '{word}') THEN 4 ELSE 6 END AS "rank" FROM m)
 SELECT 'symbol' AS type, id, NULL AS line, NULL AS "column", NULL AS excerpt, CASE WHEN lower(label) = '{word}' THEN 0 ELSE 2 END AS "rank" FROM nodes WHERE symbol_file IS NOT NULL AND contains(lower(label), '{word}')
 UNION ALL SELECT 'node', id, NULL, NULL, NULL, CASE WHEN lower(id) = '{word}' OR lower(label) = '{word}' THEN 1 ELSE 3 END FROM nodes WHERE symbol_file IS NULL AND (contains(lower(id), '{word}') OR contains(lower(label), '{word}'))
 UNION ALL SELECT type, id, line, "column", excerpt, "rank" FROM texts"""


def _search_sql(word: str) -> str:
    return ", t AS (" + _PATHS.split("AS (", 1)[1] + _LINES.format(word=word)


def _search_report(spark, d, word):
    g = derived.graph(spark, d)
    out = search.search_report(g.nodes, reports.symbols_of(g.nodes), derived.source_text(spark, d), word)
    return out.select("type", "id", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "excerpt", "rank")


@query(_search_sql("license"))
def search_report(spark, d):
    return _search_report(spark, d, "license")


@query(_search_sql("o12"))
def search_report_symbols(spark, d):
    return _search_report(spark, d, "O12")


@query(_search_sql("p12"))
def search_report_nodes(spark, d):
    return _search_report(spark, d, "p12")
