"""The graph that the driver's tables stand for: customers, suppliers and parts are files, orders are symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.schema import EDGE, NODE, edge_id

KINDS = {"1": "function", "2": "class", "3": "method", "4": "constant", "5": "variable"}
FLAGS = {"R": "call", "A": "reference", "N": "import"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _place(prefix: str, nation: str, letter: str, key: str):
    return F.concat(F.lit(f"{prefix}/r"), F.col("n_regionkey"), F.lit("/n"), F.col(nation), F.lit(f"/{letter}"), F.col(key))


def customers(spark, d) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(_place("cust", "c_nationkey", "c", "c_custkey").alias("id"), "c_custkey", "c_acctbal")


def suppliers(spark, d) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(_place("supp", "s_nationkey", "s", "s_suppkey").alias("id"), "s_suppkey", "s_acctbal")


def parts(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(_part_text().alias("id"), "p_partkey", "p_size")


def _part_text():
    return F.concat(F.lit("part/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("/p"), "p_partkey")


def _order_keys(spark, d) -> DataFrame:
    """What an order's texts are made of. Joins carry these keys; texts, which are several times as wide, are made after the last."""
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("_priority"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")


def _order_texts() -> dict:
    """file, kind and id of an order, from its keys."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("_priority")]
    file = _place("cust", "c_nationkey", "c", "c_custkey")
    return {"id": F.concat(file, F.lit("#o"), "o_orderkey", F.lit(":"), kind), "file": file, "kind": kind}


def orders(spark, d) -> DataFrame:
    """id, file, kind of each order's symbol."""
    text = _order_texts()
    return _order_keys(spark, d).select(*[text[c].alias(c) for c in ("id", "file", "kind")], "o_orderkey")


def nodes(spark, d) -> DataFrame:
    name = F.element_at(F.split("id", "/"), -1).alias("label")
    c = customers(spark, d).select("id", name, F.abs("c_acctbal").cast("long").alias("file_size"), F.col("c_custkey").alias("ord"))
    s = suppliers(spark, d).select("id", name, F.abs("s_acctbal").cast("long").alias("file_size"), (F.col("s_suppkey") + 10**10).alias("ord"))
    p = parts(spark, d).select("id", name, F.col("p_size").cast("long").alias("file_size"), (F.col("p_partkey") + 2 * 10**10).alias("ord"))
    o = orders(spark, d)
    o = o.select(
        "id",
        F.concat(F.lit("o"), "o_orderkey").alias("label"),
        F.when(F.col("kind").isin("constant", "variable"), "variable").otherwise("symbol").alias("node_type"),
        F.concat(F.lit("o"), "o_orderkey").alias("symbol_name"),
        F.col("kind").alias("symbol_kind"),
        F.col("file").alias("symbol_file"),
        (F.col("o_orderkey") + 3 * 10**10).alias("ord"),
    )
    out = _typed(c, NODE)
    for df in (s, p, o):
        out = out.unionByName(_typed(df, NODE))
    return out


def lines(spark, d) -> DataFrame:
    """Order, part and kind of each line item, with its place."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    # the order last: its keys don't travel with each line, and lines of one order leave side by side, so that the texts which
    # they share are packed well in the next shuffle
    li = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(_order_keys(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    text = _order_texts()
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus",
        F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])[F.col("l_returnflag")].alias("kind"),
        text["id"].alias("src"), text["file"].alias("src_file"), _part_text().alias("dst"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") + 10**12).alias("ord"),
    )


def edges(spark, d) -> DataFrame:
    o = orders(spark, d).select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.col("o_orderkey").alias("ord"))
    li = lines(spark, d).select("src", "dst", "kind", "ord")
    # dealt by part once, for the distinct pairs and the join; texts come last here too
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    ps = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    ps = ps.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ps = ps.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    ps = ps.select(
        _part_text().alias("src"), _place("supp", "s_nationkey", "s", "s_suppkey").alias("dst"), F.lit("type-import").alias("kind"),
        (F.col("l_partkey") * 10**7 + F.col("l_suppkey") + 2 * 10**15).alias("ord"),
    )
    out = o.unionByName(li).unionByName(ps)
    return _typed(out.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("kind"))), EDGE)


def edges_at_most(spark, d) -> int:
    """At least as many as there are edges: one for each order and two for each line, by the files' own counts."""
    return table(spark, d, "orders").count() + 2 * table(spark, d, "lineitem").count()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def relations(spark, d) -> DataFrame:
    """A relation for each line item: from an order and its file to a part."""
    return lines(spark, d).select(
        "kind", F.col("l_linestatus").alias("plugin_id"), F.lit("lineitem").alias("source_id"), F.col("src_file").alias("from_file"),
        F.col("dst").alias("to_file"), F.col("src").alias("from_symbol"), "ord",
    )


def source_text(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def changes(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select(F.concat(F.lit("f"), "user_id").alias("path"), kind.alias("type"), "ts", "event_id")


#: The same graph as common table expressions.
GRAPH_SQL = """
WITH cust AS (SELECT 'cust/r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS id, c_custkey, c_acctbal
              FROM customer JOIN nation ON c_nationkey = n_nationkey),
     supp AS (SELECT 'supp/r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey AS id, s_suppkey, s_acctbal
              FROM supplier JOIN nation ON s_nationkey = n_nationkey),
     prt AS (SELECT 'part/' || replace(p_brand, '#', '') || '/p' || p_partkey AS id, p_partkey, p_size FROM part),
     ordr AS (SELECT id || '#o' || o_orderkey || ':' || kind AS id, id AS file, kind, o_orderkey FROM (
                SELECT cust.id, o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'function' WHEN '2' THEN 'class'
                  WHEN '3' THEN 'method' WHEN '4' THEN 'constant' WHEN '5' THEN 'variable' END AS kind
                FROM orders JOIN cust ON o_custkey = c_custkey)),
     nodes AS (
       SELECT id, 'c' || c_custkey AS label, NULL AS symbol_name, NULL AS symbol_kind, NULL AS symbol_file, NULL AS node_type,
              CAST(trunc(abs(c_acctbal)) AS BIGINT) AS file_size, CAST(c_custkey AS BIGINT) AS ord FROM cust
       UNION ALL SELECT id, 's' || s_suppkey, NULL, NULL, NULL, NULL, CAST(trunc(abs(s_acctbal)) AS BIGINT), s_suppkey + 10000000000 FROM supp
       UNION ALL SELECT id, 'p' || p_partkey, NULL, NULL, NULL, NULL, CAST(p_size AS BIGINT), p_partkey + 20000000000 FROM prt
       UNION ALL SELECT id, 'o' || o_orderkey, 'o' || o_orderkey, kind, file,
              CASE WHEN kind IN ('constant', 'variable') THEN 'variable' ELSE 'symbol' END, NULL, o_orderkey + 30000000000 FROM ordr),
     line AS (SELECT ordr.id AS src, ordr.file AS src_file, prt.id AS dst, l_linestatus, l_orderkey * 100 + l_linenumber + 1000000000000 AS ord,
              CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'reference' WHEN 'N' THEN 'import' END AS kind
              FROM lineitem JOIN ordr ON l_orderkey = o_orderkey JOIN prt ON l_partkey = p_partkey),
     pairs AS (SELECT src, dst, kind, ord FROM (
       SELECT file AS src, id AS dst, 'contains' AS kind, o_orderkey AS ord FROM ordr
       UNION ALL SELECT src, dst, kind, ord FROM line
       UNION ALL SELECT prt.id, supp.id, 'type-import', l_partkey * 10000000 + l_suppkey + 2000000000000000
         FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN prt ON l_partkey = p_partkey JOIN supp ON l_suppkey = s_suppkey)),
     edges AS (SELECT src || '->' || dst || '#' || kind AS id, src, dst, kind, ord FROM pairs),
     fedges AS (SELECT coalesce(a.symbol_file, src) AS src, coalesce(b.symbol_file, dst) AS dst, kind, e.ord
                FROM edges e LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst
                WHERE coalesce(a.symbol_file, src) <> coalesce(b.symbol_file, dst))
"""
