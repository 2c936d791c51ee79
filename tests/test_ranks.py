"""Ranks in two levels and pages at any depth, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions.ordering import Pages, page_info, sort_by
from skein.graph import Bucketed, bucketed
from skein.operators import traverse
from skein.operators.project import canonical_namespaces
from skein.operators.ranks import ranked
from skein.operators.visible import fan_out


def plain_ranks(rows):
    groups = {}
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((order, value))
    return sorted((str(k), o, v, i, len(g), g[-1][1]) for k, g in groups.items() for i, (o, v) in enumerate(g, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    # a key of most rows lies across several ranges, another fills the end of one and goes on; null is a key
    rows = [(rng.choice(["hot"] * 12 + ["a", "b", "z", "y", None]), i, f"v{i}") for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v string")
    out = ranked(df, ["k"], ["o"], last="v")
    assert out.columns == ["k", "o", "v", "nth", "of", "_last"]
    assert sorted((str(r.k), r.o, r.v, r.nth, r["of"], r["_last"]) for r in out.collect()) == plain_ranks(rows)
    rows_ = [(r[0], r[1], r[2]) for r in rows if r[0] == "hot"]  # one key alone
    one = ranked(spark.createDataFrame(rows_, "k string, o long, v string"), ["k"], ["o"])
    assert sorted((r.o, r.nth, r["of"]) for r in one.collect()) == [(o, i, len(rows_)) for i, o in enumerate(sorted(r[1] for r in rows_), 1)]
    assert ranked(df.where("false"), ["k"], ["o"], last="v").count() == 0


def test_a_hot_key_is_in_several_tasks(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("o"))
    out = ranked(df, ["k"], ["o"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4000 * 0.8


def test_rows_of_common_keys_are_shuffled_once(spark):
    # one key is hot, and goes by ranges; the others take one window over what is written
    df = spark.range(6000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("o"))
    for rows, hot in ((df, True), (df.where("k >= 0"), False)):
        out = ranked(rows, ["k"], ["o"], last="o")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.o: (r.nth, r["of"], r["_last"]) for r in out.collect()}
        groups = {}
        for r in rows.orderBy("o").collect():
            groups.setdefault(r.k, []).append(r.o)
        assert got == {o: (i, len(g), g[-1]) for g in groups.values() for i, o in enumerate(g, 1)}
        assert ("ranges-" in plan) == hot
        if not hot:
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1


def test_pairs_with_many_links(spark):
    rows = [(f"e{i}", *(("a", "b") if i % 3 else ("b", "a")), "k", i) for i in range(101)] + [("x", "c", "d", "k", 7), ("l", "c", "c", "k", 8)]
    got = {r.id: r.curvature for r in fan_out(spark.createDataFrame(rows, "id string, src string, dst string, kind string, ord long")).collect()}
    assert len(got) == 103 and got["x"] == 0 and got["l"] == 0
    assert got["e100"] == 0.5  # the last of its pair
    for i in range(101):
        bend = -0.5 + i / 100
        same = (i % 3 != 0) == (100 % 3 != 0)
        assert got[f"e{i}"] == pytest.approx(bend if same else -bend)


def test_links_of_equal_order_and_without_an_end(spark):
    rows = [("z", "a", "b", "k", 1), ("b->a#k", "b", "a", "k", 1), (None, "a", "b", "k", 2), ("n", None, "b", "k", 3)]
    got = {(r.id, r.src, r.dst, r.curvature) for r in fan_out(spark.createDataFrame(rows, "id string, src string, dst string, kind string, ord long")).collect()}
    # the last of the pair is the one of the greatest ord; "b->a#k", whose id is not written, comes before "z"
    assert got == {("b->a#k", "b", "a", 0.5), ("z", "a", "b", 0.0), (None, "a", "b", 0.5), ("n", None, "b", 0.0)}


def test_pages_at_any_depth(spark):
    rng = random.Random(3)
    names = [f"{rng.choice('abcXYZ')}{rng.randrange(10**6)}" for _ in range(3000)]
    df = sort_by(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, i long").repartition(3), [], ["path", "i"])
    every = [r.path for r in df.collect()]
    pages = Pages(df)
    assert pages.total == 3000
    for offset, limit in ((0, 5), (1499, 700), (2990, 50), (3000, 5), (0, 0), (0, 3000)):
        out = pages.page(offset, limit)
        assert [r.path for r in out.collect()] == every[offset : offset + limit]
        assert pages.info(offset, limit) == page_info(3000, offset, limit)
    plan = pages.page(1499, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(_at" in plan
    none = Pages(df.where("false"))
    assert none.total == 0 and none.page().count() == 0 and none.info()["returned"] == 0


def test_namespaces_of_one_name(spark):
    rows = [("a.cpp", "n", "namespace"), ("deep/a.h", "n", "namespace"), ("b.h", "n", "namespace"), ("c.h", "m", "namespace"), ("x.cpp", "n", "class")]
    symbols = spark.createDataFrame(rows, "file_path string, name string, kind string")
    incoming = spark.createDataFrame([("deep/a.h", 2), ("b.h", 1)], "path string, n long")
    assert {(r.name, r.file_path) for r in canonical_namespaces(symbols, incoming).collect()} == {("n", "deep/a.h"), ("m", "c.h")}


def plain_distances(edges, start, most):
    near, front = {s: 0 for s in start}, set(start)
    for step in range(1, most + 1):
        front = {b for a, b in edges if a in front and b not in near}
        near.update(dict.fromkeys(front, step))
    return near


def test_distances_over_buckets(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [(f"n{i}", "hub") for i in range(40)] + [("hub", "far"), ("hub", "hub")]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(5)]
    df = spark.createDataFrame(edges + chain, "src string, dst string")
    start = spark.createDataFrame([("n1",), ("n2",), ("c0",), ("c0",)], "id string")
    for few, fold in ((100, 16), (1, 2)):  # ids in a filter; frontiers joined with the edges, files folded
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse, "FOLD", fold)
        out = {r.id: r.depth for r in traverse.distances(df, start, 4).collect()}
        assert out == plain_distances(edges + chain, ["n1", "n2", "c0"], 4)
    assert {r.id for r in traverse.distances(df.where("false"), start, 3).collect()} == {"n1", "n2", "c0"}
    assert traverse.distances(df, start.where("false"), 3).count() == 0


def test_a_step_shuffles_the_frontier_alone(spark):
    edges = bucketed(spark.range(3000).selectExpr("cast(id % 50 as string) as src", "cast(id % 700 as string) as dst"), "src", "edges")
    seen = Bucketed(spark.range(200).selectExpr("cast(id as string) as id", "1 as depth"), "id", "reached")
    step = traverse._step(edges, seen.table(), seen.table(), [str(i) for i in range(traverse.FEW + 1)])
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    # before it the ends of hubs are made one a task
    assert plan.rindex("HashAggregate") > plan.index("Exchange hashpartitioning")
