import tempfile

import pytest

from skein.sources.cache import TABLES, GraphCache, below, changed, fingerprints, pending
from skein.streaming import live
from tests.test_graph import graph_of


def test_cache_versions(spark):
    cache = GraphCache(spark, "file://" + tempfile.mkdtemp(prefix="skein-cache-"))
    assert cache.status()[0] == "missing" and cache.counts() == dict.fromkeys(TABLES, 0)
    g = graph_of(spark, ["a", "b"], [("a", "b", "import")])
    text = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    cache.save(files=fingerprints(text), nodes=g.nodes, edges=g.edges)
    assert cache.counts() == {**dict.fromkeys(TABLES, 0), "files": 2, "nodes": 2, "edges": 1} and cache.status(fingerprints(text))[0] == "fresh"
    now = fingerprints(spark.createDataFrame([("a", "9"), ("c", "2")], "path string, content string"))
    assert cache.status(now)[0] == "stale"
    assert {(r.path, r.change) for r in changed(cache.load()["files"], now).collect()} == {("a", "changed"), ("b", "removed"), ("c", "added")}
    cache.patch(spark.createDataFrame([("a",)], "path string"))
    assert cache.counts() == {**dict.fromkeys(TABLES, 0), "files": 1, "nodes": 1}
    state = cache.state()
    with pytest.raises(RuntimeError):  # a second writer that began from the same state
        cache._commit({**state, "version": "0" * 32}, "x" * 32, {}, {})
    assert cache.state() == state


def test_deleted_folders_and_pending_files(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a",), ("x",)], "path string")
    gone = spark.createDataFrame([("a/b",), ("x",)], "path string")
    assert sorted(r.path for r in below(paths, gone).collect()) == ["a/b/c", "x"]
    moved = spark.createDataFrame([("a", 5.0), ("b", 50.0), ("c", None), ("node_modules/x", 99.0)], "path string, mtime double")
    assert [r.path for r in pending(moved, 10.0).collect()] == ["b", "c"] and pending(moved, None).count() == 3


def test_stream_keeps_the_last_event(spark):
    folder, out = tempfile.mkdtemp(prefix="skein-in-"), []
    rows = [("a", "create", 1), ("a", "delete", 2), ("b", "update", 3), ("node_modules/x", "update", 4)]
    events = spark.createDataFrame(rows, "path string, type string, event_id long").selectExpr("path", "type", "timestamp_seconds(event_id) as ts", "event_id")
    events.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(live.EVENT).parquet(folder)
    q = live.apply_changes(stream, lambda df, n: out.extend((r.path, r.type, r.events) for r in df.collect()), tempfile.mkdtemp(prefix="skein-ck-"), ["node_modules/**"], once=True)
    q.awaitTermination(60)
    assert sorted(out) == [("a", "delete", 2), ("b", "update", 1)]
    s = live.sessions(spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.4), ("a", "z", 2.0)], "path string, type string, s double").selectExpr("path", "type", "timestamp_millis(cast(s * 1000 as long)) as ts"))
    assert sorted(r.events for r in s.collect()) == [1, 2]


BURSTS = [(r, p, k, ms + 10**6, i) for r, p, k, ms, i in [  # quiet after each; endless, cut at two seconds; two roots
    ("r", "a", "x", 0, 1), ("r", "a", "y", 400, 2), ("r", "b", "x", 899, 3), ("r", "a", "z", 1399, 4),
    *(("r", "c", "u", 5000 + 300 * i, 10 + i) for i in range(12)), ("q", "a", "x", 100, 50), ("q", "a", "w", 600, 51), ("q", "b", "w", 1099, 52),
]]


def plain_batches(events, quiet=500, longest=2000):
    out, open_ = [], {}
    for root, path, kind, ms, _ in sorted(events, key=lambda e: (e[0], e[3], e[4])):
        now = open_.get(root)
        if now is None or ms >= min(now["last"] + quiet, now["first"] + longest):
            now = open_[root] = {"first": ms, "paths": {}}
            out.append((root, now))
        now["last"] = ms
        now["paths"][path] = (kind, now["paths"].get(path, (0, 0))[1] + 1)
    return sorted((r, b["first"], min(b["last"] + quiet, b["first"] + longest), p, k, n) for r, b in out for p, (k, n) in b["paths"].items())


def seen(rows):
    ms = lambda t: round(t.timestamp() * 1000)
    return sorted((r.root, ms(r.start), ms(r.flush), r.path, r.type, r.events) for r in rows)


def test_debounce_with_a_longest_age(spark):
    events = spark.createDataFrame(BURSTS, "root string, path string, type string, ms long, event_id long").selectExpr("root", "path", "type", "timestamp_millis(ms) as ts", "event_id")
    assert seen(live.batches(events.repartition(3)).collect()) == plain_batches(BURSTS)
    assert any(f - s == 2000 for _, s, f, *_ in plain_batches(BURSTS))
    assert live.batches(events.where("false")).count() == 0


def test_debounce_of_a_stream(spark):
    spark.conf.set(*live.STATE_STORE)
    folder, rows = tempfile.mkdtemp(prefix="skein-in-"), []
    last = ("z", "end", "x", 2 * 10**6, 99)
    # files in the order of time, each a micro-batch of its own; the last moves the watermark past all
    times = sorted({e[3] for e in BURSTS})
    cuts = [times[i : i + 6] for i in range(0, len(times), 6)]
    for i, cut in enumerate([*cuts, None, None]):
        own = [e for e in BURSTS if e[3] in cut] if cut else [(*last[:3], last[3] + i, last[4] + i)]
        df = spark.createDataFrame(own, "root string, path string, type string, ms long, event_id long")
        df.selectExpr("root", "path", "type", "timestamp_millis(ms) as ts", "event_id").coalesce(1).write.mode("append").parquet(f"{folder}/{i:02d}")
    stream = spark.readStream.schema("root string, path string, type string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    out = live.debounced(stream, late="0 seconds")
    q = out.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", tempfile.mkdtemp(prefix="skein-ck-")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert seen(r for r in rows if r.root != "z") == plain_batches(BURSTS)
