"""Archives, URL filters, mixtures and the pipeline."""

import base64
import hashlib
import os
import random
import tempfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing, packing, queries, url_filter, warc

import corpus_pipeline


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    wanted = duck.execute(queries.ORACLE_SQL[name]).df()[columns]
    fix = lambda rows: sorted(repr(tuple(None if v != v else v for v in r)) for r in rows)
    clean = wanted.astype(object).where(wanted.notna(), None)
    clean = [tuple(int(v) if isinstance(v, float) else v for v in r) for r in clean.itertuples(index=False)]
    assert fix(tuple(r) for r in df.select(*columns).collect()) == fix(clean)


def pages(rng, n=120):
    bodies = ["", "same", "é" * 50, "\x1f", "x" * 3_000]
    rows = [(i, f"http://h/{i} \n", rng.choice([*bodies, f"own {i}", None, "".join(chr(rng.randrange(32, 5000)) for _ in range(200))])) for i in range(n)]
    return rows + [(None, None, "same"), (7, "http://again", rows[7][2])]


@pytest.mark.parametrize("split", [50, 997, 1 << 20])
def test_archive_round_trip(spark, split):
    rows = pages(random.Random(1))
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    manifest = warc.write(df, file_bytes=4_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    out = warc.read(manifest, split_bytes=split).withColumn("id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    assert len(out) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        since = first[h or ""]
        wanted[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == since else "revisit", None if i == since else since] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in out) == wanted
    assert all(bytes(r.payload).decode() == dict((i, h or "") for i, _, h in rows)[r.id] for r in out if r.record_type == "response")
    if split == 997:
        folder = manifest.first()["path"].rpartition("/")[0]
        assert warc.read(warc.listed(spark, folder)).count() == len(rows)


def test_ranges_are_read_by_many_tasks_and_payloads_split(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(4_000)) if i % 3 else "same") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    out = warc.read(warc.write(df), split_bytes=20_000).withColumn("task", F.spark_partition_id())
    assert out.count() == 300 and out.select("task").distinct().count() > 5
    wanted = sorted((r.record_id, r.record_type, r.refers_to) for r in out.collect())
    monkeypatch.setattr(warc, "FIRSTS", 0)
    monkeypatch.setattr(warc, "SALTS", 3)
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect()) == wanted


def test_a_very_long_payload(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(100_000)) * 30
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x")], "page_id long, url string, html string")
    out = {warc._id(r.record_id): r for r in warc.read(warc.write(df), split_bytes=1_000).collect()}
    assert bytes(out[1].payload).decode() == long and out[2].record_type == "revisit" and out[2].payload_bytes == 3_000_000


def test_least_size_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = lambda x: sorted((warc._id(r.record_id), r.record_type) for r in warc.read(x).collect())
    assert kinds(warc.write(df, least=3)) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.read(warc.write(df.where("false"))).count() == 0


def test_false_magic_is_no_member(spark, tmp_path):
    one = warc.record(1, "u", warc.MAGIC * 100, None)
    import zlib

    def member(x, level):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    raw = member(one, 0) + b"junk" + warc.MAGIC + b"junk" + member(warc.record(2, "u", b"z", None) + warc.record(3, "u", b"y", None), 6) + member(one, 6)[:40]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    for split in (10, 100, 1 << 20):
        got = warc.read(warc.listed(spark, f"file://{tmp_path}"), split_bytes=split)
        assert sorted(warc._id(r.record_id) for r in got.collect()) == [1, 2, 3]


URLS = [
    None, "", "no scheme", "http://", "http://a.com", "https://A.Com/x?y#z", "http://example.com/en/1", "http://WWW.example.com/en/2", "http://x.www.example.com/en/",
    "http://example.com/fr/", "http://notexample.com/en/", "http://q.net/es/a", "http://net/fr/", "http://q.net/de/1.html", "http://m.q.net/de/1?u=2", "https://q.net:80/de/1/",
    "http://u@q.net/de/1#f", "ftp://q.org/?a://b", "http://q.org",
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].lower(), path[:stop]


def plain_rule(host, path):
    best = None
    for what, text in url_filter.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = what, text
    return best


def test_url_rules_and_list(spark, monkeypatch):
    df = spark.createDataFrame([(i, u, "b") for i, u in enumerate(URLS)] + [(0, None, "b")], "page_id long, url string, block string")
    listed = spark.createDataFrame([("http://www.q.net/de/1",), (None,), ("http://q.org/",), ("http://example.com/fr",)], "url string")
    for blocks in (2**18, 0):  # 0: a filter of one block, full of false hits
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks or 1)
        out = url_filter.judged(df, listed).collect()
        assert len(out) == len(URLS) + 1
        for r in out:
            host, path = plain_url(URLS[r.page_id])
            rule = plain_rule(host, path)
            own = "block" if host and (host.split("@")[-1].split(":")[0].removeprefix("m.").removeprefix("www."), path.removesuffix(".html").rstrip("/")) in {("q.net", "/de/1"), ("q.org", ""), ("example.com", "/fr")} else "allow"
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], rule[0] if rule else own), URLS[r.page_id]
    assert url_filter.judged(df, listed.where("false")).where("in_list").count() == 0
    assert url_filter.judged(df.where("false"), listed).count() == 0


def test_pattern_is_pfair():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(1, 30)
        shares = mixing.whole_weights({f"s{i}": rng.random() ** 3 for i in range(n)}, 256)
        assert sum(shares.values()) == 256
        plan = mixing.pattern(shares, 256)
        assert [t for _, _, t in plan] == list(range(256))
        had = Counter()
        for s, j, t in plan:
            assert had[s] == j
            had[s] += 1
            assert all(abs(had[x] - shares[x] / 256 * (t + 1)) < 1 for x in shares)


def test_mixture(spark):
    rows = [(i, "big" if i % 2 else rng_source(i), "t" if i % 5 else None, 1) for i in range(900)] + [(3, "big", "t", 1), (None, "big", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rank int")
    out = mixing.scheduled(df, {"big": 3, "a": 1, "": 1}, block=4).collect()
    assert len(out) == len(rows)
    for s in ("big", "a", ""):
        assert sorted(r["rank"] for r in out if r.source == s) == list(range(sum((x[1] or "") == s for x in rows)))
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    share = mixing.whole_weights({"big": 3, "a": 1, "": 1}, 50)
    had = Counter()
    for t in range(max(r.slot for r in out if r.on_target) + 1):
        had[slots[t][0]] += 1
        assert all(abs(had[x] - share[x] / 50 * (t + 1)) < 1 for x in share)
    mixed = mixing.mixed(df, {"big": 3, "a": 1, "": 1}, block=4)
    assert mixed.columns == df.columns and Counter(map(tuple, mixed.collect())) == Counter(rows)
    assert mixing.scheduled(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_mixture_keeps_the_given_weights(spark):
    # a third in one of 20 sources, and one source of 500 with 0.7: neither is a multiple of 1 / 1024
    for weights in ({"big": 10**0.7, **{f"s{i}": 1.0 for i in range(19)}}, {"big": 0.7, **{f"s{i}": 0.3 / 499 for i in range(499)}}):
        total, had = sum(weights.values()), Counter()
        for s, _, t in mixing.pattern(mixing.whole_weights(weights), mixing.SLOTS):
            had[s] += 1
            assert all(abs(had[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())
    rows = [(i, "big") for i in range(1500)] + [(10_000 + i, f"s{i % 19}") for i in range(5700)] + [(20_000, "unweighted")]
    weights = {"big": 10**0.7, **{f"s{i}": 1.0 for i in range(19)}}
    total, had = sum(weights.values()), Counter()
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'t' text")
    out = mixing.scheduled(df, weights, block=1).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(len(rows))) and out[-1].source == "unweighted"
    on_target = [r for r in out if r.on_target]
    assert len(on_target) > 5000
    for t, r in enumerate(on_target):
        had[r.source] += 1
        assert all(abs(had[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())


def test_any_weights_any_sources_any_columns(spark):
    # 9999 : 1, against the weights as given
    had = Counter()
    for t, (s, _) in zip(range(30_000), mixing._dealt({"a": mixing.Fraction(9999, 10_000), "b": mixing.Fraction(1, 10_000)})):
        had[s] += 1
        assert abs(had["b"] - (t + 1) / 10_000) < 1 and abs(had["a"] - (t + 1) * 0.9999) < 1
    rows = [(i, f"s{i % 1100}", "t", 1, 2, 3) for i in range(3300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _rank int, slot int, Rank int")
    out = mixing.scheduled(df, block=1).collect()
    assert sorted(r.slot for r in out) == list(range(3300))
    assert mixing.mixed(df).columns == df.columns and Counter(map(tuple, mixing.mixed(df).collect())) == Counter(rows)


def test_repeated_rows_are_mixed_like_others(spark):
    df = spark.createDataFrame([(1, "a", "same")] * 1000 + [(i, "b", "t") for i in range(1000)], "doc_id long, source string, text string")
    got = [r.source for r in mixing.mixed(df, {"a": 1, "b": 1}, block=1).collect()]
    assert len(got) == 2000 and all(abs(got[:n].count("a") - n / 2) < 1 for n in range(1, 2001))


def rng_source(i):
    return "a" if i % 4 else None


def test_packed_rows_follow_the_mixture(spark, tmp_path):
    # the order survives Parquet files that Spark deals to tasks by their size
    rng = random.Random(2)
    rows = [(i, "big" if i % 4 else "small", " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(5, 400)))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    source = {r[0]: r[1] for r in rows}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        mixing.mixed(docs, {"big": 1, "small": 1}, block=4).write.option("maxRecordsPerFile", 170).parquet(f"{tmp_path}/mixed")
        read = spark.read.parquet(f"{tmp_path}/mixed")
        rows = packing.packed(read, pool=6_000, in_files=True).orderBy("since", "row").collect()
        order = [r.doc_id for r in read.select("doc_id", packing.file_position().alias("at")).orderBy("at").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.since for r in rows}) > 20
    seen, done = [], set()
    for k, r in enumerate(rows):
        seen += [d for d, piece in zip(r.doc_ids, r.pieces) if not piece]
        if k + 1 == len(rows) or rows[k + 1].since != r.since:  # a pool ends: all documents up to here, and no other
            assert set(seen) - {order[len(seen) - 1], order[min(len(seen), len(order) - 1)]} <= set(order[: len(seen)])
            if len(seen) < 550:  # small has 300 documents, so it lasts for 600
                assert abs(sum(source[d] == "small" for d in seen) - len(seen) / 2) <= 4
            done.add(len(seen))
    assert sorted(seen) == list(range(1200)) and len(done) > 20


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = tempfile.mkdtemp(prefix="skein-stage-") + "/out"
        before, out = docs, stage(spark, docs, sf)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0, name
            assert (docs.count() < before.count()) == (name != "source mixing"), name
    ids = {d for r in docs.collect() for d in r.doc_ids}
    assert ids == {r.doc_id for r in before.where("text <> ''").collect()}
