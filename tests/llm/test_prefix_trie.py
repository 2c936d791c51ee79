"""The trie of conversations against a plain one."""

import hashlib
import random
import re
import zlib

import pytest

from skein.llm import prefix_trie as pt


def plain(rows):
    """{rebuilt prefix: (conv_id, depth, parent's, n_convs, n_children, n_leaves, saved, ends)} by dictionaries."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], digest(t)))] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in inside if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in inside) for p in inside)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in inside if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c == 40:
            continue  # a block without its first conversation
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = rng.choice(["same  words here", "a b", "", None, "word one\tx", "Z" * rng.randint(1, 4)])
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["user", "bot", None]), text))
    rows += [(c, t, "user", f"common {t}") for c in range(100, 130) for t in range(4)]
    rows += [(7, 0, "user", "again")] * 3 + [(None, 0, "user", "no id")]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_plain_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, KEY string").repartition(3)
    wanted = plain(rows)
    assert got(pt.trie(df)) == wanted
    # subtrees of many nodes below a small crown, and queues that spill
    assert got(pt.trie(df, shards=5, most=2)) == wanted


def test_a_conversation_over_many_tasks(spark):
    rows = [(20, t, "user", f"t{t % 7} x") for t in range(400)] + [(21, t, "user", f"t{t % 7} x") for t in range(399)]
    rows += [(22, None, None, None), (40, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = pt._sorted(pt._turns(df)).mapInArrow(pt._place, pt._PLACED_SQL)
        assert placed.where(f"form = {pt.PIECE}").count() > 300
        assert got(pt.trie(df)) == plain(rows)
    finally:
        for key, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), before):
            spark.conf.set(key, value)


def test_pieces_within_the_turns_that_are_not_kept(spark):
    # a task for nearly each row, so conversations are cut within their first turns as well
    rows = [(c, t, "user", f"{c} {t}") for c in (20, 23, 26, 29, 31, 33, 40, 41) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(pt.trie(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rows_and_a_single_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert got(pt.trie(spark.createDataFrame([], schema))) == []
    assert got(pt.trie(spark.createDataFrame([(None, 1, "a", "b")], schema))) == []
    rows = [(21, 0, None, None)]  # it takes over turns of a conversation that is absent
    assert got(pt.trie(spark.createDataFrame(rows, schema))) == plain(rows)
    rows = [(0, 0, "user", "x " * 100_000)]
    assert got(pt.trie(spark.createDataFrame(rows, schema))) == plain(rows)


def test_the_queue_spills_in_order():
    rng = random.Random(4)
    items = [(rng.randint(-9, 0), bytes([rng.randint(0, 9)]) * 16, 1, i, 2) for i in range(500)]
    queue, out = pt.Queue(most=7), []
    for x in items[:300]:
        queue.push(x)
    first = [queue.pop() for _ in range(100)]
    for x in items[300:]:
        queue.push(x)
    while queue.least() is not None:
        out.append(queue.pop())
    assert first == sorted(items[:300])[:100]
    assert out == sorted(sorted(items[:300])[100:] + items[300:])
