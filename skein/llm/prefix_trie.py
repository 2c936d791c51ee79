"""Prefix trie of conversations with subtree totals by time-forward processing (operator 13).

Turns are sorted by range, so a conversation of any length may lie over many tasks. A node is known by a polynomial of
the digests of its turns modulo 2^127 - 1; the polynomial of a piece of a conversation can be moved to its place later,
so what a task needs of those before it is one row for each task. Nodes are counted by one aggregation.

Subtree totals go from children to parents. Nodes with more than one in 1,024 of the conversations are the crown, closed
under parents and at most 1,024 a level; what hangs below it are subtrees, each of which lies whole in a shard. A shard's
nodes are sorted in reverse level order by Spark's spilling sort, and read once; a node's totals wait for its parent in a
priority queue that spills sorted runs. The totals of the subtrees' roots are summed by parent and the crown is read in
the same way. Nodes of a single conversation have totals that are known at once; they aren't sent through the queues.

Defined results: null roles and texts are empty. Turns of equal number stand in the order of the digests of role and text,
and repeated rows are turns each. Rows without conv_id belong to no conversation; an empty table has no node, not even a
root. A rebuilt conversation without turns is a member of the root alone and ends there. Texts of any length are digested
where they are read. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import small_side, written

#: Every BLOCK-th conversation lends its first turns to those up to the next; at most FIRST turns are lent.
BLOCK, FIRST = 20, 3
#: A node with more than one in so many of the conversations belongs to the crown.
SHARDS = 1024
#: Messages of a priority queue that stay in memory (about 30 MB).
WAITING = 100_000
#: Bytes of member ids in a row before they are hashed.
CHUNK = 1 << 16

_PRIME = (1 << 127) - 1
_BASE = 0x5D1F2B6E0A4C93D7E8F1A3B5C7D9E0F3 % _PRIME
ROOT = bytes(16)


def lent(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its block."""
    return (F.crc32(conv_id.cast("string")) % (FIRST + 1)).cast("int")


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "\x01"), r"[\x20\x09-\x0D]+", "")).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words(text).alias("words"))


def _sorted(turns: DataFrame) -> DataFrame:
    """Before the turns of each conversation a row with those that it takes over (head); all in order over the tasks."""
    ids = turns.groupBy("conv_id").agg(F.lit(0).alias("_")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    firsts = turns.where(f"conv_id % {BLOCK} = 0").withColumn("nth", F.row_number().over(order)).where(f"nth <= {FIRST}")
    firsts = firsts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "words"))).alias("head"))
    heads = ids.join(firsts.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.slice(F.transform(F.coalesce("head", F.array()), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))), 1, lent(F.col("conv_id")))
    of = turns.schema["turn"].dataType
    none = F.lit(None)
    rows = heads.select("conv_id", F.lit(0).alias("kind"), none.cast(of).alias("turn"), none.cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), head.alias("head"), lent(F.col("conv_id")).alias("lent"))
    rows = rows.unionByName(turns.withColumns({"kind": F.lit(1), "head": none.cast(rows.schema["head"].dataType), "lent": lent(F.col("conv_id"))}))
    by = [F.col("conv_id").asc(), F.col("kind").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("kind", "turn")


_PLACED = pa.schema(
    [("task", pa.int32()), ("form", pa.int8()), ("conv_id", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64())]
    + [("last", pa.bool_()), ("firsts", pa.list_(pa.binary())), ("head", pa.list_(pa.binary())), ("lent", pa.int32())]
)
_PLACED_SQL = "task int, form tinyint, conv_id long, place long, key binary, parent binary, words long, last boolean, firsts array<binary>, head array<binary>, lent int"
#: Forms of a row: a node of a conversation; a turn whose earlier ones lie in another task; a task's first or last piece.
NODE, PIECE, RUN = 0, 1, 2


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _value(digest: bytes) -> int:
    return int.from_bytes(digest, "big") % _PRIME


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the conversations that begin in this task, turns of one that began before, and up to two runs."""
    task, out = TaskContext.get().partitionId(), []
    conv = head = None  # of the conversation at hand; head is None if it began in an earlier task
    count = total = key = depth = lends = 0
    power = local = 1
    firsts: list[bytes] = []
    began = False  # whether a conversation has been seen to end

    def run() -> tuple:
        return (task, RUN, conv, count, _bytes(total), None, 0, False, firsts, head, lends)

    def ended() -> None:
        if conv is not None and out and out[-1][1] == NODE:
            out[-1] = (*out[-1][:7], True, *out[-1][8:])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "digest", "words", "head", "lent")]
        for c, digest, words, taken, lends_ in zip(*columns):
            if c != conv:
                if conv is not None and head is None:
                    out.append(run())
                else:
                    ended()
                conv, count, total, local, firsts, lends = c, 0, 0, 1, [], lends_
                head, key, depth, power = None, 0, 0, 1
                if taken is not None:
                    head = [t["digest"] for t in taken]
                    out.append((task, NODE, c, 0, ROOT, None, 0, False, None, None, None))
                    for t in taken:
                        depth, power, parent = depth + 1, power * _BASE % _PRIME, key
                        key = (key + _value(t["digest"]) * power) % _PRIME
                        out.append((task, NODE, c, depth, _bytes(key), _bytes(parent), t["words"], False, None, None, None))
                    continue
            if digest is None:
                continue
            count, local, before = count + 1, local * _BASE % _PRIME, total
            value = _value(digest)
            total = (total + value * local) % _PRIME
            if len(firsts) < FIRST:
                firsts.append(digest)
            if head is None:
                out.append((task, PIECE, c, count, _bytes(total), _bytes(before), words, False, None, None, lends))
            elif count > lends:
                depth, power, parent = depth + 1, power * _BASE % _PRIME, key
                key = (key + value * power) % _PRIME
                out.append((task, NODE, c, depth, _bytes(key), _bytes(parent), words, False, None, None, None))
        if len(out) > 20_000:
            yield _batch(out[:-1])
            out = out[-1:]
    if conv is not None:
        if head is not None:
            ended()
        out.append(run())
        yield _batch(out)


def _batch(rows: list[tuple], schema: pa.Schema = _PLACED) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _joined(runs: list) -> dict[int, dict]:
    """What the pieces of each conversation that lies in several tasks need to find their place; runs in the tasks' order."""
    found: dict[int, list] = {}
    for r in runs:
        found.setdefault(r.conv_id, []).append(r)
    out = {}
    for conv, parts in found.items():
        if len({r.task for r in parts}) < 2:
            continue
        whole = {r.task: r for r in sorted(parts, key=lambda r: r.task)}
        head, lends = next(r.head for r in whole.values() if r.head is not None), parts[0].lent
        before, total, firsts, at = 0, 0, [], {}
        for task, r in whole.items():
            at[task] = (before, total)
            total = (total + pow(_BASE, before, _PRIME) * int.from_bytes(r.key, "big")) % _PRIME
            before += r.place
            firsts += r.firsts
        raw = lambda digests: sum(_value(bytes(d)) * pow(_BASE, i + 1, _PRIME) for i, d in enumerate(digests)) % _PRIME
        out[conv] = {"lent": lends, "taken": len(head), "head": raw(head), "skip": raw(firsts[:lends]), "at": at, "depth": len(head) + max(0, before - lends)}
    return out


def _moved(joined: dict[int, dict]):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                j = joined[r["conv_id"]]
                if r["form"] == PIECE:
                    before, total = j["at"][r["task"]]
                    if before + r["place"] <= j["lent"]:
                        continue
                    scale, shift = pow(_BASE, before, _PRIME), pow(_BASE, j["taken"] - j["lent"], _PRIME)
                    moved = lambda local: _bytes((j["head"] + shift * (total + scale * int.from_bytes(local, "big") - j["skip"])) % _PRIME)
                    r |= {"place": j["taken"] + before + r["place"] - j["lent"], "key": moved(r["key"]), "parent": moved(r["parent"])}
                out.append((r["conv_id"], r["place"], r["key"], r["parent"], r["words"], r["place"] == j["depth"]))
            if out:
                yield _batch(out, _NODES)

    return move


_NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])


def members(conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and node that it starts with: conv_id, depth, key, parent, words, last."""
    spark = conversations.sparkSession
    placed = written(_sorted(_turns(conversations)).mapInArrow(_place, _PLACED_SQL), "placed")
    # two rows a task at most
    joined = _joined(placed.where(f"form = {RUN}").orderBy("task").collect())
    rows = placed.where(f"form < {RUN}")
    plain = lambda df: df.select("conv_id", F.col("place").alias("depth"), "key", "parent", "words", "last")
    if not joined:
        return plain(rows)
    long_ = F.broadcast(spark.createDataFrame([(c,) for c in joined], "conv_id long"))
    moved = rows.join(long_, "conv_id", "left_semi").select("task", "form", "conv_id", "place", "key", "parent", "words")
    moved = moved.mapInArrow(_moved(joined), "conv_id long, depth long, key binary, parent binary, words long, last boolean")
    return written(plain(rows.join(long_, "conv_id", "left_anti")).unionByName(moved), "members")


class Queue:
    """A priority queue of (level, key, children, leaves, saved), least first, which spills sorted runs to the task's own disk."""

    _FORM = struct.Struct("<q16sqqq")

    def __init__(self, most: int = WAITING):
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()
            file.writelines(self._FORM.pack(*x) for x in sorted(self.heap))
            file.seek(0)
            self.heap = []
            run = iter(lambda: file.read(self._FORM.size), b"")
            heapq.heappush(self.runs, (self._FORM.unpack(next(run)), len(self.runs), run))

    def least(self) -> tuple | None:
        ends = [x[0] for x in (self.heap[:1], self.runs[:1] and self.runs[0][:1]) if x]
        return min(ends) if ends else None

    def pop(self) -> tuple:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        item, nth, run = self.runs[0]
        if data := next(run, None):
            heapq.heapreplace(self.runs, (self._FORM.unpack(data), nth, run))
        else:
            heapq.heappop(self.runs)
        return item


_TOTALS = pa.schema([("key", pa.binary()), ("up", pa.binary()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _forward(most: int):
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals of nodes read in reverse level order; up is the parent of a node whose parent isn't in the shard."""
        queue = Queue(most)
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("key", "parent", "depth", "outside", "children", "leaves", "saved")]
            for key, parent, depth, outside, children, leaves, saved in zip(*columns):
                while (x := queue.least()) is not None and x[:2] == (-depth, key):
                    _, _, more, ends, sums = queue.pop()
                    children, leaves, saved = children + more, leaves + ends, saved + sums
                leaves = leaves if children else 1
                if parent is not None and not outside:
                    queue.push((1 - depth, parent, 1, leaves, saved))
                out.append((key, parent if outside else None, children, leaves, saved))
            if out:
                yield _batch(out, _TOTALS)

    return forward


def _totals(shard: DataFrame, most: int = WAITING) -> DataFrame:
    order = [F.col("depth").desc(), F.col("key").asc()]
    rows = shard.select("key", "parent", "depth", "outside", "children", "leaves", "saved").sortWithinPartitions(*order)
    return rows.mapInArrow(_forward(most), "key binary, up binary, children long, leaves long, saved long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of a node's members end to end, in rows of bounded size."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or size > CHUNK:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield _batch(out, schema)
    if ids:
        yield _batch([(key, first, ",".join(ids))], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, sha = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                sha.update(b"," + ids.encode())
                continue
            if sha:
                out.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(ids.encode())
        if out:
            yield _batch(out, schema)
    if sha:
        yield _batch([(key, sha.hexdigest())], schema)


def _ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where conversations end: ids are sorted by range, and joined piece by piece."""
    by = ["key", "conv_id"]
    pieces = rows.where("last").select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, shards: int = SHARDS, most: int = WAITING) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text)."""
    rows = members(conversations)
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
        F.count_if("last").alias("n_ends"),
    )
    nodes = written(nodes, "trie-nodes")
    root = nodes.where("depth = 0").select("n_convs").first()
    least = max(1, (root.n_convs if root else 0) // shards)
    crown = F.expr(f"depth = 0 or n_convs > {least}")
    single = F.expr("depth > 0 and n_convs = 1")

    # nodes that conversations share, with what reaches them from nodes of one conversation
    tails = nodes.where(single).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    children = F.coalesce("children", F.lit(0)).cast("long")
    shared = nodes.where(~single).join(tails, "key", "left")
    shared = shared.select("key", "parent", "depth", "conv_id", crown.alias("crown"), children.alias("children"), children.alias("leaves"), saved)
    shared = written(shared, "shared-nodes")

    # the shard of a node is the node where its least conversation leaves the crown
    tops = shared.where("crown").select("key", "conv_id")
    keys = tops.select(F.col("key").alias("top"))
    out = rows.join(small_side(keys), rows["parent"] == F.col("top"), "left_semi")
    out = out.join(small_side(keys), out["key"] == F.col("top"), "left_anti").select("conv_id", F.col("key").alias("shard"))
    light = shared.where("not crown").join(out, "conv_id").withColumn("outside", F.col("shard") == F.col("key"))
    below = written(_totals(light.repartition("shard"), most), "subtrees")

    # the crown, with the sums of the subtrees' roots
    sums = below.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    above = shared.where("crown").join(sums, "key", "left")
    above = above.select("key", "parent", "depth", F.lit(False).alias("outside"), plus("children", "c"), plus("leaves", "l"), plus("saved", "s"))
    totals = below.unionByName(_totals(above.coalesce(1), most)).drop("up")

    # least conversations of parents: of the crown by broadcast, of other shared nodes by a join, else the node's own
    of = lambda df: df.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = small_side(of(tops))
    lower = nodes.join(upper, "parent", "left_anti").join(of(shared.where("not crown")), "parent", "left")
    lower = lower.withColumn("parent_conv_id", F.expr("if(depth = 0, null, coalesce(parent_conv_id, conv_id))"))
    named = nodes.join(upper, "parent").unionByName(lower)
    result = named.join(totals, "key", "left").join(_ends(rows), "key", "left")
    return result.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("children", 1 - F.col("n_ends")).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
