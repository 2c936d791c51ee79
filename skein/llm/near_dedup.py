"""Near duplicates by DartMinHash (operator 8).

A text is the multiset of its shingles of five words; its similarity to another is the weighted Jaccard index of the
two multisets (sum of least counts over sum of greatest counts), which is plain Jaccard where no shingle repeats.

Signatures: each unit of weight of a shingle is a region over which darts fall as a Poisson process of hashed gaps, so
equal regions get equal darts in all texts. A dart names one of k coordinates; the earliest dart of a coordinate is its
value, and two texts agree there with the probability of their similarity. Only the darts up to a rank that is short
for heavy texts are thrown, about k (ln k + 4) a text, however long it is; where a coordinate stays empty, the rank is
doubled. Bands of five coordinates are joined.

Groups: within a band's bucket all members are compared with its least one, the leader, and connected components by star
contraction give the first classes. Then every bucket is finished: of the members that didn't lead, each two that are in
different components are compared. Members go in blocks of bounded weight, so no bucket must fit in a task; blocks within
one component aren't paired, and a pair is compared in the first band that it shares. Left out are only pairs that can't
be similar, since one text has too few shingles for the other, or that are connected by then. So the classes are the
components of all similar pairs that share a bucket. Links are verified on the whole texts.

Defined results: null, empty and word-less texts are classes of their own; rows without doc_id have no class and are
never dropped. A text of one to four words has a single shingle. Rows that repeat a doc_id are one document; if its texts
differ, it joins their classes. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.llm.common import WordHashes, fresh, mixed, slices, small_side, words_of, written

SHINGLE = 5
SIMILAR = 0.8
#: 26 bands of 5: a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
#: Units in a block of a bucket's members, and the least that a member counts for (so 512 members are a block at most).
BLOCK, LEAST = 1 << 19, 1 << 10

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) | 1 for i in range(1, SHINGLE + 1)], dtype=object)
_PLACE = np.array([int(x) % 2**64 for x in _PLACE], dtype=np.uint64)


def shingles(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit elements of each text, one for each unit of a shingle's weight, end to end, and where each text begins."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    pad = np.zeros(SHINGLE - 1, np.uint64)
    rows = np.concatenate([x for h in hashes for x in (h, pad)]) if hashes else pad
    window = np.zeros(max(len(rows) - SHINGLE + 1, 0), np.uint64)
    for i, factor in enumerate(_PLACE):
        window += rows[i : len(window) + i] * factor
    begins = np.concatenate([[0], np.cumsum(sizes + SHINGLE - 1)])[:-1]
    at = np.repeat(begins - starts[:-1], counts) + np.arange(starts[-1])
    units = mixed(window[at])
    for a, b in zip(starts[:-1], starts[1:]):
        units[a:b].sort()
    # the n-th occurrence of a shingle in a text is a unit of its own
    first = np.ones(len(units), bool)
    first[1:] = units[1:] != units[:-1]
    first[starts[:-1][counts > 0]] = True
    index = np.arange(len(units))
    nth = index - np.maximum.accumulate(np.where(first, index, 0))
    return mixed(units + nth.astype(np.uint64) * _GOLD), starts


def darts(units: np.ndarray, starts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Signatures, a row of k values for each text that has a unit; the other texts' rows are 0."""
    n = len(starts) - 1
    weight = np.diff(starts)
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero(weight)
    reach = k * (np.log(k) + 4) / np.maximum(weight, 1)
    while len(todo):
        of = np.repeat(np.arange(len(todo)), weight[todo])
        at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in todo])
        unit, most, rank = units[at], np.repeat(reach[todo], weight[todo]), np.zeros(len(at))
        best = np.full(len(todo) * k, np.inf)
        thrown, level = [], 0
        while len(unit):
            level += 1
            hit = mixed(unit + np.uint64(level * int(_GOLD) % 2**64))
            rank = rank - np.log(((hit >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank < most
            unit, most, rank, of, hit = unit[near], most[near], rank[near], of[near], mixed(hit[near])
            slot = of * k + (hit % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            thrown.append((slot, rank, hit))
        value = np.zeros(len(best), np.uint64)
        for slot, rank, hit in thrown:
            won = rank == best[slot]
            value[slot[won]] = hit[won]
        out[todo] = value.reshape(-1, k)
        todo = todo[np.isinf(best.reshape(-1, k)).any(axis=1)]
        reach[todo] *= 2
    return out


def _bands(signs: np.ndarray) -> np.ndarray:
    rows = signs.reshape(len(signs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]) * _GOLD
    for i in range(ROWS):
        key = mixed(key + rows[:, :, i])
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes(100_000)
    for batch in slices(batches, "text", 500_000):
        hashes = [cache.of(words_of(t)) for t in batch.column("text").to_pylist()]
        keys = _bands(darts(*shingles(hashes)))
        digest = [xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None for h in hashes]
        bands = pa.array([k if len(h) else None for k, h in zip(keys, hashes)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.string()), bands], schema=_SIGNED)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the word sequence, band keys; both null for a text without words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sign, "doc_id long, digest string, bands array<long>"
    )


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes(100_000)
    for batch in slices(batches, "text", 500_000):
        units = [shingles([cache.of(words_of(t))])[0].tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(units, pa.binary())], names=["doc_id", "units"])


def weighed(texts: DataFrame) -> DataFrame:
    """doc_id and the sorted unit elements of each whole text of ``texts`` (doc_id, text) that has a word."""
    return texts.mapInArrow(_weigh, "doc_id long, units binary").where("octet_length(units) > 0")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The unit arrays of a binary column, as views of its buffer."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b].view(np.uint64) for a, b in zip(ends, ends[1:])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for mine, theirs in zip(_arrays(batch.column("units")), _arrays(batch.column("leader_units"))):
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            scores.append(both / (len(mine) + len(theirs) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("leader"), batch.column("member"), pa.array(scores, pa.float64())],
            names=["leader", "member", "similarity"],
        )


def compared(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Exact similarity of each (leader, member) on the units of their whole texts."""
    both = pairs.join(units.select(F.col("doc_id").alias("member"), "units"), "member").join(
        units.select(F.col("doc_id").alias("leader"), F.col("units").alias("leader_units")), "leader"
    )
    return both.select("leader", "member", "units", "leader_units").mapInArrow(
        _compare, "leader long, member long, similarity double"
    )


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch replaced by (node, least node that the batch connects it with)."""
    for batch in batches:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in up if (r := find(x)) != x]
        columns = zip(*pairs) if pairs else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b longs): root is the least node of its connected component.

    Alternates large-star and small-star contraction, each a min-aggregation and a join, until no edge moves; each
    begins by contracting the edges batch by batch where they lie."""

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        """Contracted edges, written, and their number and checksum, observed while they are written."""
        seen = Observation()
        df = df.mapInArrow(_contract, "a long, b long").distinct()
        df = df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        return written(df, "edges"), tuple(sorted(seen.get.items()))

    edges, before = step(edges.select("a", "b"))
    while before[0][1]:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large, _ = step(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select("b", "m").union(root.select("a", "m")).toDF("a", "b")
        edges, after = step(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``df`` with the column's nodes replaced by their roots."""
    out = df.join(roots.toDF("_node", "_root"), F.col(column) == F.col("_node"), "left")
    return out.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _linked(similar: float):
    def links(rows: pa.Table) -> pa.Table:
        """(a, b): links between two blocks of a bucket (or within one) that connect components."""
        key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
        block, root = np.array(rows.column("block").to_pylist()), rows.column("root").to_numpy().copy()
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        earlier = bands[:, : int((bands == key).any(axis=0).argmax())]
        units = [np.frombuffer(u, np.uint64) for u in rows.column("units").to_pylist()]
        size = np.array([len(u) for u in units])
        ids = np.split(np.unique(np.concatenate(units), return_inverse=True)[1], np.cumsum(size)[:-1])
        marked = np.zeros(size.sum(), bool)
        right, out = np.flatnonzero(block == j), []
        for x in np.flatnonzero(block == i):
            at = right[right > x] if i == j else right
            at = at[(root[at] != root[x]) & (np.minimum(size[at], size[x]) / np.maximum(size[at], size[x]) >= similar)]
            at = at[~(earlier[at] == earlier[x]).any(axis=1)]
            if not len(at):
                continue
            marked[ids[x]] = True
            both = np.add.reduceat(marked[np.concatenate([ids[y] for y in at])], np.cumsum(size[at]) - size[at], dtype=np.int64)
            marked[ids[x]] = False
            for y in at[both / (size[at] + size[x] - both) >= similar]:
                if root[y] != root[x]:
                    out.append((root[x], root[y]))
                    root[root == root[y]] = root[x]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], names=["a", "b"])

    return links


def _blocked(placed: DataFrame) -> DataFrame:
    """``placed`` (key, doc_id, root, weight) without weight, a row for each pair of blocks, i and j, that the member is in.

    Most buckets are one block, '0'. Of a bucket with more weight than a block, a component of more than a block has
    blocks of its own, which aren't paired with each other; the other components share blocks."""
    large = placed.groupBy("key", "root").agg(F.sum("weight").alias("weight")).withColumn("own", F.expr(f"if(weight > {BLOCK}, root, null)"))
    parts = large.groupBy("key", "own").agg(F.ceil(F.sum("weight") / BLOCK).cast("long").alias("parts"))
    hot = parts.groupBy("key").agg(F.collect_list(F.struct("own", "parts")).alias("hot"), F.sum("parts").alias("n")).where("n > 1").drop("n")
    placed = placed.drop("weight").join(small_side(written(hot, "hot-buckets")), "key", "left")
    label = lambda own, part: F.concat_ws(":", own.cast("string"), part.cast("string"))
    parts_of = lambda own: F.get(F.filter("hot", lambda b: b["own"].eqNullSafe(own)), 0)["parts"]
    own, shared, nobody = parts_of(F.col("root")), parts_of(F.lit(None).cast("long")), F.lit(None)
    block = F.when(own.isNotNull(), label(F.col("root"), F.pmod(F.xxhash64("doc_id"), own))).otherwise(label(nobody, F.pmod(F.xxhash64("root"), shared)))
    others = F.filter("hot", lambda b: ~b["own"].eqNullSafe(F.col("root")))
    labels = F.flatten(F.transform(others, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["parts"] - 1), lambda p: label(b["own"], p))))
    placed = placed.withColumn("block", F.when(F.col("hot").isNull(), "0").otherwise(block))
    placed = placed.withColumn("with", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit("0"))).otherwise(labels)))
    return placed.select("key", "doc_id", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


def _rest(placed: DataFrame, signed: DataFrame, units: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the components of ``placed`` (key, doc_id, root): all members of a bucket against all."""
    open_ = placed.groupBy("key").agg(F.min("root").alias("m"), F.max("root").alias("n")).where("m < n").select("key")
    placed = placed.join(small_side(written(open_, "open-buckets")), "key", "left_semi")
    some = small_side(written(placed.select("doc_id").distinct(), "open"))
    units = units.join(some, "doc_id", "left_semi").join(signed.join(some, "doc_id", "left_semi").select("doc_id", "bands"), "doc_id")
    units = written(units, "open-units")
    weight = units.groupBy("doc_id").agg(F.greatest(F.sum(F.octet_length("units")) / 8, F.lit(LEAST)).alias("weight"))
    placed = _blocked(written(placed.join(weight, "doc_id"), "unfinished"))
    return placed.join(units, "doc_id").groupBy("key", "i", "j").applyInArrow(_linked(similar), "a long, b long")


def _roots(signed: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(node, root) of the representatives that have links; ``signed`` (doc_id, bands) holds each one's band keys."""
    keys = signed.select(F.explode("bands").alias("key"), "doc_id")
    firsts = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    placed = written(keys.join(firsts.select("key", "leader"), "key"), "buckets")
    new = placed.where("doc_id <> leader")
    # only texts that share a bucket are read again
    some = small_side(written(placed.select("doc_id").distinct(), "members"))
    units = written(weighed(texts.join(some, "doc_id", "left_semi")), "units")
    found = compared(new.select("leader", F.col("doc_id").alias("member")).distinct(), units).where(F.col("similarity") >= similar)
    # links are written before they are contracted, so that a task has one Python worker at a time
    roots = components(written(found.select(F.col("leader").alias("a"), F.col("member").alias("b")), "links"))
    rest = _rooted(new.withColumn("root", F.col("doc_id")).select("key", "doc_id", "root"), "root", small_side(roots))
    joined = components(written(_rest(written(rest, "placed"), signed, units, similar), "links"))
    # only the roots that the new links join are contracted anew
    return written(_rooted(roots, "root", joined).union(joined.join(roots, "node", "left_anti")), "roots")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id of each document of ``docs`` (doc_id, text): the least doc_id of its class of near duplicates."""
    signed = written(signatures(docs).where("doc_id is not null"), "signatures")
    alone = signed.where("digest is not null").groupBy("digest")
    alone = written(alone.agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "representatives")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    roots = _roots(alone.select("doc_id", "bands"), texts.where("doc_id is not null"), similar)
    known = alone.select("digest", F.col("doc_id").alias("node")).join(roots, "node", "left")
    known = known.select("digest", F.coalesce("root", "node").alias("class_id"))
    member = signed.where("digest is not null").select("doc_id", "digest").join(known, "digest").select("doc_id", "class_id")
    # a document of several texts joins their classes
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("a")).where("a > b")
    several = written(several.select("doc_id", "b"), "several")
    if not several.isEmpty():
        same = components(member.join(small_side(several), "doc_id").where("class_id > b").select(F.col("class_id").alias("a"), "b"))
        member = _rooted(member, "class_id", small_side(same))
    empty = signed.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return member.union(empty).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its class, one row for each, with the columns of ``docs``."""
    classes = written(near_duplicates(docs, similar), "classes")
    dropped, nth = fresh("gone", docs), fresh("nth", docs)
    gone = small_side(written(classes.where("class_id <> doc_id").select(F.col("doc_id").alias(dropped)), "gone"))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone[dropped], "left_anti")
    if docs.where("doc_id is not null").count() > classes.count():
        # repeated ids are rare; only then are whole rows shuffled
        order = Window.partitionBy("doc_id").orderBy(*[c for c in ("text",) if c in docs.columns])
        again = kept.where("doc_id is not null").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        kept = again.unionByName(kept.where("doc_id is null"))
    return kept
