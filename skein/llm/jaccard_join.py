"""Similarity join of sets of shingles by size-banded tiles with bitmap signatures (operator 12).

A text is the set of its five-word shingles, and two texts link when the Jaccard index of their sets is at least 80
hundredths, a test in integers. Two such sets of sizes m and n share one of the first m // 5 + 1 and n // 5 + 1 shingles of
any common order, so each set is entered under those alone, and the join is exact. The order puts shingles that many texts
have last, by powers of two of their number: tasks count the shingles that repeat among the texts they read, and up to 2**20 of
the most frequent are sent to all tasks. The order changes the work, never the result.

Equal sets are one representative. The sets under a shingle are a bucket; sets without one of near size in it leave it, as
do those whose shingles from this one on are too few for a link (of a link's two sets, the first common shingle isn't late).
A bucket is a tile, or if it is large is cut into tiles: members go into blocks by size band (sizes within a fifth) and
hash, and blocks of equal or neighbouring bands are paired. In a tile every two members of near sizes meet by their bitmaps
of 1,024 bits: each bit in which two bitmaps differ is a shingle that only one of them has, so bit counts bound the overlap
from above. Pairs that pass are listed once for all tiles; those of large sets meet again by wider bitmaps that grow with
the set. What is left has its whole sorted arrays intersected, turn by turn, so
that most pairs of a group of copies are connected before their turn comes. Where more than
FEW pairs a member pass, at first only those with a band's least member are listed, which connects most of a group of
copies. Then these buckets go into tiles again, members of one component don't meet any more, and if still too many pairs
pass, members go into tiles with their wide bitmaps, and what these leave with their arrays; pairs that have been connected
meanwhile are left out. So nothing is
listed that grows with the square of a bucket, no pair of different components stays uncompared, and a tile's weight is
bounded, so no bucket must fit in a task.

Shingles are known by 64-bit hashes. Defined results: null, empty and word-less texts have no shingles and are components
of their own; a text of one to four words is one shingle. Rows that repeat a doc_id are one document: if its texts differ
it joins their components, and its size is that of the largest set. Rows without doc_id have no component. A text of any
length is one set. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import mixed, slices, small_side, written
from skein.llm.near_dedup import _rooted, components

SHINGLE = 5
#: Least similarity in hundredths.
PERCENT = 80
BITS = 1024
#: Shingles that a task counts at once; the most that are sent to all tasks (8 MB); the least count of one that is.
SLAB, FREQUENT, OFTEN = 2_000_000, 1 << 20, 16
#: Members of a tile up to which it is compared row by row; pairs for each member up to which they are listed.
SMALL, FEW = 16, 4
#: Turns in which each set is compared with one partner, before all that are left are; shingles of pairs that need no turns.
TURNS, AT_ONCE = 3, 1 << 22
#: Members of a block of bitmaps; shingles of a block of sets, and the least that a set counts for.
MEMBERS, WEIGHT, LEAST = 2048, 1 << 19, 256
#: Shingles that a set counts for at least in a block of wide bitmaps (a member of ``MEMBERS``).
GREAT = 4096

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(SHINGLE)], np.uint64)
_GOLD = 0x9E3779B97F4A7C15
#: Bytes hashed at once.
BYTES = 1 << 22

_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)])
_VALUES = mixed(_LOWER.astype(np.uint64) * np.uint64(_GOLD) + np.uint64(_GOLD))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of an odd ``base`` modulo 2**64, ``n`` at least; kept for the next call."""
    if len(_powers.get(base, ())) < n:
        out = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts whose A-Z are lower-cased, and how many words each text has.

    ``data`` are the texts' UTF-8 bytes end to end, ``ends`` where they end. A word's hash is a polynomial of its bytes'
    values, taken from the sums up to its ends, so all words of a block are hashed in a few operations on whole arrays."""
    out, starts = [], []
    bounds = np.concatenate([[0], ends])
    at = 0
    while at < len(data):
        to = min(at + BYTES, len(data))
        while to < len(data) and not _SEPARATES[data[to]]:  # never within a word
            after = np.flatnonzero(_SEPARATES[data[to : to + BYTES]])
            to += int(after[0]) if len(after) else min(BYTES, len(data) - to)
        block = data[at:to]
        cut = np.zeros(len(block) + 1, bool)
        cut[bounds[(bounds >= at) & (bounds <= to)] - at] = True
        word = ~_SEPARATES[block]
        begins, ends_ = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | cut[1:-1]
        ends_[:-1] &= ~word[1:] | cut[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends_) + 1
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_VALUES[block] * _power(_BASE, len(block))[: len(block)], out=sums[1:])
        out.append(mixed((sums[e] - sums[s]) * _power(_INVERSE, len(block))[s] + (e - s).astype(np.uint64) * np.uint64(_GOLD)))
        starts.append(s + at)
        at = to
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    of = np.searchsorted(bounds, np.concatenate(starts), "right") - 1
    return np.concatenate(out), np.bincount(of, minlength=len(ends))


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of texts: ``words`` are their words' hashes end to end, ``counts`` how many each has."""
    room = np.maximum(counts, SHINGLE) * (counts > 0)  # a short text is filled up with zeros to one shingle
    first, own = np.cumsum(room) - room, np.cumsum(counts) - counts
    row = np.zeros(room.sum() + SHINGLE, np.uint64)
    row[np.repeat(first - own, counts) + np.arange(len(words))] = words
    n = np.maximum(room - SHINGLE + 1, 0)
    ends = np.cumsum(n)
    window = np.zeros(room.sum(), np.uint64)
    for i, factor in enumerate(_FACTORS):
        window += row[i : i + len(window)] * factor
    units = mixed(window[np.repeat(first - (ends - n), n) + np.arange(n.sum())])
    for a, b in zip(ends - n, ends):
        units[a:b].sort()
    new = np.ones(len(units), bool)
    new[1:] = units[1:] != units[:-1]
    new[(ends - n)[n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return np.split(units[new], kept[ends])[: len(counts)]


def required(n: int) -> int:
    """The least overlap of a set of ``n`` with a similar one."""
    return -(-PERCENT * n // 100)


def similar(both, m, n):
    return 100 * both >= PERCENT * (m + n - both)


def bitmap(units: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(units % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", 500_000):
        column = batch.column("text")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        yield batch, shingle_sets(*word_hashes(data, (ends[1:] - ends[0]).astype(np.int64)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that repeat among the different sets of a slab, and how often they do."""

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([*slab.values(), np.zeros(0, np.uint64)]), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    slab, size = {}, 0
    for _, sets in _sets(batches):
        for units in sets:
            key = xxhash.xxh3_128_digest(units.tobytes())
            if key not in slab:
                slab[key], size = units, size + len(units)
            if size > SLAB:
                yield counted()
                slab, size = {}, 0
    yield counted()


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most FREQUENT shingles that many texts have, and of each the power of two that its count is over."""
    counts = texts.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}")
    counts = written(counts, "frequent")
    # by powers of two (64 rows at most), from the most frequent; of the last that the bound allows, a part by hash
    level = F.floor(F.log2("n")).cast("int")
    taken, left = F.lit(False), 0.9 * FREQUENT
    for at, n in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        taken |= (level == at) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(min(1, left / n) * (1 << 20)))
        left = max(0, left - n)
    got = counts.where(taken).select("token", level.cast("byte").alias("level")).toArrow()
    tokens = got.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got.column("level").to_numpy().astype(np.int8)[order]


_SIGNED = "doc_id long, n long, digest binary, bits binary, prefix array<long>"


def _signing(rare: "object"):
    """``rare``: broadcast of the frequent shingles and their counts' powers, by which they stand behind the others."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = rare.value
        for batch, sets in _sets(batches):
            n, digest, bits, prefix = [], [], [], []
            for units in sets:
                n.append(len(units))
                digest.append(xxhash.xxh3_128_digest(units.tobytes()) if len(units) else None)
                bits.append(bitmap(units) if len(units) else None)
                if len(often) and len(units):
                    at = np.minimum(np.searchsorted(often, units), len(often) - 1)
                    last = often[at] == units
                    units = np.concatenate([units[~last], units[last][np.argsort(level[at[last]], kind="stable")]])
                prefix.append(units[: len(units) - required(len(units)) + 1].view(np.int64) if len(units) else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "bits", "prefix"])

    return sign


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "units"])


def _grouped(keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch]):
    """``fn`` for stretches of a sorted partition that end where the keys change, with the places where they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cuts, size, last = [0], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            here = [i for i in range(len(rows)) if rows[i] != (rows[i - 1] if i else last)]
            if here and size:
                at = here[-1]
                cuts += [size + i for i in here]
                held.append(batch.slice(0, at))
                yield fn(pa.Table.from_batches(held), np.array(cuts))
                held, cuts, size = [batch.slice(at)], [0], batch.num_rows - at
            else:
                cuts += [size + i for i in here if size + i]
                held.append(batch)
                size += batch.num_rows
            last = rows[-1]
        if held:
            yield fn(pa.Table.from_batches(held), np.array([*cuts, size]))

    return run


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a binary column, as views of its buffers."""
    out = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [data[a:b].view(np.uint64) for a, b in zip(ends, ends[1:])]
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays: the shorter is looked up in the longer."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _bound(x: np.ndarray, others: np.ndarray, m, n: np.ndarray) -> np.ndarray:
    """Whether sets may be similar, by sizes and by the bits in which their bitmaps differ."""
    differ = np.bitwise_count(others ^ x).sum(-1, dtype=np.int64)
    return similar((m + n - differ) // 2, m, n) & (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*pairs) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_LINKS)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (leader, member) that sizes and bitmaps don't clear, with the member's size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
        kept = pa.array(_bound(_bits(batch, "x"), _bits(batch, "y"), m, n))
        yield batch.select(["leader", "member", "n"]).filter(kept).rename_columns(["leader", "member", "weight"])


def wide(units: np.ndarray) -> np.ndarray:
    """The number of shingles and a bitmap of two to four bits for each (1,024 at least), as 64-bit words."""
    size = max(BITS, 1 << (2 * len(units) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(units % np.uint64(size)).astype(np.int64)] = 1
    return np.concatenate([np.array([len(units)], np.uint64), np.packbits(bits, bitorder="little").view(np.uint64)])


def _cleared(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ``wide`` arrays show that their sets aren't similar; the longer bitmap is folded to the other's length."""
    m, n = int(x[0]), int(y[0])
    x, y = sorted((x[1:], y[1:]), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return not similar((m + n - int(np.bitwise_count(x ^ y).sum())) // 2, m, n)


def _with_wide_leader(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """Pairs of each chunk's members with their leader that wide bitmaps don't clear."""
    ids, lead, sets, out = rows.column("doc_id").to_pylist(), rows.column("lead").to_numpy(), _arrays(rows.column("units")), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = np.arange(a, b)
        for i in at[lead[a:b]]:
            out += [(ids[i], ids[j]) for j in at[~lead[a:b]] if not _cleared(sets[i], sets[j])]
    return _linked(out)


def _with_leader(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """Links of each chunk's members with their leader, whose row is marked."""
    ids, lead, units, out = rows.column("doc_id").to_pylist(), rows.column("lead").to_numpy(), _arrays(rows.column("units")), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = np.arange(a, b)
        for i in at[lead[a:b]]:
            out += [(ids[i], ids[j]) for j in at[~lead[a:b]] if similar(_overlap(units[i], units[j]), len(units[i]), len(units[j]))]
    return _linked(out)


def _bits(rows: pa.Table | pa.RecordBatch, column: str = "bits") -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), np.uint64).reshape(rows.num_rows, -1)


def _chunk_units(bitmaps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            kept = [batch.column(c) for c in ("leader", "chunk", "doc_id", "lead")]
            sets = [(wide(s) if bitmaps and len(s) else s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=["leader", "chunk", "doc_id", "lead", "units"])

    return run


def with_leaders(pairs: DataFrame, texts: DataFrame, bitmaps: bool = False) -> DataFrame:
    """Links (a, b) among the distinct (leader, member, weight) of ``pairs``, or with ``bitmaps`` the pairs that wide bitmaps
    don't clear; ``texts`` has doc_id and text.

    Members go in chunks of bounded weight, and a leader's shingles are sent once for each chunk. Sets are made where the
    texts are read, and only then shuffled, to their chunk."""
    of = F.greatest(F.ceil(F.sum(F.greatest("weight", F.lit(LEAST))) / WEIGHT), F.lit(1)).cast("int")
    parts = pairs.groupBy("leader").agg(of.alias("parts")).where("parts > 1")
    placed = pairs.join(small_side(written(parts, "great-leaders")), "leader", "left")
    chunk = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).alias("chunk")
    placed = placed.select("leader", chunk, F.col("member").alias("doc_id"), F.lit(False).alias("lead"))
    leaders = placed.select("leader", "chunk", F.col("leader").alias("doc_id"), F.lit(True).alias("lead")).distinct()
    placed = small_side(written(placed.unionByName(leaders), "chunks"))
    rows = texts.join(placed, "doc_id").select("leader", "chunk", "doc_id", "lead", "text")
    rows = rows.mapInArrow(_chunk_units(bitmaps), "leader long, chunk long, doc_id long, lead boolean, units binary").where("octet_length(units) > 0")
    compare = _with_wide_leader if bitmaps else _with_leader
    return _dealt(rows, "leader", "chunk").mapInArrow(_grouped(["leader", "chunk"], compare), "a long, b long")


def _units_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id and shingles of the texts of some documents (doc_id)."""
    some = small_side(written(ids.distinct(), "compared"))
    return texts.join(some, "doc_id", "left_semi").mapInArrow(_units, "doc_id long, units binary").where("octet_length(units) > 0")


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "bits"])


def _wide_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, n and wide bitmaps of the texts of some documents (doc_id)."""
    some = small_side(written(ids.distinct(), "compared"))
    return texts.join(some, "doc_id", "left_semi").mapInArrow(_wide, "doc_id long, n long, bits binary").where("n > 0")


def links(pairs: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the distinct (leader, member) of ``pairs``, leader < member, connect.

    Bitmaps first, of large sets wide ones as well; of the pairs that they don't clear, each member's with its least partner; then those between components
    that are still apart, in the same way, and after ``TURNS`` turns all of them. ``bits`` has doc_id, n and bits."""
    both = pairs.join(bits.toDF("leader", "m", "x"), "leader").join(bits.toDF("member", "n", "y"), "member")
    near = both.select("leader", "member", "m", "n", "x", "y").mapInArrow(_near, "leader long, member long, weight long")
    near = written(near.groupBy("leader", "member").agg(F.max("weight").alias("weight")), "near-pairs")
    # the narrow bitmaps of large sets are full
    left = with_leaders(near.where(f"weight > {BITS // 2}"), texts, bitmaps=True).toDF("leader", "member").distinct()
    large = near.where(f"weight > {BITS // 2}").join(left, ["leader", "member"], "left_semi")
    near = written(near.where(f"weight <= {BITS // 2}").unionByName(large), "near-pairs")
    found = None
    for turn in range(TURNS + 1):
        now, last = near, turn == TURNS or (near.agg(F.sum("weight")).first()[0] or 0) <= AT_ONCE
        if not last:
            least = F.min(F.struct("leader", "weight")).alias("p")
            now = written(near.groupBy("member").agg(least).select("p.leader", "member", "p.weight"), "picked")
        got = written(with_leaders(now, texts), "jaccard-links")
        found = got if found is None else found.union(got)
        if last:
            break
        roots = small_side(components(found))
        rest = near.join(small_side(now.select("leader", "member")), ["leader", "member"], "left_anti")
        a, b = roots.toDF("leader", "_a"), roots.toDF("member", "_b")
        rest = rest.join(a, "leader", "left").join(b, "member", "left")
        near = written(rest.where("coalesce(_a, leader) <> coalesce(_b, member)").select("leader", "member", "weight"), "near-pairs")
        if near.isEmpty():
            break
    return written(found, "jaccard-links")


def _tiled(placed: DataFrame, block: int, weight: str) -> DataFrame:
    """``placed`` (token, doc_id, root, n, ...) with a row for each tile that a member is in: tile, side.

    A bucket within a block is one tile. Of others, each size band has blocks of its own, and a tile is two blocks of
    equal or neighbouring bands (or one block with itself)."""
    sizes = placed.groupBy("token", "band").agg(F.sum(F.expr(weight)).alias("w"))
    great = sizes.groupBy("token").agg(F.sum("w").alias("w")).where(f"w > {block}").select("token")
    great = small_side(written(great, "great-buckets"))
    parts = sizes.join(great, "token", "left_semi").withColumn("parts", F.ceil(F.col("w") / block).cast("int"))
    # a row for each band of a great bucket; a band has two neighbours, so a member's row is multiplied by their parts alone
    near = parts.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct("band", "parts").alias("other"))
    near = written(near.groupBy("token", "band").agg(F.collect_list("other").alias("others")), "bands")
    few = placed.join(great, "token", "left_anti").withColumns({"tile": F.lit(""), "side": F.lit(0)})
    many = placed.join(small_side(near, 100_000), ["token", "band"])
    own = F.filter("others", lambda o: o["band"] == F.col("band"))[0]["parts"]
    many = many.withColumn("mine", F.concat_ws(":", "band", F.pmod(F.xxhash64("doc_id"), own)))
    labels = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda p: F.concat_ws(":", o["band"], p))))
    many = many.withColumn("theirs", F.explode(labels))
    tile = F.concat_ws("|", F.least("mine", "theirs"), F.greatest("mine", "theirs"))
    side = F.expr("if(mine = theirs, 0, if(mine < theirs, 1, 2))")
    return few.unionByName(many.withColumns({"tile": tile, "side": side}).drop("others", "mine", "theirs"))


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a tile's two sides, the same ones if it is one block."""
    whole = np.arange(len(side))
    return (whole, whole) if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))


def _narrow_test(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test whether sets (row numbers x or one, and y) may be similar, by sizes and bitmaps."""
    bits, n = _bits(rows), rows.column("n").to_numpy()
    return lambda x, y: _bound(bits[x], bits[y], n[x], n[y])


def _wide_test(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same by ``wide`` bitmaps; pairs of one length each are compared at once, the longer folded to the other's length."""
    n, maps = rows.column("n").to_numpy(), [m[1:] for m in _arrays(rows.column("bits"))]
    width, at, of = np.array([len(m) for m in maps]), np.zeros(len(maps), np.int64), {}
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        at[same], of[w] = np.arange(len(same)), np.stack([maps[i] for i in same])

    def folded(rows: np.ndarray, w: int, to: int) -> np.ndarray:
        return np.bitwise_or.reduce(of[w][at[rows]].reshape(len(rows), w // to, to), axis=1)

    def test(x, y: np.ndarray) -> np.ndarray:
        x, out = np.broadcast_to(x, y.shape), 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
        lengths = width[x] * (1 << 32) + width[y]
        for both in np.unique(lengths[out]):
            v, w = int(both) >> 32, int(both) & 0xFFFFFFFF
            here = np.flatnonzero(out & (lengths == both))
            for part in np.array_split(here, len(here) * max(v, w) // (1 << 21) + 1):
                a, b = x[part], y[part]
                out[part] = _bound(folded(a, v, min(v, w)), folded(b, w, min(v, w)), n[a], n[b])
        return out

    return test


_POSSIBLE = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("other", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("band", pa.int32())])


def _possible(first: bool, test: Callable[[pa.Table], Callable] = _narrow_test):
    def possible(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """Pairs (doc_id, other) that the bitmaps of a tile don't clear, where they are few. Where they are many: at first the
        pairs with the least member of a band, and the token; later the members.

        Members of small tiles are compared with those that stand one, two, ... rows below, for all tiles at once."""
        root, n, side, token, ids, band = (rows.column(c).to_numpy() for c in ("root", "n", "side", "token", "doc_id", "band"))
        near, size = test(rows), np.diff(cuts)
        tile = np.repeat(np.arange(len(size)), size)
        lead = np.zeros(len(n), bool)
        lead[np.lexsort((ids, band, tile))[np.concatenate([[True], np.diff(np.sort(tile * 1000 + band)) > 0])] if len(n) else []] = True
        small = size[tile] <= SMALL
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, min(SMALL, int(size.max(initial=0)))):
            i = np.flatnonzero(small[:-step] & (tile[:-step] == tile[step:]) & (root[:-step] != root[step:]))
            i = i[(side[i] == 0) | (side[i] != side[i + step])]
            for part in np.array_split(i, len(i) // 20_000 + 1):
                hit = part[near(part, part + step)]
                found.append((hit, hit + step))
        marked, many = np.zeros(len(n), bool), np.zeros(len(size), bool)
        for t in np.flatnonzero(size > SMALL):
            a, b = cuts[t], cuts[t + 1]
            if (root[a:b] == root[a]).all():
                continue
            left, right = (x + a for x in _sides(side[a:b]))
            order = right[np.argsort(n[right], kind="stable")]
            sizes, own, total = n[order], [], 0
            for x in left:
                # only the stretch of near sizes
                at = order[np.searchsorted(sizes, -(-PERCENT * n[x] // 100)) : np.searchsorted(sizes, n[x] * 100 // PERCENT, "right")]
                at = at[root[at] != root[x]]
                hit = at[near(x, at)] if len(at) else at
                total += len(hit)
                if total > FEW * size[t]:
                    if not many[t]:
                        for u, v in own:
                            marked[u] = marked[v] = True
                        own = [(u[k], v[k]) for u, v in own for k in (lead[u] | lead[v],)]
                    many[t] = True
                    marked[x] |= len(hit) > 0
                    marked[hit] = True
                    hit = hit[lead[hit] | lead[x]]
                if len(hit):
                    own.append((np.full(len(hit), x), hit))
            if first or not many[t]:
                found += own
        x, y = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        a, b, m = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.maximum(n[x], n[y])
        if len(a):
            a, b, m = np.unique(np.stack([a, b, m]), axis=1)
        if first:
            marked[:] = False
            marked[cuts[:-1][many]] = True  # a row for each token
        pairs, rest = len(a), int(marked.sum())
        joined = lambda of, listed, own: pa.concat_arrays([pa.nulls(pairs, of) if listed is None else pa.array(listed, of), pa.nulls(rest, of) if own is None else pa.array(own[marked], of)])
        columns = [(None, token), (a, ids), (b, None), (None, root), (m, n), (None, band)]
        return pa.RecordBatch.from_arrays([joined(f.type, *c) for f, c in zip(_POSSIBLE, columns)], schema=_POSSIBLE)

    return possible


def _certain(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """Links of each tile that connect components, by exact intersection."""
    roots, sides, units, out = rows.column("root").to_numpy(), rows.column("side").to_numpy(), _arrays(rows.column("units")), []
    n, bits = np.array([len(u) for u in units]), np.stack([np.frombuffer(bitmap(u), np.uint64) for u in units])
    for a, b in zip(cuts[:-1], cuts[1:]):
        root, ids = roots[a:b].copy(), roots[a:b]
        left, right = _sides(sides[a:b])
        for x in left:
            at = right[root[right] != root[x]]
            at = at[_bound(bits[a + x], bits[a + at], n[a + x], n[a + at])] if len(at) else at
            for y in at:
                if root[y] != root[x] and similar(_overlap(units[a + x], units[a + y]), n[a + x], n[a + y]):
                    out.append((ids[x], ids[y]))
                    root[root == root[y]] = root[x]
    return _linked(out)


def _reached(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """The members of buckets that have another member within their reach, whose own reach they are within."""
    n, reach = rows.column("n").to_numpy(), rows.column("reach").to_numpy()
    bucket = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) << 32
    order = np.lexsort((n, bucket))
    m, far, bucket = n[order], reach[order], bucket[order]
    # the greatest reach of 1, 2, 4, ... members in the order of sizes
    most = [far]
    while (1 << len(most)) <= int(np.diff(cuts).max(initial=1)):
        step = 1 << (len(most) - 1)
        most.append(np.maximum(most[-1], np.concatenate([most[-1][step:], np.zeros(step, far.dtype)])))
    at, end = np.arange(len(m)), np.searchsorted(m + bucket, far + bucket, "right")
    kept = np.zeros(len(m), bool)
    for a, b in ((np.searchsorted(bucket, bucket), np.minimum(at, end)), (at + 1, end)):
        level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
        for k in np.unique(level[b > a]):
            i = np.flatnonzero((b > a) & (level == k))
            kept[i] |= np.maximum(most[k][a[i]], most[k][b[i] - (1 << k)]) >= m[i]
    left, columns = np.sort(order[kept]), ("token", "doc_id", "n")
    return pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[left]) for c in columns], names=list(columns))


def _several(placed: DataFrame) -> DataFrame:
    """Members (token, doc_id, root, n, band) of the buckets that hold several components."""
    several = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    return written(placed.join(small_side(written(several, "open-buckets")), "token", "left_semi"), "open-members")


def _met(placed: DataFrame, bits: DataFrame, first: bool, wide: bool = False) -> DataFrame:
    """What the tiles of ``placed`` (token, doc_id, root, n, band) leave by ``bits`` (doc_id, n, bits); see ``_possible``."""
    block, weight, test = (MEMBERS * GREAT, f"greatest(n, {GREAT})", _wide_test) if wide else (MEMBERS, "1", _narrow_test)
    tiles = _dealt(_tiled(placed, block, weight).join(bits, ["doc_id", "n"]), "token", "tile")
    kept = "token long, doc_id long, other long, root long, n long, band int"
    return written(tiles.mapInArrow(_grouped(["token", "tile"], _possible(first, test)), kept).distinct(), "possible")


def _listed(met: DataFrame) -> DataFrame:
    return met.where("other is not null").select(F.col("doc_id").alias("leader"), F.col("other").alias("member")).distinct()


def _over(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of ``roots`` whose roots have been connected by ``more``."""
    return _rooted(roots, "root", more).union(more.join(roots, "node", "left_anti"))


def _finished(placed: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) for the components that share a bucket of ``placed`` (token, doc_id, root, n, band) and have a link."""
    roots = None
    # buckets in which too many pairs are possible to list them meet again by wide bitmaps, which are some thirtieth of the sets
    for wide_ in (False, True):
        members = _several(placed)
        maps = written(_wide_of(members.select("doc_id"), texts), "wide-bitmaps") if wide_ else bits
        left = _met(members, maps, False, wide_)
        found = links(_listed(left), bits, texts)
        names = members.select("doc_id", "root").distinct()
        named = found.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        more = components(written(named, "jaccard-links"))
        roots = more if roots is None else written(_over(roots, more), "jaccard-roots")
        many = left.where("other is null").select("token", "doc_id", "root", "n", "band")
        if many.isEmpty():
            return roots
        placed = _rooted(many, "root", small_side(more)).select("token", "doc_id", "root", "n", "band")
    many = _several(placed)
    units = written(_units_of(many.select("doc_id"), texts), "open-sets")
    tiles = _tiled(many, WEIGHT, f"greatest(n, {LEAST})").join(units, "doc_id").select("token", "tile", "side", "doc_id", "root", "units")
    more = _dealt(tiles, "token", "tile").mapInArrow(_grouped(["token", "tile"], _certain), "a long, b long")
    return _over(roots, components(written(more, "jaccard-links")))


def _roots(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the representatives ``reps`` (doc_id, n, bits, prefix) that have links."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int").alias("band")
    # of two similar sets the first shingle that both have leaves room for the overlap behind it, which bounds the other's size
    reach = F.floor(((100 + PERCENT) * (F.col("n") - F.col("at")) - PERCENT * F.col("n")) / PERCENT).cast("long").alias("reach")
    keys = reps.select(F.posexplode("prefix").alias("at", "token"), "doc_id", "n").select("token", "doc_id", "n", reach)
    several = keys.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token", (F.col("k") > MEMBERS).alias("great"))
    placed = written(keys.join(small_side(written(several, "shared-shingles")), "token"), "jaccard-buckets")
    few = _dealt(placed.where("not great").select("token", "doc_id", "n", "reach"), "token")
    few = few.mapInArrow(_grouped(["token"], _reached), "token long, doc_id long, n long").select("token", "doc_id", "n", band)
    # in larger buckets those that share a shingle with a set of their own band or of one beside it
    placed = placed.where("great").select("token", "doc_id", "n", band)
    around = placed.groupBy("token", "band").agg(F.count("*").alias("k"))
    around = around.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "k")
    around = around.groupBy("token", "band").agg(F.sum("k").alias("k")).where("k > 1").select("token", "band")
    placed = few.unionByName(placed.join(around, ["token", "band"], "left_semi"))
    placed = written(placed.withColumn("root", F.col("doc_id")), "jaccard-near")
    bits = reps.join(small_side(written(placed.select("doc_id").distinct(), "jaccard-members")), "doc_id", "left_semi").select("doc_id", "n", "bits")
    met = _met(placed.select("token", "doc_id", "root", "n", "band"), bits, True)
    roots = components(links(_listed(met), bits, texts))
    open_ = met.where("other is null").select("token").distinct()
    if open_.isEmpty():
        return roots
    # buckets of which only the pairs with a band's least member have been compared
    rest = _rooted(placed.join(small_side(open_), "token", "left_semi"), "root", small_side(roots))
    joined = written(_finished(rest.select("token", "doc_id", "root", "n", "band"), bits, texts), "jaccard-roots")
    return written(_over(roots, joined), "jaccard-roots")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    often = spark.sparkContext.broadcast(frequent(texts))
    signed = written(texts.mapInArrow(_signing(often), _SIGNED), "shingle-sets")
    # of equal sets the least document stands for all
    reps = written(signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "shingle-reps")
    copies = signed.where("n > 0").select("doc_id", "digest").join(reps, "digest").where("doc_id <> node").select("doc_id", "digest")
    copies = small_side(written(copies.distinct(), "copies"))
    roots = _roots(signed.where("n > 0").join(copies, ["doc_id", "digest"], "left_anti").drop("digest"), texts)
    known = reps.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    found = signed.where("n > 0").select("doc_id", "n", "digest").join(known, "digest").select("doc_id", "n", "component_id")
    # a document of several texts joins their components
    split = found.groupBy("doc_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("c")).where("b < c")
    split = written(split.select("doc_id", "b"), "split")
    if not split.isEmpty():
        same = components(found.join(small_side(split), "doc_id").where("component_id > b").select(F.col("component_id").alias("a"), "b"))
        found = _rooted(found, "component_id", small_side(same))
    empty = signed.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = found.unionByName(empty).groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
