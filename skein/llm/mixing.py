"""Mixing sources to target weights by Pfair scheduling (operator 5).

Each source's documents, in a hashed order, are cut into blocks. With weight w, a source's j-th block is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot the released block of the earliest deadline goes.
Weights are taken as given, in whole numbers without rounding. Up to any slot, the blocks of a source differ from
weight times slots by less than one, as long as no source has run out; afterwards its slots are left out and the
others keep their proportions. No document is dropped or repeated.

Ranks within a source are counted in salted buckets, whose number follows the source's rows, and added up, so no source's
rows meet in one task. The rule of the earliest deadline is sequential: one task deals the slots, a row a block of ``BLOCK``
documents, and holds one block a source (about 2 microseconds a block; no document passes it). What it deals is a table
that is joined with the rows. Up to ``MOST_SOURCES`` sources, whose names and counts the driver holds; more is an error.

Defined results: a null source is a source of its own ('' in the output of ``scheduled``). Sources without a target weight
come after all others, in equal parts; if none has a weight, all have the same. Null texts and ids count as rows.
Repeated rows have ranks and slots of their own, in any order. Extra columns are ignored by ``scheduled`` and kept by
``mixed``. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import fresh, small_side, written

#: Documents in a block; rows of a source in a salted bucket in the mean, and the least buckets of a source.
BLOCK, ROWS, LEAST_BUCKETS = 64, 1024, 64
#: Slots of ``pattern``; sources at most.
SLOTS, MOST_SOURCES = 1024, 1_000_000
#: Weights that are not given follow the source's rows to this power.
POWER = 0.7


def whole_weights(weights: dict[str, float], slots: int = SLOTS) -> dict[str, Fraction]:
    """Each source's exact part of ``slots`` slots."""
    parts = {s: Fraction(max(w, 0)) for s, w in weights.items()}
    total = sum(parts.values())
    return {s: p / total * slots if total else Fraction(slots, len(parts)) for s, p in parts.items()}


def _dealt(shares: dict[str, Fraction], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int]]:
    """(source, block) slot by slot: earliest deadline first among the released blocks; without end where ``blocks`` is None."""
    shares = {s: Fraction(w) for s, w in shares.items() if w > 0 and (blocks is None or blocks[s])}
    if sum(shares.values()) > 1:
        raise ValueError("the shares are more than the slots")
    waiting = sorted((0, s, 0) for s in shares)  # release, source, block
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * shares[s].denominator // shares[s].numerator), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j
        slot += 1
        if blocks is None or j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * shares[s].denominator // shares[s].numerator, s, j + 1))


def pattern(shares: dict[str, Fraction], slots: int = SLOTS) -> list[tuple[str, int, int]]:
    """(source, block, slot) for the first ``slots`` slots, of which each source has its share."""
    dealt = _dealt({s: Fraction(w) / slots for s, w in shares.items()})
    return [(s, j, slot) for slot, (s, j) in enumerate(islice(dealt, slots))]


def _plan(spark, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """source, block and slot of every block; sources without a weight come last."""
    shares = whole_weights(weights, 1)
    rest = [s for s, w in shares.items() if not w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            since = 0
            for part in (shares, whole_weights(dict.fromkeys(rest, 1), 1)):
                dealt = _dealt(part, blocks)
                while some := list(islice(dealt, 50_000)):
                    source, block = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(range(since, since + len(some)), pa.int64())], names=["source", "block", "slot"])
                    since += len(some)

    return written(spark.range(0, 1, 1, 1).mapInArrow(run, "source string, block long, slot long"), "plan")


def _placed(docs: DataFrame, weights: dict[str, float] | None, block: int) -> tuple[DataFrame, dict[str, str], int]:
    """``docs`` with rank, block and slot in columns whose names, given by the dict, clash with none of its own; and the
    last slot before which no source has run out."""
    name = {n: fresh(n, docs) for n in ("mix_source", "mix_hash", "mix_bucket", "mix_buckets", "mix_before", "rank", "block", "slot")}
    source, hash_, bucket, buckets, before = (name[n] for n in ("mix_source", "mix_hash", "mix_bucket", "mix_buckets", "mix_before"))
    docs = docs.withColumn(source, F.coalesce(docs["source"].cast("string"), F.lit("")))
    docs = docs.withColumn(hash_, F.xxhash64(F.lit("mix"), docs["doc_id"].cast("long"), docs["text"].cast("string")))
    rows = docs.groupBy(source).count().limit(MOST_SOURCES + 1).collect()  # one row a source
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = {r[0]: r[1] for r in rows}
    spark = docs.sparkSession
    cuts = spark.createDataFrame([(s, max(LEAST_BUCKETS, -(-n // ROWS))) for s, n in rows.items()], f"`{source}` string, `{buckets}` long")
    docs = docs.join(F.broadcast(cuts), source).withColumn(bucket, F.pmod(hash_, buckets)).drop(buckets)
    # sums by bucket, a few rows in thousands of documents; in each, rows are ranked by their hash
    counts = docs.groupBy(source, bucket).agg(F.count("*").alias(before))
    up_to = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn(before, F.coalesce(F.sum(before).over(up_to), F.lit(0))), "counts")
    docs = docs.withColumn(name["rank"], F.row_number().over(Window.partitionBy(source, bucket).orderBy(hash_, docs["doc_id"])))
    docs = docs.join(small_side(counts), [source, bucket])
    docs = docs.withColumn(name["rank"], (F.col(before) + F.col(name["rank"]) - 1).cast("long"))
    docs = docs.withColumn(name["block"], F.floor(F.col(name["rank"]) / block).cast("long"))

    targets = {s: (weights or {}).get(s, 0.0) if weights else n**POWER for s, n in rows.items()}
    plan = _plan(spark, targets, {s: -(-n // block) for s, n in rows.items()})
    # the slot of the last block of the source that is the first to run out
    end = plan.groupBy("source").agg(F.max("slot").alias("last")).agg(F.min("last")).first()[0] or 0
    plan = plan.select(F.col("source").alias(source), F.col("block").alias(name["block"]), F.col("slot").alias(name["slot"]))
    return docs.join(small_side(plan), [source, name["block"]]).drop(hash_, bucket, before), name, end


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, rank (in the source), block, slot, and on_target: no source has run out before that slot.

    ``weights`` are the sources' target weights; without them, rows to the power ``POWER``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64(F.col("text").cast("string")).alias("text"))
    placed, name, end = _placed(docs, weights, block)
    return placed.select("doc_id", F.col(name["mix_source"]).alias("source"), name["rank"], name["block"], name["slot"], (F.col(name["slot"]) <= end).alias("on_target"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, sorted by slot and by rank within the block: read in order, they are the mixture."""
    placed, name, _ = _placed(docs, weights, block)
    return placed.orderBy(name["slot"], name["rank"]).select(*[placed[f"`{c}`"] for c in docs.columns])
