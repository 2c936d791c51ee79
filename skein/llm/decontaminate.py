"""Benchmark decontamination by spaced-seed hashing (operator 1), in DataFrame functions alone.

A mask such as 11010111 is laid over every window of words; the words under its ones are hashed, those under its zeros
are ignored, so a substituted word there does no harm. Hashes of the texts are joined with those of the benchmark
items. Each hit fixes a diagonal (the offset of the item in the text); on it the words of text and item are compared,
and the overlap is verified if some window of ``WINDOW`` words (or the whole item, if it has fewer) agrees in at least
``AGREE`` of its words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, without regard to punctuation or layout.
The search is exhaustive: however the words that may differ lie in a window of ``WINDOW`` words, or in an item of 12 words
or more, one of ``MASKS`` has them all under its zeros somewhere. Shorter items have masks of their own length (``own``),
made so that the same holds; in items of one to four words no word may differ. Tests try every placement.

Defined results: null, empty and word-less texts and items have no overlap. Repeated rows give one result. Rows without
doc_id or item_id have none. Columns other than doc_id, text, item_id are ignored. Empty tables give no overlaps.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh, small_side, written

MASKS = ("11100100101", "11010111", "10001111")
#: Items of fewer words have masks of their own.
SHORT = 12
WINDOW, AGREE = 16, 0.8
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def own(n: int) -> tuple[str, ...]:
    """Masks of n words such that any n - ceil(AGREE * n) of them are under the zeros of one: a greedy cover.

    About half of the words stay under ones, four at least as long as there are so many."""
    differ = n - ceil(AGREE * n)
    if not differ:
        return ("1" * n,)
    todo, masks = set(combinations(range(n), differ)), []
    sets = list(combinations(range(n), n - max(4, n // 2 + 1)))
    while todo:
        zeros = max(sets, key=lambda z: sum(set(t) <= set(z) for t in todo))
        todo -= {t for t in todo if set(t) <= set(zeros)}
        masks.append("".join("0" if i in zeros else "1" for i in range(n)))
    return tuple(masks)


def _words(text: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(text), _SPLIT, " "))
    return F.when(text != "", F.split(text, " "))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: str, mask: str) -> Column:
    """The mask's hash at each window of the array column ``hashes``; empty if it is shorter than the mask."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    h = F.col(hashes)
    at = F.when(F.size(h) >= len(mask), F.sequence(F.lit(0), F.size(h) - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[h[i + o] for o in ones], F.lit(mask)))


def _positions(df: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """key, seed and at: all windows of all masks, with the word that each begins at; a null seed if there is none.

    (The outer form of explode: for the inner one Spark would push a filter on the seeds below the hashing, and hash anew
    for each window.)"""
    lengths = [F.greatest(F.size("hashes") - (len(m) - 1), F.lit(0)) for m in masks]
    df = df.select(key, *[n.alias(f"n{i}") for i, n in enumerate(lengths)], F.concat(*[_seeds("hashes", m) for m in masks]).alias("seeds"))
    df = df.select(key, *[f"n{i}" for i in range(len(masks))], F.posexplode_outer("seeds").alias("pos", "seed"))
    at = F.col("pos")
    start = F.lit(0)
    for i in range(len(masks)):
        at = F.when(F.col("pos") >= start, F.col("pos") - start).otherwise(at) if i else at
        start = start + F.col(f"n{i}")
    return df.select(key, "seed", at.alias("at"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each text and item that overlap: doc_id, item_id, starts_at (word of the text that the best window
    begins at), n_words (of that window), n_equal (of its words), n_overlap and n_overlap_equal (whole diagonal)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("item_words"))
    items = items.where("item_id is not null and item_words is not null").distinct()
    items = written(items.withColumn("hashes", _hashed(F.col("item_words"))), "items")
    short = items.where(F.size("hashes") < SHORT).select(F.size("hashes")).distinct()
    lengths = sorted(r[0] for r in short.collect())  # fewer than SHORT numbers
    masks = {n: own(n) for n in lengths}
    seeds = _positions(items.where(F.size("hashes") >= SHORT), "item_id", MASKS)
    for n in lengths:
        seeds = seeds.union(_positions(items.where(F.size("hashes") == n), "item_id", masks[n]))
    seeds = written(seeds.withColumnRenamed("at", "item_at").where("seed is not null").distinct(), "item-seeds")

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null and text is not null")
    hashed = docs.select("doc_id", _hashed(_words(F.col("text"))).alias("hashes"))
    found = _positions(hashed, "doc_id", MASKS + tuple(m for n in lengths for m in masks[n]))
    hits = found.join(small_side(seeds), "seed")
    hits = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    hits = written(hits, "hits")

    # the texts of the hits alone are read again; of a text each hit takes only the words that face its item
    ids = small_side(written(hits.select("doc_id").distinct(), "hit-ids"))
    near = docs.join(ids, "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("words"))
    near = hits.join(items.select("item_id", "item_words"), "item_id").join(near, "doc_id")
    first = F.greatest(F.lit(0), -F.col("offset"))
    last = F.least(F.size("item_words"), F.size("words") - F.col("offset"))
    near = near.withColumn("first", first).withColumn("n", last - first)
    near = near.withColumn("mine", F.slice("words", F.col("first") + F.col("offset") + 1, F.col("n")))
    near = near.withColumn("theirs", F.slice("item_words", F.col("first") + 1, F.col("n")))
    near = near.withColumn("equal", F.zip_with("mine", "theirs", lambda a, b: F.when(a == b, 1).otherwise(0)))
    near = near.withColumn("size", F.least(F.lit(WINDOW), F.size("item_words"))).where("n >= size")
    near = near.select("doc_id", "item_id", "offset", "first", "n", "size", "equal").withColumn(
        "best",
        F.array_max(
            F.transform(
                F.sequence(F.lit(1), F.col("n") - F.col("size") + 1),
                lambda i: F.struct(
                    F.aggregate(F.slice(F.col("equal"), i, F.col("size")), F.lit(0), lambda a, b: a + b).alias("n"),
                    (-i).alias("at"),
                ),
            )
        ),
    )
    near = near.where(F.col("best.n") >= F.ceil(F.col("size") * AGREE))
    near = near.select(
        "doc_id",
        "item_id",
        F.struct(
            F.col("best.n").cast("long").alias("n_equal"),
            F.aggregate("equal", F.lit(0), lambda a, b: a + b).cast("long").alias("n_overlap_equal"),
            F.col("n").cast("long").alias("n_overlap"),
            F.col("size").cast("long").alias("n_words"),
            (F.col("first") + F.col("offset") - F.col("best.at") - 1).cast("long").alias("starts_at"),
        ).alias("best"),
    )
    return near.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with the columns of ``docs``; rows without doc_id stay."""
    dropped = fresh("gone", docs)
    gone = written(overlaps(docs, items).select(F.col("doc_id").alias(dropped)).distinct(), "contaminated")
    return docs.join(small_side(gone), docs["doc_id"].cast("long") == gone[dropped], "left_anti")
