"""Token ids in packed binary rows (operator 7).

Each text is tokenised whole by a public vocabulary (a parameter), cut losslessly into pieces of at most ``length``
ids, and the pieces are packed into rows of ``length`` by best-fit decreasing: the fullest row that still has room takes
the next longest piece, found by a segment tree over the free capacities. Packing runs within pools of bounded size
(``POOL`` ids), cut from each input partition in order, so memory is bounded and a lost executor's rows come out equal.

The order of the documents is kept: each pool holds documents of consecutive positions, ``since`` is its least position
and its rows are counted by their first document, so rows in the order of (since, row) follow the input pool by pool. With
``in_files`` positions are those in the Parquet files that the documents are read from, file by file in the order of
their part numbers, however Spark deals the files to tasks; otherwise they are those in the partitions.

A row holds the ids as little-endian integers (2 bytes if the vocabulary allows, else 4), padded to ``length``, the
cumulative lengths of its segments (0 first) and, for each segment, the document, the piece's number in it and its
first token, and the position of each token (padding has none): positions start anew at 0 in each segment.

Defined results: null and empty texts have no tokens, hence no segment. Rows without doc_id are packed with a null in
doc_ids. Repeated rows are packed each. Extra columns are ignored; an empty table gives no rows. The vocabulary is read
by the driver and broadcast (``MOST_BYTES`` at most); a missing one is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import slices

LENGTH, POOL, MOST_BYTES = 2048, 2_000_000, 64 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAD = 50_256


#: White space as the pattern has it, in a run so long that the library's expression would fail on it.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class Tokens:
    """Ids of whole texts. A very long run of white space is a piece of its own, but for its last sign before other text."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY):
        import tiktoken

        lines = (vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        parts, since = [], 0
        for gap in _GAP.finditer(text):
            end = gap.end() - (gap.end() < len(text))
            parts += [self._plain(text[since : gap.start()]), np.array(self.coding._encode_single_piece(text[gap.start() : end]), np.uint32)]
            since = end
        parts.append(self._plain(text[since:]))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _plain(self, text: str) -> np.ndarray:
        return self.coding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


def best_fit(sizes: list[int], length: int) -> list[int]:
    """Bin of each size, none above ``length``: decreasing sizes, each to the bin with the least room that suffices.

    The segment tree has a leaf for each amount of room, with the bins that have it; inner nodes tell if any has."""
    width = 1 << length.bit_length()
    tree, having = [0] * (2 * width), [[] for _ in range(length + 1)]
    bins, used = [0] * len(sizes), 0

    def change(room: int, by: int) -> None:
        at = room + width
        while at:
            tree[at] += by
            at >>= 1

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = sizes[i] + width
        # least leaf from here on that has a bin: up until a right neighbour holds one, then down
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < width:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - width
            b = having[room].pop()
            change(room, -1)
        else:
            room, b, used = length, used, used + 1
        bins[i], room = b, room - sizes[i]
        if room:
            having[room].append(b)
            change(room, 1)
    return bins


_ROW = pa.schema([("shard", pa.int32()), ("since", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.list_(pa.int32()))])
_DDL = "shard int, since long, row long, n_tokens int, doc_ids array<long>, pieces array<int>, firsts array<long>, cu_seqlens array<int>, ids binary, position_ids array<int>"


def file_position() -> Column:
    """A row's position in the Parquet files that a table is read from: part number, number of the part's file, row."""
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    return F.shiftleft(number(r"^part-(\d+)"), 40) + F.shiftleft(number(r"-c(\d+)"), 30) + F.col("_metadata.row_index")


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, pad: int = PAD, pool: int = POOL, in_files: bool = False) -> DataFrame:
    """Packed rows: shard, since and row (their key), n_tokens, doc_ids, pieces and firsts (one for each segment),
    cu_seqlens, ids, position_ids."""
    raw = Path(vocabulary).read_bytes()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    places = np.arange(length, dtype=np.int32)

    def rows_of(held: list[tuple], shard: int, before: int, kind: type) -> Iterator[tuple]:
        bins: dict[int, list] = {}
        for item, b in zip(held, best_fit([len(x[3]) for x in held], length)):  # in the order of their positions
            bins.setdefault(b, []).append(item)
        for row, items in enumerate(bins.values(), before):
            ids = np.full(length, pad, kind)
            ends = np.cumsum([0, *(len(x[3]) for x in items)])
            ids[: ends[-1]] = np.concatenate([x[3] for x in items])
            yield shard, held[0][4], row, int(ends[-1]), [x[0] for x in items], [x[1] for x in items], [x[2] for x in items], ends, ids.tobytes(), np.concatenate([places[: len(x[3])] for x in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard = Tokens(shared.value), TaskContext.get().partitionId()
        kind = "<u2" if max(tokens.size - 1, pad) < 65_536 else "<u4"
        held, n, last, count = [], 0, -1, 0

        def packed_up() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, count
            rows = list(rows_of(held, shard, count, kind))
            held, n, count = [], 0, count + len(rows)
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 500]), _ROW)], schema=_ROW)

        for batch in slices(batches, "text"):
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at"))):
                if held and (at < last or at >> 30 != last >> 30):  # another file begins
                    yield from packed_up()
                ids, last = tokens.of(text).astype(kind), at
                for piece, begin in enumerate(range(0, len(ids), length)):
                    held.append((doc, piece, begin, ids[begin : begin + length], at))
                    n += len(held[-1][3])
                    if n >= pool:
                        yield from packed_up()
        if held:
            yield from packed_up()

    at = file_position() if in_files else F.monotonically_increasing_id()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at.alias("at"))
    return docs.where("text is not null and text <> ''").mapInArrow(run, _DDL)
