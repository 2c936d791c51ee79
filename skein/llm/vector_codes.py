"""Product codes of vectors by k-means under norm-of-sum bounds (operator 11).

Components become integers floor(1024 * x), so distances, means and ties are exact. Vectors are cut into equal parts; a
codebook of a part begins as that part of the first vectors, and rounds of assignment and rounding down of means follow.

A round reads, for each part of a vector, its entry and a lower bound of the distance to the other entries of each group
of entries, with the stamp of the round in which the bound was found. All codebooks so far are kept, so a bound is
lowered by the most that an entry of the group has really moved since its stamp, the norm of the sum of its moves, which
is never more than the sum of the norms. Only groups whose bound doesn't exceed the exact distance to the present entry
are measured again. Bounds are rounded downwards and movements upwards, and a tie is measured, so results are those of a
whole search.

Tasks add up the parts of each entry before sums are shuffled; codebooks, of a size that doesn't depend on the rows, go
through the driver. Each round's assignments are a table in the shared folder.

Defined results: rows whose vector is null or holds a null, NaN or infinity are dropped, and so are those whose length
isn't a multiple of the number of parts or differs from that of the first vector (of least vec_id, nulls last). Repeated
rows count each; rows of equal vec_id come in the order of their vectors. Rows without vec_id are coded. With fewer vectors
than entries, codebooks are as short. Components beyond +-2^27 (64 components; the bound keeps the error within a long)
count as that bound. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of entries that share a bound.
GROUPS = 16
#: Rows measured at once.
SLICE = 4096

Books = list[np.ndarray]


def whole(embedding: Column) -> Column:
    """Whether a vector isn't null and all its components are numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _limit(size: int) -> int:
    """The greatest component, a power of two, for which the squared distances of whole vectors fit in a long."""
    return 1 << (61 - (size - 1).bit_length()) // 2


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each entry."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:  # every intermediate sum is an integer that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few rounds of k-means over the entries themselves. Any grouping gives the same codes."""
    centres = entries[:: -(-len(entries) // GROUPS)][:GROUPS].astype(np.float64)
    for _ in range(5):
        of = ((entries[:, None].astype(np.float64) - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([entries[of == g].mean(0) if (of == g).any() else c for g, c in enumerate(centres)])
    return of


def moves(history: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """[stamp, group]: the most that an entry of the group has moved from the codebook of the stamp to the latest, rounded up."""
    now, n = history[-1], groups.max() + 1
    out = np.zeros((len(history), n))
    for stamp, then in enumerate(history):
        norm = np.sqrt(((now - then).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        np.maximum.at(out[stamp], groups, norm)
    return out


def assign(x: np.ndarray, history: list[np.ndarray], groups: np.ndarray, code=None, low=None, stamp=None):
    """Nearest entry of the latest codebook for each row, its squared distance, bounds, stamps and how many distances were found.

    Without ``code`` all are measured."""
    entries, now = history[-1], len(history) - 1
    n, members = len(x), [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
    first = code is None
    if first:
        code, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        need = np.ones((n, len(members)), bool)
        low, stamp = np.zeros((n, len(members))), np.zeros((n, len(members)), np.uint8)
        old, eff = np.full(n, -1), low
    else:
        old, code = code, code.copy()
        best = ((x - entries[code]) ** 2).sum(1)
        eff = low - moves(history, groups)[stamp, np.arange(len(members))]
        need = eff <= (np.sqrt(best.astype(np.float64)) * (1 + 1e-9))[:, None]
        low, stamp = low.astype(np.float64), stamp.copy()
    old_best, found, scanned = best.copy(), n * (not first), []
    for g, of in enumerate(members):
        rows = np.flatnonzero(need[:, g])
        if not len(rows) or not len(of):
            continue
        d = squares(x[rows], entries[of])
        found += d.size
        at = d.argmin(1)
        least, index = d[np.arange(len(rows)), at], of[at]
        d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        scanned.append((g, rows, least, index, d, of))
        better = (least < best[rows]) | ((least == best[rows]) & (index < code[rows]))
        best[rows[better]], code[rows[better]] = least[better], index[better]
    for g, rows, least, index, d, of in scanned:
        # the least distance to the others of the group: the second least if the nearest is the row's entry
        mine = index == code[rows]
        elsewhere = np.where(mine, d.min(1), least)
        low[rows, g], stamp[rows, g] = np.sqrt(elsewhere.astype(np.float64)) * (1 - 1e-9), now
    if not first:
        # the entry that was left becomes one of the others of a group that wasn't measured
        rows = np.flatnonzero(code != old)
        rows = rows[~need[rows, groups[old[rows]]]]
        g = groups[old[rows]]
        low[rows, g] = np.minimum(eff[rows, g], np.sqrt(old_best[rows].astype(np.float64)) * (1 - 1e-9))
        stamp[rows, g] = now
    return code, best, np.nextafter(low.astype(np.float32), np.float32(-np.inf)), stamp, found


_STATE = pa.schema([("code", pa.binary()), ("low", pa.binary()), ("stamp", pa.binary()), ("error", pa.int64())])


def _parts(column: pa.Array, size: int) -> np.ndarray:
    """[part, row, component] of a column of integer lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, PARTS, size // PARTS).transpose(1, 0, 2)


def _assigned(history: list[Books], groups: list[np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, SLICE):
                batch = whole_batch.slice(at, SLICE)
                n, out = batch.num_rows, []
                ends = np.cumsum([0, *(g.max() + 1 for g in groups)])
                if len(history) > 1:
                    raw = [b"".join(batch.column(c).to_pylist()) for c in ("code", "low", "stamp")]
                    codes, lows, stamps = (np.frombuffer(b, t).reshape(n, -1) for b, t in zip(raw, (np.uint8, np.float32, np.uint8)))
                for p, x in enumerate(_parts(batch.column("parts"), size)):
                    known = ()
                    if len(history) > 1:
                        known = codes[:, p].astype(np.int64), lows[:, ends[p] : ends[p + 1]], stamps[:, ends[p] : ends[p + 1]]
                    out.append(assign(x, [books[p] for books in history], groups[p], *known))
                rows = [np.hstack([o[i].reshape(n, -1) for o in out]) for i in (0, 2, 3)]
                binary = [pa.array([r.tobytes() for r in np.ascontiguousarray(a.astype(t))], pa.binary()) for a, t in zip(rows, (np.uint8, np.float32, np.uint8))]
                kept = [batch.column(c) for c in ("vec_id", "label", "parts")]
                error = pa.array(sum(o[1] for o in out), pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, *binary, error], names=["vec_id", "label", "parts", *_STATE.names])

    return run


def _sums(entries: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number and sum of a task's parts for each part position and entry."""
        sums, count = np.zeros((PARTS, entries, size // PARTS), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p, x in enumerate(_parts(batch.column("parts"), size)):
                np.add.at(sums[p], codes[:, p], x)
                count[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        rows = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["part", "entry", "n", "sums"])

    return run


def _means(state: DataFrame, books: Books, size: int) -> Books:
    sums = state.select("code", "parts").mapInArrow(_sums(len(books[0]), size), "part int, entry int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size // PARTS)]
    out = [b.copy() for b in books]
    # at most PARTS x ENTRIES rows
    for part, entry, n, *s in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        out[part][entry] = [x // n for x in s]
    return out


def trained(vectors: DataFrame) -> tuple[DataFrame | None, list[Books]]:
    """Rows of ``vectors`` (vec_id, embedding, label) with code and error, and the codebooks of all rounds; None without rows."""
    rows = vectors.where(whole(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    head = rows.orderBy(*order).select(F.size("embedding").alias("size")).first()
    if head is None:
        return None, []
    most = _limit(head.size)
    number = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))), F.lit(most)), F.lit(-most))
    rows = rows.where(F.size("embedding") == head.size)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.transform("embedding", number).alias("parts"))
    first = np.array([r.parts for r in rows.orderBy(*order).select("parts").limit(ENTRIES).collect()], np.int64)
    books = list(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    groups = [grouped(b) for b in books]
    history = [books]
    kept = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, parts array<long>"
    state = rows.select("vec_id", "label", "parts")
    for r in range(ROUNDS + 1):
        state = state.mapInArrow(_assigned(history, groups, head.size), f"{kept}, code binary, low binary, stamp binary, error long")
        state = written(state, "codes")
        if r < ROUNDS:
            history.append(_means(state, history[-1], head.size))
    return state, history


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of ``vectors`` (vec_id, embedding, label)."""
    state, history = trained(vectors)
    if state is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    sums = state.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    out = state.join(small_side(written(sums, "label-errors")), F.col("label").eqNullSafe(F.col("of")))
    code = F.lower(F.hex("code"))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(history[-1])).alias("codebooks_sha256"))
