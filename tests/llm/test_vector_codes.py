"""Vector codes against a whole search in plain Python."""

import hashlib
import math

import numpy as np
import pytest

from skein.llm import vector_codes as vc


def plain(rows):
    """{vec_id: [(code, error, label_error, sha)]} of (vec_id, vector, label) rows, all vectors of one length."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 4
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((square(part, e), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [near(part, books[p]) for p, part in enumerate(cut(v))], y) for i, v, y in kept]
    of = {}
    for _, f, y in found:
        of[y] = of.get(y, 0) + sum(d for d, _ in f)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), of[y], sha) for i, f, y in found)


def vectors(seed, n, size, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size)) * spread
    rows = [(i, (centres[i % 12] + rng.normal(size=size) * 0.2 * spread).astype(np.float32).tolist(), int(i % 5) if i % 7 else None) for i in range(n)]
    return rows + [(n, rows[3][1], 1), (n + 1, rows[3][1], 2), (5, rows[5][1], 0), (None, rows[6][1], 9)]


BAD = [(900_000, None, 1), (900_001, [1.0, None, 2.0, 3.0] * 2, 1), (900_002, [float("nan")] * 8, 1), (900_003, [float("-inf")] + [0.0] * 7, 1)]
SCHEMA = "vec_id long, embedding array<float>, label int"


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n, size", [(700, 8), (120, 12)])
def test_equals_a_whole_search(spark, n, size):
    rows = vectors(n, n, size)
    odd = [(910_000, [1.0] * (size + 4), 1), (910_001, [1.0] * 3, 1), (910_002, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + BAD + odd], SCHEMA + ", code string, PARTS int").repartition(3)
    assert got(vc.compressed(df)) == plain(rows)


def test_great_components_and_no_rows(spark):
    rows = vectors(1, 300, 8, spread=40_000.0)  # squares beyond what a double holds
    assert got(vc.compressed(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    out = vc.compressed(spark.createDataFrame(rows[:2] + [(3, [3e38] * 8, 0), (4, [-3e38] * 8, 0)], SCHEMA)).collect()
    assert len(out) == 4 and all(r.error == 0 for r in out)
    none = vc.compressed(spark.createDataFrame(BAD, SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 8)) * 3000
    x = np.floor(centres[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 8)) * 300).astype(np.int64)
    history = [x[:256].copy()]
    groups = vc.grouped(history[0])
    state, spent = (), []
    for _ in range(5):
        code, best, low, stamp, found = vc.assign(x, history, groups, *state)
        d = vc.squares(x, history[-1])
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        # each bound holds now: no other entry of a group is nearer than it says
        since = low - vc.moves(history, groups)[stamp, np.arange(low.shape[1])]
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        for g in range(low.shape[1]):
            assert (since[:, g] <= np.sqrt(d[:, groups == g].min(1).astype(float))).all()
        spent.append(found / d.size)
        state = code, low, stamp
        history.append(np.stack([np.floor_divide(x[code == e].sum(0), max(1, (code == e).sum())) if (code == e).any() else history[-1][e] for e in range(256)]))
    assert spent[0] == 1 and max(spent[2:]) < 0.5, spent


def test_net_moves_are_no_more_than_the_sum_of_moves():
    rng = np.random.default_rng(6)
    history = [rng.integers(-100, 100, (32, 4))]
    for _ in range(3):
        history.append(history[-1] + rng.integers(-20, 20, (32, 4)))
    groups = vc.grouped(history[0])
    step = sum(np.array([np.linalg.norm(b - a, axis=1)]) for a, b in zip(history, history[1:]))[0]
    net = vc.moves(history, groups)[0]
    assert all(net[g] <= step[groups == g].max() + 1e-6 for g in range(len(net)) if (groups == g).any())
