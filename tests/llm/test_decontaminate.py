"""Spaced-seed overlaps against brute force over all diagonals."""

import math
import random
import re
from itertools import combinations

from skein.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, s in items:
            mine, theirs = words(t), words(s)
            if not theirs:
                continue
            size = min(dc.WINDOW, len(theirs))
            for offset in range(-len(theirs) + 1, len(mine)):
                q = [k for k in range(len(theirs)) if 0 <= k + offset < len(mine)]
                eq = [mine[k + offset] == theirs[k] for k in q]
                best = max((sum(eq[j : j + size]) for j in range(len(eq) - size + 1)), default=0)
                if best >= math.ceil(size * dc.AGREE):
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([2, 4, 5, 6, 7, 8, 9, 10, 11, 14, 20, 40]))) for i in range(36)]
    docs = []
    for d in range(60):
        own = text(rng.randint(0, 80))
        if d % 3 == 0:
            item = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            own[len(own) // 2 : len(own) // 2] = item
        docs.append((d, ", ".join(own).upper()))
    items += [(100, [vocabulary[7]]), (101, [])]
    items = [(i, " ".join(t)) for i, t in items]
    docs += [(100, None), (101, ""), (102, docs[0][1] + " x " * 3000)]
    a = spark.createDataFrame([(d, t, 5) for d, t in docs] + [(0, docs[0][1], 5)], "doc_id long, text string, seed int")
    b = spark.createDataFrame([(*x, "h") for x in items] + [(None, "a b c d e f", "h"), (77, None, "h")], "item_id long, text string, hashes string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in dc.overlaps(a, b).collect()}
    wanted = brute(docs, items)
    assert got == wanted and len(wanted) > 20
    clean = dc.decontaminated(a, b)
    assert clean.columns == a.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.overlaps(a.where("false"), b).count() == 0
    assert dc.overlaps(a, b.where("false")).count() == 0
    assert [tuple(r)[:2] for r in dc.overlaps(a, b).collect()] == [(1, 1)]


def hit(n, differ, masks):
    return any(all(m[d - s] == "0" for d in differ if 0 <= d - s < len(m)) for m in masks for s in range(n - len(m) + 1))


def test_every_placement_is_hit():
    for n in range(1, dc.WINDOW + 1):
        masks = dc.MASKS if n >= dc.SHORT else dc.own(n)
        assert all(hit(n, p, masks) for p in combinations(range(n), n - math.ceil(dc.AGREE * n))), n
        assert n >= dc.SHORT or min(m.count("1") for m in masks) >= min(n, 4)


def test_masks_tolerate_substitutions(spark):
    docs, items = [], []
    for n in (3, 5, 8, 10, 11, 12, 16):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for bad in combinations(range(n), n - math.ceil(dc.AGREE * n)):
            docs.append((len(docs), "before it " + " ".join("other" if i in bad else w for i, w in enumerate(item)) + " behind it"))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in dc.overlaps(a, b).collect()} == set(range(len(docs)))
    assert dc.decontaminated(a.withColumn("gone", a.doc_id).withColumn("GONE_", a.doc_id), b).count() == 0
