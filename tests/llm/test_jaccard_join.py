"""The join of shingle sets against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import jaccard_join as jj


def sets_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{doc_id: (n_shingles, component_id)} over all pairs."""
    rows = [(d, sets_of(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    size = {}
    for d, s in rows:
        size[d] = max(size.get(d, 0), len(s))
    return {d: (size[d], find(d)) for d in root}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    shared = [word() for _ in range(30)]
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.5:
                own[3:3] = shared
            docs.append((len(docs) * 3 + 1, rng.choice([" ", "\n", " \t"]).join(own).capitalize()))
    docs += [(5000, None), (5003, ""), (5006, " \n\t "), (5009, "One two"), (5012, "one TWO"), (5015, "one three"), (5018, "a b c d e"), (5021, "a\x1fb"), (5024, "Ä b"), (5027, "ä b")]
    rng.shuffle(docs)
    return docs


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("often", [jj.OFTEN, 2])
def test_equals_all_pairs(spark, monkeypatch, often):
    monkeypatch.setattr(jj, "OFTEN", often)
    rows = corpus(often)
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows] + [(None, "no id", 1, "x", 2)], "doc_id long, text string, n int, TOKEN string, root int").repartition(3)
    assert got(jj.joined(df)) == brute(rows)


@pytest.mark.parametrize("few", [0, 4])
def test_texts_behind_many_unlike_ones_in_small_tiles(spark, monkeypatch, few):
    # a family in which the least member is similar to few, and pairs of the highest ids
    for name, value in (("MEMBERS", 16), ("WEIGHT", 4000), ("SMALL", 4), ("FEW", few)):
        monkeypatch.setattr(jj, name, value)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]

    def changed(words, n, mark, size=300):
        words = list(words)
        for at in rng.sample(range(0, 300, 5), n):
            words[at] = f"{mark}x{at}"
        return words[:size]

    rows = [(i, " ".join(changed(base, rng.randint(5, 12), i, rng.choice([300, 280, 230, 200])))) for i in range(100)]
    for i in range(200, 230, 2):
        first = changed(base, 14, i)
        rows += [(i, " ".join(first)), (i + 1, " ".join(changed(first, 4, i + 1)))]
    wanted = brute(rows)
    assert len({c for _, c in wanted.values()}) > 20 and len({c for _, c in wanted.values()}) < len(rows) - 10
    assert got(jj.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == wanted


def test_chains_repeats_several_texts_and_no_rows(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]  # each like the next, the ends unlike
    rows += [(900, "a b c d e f"), (900, "a b c d e f"), (910, "a b c d e f"), (910, "p q r s t u v"), (912, "p q r s t u v"), (950, None), (950, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jj.joined(df)) == brute(rows)
    assert got(jj.joined(df.where("false"))) == {}


def test_bit_counts_bound_the_overlap_from_above():
    rng = np.random.default_rng(2)
    for n in (3, 40, 400, 5000):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 2**63, n // 3 + 1, np.uint64)]))
        bits = [np.frombuffer(jj.bitmap(x), np.uint64) for x in (a, b)]
        bound = (len(a) + len(b) - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2
        assert jj._overlap(a, b) == len(np.intersect1d(a, b)) <= bound
        # wide bitmaps never clear a pair of this or a greater overlap
        sets = [np.unique(rng.integers(0, 2**63, n, np.uint64))]
        sets.append(np.concatenate([sets[0][: len(sets[0]) * 9 // 10], np.unique(rng.integers(0, 2**63, n // 20, np.uint64))]))
        m, k = len(sets[0]), len(np.unique(sets[1]))
        if jj.similar(len(np.intersect1d(*sets)), m, k):
            assert not jj._cleared(jj.wide(sets[0]), jj.wide(np.unique(sets[1])))
        if n > 100:
            assert jj._cleared(jj.wide(a), jj.wide(b[b > b[len(b) // 3]])) and jj._cleared(jj.wide(a), jj.wide(np.unique(rng.integers(0, 2**63, n * 5 // 4, np.uint64))))
    unlike = [np.frombuffer(jj.bitmap(np.unique(rng.integers(0, 2**63, 200, np.uint64))), np.uint64) for _ in range(2)]
    assert not jj._bound(unlike[0], unlike[1][None], 200, np.array([200]))[0]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(300_000)]
    near = list(words)
    for i in range(0, 300_000, 100):
        near[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "v1 v2")]
    assert got(jj.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_words_over_blocks(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abCÄ\t \n\x1fz") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["x" * 500, "", "ends "]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    whole, counts = jj.word_hashes(np.frombuffer(b"".join(data), np.uint8), ends)
    plain = [[w for w in d.lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w] for d in data]
    assert counts.tolist() == [len(p) for p in plain]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip((w for p in plain for w in p), whole.tolist())) and len(set(names.values())) == len(names)
    monkeypatch.setattr(jj, "BYTES", 7)
    again, counts_ = jj.word_hashes(np.frombuffer(b"".join(data), np.uint8), ends)
    assert (again == whole).all() and (counts_ == counts).all()
    sets = jj.shingle_sets(whole, counts)
    assert [len(s) for s in sets] == [len(sets_of(t)) for t in texts]


def test_members_that_no_other_reaches_leave_their_bucket():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = rng.integers(1, 40, rng.integers(1, 30))
        cuts = np.concatenate([[0], np.cumsum(size)])
        token, n = np.repeat(np.arange(len(size)), size), rng.integers(1, 60, cuts[-1])
        reach = (180 * (n - rng.integers(0, 1 + n // 5)) - 80 * n) // 80
        out = jj._reached(pa.table({"token": token, "doc_id": np.arange(len(n)), "n": n, "reach": reach}), cuts)
        meet = (token[:, None] == token) & (n <= reach[:, None]) & (n[:, None] <= reach) & ~np.eye(len(n), dtype=bool)
        assert out.column("doc_id").to_pylist() == np.flatnonzero(meet.any(1)).tolist()


def test_frequent_shingles_stand_behind_rarer_ones():
    texts = [" ".join(f"w{i}" for i in range(24))]
    often = jj.shingle_sets(*jj.word_hashes(np.frombuffer(texts[0].encode(), np.uint8), np.array([len(texts[0])])))[0]
    level = np.arange(len(often), dtype=np.int8)[::-1]
    sign = jj._signing(type("B", (), {"value": (often, level)}))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(texts)], names=["doc_id", "text"])
    prefix = next(sign(iter([batch]))).column("prefix")[0].as_py()
    assert prefix == often[::-1].view(np.int64)[: len(prefix)].tolist() and len(prefix) == 20 - jj.required(20) + 1


def test_wide_bitmaps_in_tiles_clear_what_they_clear_in_pairs():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 3000, np.uint64))
    sets = [np.unique(np.concatenate([base[: rng.integers(300, 3000)], rng.integers(0, 2**63, rng.integers(1, 400), np.uint64)])) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    test = jj._wide_test(pa.table({"n": n, "bits": pa.array([jj.wide(s).tobytes() for s in sets], pa.binary())}))
    x, y = (i.ravel() for i in np.meshgrid(np.arange(30), np.arange(30)))
    near = 100 * np.minimum(n[x], n[y]) >= 80 * np.maximum(n[x], n[y])
    assert test(x, y).tolist() == [bool(k and not jj._cleared(jj.wide(sets[i]), jj.wide(sets[j]))) for i, j, k in zip(x, y, near)]
    assert test(3, y[:5]).tolist() == test(np.full(5, 3), y[:5]).tolist()


def test_unlike_long_texts_with_a_common_passage_send_no_arrays(spark, monkeypatch):
    # their bitmaps of 1,024 bits are full, so every two of them pass these
    for name, value in (("SMALL", 4), ("FEW", 1)):
        monkeypatch.setattr(jj, name, value)
    monkeypatch.setattr(jj, "frequent", lambda texts: (np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    asked, plain = [], jj._units_of
    monkeypatch.setattr(jj, "_units_of", lambda ids, texts: asked.append(1) or plain(ids, texts))
    passage = " ".join(f"p{i}" for i in range(800))
    rows = [(i, passage + " " + " ".join(f"x{i}y{j}" for j in range(2200))) for i in range(40)]
    rows.append((40, rows[0][1] + " end"))
    assert got(jj.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == {i: (2996 + (i == 40), i % 40) for i in range(41)}
    assert not asked
