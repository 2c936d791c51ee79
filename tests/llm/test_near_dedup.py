"""Near duplicates against brute force over all pairs."""

import random

import numpy as np

from skein.llm import near_dedup as nd
from skein.llm.common import WordHashes, words_of

EMPTY = [(900, None), (901, ""), (902, "!!! ..."), (903, None)]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    docs = []
    for family in range(12):
        base = [word() for _ in range(rng.randint(40, 200))]
        for copy in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 10])):
                own[rng.randrange(len(own))] = word()
            docs.append((len(docs) * 3 + 1, " ".join(own).capitalize() + rng.choice(["", ".", "\n"])))
    docs += [(700, "one two"), (701, "One, two"), (702, "one three")]
    rng.shuffle(docs)
    return docs


def brute(docs, similar=0.8):
    cache = WordHashes()
    sets = {d: set(nd.shingles([cache.of(words_of(t))])[0].tolist()) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similar:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_classes_equal_brute_force(spark):
    docs = corpus() + EMPTY
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, "no id", "x", 1)], "doc_id long, text string, key string, leader int")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert got == brute(docs)
    kept = nd.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for c in got.values()})
    assert kept.where("doc_id is null").count() == 1


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g!")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()} == {(1, 1), (2, 1)}
    assert [r.doc_id for r in nd.deduplicated(df).collect()] == [1]
    none = df.where("false")
    assert nd.near_duplicates(none).count() == 0 and nd.deduplicated(none).count() == 0


def test_a_group_of_chained_texts_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]  # each like the next, the ends unlike
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert got == brute(docs) and set(got.values()) == {0}


def test_signatures_estimate_weighted_similarity():
    rng, cache = random.Random(1), WordHashes()
    texts = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)] for n in (3, 40, 300, 5000)]
    texts.append(texts[2][:200] + ["zz"] * 100)
    hashes = [cache.of([w.encode() for w in t]) for t in texts]
    units, starts = nd.shingles(hashes)
    signs = nd.darts(units, starts)
    assert (signs != 0).all()
    a, b = (set(units[starts[i] : starts[i + 1]].tolist()) for i in (2, 4))
    assert abs((signs[2] == signs[4]).mean() - len(a & b) / len(a | b)) < 0.15
    alone = nd.darts(*nd.shingles([hashes[2]]))
    assert (alone[0] == signs[2]).all()  # whatever else is in the batch


def test_long_text_and_repeats():
    hashes = [WordHashes().of([b"a"] * 20_000), WordHashes().of([b"a", b"b"])]
    units, starts = nd.shingles(hashes)
    assert np.diff(starts).tolist() == [19_996, 1] and len(set(units.tolist())) == 19_997


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_similar_texts_behind_many_unlike_ones(spark):
    # a family of texts at 0.3 to 0.75 with low ids; the similar pairs have the highest ids, so they lead hardly a bucket
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]

    def changed(words, n, mark):
        words = list(words)
        for at in rng.sample(range(0, 400, 5), n):
            words[at] = f"{mark}x{at}"
        return words

    docs = [(i, " ".join(changed(base, rng.randint(12, 20), i))) for i in range(120)]
    for i in range(200, 240, 2):
        first = changed(base, 16, i)
        docs += [(i, " ".join(first)), (i + 1, " ".join(changed(first, 4, i + 1)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = brute(docs)
    assert sum(wanted[i + 1] == i for i in range(200, 240, 2)) > 10
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == wanted


def test_bucket_is_finished(spark, monkeypatch):
    # one bucket in small blocks: a large component, texts that are like no other, and pairs that never lead
    for least in (nd.LEAST, nd.BLOCK // 3):
        monkeypatch.setattr(nd, "LEAST", least)
        docs = [(i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(12)]
        docs += [(i, " ".join(["a"] * (i - 19) + [f"same{k}" for k in range(60)])) for i in range(20, 30)]
        docs += [(i, " ".join([f"{i // 2}p{k}" for k in range(60)] + ["end"] * (i % 2))) for i in range(40, 50)]
        signed = spark.createDataFrame([(d, [7]) for d, _ in docs], "doc_id long, bands array<long>")
        got = {r.node: r.root for r in nd._roots(signed, spark.createDataFrame(docs, "doc_id long, text string"), 0.8).collect()}
        assert {d: got.get(d, d) for d, _ in docs} == brute(docs)


def test_a_document_of_two_texts_joins_their_classes(spark):
    rows = [(3, "a b c d e f"), (10, "a b c d e f"), (10, "p q r s t u"), (12, "p q r s t u"), (12, "v w x y z"), (20, "v w x y z"), (30, "k l m n o")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {3: 3, 10: 3, 12: 3, 20: 3, 30: 30}
    assert sorted(r.doc_id for r in nd.deduplicated(df).collect()) == [3, 30]


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, 8), (1, "p q r s t u", 5, 6, 7, 8), (2, "A b c d e f!", 5, 6, 7, 8), (None, None, 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth int, NTH int, gone int, _root int")
    kept = nd.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert {(r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()} == {(1, 1), (2, 1)}
