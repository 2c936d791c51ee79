"""The task map: files that matter to a task, by their words and by their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ordering import collated
from skein.functions.text import TASK_STOP, bases, has_term, normalized, query_tokens, words_in
from skein.graph import Graph, with_files, written
from skein.operators.traverse import flowed, numbered, pagerank

# The most that a map shows, and the folders that have one level more to an area.
MOST_TERMS, MOST_FILES, MOST_SYMBOLS, MOST_RELATIONS = 16, 20, 3, 12
TEST_FILE = r"(?i)(?:^|/)(?:__tests__|tests?)(?:/|\.)|\.(?:spec|test)\.[^/]+\z"


def documents(graph: Graph, text: DataFrame) -> DataFrame:
    files = graph.nodes.where("node_type = 'file' and symbol_file is null").select(F.col("id").alias("path"))
    docs = text.join(files, "path", "left_semi")
    return docs.select("path", normalized(F.col("path")).alias("p"), normalized(F.col("content")).alias("t"))


def term_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """path and, for each term, 2 where the path has it, 1 where only the text has it, else 0."""
    found = docs.select("path", *[bases(words_in(F.col(c))).alias(c) for c in ("p", "t")])
    each = [F.when(has_term(F.col("p"), t), 2).when(has_term(F.col("t"), t), 1).otherwise(0).alias(f"h{i}") for i, t in enumerate(terms)]
    return found.select("path", *each)


def lexical(docs: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    """path, score and matched terms of each document; and the terms, the rarest 16 in the query's order."""
    candidates = query_tokens(query, 3, TASK_STOP)
    hits = written(term_hits(docs, candidates), "hits")
    row = hits.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"h{i}") > 0).alias(f"h{i}") for i in range(len(candidates))]).first()
    df = {i: row[f"h{i}"] for i in range(len(candidates)) if row[f"h{i}"]}
    chosen = sorted(sorted(df, key=lambda i: (df[i], i))[:MOST_TERMS])
    score = F.lit(0.0)
    for i in chosen:
        idf = F.log(F.lit((row["n"] + 1) / (df[i] + 1))) + 1
        score = score + idf * F.when(F.col(f"h{i}") == 2, 4).otherwise(F.col(f"h{i}"))
    matched = F.array_compact(F.array(*[F.when(F.col(f"h{i}") > 0, F.lit(candidates[i])) for i in chosen])) if chosen else F.array().cast("array<string>")
    score = F.when(F.col("path").rlike(TEST_FILE), score * 0.15).otherwise(score)
    return hits.select("path", score.alias("score"), matched.alias("matched")), [candidates[i] for i in chosen]


def edge_weight(kind: Column) -> Column:
    return F.when(kind.isin("call", "event", "inherit", "reference"), 3).when(kind == "type-import", 1).otherwise(2)


def file_links(graph: Graph, paths: DataFrame) -> DataFrame:
    """Weighted links between the files of ``paths``, each both ways."""
    pairs = with_files(graph.edges.where("kind <> 'contains'"), graph.nodes).where("src_file <> dst_file")
    pairs = pairs.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), edge_weight(F.col("kind")).alias("weight"), "kind")
    ids = paths.select(F.col("path").alias("_p")).distinct()
    pairs = pairs.join(ids, F.col("src") == F.col("_p"), "left_semi").join(ids, F.col("dst") == F.col("_p"), "left_semi")
    both = pairs.select("src", "dst", "weight").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))


def file_ranks(graph: Graph, weights: DataFrame, iterations: int = 20) -> DataFrame:
    """``pagerank`` over the ``file_links`` of the files of ``weights`` (id, weight).

    Ends of edges become numbers as they are met, a symbol's the one of its file, so links are never texts."""
    names = numbered(weights)
    files = names.select(F.col("id").alias("_f"), F.col("n").alias("_n"))
    symbols = graph.nodes.where("symbol_file is not null").select(F.col("id").alias("_id"), "symbol_file")
    places = symbols.join(files, F.col("symbol_file") == F.col("_f")).select("_id", "_n").union(files)
    flows = graph.edges.where("kind <> 'contains'").select("src", "dst", edge_weight(F.col("kind")).alias("weight"))
    for end in ("src", "dst"):
        flows = flows.join(places, F.col(end) == F.col("_id")).withColumn(end, F.col("_n")).drop("_id", "_n")
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return flowed(flows.where("src <> dst").select(F.explode(ways).alias("_way"), "weight").select("_way.*", "weight"), names, iterations)


def source_area(path: Column) -> Column:
    """The part of a path that names its area: up to one folder below src or tests, else its first four parts."""
    parts = F.split(path, "/")
    n = F.size(parts)
    at = F.least(*[F.when(F.array_position(parts, w) > 0, F.array_position(parts, w)).otherwise(1_000_000) for w in ("src", "tests")]).cast("int")
    deep = F.when(F.get(parts, at).isin("extension", "webview"), 2).otherwise(1)
    size = F.when(at == 1_000_000, F.least(n, F.lit(4))).when(at >= n - 1, at).otherwise(F.least(n, at + deep))
    return F.array_join(F.slice(parts, F.lit(1), size), "/")


def balanced(ranked: DataFrame) -> DataFrame:
    """place of each file when the areas take turns, the area of the best file first (path, lexical, score)."""
    order = [(F.col("lexical") > 0).desc(), F.desc("score"), F.desc("lexical")]
    out = ranked.withColumn("area", source_area(F.col("path")))
    out = out.withColumn("turn", F.row_number().over(Window.partitionBy("area").orderBy(*order, collated("path"))))
    firsts = out.where("turn = 1").select("area", *[F.col(c).alias(f"_{c}") for c in ("lexical", "score")])
    return out.join(firsts, "area").orderBy("turn", (F.col("_lexical") > 0).desc(), F.desc("_score"), F.desc("_lexical"), collated("area")).drop("_lexical", "_score")


def top_symbols(symbols: DataFrame, terms: list[str], most: int = MOST_SYMBOLS) -> DataFrame:
    """Of each file the symbols whose names have most of the terms."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + has_term(F.col("_found"), t).cast("int")
    best = Window.partitionBy("file_path").orderBy(F.desc("hits"), collated("name"), collated("id"))
    out = symbols.withColumn("_found", bases(words_in(normalized(F.col("name"))))).withColumn("hits", hits)
    return out.drop("_found").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)


def task_map(graph: Graph, text: DataFrame, query: str, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """path, matched, lexical, graph and score of the files in order, and the terms used."""
    limit = min(limit, MOST_FILES) if isinstance(limit, int) and limit > 0 else 8
    docs = documents(graph, text)
    words, terms = lexical(docs, query)
    words = written(words, "lexical")
    links = written(file_links(graph, words), "file-links")
    ranks = pagerank(links, words.select(F.col("path").alias("id"), F.col("score").alias("weight")))
    hit = words.where("score > 0").select("path")
    near = hit.union(hit.join(links, F.col("path") == F.col("src")).select("dst")).distinct()
    all_ = words.join(ranks, F.col("path") == F.col("id"))
    top = all_.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("_s"), F.greatest(F.max("rank"), 1 / F.greatest(F.count("*"), F.lit(1))).alias("_r"))
    scored = all_.join(near, "path", "left_semi").join(F.broadcast(top)).select(
        "path", "matched", F.col("score").alias("lexical"), F.col("rank").alias("graph"), (F.col("score") / F.col("_s") * 0.85 + F.col("rank") / F.col("_r") * 0.15).alias("score"))
    return balanced(scored).limit(limit), terms


def map_relationships(graph: Graph, paths: list[str]) -> DataFrame:
    """Pairs among the files that a map shows (20 at most), with sorted kinds; twelve of them."""
    pairs = with_files(graph.edges.where("kind <> 'contains'"), graph.nodes).where("src_file <> dst_file")
    pairs = pairs.where(F.col("src_file").isin(paths) & F.col("dst_file").isin(paths))
    pairs = pairs.groupBy(F.col("src_file").alias("from"), F.col("dst_file").alias("to")).agg(F.sort_array(F.collect_set("kind")).alias("edge_types"))
    return pairs.orderBy(collated("from"), collated("to")).limit(MOST_RELATIONS)
