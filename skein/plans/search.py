"""The search report: symbols, nodes and lines of text, ranked; and files with all words of a phrase where little is found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ordering import collated
from skein.functions.text import grams, grams_of, query_tokens, tokens

EXCERPT = 240
# Fixed value: extensions of source files.
SOURCE_FILE = r"(?i)\.(?:[cm]?[jt]sx?|py|go|rs|java|kt|kts|swift|dart|cs|c|cc|cpp|cxx|h|hh|hpp|hxx|m|mm|php|rb|lua|scala|sc|hs|lhs|pas|pp)\z"


class Pattern:
    """A pattern in which ``*`` stands for anything, without regard to case."""

    def __init__(self, pattern: str):
        self.text, self.wild = pattern.lower(), "*" in pattern
        self._regex = "(?iu)" + ".*".join(re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", p) for p in pattern.split("*"))

    def exact(self, value: Column) -> Column:
        return value.rlike(rf"(?iu)\A(?:{self._regex[5:]})\z") if self.wild else F.lower(value) == self.text

    def at(self, value: Column) -> Column:
        """Place of the first match from 1, 0 without one."""
        return F.regexp_instr(value, F.lit(self._regex)) if self.wild else F.instr(F.lower(value), self.text)

    def found(self, value: Column) -> Column:
        return value.rlike(self._regex) if self.wild else F.lower(value).contains(self.text)


def terms_of(pattern: str) -> list[str]:
    words = [w for w in re.split(r"[^\w]+", pattern.lower()) if len(w) >= 3]
    return [t for w in words for t in ([w, w[:-3]] if w.endswith("ing") and len(w) > 5 else [w])]


def text_rank(path: Column, pattern: str) -> Column:
    terms, lower = terms_of(pattern), F.lower(path)
    rank = F.when(path.rlike(SOURCE_FILE), 5).otherwise(6)
    if not terms:
        return rank
    parts = F.split(lower, r"[^\p{L}\p{N}_]+")
    part = F.arrays_overlap(parts, F.array(*[F.lit(t) for t in terms]))
    inside = F.lit(False)
    for t in terms:
        inside = inside | lower.contains(t)
    return F.when(part, 3).when(inside, 4).otherwise(rank)


def excerpt(line: Column, at: Column) -> Column:
    """At most 240 characters around column ``at`` (from 0), with an ellipsis where text is left out."""
    start = F.greatest(F.lit(0), F.least(at - 80, F.length(line) - EXCERPT))
    room = F.when(start > 0, EXCERPT - 2).otherwise(EXCERPT - 1)
    end = F.least(F.length(line), start + room)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(line, start + 1, end - start), F.when(end < F.length(line), "…").otherwise(""))
    return F.when(F.length(line) <= EXCERPT, line).otherwise(cut)


def text_matches(text: DataFrame, pattern: str) -> DataFrame:
    """path, line, column (both from 1), excerpt and rank of each line of ``text`` (path, content) with the pattern."""
    p = Pattern(pattern)
    lines = text.where(p.found(F.col("content"))) if not p.wild else text
    lines = lines.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "said"))
    lines = lines.withColumn("at", p.at(F.col("said"))).where("at > 0")
    return lines.select("path", (F.col("n") + 1).alias("line"), F.col("at").alias("column"), excerpt(F.col("said"), F.col("at") - 1).alias("excerpt"), text_rank(F.col("path"), pattern).alias("rank"))


def postings(text: DataFrame) -> DataFrame:
    """path and gram of texts (path, content): what ``holding`` looks a pattern up in."""
    return text.select("path", F.explode(grams(F.col("content"))).alias("gram"))


def holding(found: DataFrame, pattern: str) -> DataFrame | None:
    """path of the texts of which ``postings`` hold all grams of a pattern; None if it has none, so that any may match."""
    wanted = grams_of(pattern)
    if not wanted:
        return None
    each = found.where(F.col("gram").isin(wanted)).groupBy("path").agg(F.count("*").alias("n"))
    return each.where(F.col("n") == len(wanted)).select("path")


def phrase_documents(text: DataFrame, phrase: str) -> DataFrame:
    """path and score of the documents that hold all words of the phrase; only those that hold them in the path, if any do."""
    words = query_tokens(phrase)
    if len(words) < 2 or not re.search(r"\s", phrase):
        return text.select("path", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    docs = text.select("path", tokens(F.col("path")).alias("p"), tokens(F.col("content")).alias("t"))
    count = lambda c, w: F.size(F.filter(c, lambda x: x == w))
    for i, w in enumerate(words):
        docs = docs.withColumn(f"p{i}", count("p", w)).withColumn(f"t{i}", count("t", w))
    has, in_path, score = F.lit(True), F.lit(True), F.lit(0)
    for i, w in enumerate(words):
        has, in_path = has & (F.col(f"p{i}") + F.col(f"t{i}") > 0), in_path & (F.col(f"p{i}") > 0)
        score = score + 100 * F.col(f"p{i}") + F.when(F.lower("path").contains(w), 20).otherwise(0) + F.least(F.lit(10), F.col(f"t{i}"))
    docs = docs.where(has).select("path", score.cast("long").alias("score"), in_path.alias("in_path"))
    any_path = docs.agg(F.coalesce(F.max("in_path"), F.lit(False)).alias("_any"))
    return docs.join(F.broadcast(any_path)).where("in_path or not _any").select("path", "score")


def search_report(nodes: DataFrame, symbols: DataFrame, text: DataFrame, pattern: str, near: DataFrame | None = None) -> DataFrame:
    """type, id (of a symbol or node, else the path), line, column, excerpt, rank; best first.

    ``near``: those of ``text`` whose lines are looked at, where an index tells that others can't have the pattern."""
    p = Pattern(pattern)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("column", "int"), ("excerpt", "string"))]
    key = lambda *cs: F.concat_ws("\x00", *cs)
    s = symbols.where(p.found(F.col("name"))).select(
        F.lit("symbol").alias("type"), "id", *nothing, F.when(p.exact(F.col("name")), 0).otherwise(2).alias("rank"), key("file_path", "name", F.coalesce("kind", F.lit("")), "id").alias("sort"))
    plain = nodes.where("symbol_file is null")
    n = plain.where(p.found(F.col("id")) | p.found(F.col("label"))).select(
        F.lit("node").alias("type"), "id", *nothing, F.when(p.exact(F.col("id")) | p.exact(F.col("label")), 1).otherwise(3).alias("rank"), key("id", "label").alias("sort"))
    t = text_matches(text if near is None else near, pattern)
    t = t.select(F.lit("text").alias("type"), F.col("path").alias("id"), "line", "column", "excerpt", "rank", key("path", F.lpad((F.col("line") - 1).cast("string"), 10, "0"), F.lpad((F.col("column") - 1).cast("string"), 10, "0")).alias("sort"))
    direct = s.unionByName(n).unionByName(t)
    if not p.wild and len(query_tokens(pattern)) > 1 and direct.limit(5).count() < 5:
        best = phrase_documents(text, pattern).orderBy(F.desc("score"), collated("path")).limit(3)  # three rows
        ranked = [(r["path"], f"{i:010d}") for i, r in enumerate(best.collect())]
        more = nodes.sparkSession.createDataFrame(ranked, "id string, sort string") if ranked else None
        if more is not None:
            more = more.join(plain.select("id"), "id", "left_semi").join(direct.where("type = 'node'").select("id"), "id", "left_anti")
            direct = direct.unionByName(more.select(F.lit("node").alias("type"), "id", *nothing, F.lit(4).alias("rank"), "sort"))
    return direct.orderBy("rank", collated("sort")).drop("sort")
