"""Quality rules as learned decision lists (operator 4).

Statistics of every whole text are measured once; a bounded sample of labelled rows (``SAMPLE``) is fetched, and
sequential covering learns a list of rules for the rejected class: each grows a conjunction of thresholds by FOIL gain
on two thirds of the sample and is pruned on the last third; the first rule that there covers fewer rows than ``COVERED``
or whose precision is below ``PRECISE`` ends the list. The list is emitted as an ordered conditional expression over the statistics, which Spark applies to all rows.

Words are ``[^\\x20\\x09-\\x0D]+``, case kept. A repeated word is one in a window of three words that the text has twice
or more (each place counts once); a repeated line is one with a word that equals an earlier line.

Defined results: null and empty texts have statistics of 0 and fail the base rule. Rows without label only get judged;
rows labelled more than once count with their least label; null labels are ignored. Without labels of both kinds the
list is empty and the base rule alone decides. Repeated rows are judged one by one. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh, slices, small_side, written

#: Labelled rows that the list is learned from, at most about so many.
SAMPLE = 20_000
#: Precision on the pruning set below which a rule isn't taken; rows that it must cover there; longest conjunction; most
#: rules; thresholds tried a feature.
PRECISE, COVERED, LONGEST, MOST, CUTS = 0.95, 4, 4, 16, 40
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), *((c, pa.int64()) for c in _COUNTS)])


def _repeated(ids: np.ndarray) -> int:
    """Places in windows of three that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    ids = np.unique(ids, return_inverse=True)[1]  # numbered within the text: below n, so a pair of them fits 64 bits
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    key = pair[:-1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    place = np.zeros(n, bool)
    place[:-2] |= again
    place[1:-1] |= again
    place[2:] |= again
    return int(place.sum())


def _stats(text: str | None, ids: dict[bytes, int]) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at the six blanks above
    blanks = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known = [ids.setdefault(w, len(ids)) for w in words]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper = without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        len(words),
        len(text or "") - blanks,
        without(b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        _repeated(np.array(known, np.int64)),
        len(lines),
        upper,
        upper + without(b"abcdefghijklmnopqrstuvwxyz"),
        without(b"0123456789"),
        without(b".,;:!?"),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[bytes, int] = {}
    for batch in slices(batches, "text"):
        if len(ids) > 300_000:
            ids.clear()
        rows = [_stats(t, ids) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *columns], schema=_SCHEMA)


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the counts of each row's whole text."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row_key"), docs["text"].cast("string").alias("text"))
    return docs.mapInArrow(_measure, "doc_id long, row_key long, " + ", ".join(f"{c} long" for c in _COUNTS))


def features() -> dict[str, Column]:
    """What the rules may test, from the counts."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "word_length": c("word_chars") / words,
        "symbols": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeated": c("n_repeat_words") / words,
        "upper": c("n_upper") / F.greatest(c("n_letters"), F.lit(1)),
        "digits": c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
        "marks": c("n_marks") / words,
        "line_words": c("n_words") / F.greatest(c("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, sign, threshold) holds; covered and precision on the pruning set."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int = 0
    precision: float = 0.0

    def column(self) -> Column:
        has = features()
        return reduce(lambda a, b: a & b, [has[f] >= t if sign == ">=" else has[f] <= t for f, sign, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{f} {sign} {t:.6g}" for f, sign, t in self.tests)


@dataclass(frozen=True)
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def kept(self) -> Column:
        """The ordered conditional: the first rule that holds rejects, else the text is kept."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(False)).otherwise(out)
        return out


def _holds(x: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, t in tests:
        out &= x[:, f] >= t if sign == ">=" else x[:, f] <= t
    return out


def _grown(x: np.ndarray, bad: np.ndarray) -> list:
    tests, live = [], np.ones(len(x), bool)
    while len(tests) < LONGEST and bad[live].any() and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        now, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(x.shape[1]):
            v, y = x[live, f], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # cut between ends and the next value
            if len(ends) > CUTS:
                # where classes change most matters; evenly by rank of the bad rows as well as of all rows
                rank = np.cumsum(y)[ends]
                ends = ends[np.unique(np.concatenate([np.linspace(0, len(ends) - 1, CUTS).astype(int), np.searchsorted(rank, np.linspace(1, rank[-1], CUTS)).clip(0, len(ends) - 1)]))]
            for p, n, sign in ((np.cumsum(y)[ends], np.cumsum(~y)[ends], "<="), (p0 - np.cumsum(y)[ends], n0 - np.cumsum(~y)[ends], ">=")):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - now), -1)
                if len(gain) and gain.max() > best[0]:
                    e = ends[int(gain.argmax())]
                    best = (gain.max(), (f, sign, float((v[e] + v[e + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= _holds(x, [best[1]])
    return tests


def learned(x: np.ndarray, bad: np.ndarray, names: list[str]) -> DecisionList:
    """Sequential covering over rows ``x`` (in a random order) of which ``bad`` are to be rejected."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MOST and bad[left & ~third].sum() >= 3 and (~bad).any():
        tests = _grown(x[left & ~third], bad[left & ~third])
        xp, yp = x[left & third], bad[left & third]

        def worth(tests, xp=xp, yp=yp) -> tuple[float, int]:
            on = _holds(xp, tests)
            p, n = int(yp[on].sum()), int((~yp[on]).sum())
            return (p + 1) / (p + n + 2), p + n

        while len(tests) > 1 and (shorter := max((tests[:k] for k in range(1, len(tests))), key=worth)) and worth(shorter)[0] >= worth(tests)[0]:
            tests = shorter
        on = _holds(xp, tests)
        precision = yp[on].mean() if on.any() else 0.0
        if not tests or on.sum() < COVERED or precision < PRECISE:
            break
        rules.append(Rule(tuple((names[f], sign, t) for f, sign, t in tests), int(on.sum()), float(precision)))
        left &= ~_holds(x, tests)
    return DecisionList(rules)


def decision_list(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn from the rows of ``stats`` that ``labels`` (doc_id, quality) mark, a hashed sample of about ``sample`` rows."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(labels.count(), 1))
    labels = labels.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    has = features()
    rows = stats.join(labels, "doc_id").select(F.xxhash64("row_key").alias("_at"), "quality", *[c.alias(n) for n, c in has.items()])
    rows = rows.limit(2 * sample).toPandas().sort_values("_at", kind="stable")
    return learned(rows[list(has)].to_numpy(float).reshape(-1, len(has)), (rows["quality"] == 0).to_numpy(bool), list(has))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, row_key, the counts, base_failed and kept for each row of ``docs``."""
    stats = written(measured(docs), "stats")
    rules = decision_list(stats, labels, sample)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def passed(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    key, doc = fresh("key", docs), fresh("doc", docs)
    gone = judged(docs, labels, sample).where(~F.col("kept")).select(F.col("row_key").alias(key), F.col("doc_id").alias(doc)).distinct()
    gone = small_side(written(gone, "rejected"))
    # the hash of id and text tells rows of one id apart; two ids never share a verdict
    return docs.join(gone, (row_key(docs) == gone[key]) & docs["doc_id"].cast("long").eqNullSafe(gone[doc]), "left_anti")
