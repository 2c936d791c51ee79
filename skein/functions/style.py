"""Styles as columns: legends, decorations, colours."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.glob import matches
from skein.functions.paths import extension
from skein.operators.scope import node_type


@dataclass(frozen=True)
class Rule:
    """Applies where all its constraints hold; the first rule of a list that gives a property wins."""

    pattern: str | None = None
    kind: str | None = None
    type: str | None = None
    color: str | None = None
    shape: str | None = None

    def test(self) -> Column:
        tests = []
        if self.pattern:
            tests.append(matches(F.col("id"), self.pattern, "classes"))
            if "/" not in self.pattern:
                low = self.pattern.lower()
                tests[0] = tests[0] | F.coalesce(matches(F.lower("label"), low, "classes"), F.lit(False)) | F.coalesce(matches(F.lower("symbol_name"), low, "classes"), F.lit(False))
        if self.kind:
            tests.append(F.coalesce(F.col("symbol_kind") == self.kind, F.lit(False)))
        if self.type:
            tests.append(node_type() == self.type)
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def _first(rules: list[Rule], name: str, default: Column) -> Column:
    out = default
    for rule in reversed(rules):
        if getattr(rule, name) is not None:
            out = F.when(rule.test(), F.lit(getattr(rule, name))).otherwise(out)
    return out


def color(rules: list[Rule], default: str) -> Column:
    return _first(rules, "color", F.lit(default))


def shape(rules: list[Rule], default: str = "circle") -> Column:
    return _first(rules, "shape", F.lit(default))


def legend_ids(rules: dict[str, str]) -> Column:
    """Ids of the rules (id to pattern) that fit an edge: its id, kind, or its ends with or without the kind."""
    plain = F.concat("src", F.lit("->"), "dst")
    forms = (F.col("id"), F.col("kind"), plain, F.concat(plain, F.lit("#"), F.col("kind")))
    fits = [reduce(lambda a, b: a | b, [matches(f, pattern, "classes") for f in forms]) for pattern in rules.values()]
    return F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in zip(rules, fits)]))


def edge_color(rules: dict[str, str], default: str) -> Column:
    """By kind or pattern on the id, first rule first."""
    out = F.lit(default)
    for pattern, value in reversed(rules.items()):
        out = F.when((F.col("kind") == pattern) | matches(F.col("id"), pattern, "classes"), value).otherwise(out)
    return out


def extension_color(colors: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for ext, value in colors.items():
        out = F.when(extension(F.col("id")) == ext, value).otherwise(out)
    return out


def hex_color(value: Column, default: str) -> Column:
    """``#`` and six hexadecimal digits in upper case; the default for anything else."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"\A#[0-9A-Fa-f]{6}\z"), F.upper(trimmed)).otherwise(F.lit(default))


def type_color(colors: dict[str, str], own: Column, folder: str, package: str, default: str) -> Column:
    """A node's colour by its type: as set for the type, else the node's own, else the default of folders, packages, all."""
    kind = node_type()
    rest = F.when(kind == "folder", folder).when(kind == "package", package).otherwise(default)
    set_ = F.coalesce(*[F.when(kind == t, c) for t, c in colors.items()], F.lit(None).cast("string"))
    return F.coalesce(set_, F.nullif(own, F.lit("")), rest)


def merged(decorations: DataFrame, properties: list[str]) -> DataFrame:
    """Of each id the set value of highest priority for each property, and all tooltip sections, highest first."""
    out = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col("priority"))).alias(p) for p in properties]
    tips = F.flatten(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("priority", "tooltip")))), lambda t: t.tooltip))
    return decorations.groupBy("id").agg(*out, tips.alias("tooltip"))


def canvas_diameter(degree: Column) -> Column:
    return F.floor(F.least(8 + 3 * F.sqrt(degree), F.lit(30.0)) * 10 + 0.5)
