"""Scope: which node and edge types are shown, and what becomes of edges whose ends are hidden."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.glob import matches
from skein.graph import HELD, Graph, firsts, freed, full, slim, written
from skein.operators.ranks import BUCKETS
from skein.schema import EDGE_KINDS, SYMBOL_TYPES, VISIBLE_EDGES


@dataclass(frozen=True)
class NodeType:
    """A definition of a node type; the fields named after a symbol's restrict which symbols it stands for."""

    id: str
    parent: str | None = None
    kinds: tuple[str, ...] | None = None
    plugin_kind: str | None = None
    source: str | None = None
    language: str | None = None
    file_path: str | None = None

    @property
    def symbol_kinds(self) -> tuple[str, ...] | None:
        return self.kinds or ((self.id[7:],) if self.id.startswith("symbol:") else None)

    @property
    def specificity(self) -> float:
        return sum(bool(x) for x in (self.plugin_kind, self.source, self.language, self.file_path)) + (1 / len(self.symbol_kinds) if self.symbol_kinds else 0)

    @property
    def has_matcher(self) -> bool:
        return bool(self.kinds or self.plugin_kind or self.source or self.language or self.file_path)

    def fits(self) -> Column:
        tests = [F.col("symbol_file").isNotNull()]
        if self.kinds:
            tests.append(F.col("symbol_kind").isin(*self.kinds))
        tests += [F.col(c) == v for c, v in (("plugin_kind", self.plugin_kind), ("source", self.source), ("language", self.language)) if v is not None]
        if self.file_path is not None:
            tests.append(matches(F.col("symbol_file"), self.file_path))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


CORE_TYPES = (NodeType("file"), NodeType("folder"), NodeType("package"), *(NodeType(*t) for t in SYMBOL_TYPES))


@dataclass(frozen=True)
class Scope:
    """Types in the order in which they were set; types that aren't named are shown."""

    nodes: dict[str, bool] = field(default_factory=dict)
    edges: dict[str, bool] = field(default_factory=dict)
    types: tuple[NodeType, ...] = ()

    def definitions(self) -> dict[str, NodeType]:
        return {t.id: t for t in (*CORE_TYPES, *self.types)}


def node_type() -> Column:
    by_id = F.when(F.col("id").startswith("pkg:"), "package").otherwise("file")
    return F.coalesce("node_type", F.when(F.col("symbol_file").isNotNull(), "symbol").otherwise(by_id))


def _up(types: dict[str, NodeType], id_: str | None) -> list[str]:
    out: list[str] = []
    while id_ and id_ not in out:
        out.append(id_)
        id_ = types[id_].parent if id_ in types else None
    return out


def expanded(wanted: list[str], types: tuple[NodeType, ...] = ()) -> list[str]:
    """The types a question about ``wanted`` types covers: these, those at or below them, those of the same symbol kinds
    (types of plugins aside), and the parents of all."""
    every = Scope(types=types).definitions()
    own = {t: d for t, d in every.items() if not t.startswith("plugin:")}
    kinds = {k for t in wanted if t in own for k in own[t].kinds or ()}
    out = dict.fromkeys(wanted)
    for t in every:
        below = any(w in _up(every, t) for w in wanted) or ("symbol" in wanted and (t.startswith("symbol:") or ":symbol" in t))
        if below or (t in own and kinds & set(own[t].kinds or ())):
            out[t] = None
    for t in list(out):
        out.update(dict.fromkeys(_up(every, t)))
    return list(out)


def saved_scope(
    nodes: dict[str, bool], edges: dict[str, bool], seen_types: list[str] = (), seen_kinds: list[str] = (),
    declared_types: dict[str, bool] | None = None, declared_kinds: dict[str, bool] | None = None, types: tuple[NodeType, ...] = (),
) -> Scope:
    """The scope that settings stand for: files alone by default, edges by ``VISIBLE_EDGES``.

    What plugins declare takes their default, but what is scoped to a plugin (``plugin:`` types, kinds with a colon) is
    off; kinds that are merely seen in the graph are on, types are off. Settings come last. A type that isn't set itself
    is shown if a type of the same symbol kinds is, or one below it."""
    core = {t.id: t for t in CORE_TYPES}
    on = {t: t == "file" for t in core}
    on |= {t: v and not t.startswith("plugin:") for t, v in (declared_types or {}).items()}
    shown = {k: k in VISIBLE_EDGES for k in EDGE_KINDS} | {k: v and ":" not in k for k, v in (declared_kinds or {}).items()}
    on = {**{t: False for t in seen_types}, **on, **nodes}
    shown = {**{k: ":" not in k for k in seen_kinds}, **shown, **edges}
    kinds = {k for t, d in core.items() if on.get(t) for k in d.kinds or ()}
    on |= {t: True for t, d in core.items() if t not in nodes and kinds & set(d.kinds or ())}
    for t in [t for t, v in on.items() if v]:
        on |= {up: True for up in _up(core, t)[1:] if up not in nodes}
    return Scope(on, shown, types)


def hidden_kinds(scope: Scope) -> set[str]:
    """Symbol kinds whose most specific, else latest, named type is off."""
    types, state = scope.definitions(), {}
    for id_, on in scope.nodes.items():
        if id_.startswith("symbol:"):
            kinds = (types[id_].kinds if id_ in types else None) or (id_[7:],)
            for kind in kinds:
                if kind not in state or state[kind][0] <= 1 / len(kinds):
                    state[kind] = (1 / len(kinds), on)
    return {k for k, (_, on) in state.items() if not on}


def in_scope(scope: Scope) -> Column:
    types = scope.definitions()
    off = {t for t, on in scope.nodes.items() if not on}
    off_types = [t for t in types if off & set(_up(types, t))] + [t for t in off if t not in types]
    shown = ~node_type().isin(*off_types) if off_types else F.lit(True)
    kind = F.col("symbol_kind")
    if kinds := hidden_kinds(scope):
        shown = shown & ~F.coalesce(kind.isin(*sorted(kinds)), F.lit(False))
    # a symbol's most specific definition decides; symbols without one aren't shown
    ranked = sorted((t for t in types.values() if t.parent and t.specificity > 0), key=lambda t: -t.specificity)
    best = F.lit(None).cast("boolean")
    for t in reversed(ranked):
        best = F.when(t.fits(), F.lit(not off & set(_up(types, t.id)))).otherwise(best)
    shown = shown & F.when(kind.isNull() | (kind == ""), F.coalesce(best, F.lit(True))).otherwise(F.coalesce(best, F.lit(False)))
    for t in types.values():
        if t.id in off and ":" in t.id and (t.plugin_kind or t.source or t.language or t.file_path):
            shown = shown & ~t.fits()
    return shown


def places(nodes: DataFrame, shown: Column) -> DataFrame:
    """id of each node, and where the scope shows it: state (``OWN``: as itself, ``MOVED``: as the file of a hidden symbol, else
    ``GONE``), to (that file; null if not moved) and file (that contains what is shown; null if this is no symbol). One table,
    so that edges meet it once at each end; it says only what differs from the id, so that they carry no text twice."""
    each = nodes.select("id", "symbol_file", F.coalesce(shown, F.lit(False)).alias("shown"))
    seen = each.where("shown").select(F.col("id").alias("_f"), F.col("symbol_file").alias("_of"))
    out = each.join(seen, ~F.col("shown") & (F.col("symbol_file") == F.col("_f")), "left")
    return out.select(
        "id",
        F.when(F.col("shown"), OWN).when(F.col("_f").isNotNull(), MOVED).otherwise(GONE).cast("byte").alias("state"),
        F.when(~F.col("shown"), F.col("_f")).alias("to"),
        F.when(F.col("shown"), F.col("symbol_file")).otherwise(F.col("_of")).alias("file"),
    )


#: States of a place.
GONE, OWN, MOVED = 0, 1, 2


def _at_places(edges: DataFrame, where: DataFrame, side: str) -> DataFrame:
    """Edges with the place of an end: a_state, a_to, a_file of src, b_state, b_to, b_file of dst; null of ends that are no nodes."""
    end = {"a": "src", "b": "dst"}[side]
    names = {c: f"{side}_{c}" for c in ("id", "state", "to", "file")}
    return edges.join(where.select(*[F.col(c).alias(n) for c, n in names.items()]), F.col(end) == F.col(names["id"]), "left").drop(names["id"])


def _with_files(edges: DataFrame, where: DataFrame, side: str) -> DataFrame:
    """Edges with a_file or b_file alone, the file that contains their src or dst."""
    end = {"a": "src", "b": "dst"}[side]
    return edges.join(where.select(F.col("id").alias("_id"), F.col("file").alias(f"{side}_file")), F.col(end) == F.col("_id"), "left").drop("_id")


def _put(edges: DataFrame, side: str) -> DataFrame:
    """An end of edges put to its place, but for ``contains``, so that the next join doesn't carry both. _went tells whether this is
    another one; edges without a kind keep their ends, and _at is the place."""
    end = {"a": "src", "b": "dst"}[side]
    at = F.when(F.col(f"{side}_state") == MOVED, F.col(f"{side}_to")).when(F.col(f"{side}_state") == OWN, F.col(end))
    new = {end: F.when(F.col("kind") != "contains", at).otherwise(F.col(end)), f"{side}_went": F.coalesce(at != F.col(end), F.lit(False)), f"{side}_at": F.when(F.col("kind").isNull(), at)}
    return edges.withColumns(new).drop(f"{side}_state", f"{side}_to")


def _moved(edges: DataFrame) -> DataFrame:
    """Slim edges whose ends have been ``_put``; loops that arise go, loops that were stay. The id keeps what follows its last ``#``."""
    a, b = F.coalesce("a_at", "src"), F.coalesce("b_at", "dst")
    same = ~(F.col("a_went") | F.col("b_went"))
    edges = edges.where((F.col("kind") == "contains") | same | (a != b))
    goes = (F.col("kind") != "contains") & ~same
    hash_ = F.lit("#")
    suffix = F.when(F.instr("id", "#") > 0, F.concat(hash_, F.substring_index("id", "#", -1))).otherwise(F.concat(hash_, F.col("kind")))
    suffix = F.when(F.col("_said"), suffix).otherwise(F.concat(hash_, F.substring_index("kind", "#", -1)))
    said = F.col("_said") | (goes & (F.instr("kind", "#") > 0))  # a kind with a # makes an id that doesn't say the whole kind
    return edges.withColumns({"_said": F.coalesce(said, F.lit(False)), "id": F.when(goes & said, F.concat(a, F.lit("->"), b, suffix)).otherwise(F.col("id"))})


def projected(edges: DataFrame, nodes: DataFrame, shown: Column) -> DataFrame:
    """Edges between nodes for which ``shown`` holds: a hidden symbol gives way to its file if that is visible, else the
    edge goes. ``contains`` edges pass."""
    where, out = places(nodes, shown), slim(edges)
    for side in ("a", "b"):
        out = _put(_at_places(out, where, side).where(f"kind = 'contains' or {side}_state > {GONE}"), side)
    return full(_moved(out)).select(*edges.columns)


def _half(edges: DataFrame) -> DataFrame:
    """Slim edges that have met the places of their src, written: what that shuffled goes before they meet those of dst. _odd marks
    edges whose id may be that of an edge with other ends or kind, or is none."""
    told = F.col("_said") | F.contains("src", F.lit("->")) | F.contains("kind", F.lit("#")) | F.col("dst").isNull()
    return written(edges.withColumn("_odd", F.coalesce(told, F.lit(True))), "half-placed")


def _even(half: DataFrame) -> bool:
    """Whether no edge is odd and no file and kind has more edges than a task holds and than are its share, counted in buckets of
    their hashes. Then all edges of a pair of files may go to one task, and edges of the same id are of one pair."""
    most = int(half.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("kind", F.coalesce("a_file", "src")), F.lit(most * BUCKETS))
    counts = half.groupBy(bucket).agg(F.count("*").alias("n"), F.bool_or("_odd").alias("_odd"))
    with freed(half.sparkSession):
        row = counts.agg(F.max("n").alias("n"), F.sum("n").alias("every"), F.bool_or("_odd").alias("_odd")).first()
    return not row["_odd"] and (row["n"] or 0) <= max(HELD, (row["every"] or 0) // most)


def _specific(edges: DataFrame, columns: list[str], even: bool) -> DataFrame:
    """Of the edges of a kind between two files those with most symbol ends (fewest for type-import); first of each id.

    ``edges`` are slim, with a_file and b_file of ends that are symbols. ``even`` ones are dealt by their files and kind once, and
    sorted once, for both questions."""
    ends = F.col("a_file").isNotNull().cast("int") + F.col("b_file").isNotNull().cast("int")
    rank = F.when(F.col("kind") == "type-import", -ends).otherwise(ends)
    pair, files = ["kind", "_a", "_b"], {"_a": F.coalesce("a_file", "src"), "_b": F.coalesce("b_file", "dst")}
    if even:
        order = F.asc_nulls_last("ord")
        every = Window.partitionBy(*pair).orderBy("src", "dst", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # dealt by what is made anew behind the shuffle, which carries no end's text twice
        out = edges.select(*columns, "_said", "a_file", "b_file").repartition("kind", *files.values())
        out = out.withColumns({**files, "_rank": rank}).withColumn("_best", F.max("_rank").over(every))
        out = out.where("kind = 'contains' or _rank = _best")
        out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(*pair, "src", "dst").orderBy(order))).where("_nth = 1")
        return full(out).select(*columns)
    # written once, as it is read several times. Aggregates and joins rather than a window: the best rank of a hot pair is
    # combined before the shuffle, and Spark splits the join
    out = written(edges.select(*columns, "_said", "a_file", "b_file"), "ranked-edges").withColumns({"_rank": rank, **files})
    # most pairs have edges of one rank. A hash of pairs finds the others, and some more if hashes are equal; only their
    # edges are compared, and what comes of it is written, so that it is broadcast if it is small
    mixed = out.where("kind <> 'contains'").groupBy(F.xxhash64(*pair).alias("_h")).agg(F.max("_rank").alias("_best"), F.min("_rank").alias("_least"))
    mixed = written(mixed.where("_best > _least").select("_h"), "mixed-pairs")
    some = out.where("kind <> 'contains'").join(mixed, F.xxhash64(*pair) == F.col("_h"), "left_semi")
    best = some.groupBy(*pair).agg(F.max("_rank").alias("_best"), F.min("_rank").alias("_least"))
    best = written(best.where("_best > _least").drop("_least"), "best-ranks")
    out = out.join(best, pair, "left").where("_best is null or _rank = _best")
    return firsts(full(out).select(*columns))


def most_specific(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``_specific`` for edges as they are; ends that are no nodes count as files."""
    # a file and an end that is no node are alike here
    where = written(places(nodes.where("symbol_file is not null"), F.lit(True)).select("id", "file"), "places")
    half = _half(_with_files(slim(edges), where, "a"))
    return _specific(_with_files(half, where, "b"), edges.columns, _even(half))


def apply_scope(graph: Graph, scope: Scope) -> Graph:
    """Both ends of the edges that are left are among the nodes that are left."""
    shown = in_scope(scope)
    off = [k for k, on in scope.edges.items() if not on]
    edges = graph.edges.where(~F.col("kind").isin(*off)) if off else graph.edges
    where = written(places(graph.nodes, shown), "places")

    def put(edges: DataFrame, side: str) -> DataFrame:
        # what contains and what is contained must be shown themselves
        return _put(_at_places(edges, where, side).where(f"{side}_state = {OWN} or ({side}_state = {MOVED} and kind <> 'contains')"), side)

    half = _half(put(slim(edges), "a"))
    return Graph(graph.nodes.where(shown), _specific(_moved(put(half, "b")), edges.columns, _even(half)))
