"""Analyzers: a file's text becomes symbols and relations, by core rules and by plugins, in Spark tasks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import extension
from skein.operators.scope import NodeType

Fact = dict
Analyze = Callable[[str, str], Iterable[Fact]]
log = logging.getLogger(__name__)

#: One row a fact; what ``fact`` says, symbol or relation, decides which columns count.
FACT = (
    "file string, layer int, ord long, fact string, plugin_id string, source_id string, kind string, name string, id string, "
    "start_line int, end_line int, signature string, specifier string, type string, from_symbol string, imported string, local string, member string"
)
_COLUMNS = [c.split()[0] for c in FACT.split(", ")]


HOOKS = ("initialize", "pre_analyze", "files_changed", "post_analyze", "graph_rebuild", "workspace_ready", "unload")
#: From the least to the most work.
IMPACTS = ("settings-only", "projection-only", "reanalyze-plugin-files", "requires-full-index")


@dataclass(frozen=True)
class Plugin:
    """An analyzer of the extensions it names ('*' for all); a later one overrides an earlier one's fact of equal key."""

    id: str
    extensions: tuple[str, ...]
    analyze: Analyze
    enabled: bool = True
    #: (id, shown by default) of the types that it contributes.
    node_types: tuple[tuple[str, bool], ...] = ()
    edge_types: tuple[tuple[str, bool], ...] = ()
    default_filters: tuple[str, ...] = ()
    #: Node types with what they match, for the symbols that the plugin declares.
    types: tuple[NodeType, ...] = ()
    #: Callbacks on the driver, by one of ``HOOKS``; they take tables and may return one.
    hooks: dict[str, Callable] = field(default_factory=dict)
    #: What a change asks for, one of ``IMPACTS``: of the switch ('toggle'), of a setting, else of any ('default').
    impact: dict[str, str] = field(default_factory=dict)

    def analyzes(self, path: Column) -> Column:
        """Whether a path has one of the plugin's extensions."""
        return F.lit(True) if "*" in self.extensions else extension(path).isin(*self.extensions)


@dataclass
class Registry:
    plugins: list[Plugin] = field(default_factory=list)

    def add(self, plugin: Plugin) -> Registry:
        if any(p.id == plugin.id for p in self.plugins):
            raise ValueError(f"plugin {plugin.id} is there already")
        self.plugins.append(plugin)
        return self

    def active(self, switches: dict[str, bool] | None = None) -> list[Plugin]:
        return [p for p in self.plugins if (switches or {}).get(p.id, p.enabled)]

    def notify(self, hook: str, *tables, switches: dict[str, bool] | None = None, restrict: bool = False) -> list[DataFrame]:
        """Call a hook of the active plugins in order and return the tables that they give; a plugin that fails is logged and
        skipped. ``restrict``: each gets the rows (path) of its own extensions only."""
        if hook not in HOOKS:
            raise ValueError(f"no hook {hook}")
        out = []
        for plugin in self.active(switches):
            if call := plugin.hooks.get(hook):
                own = [t.where(plugin.analyzes(F.col("path"))) for t in tables] if restrict else tables
                try:
                    out.append(call(*own))
                except Exception:
                    log.exception("hook %s of plugin %s failed", hook, plugin.id)
        return [t for t in out if t is not None]

    def types(self, of: str, switches: dict[str, bool] | None = None) -> dict[str, bool]:
        """Contributed 'node' or 'edge' types and whether they are shown by default; the last plugin's word counts."""
        return {t: on for p in self.active(switches) for t, on in (p.node_types if of == "node" else p.edge_types)}

    def impact(self, plugin: str, setting: str | None = None) -> str:
        """What a change of the plugin's switch, or of one of its settings, asks for; a full index where it doesn't say."""
        policy = next(p.impact for p in self.plugins if p.id == plugin)
        said = policy.get("toggle") if setting is None else policy.get(setting, policy.get("default"))
        return said if said in IMPACTS else IMPACTS[-1]

    def facts(self, texts: DataFrame, switches: dict[str, bool] | None = None) -> DataFrame:
        """Facts of ``texts`` (path, content); a plugin that fails on a file is logged and skipped."""
        plugins = [(p.id, p.extensions, p.analyze) for p in self.active(switches)]  # hooks stay on the driver
        wanted = {e for _, extensions, _ in plugins for e in extensions}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows: list[Fact] = []
                for path, content in zip(frame["path"], frame["content"]):
                    ext = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
                    # the first plugin's facts are the top layer, as it would merge last
                    for layer, (id_, extensions, analyze) in enumerate(reversed(plugins)):
                        if ext in extensions or "*" in extensions:
                            try:
                                found = list(analyze(path, content))
                            except Exception:
                                log.exception("plugin %s failed on %s", id_, path)
                                continue
                            rows += [{"file": path, "layer": layer, "ord": i, "plugin_id": id_, **f} for i, f in enumerate(found)]
                yield pd.DataFrame(rows, columns=_COLUMNS).astype(object).where(lambda d: d.notna(), None)

        texts = texts.where("content is not null")
        if "*" not in wanted:
            texts = texts.where(extension(F.col("path")).isin(*wanted))
        return texts.select("path", "content").mapInPandas(run, FACT)


def symbols(facts: DataFrame) -> DataFrame:
    """Of each file and id the top layer's symbol."""
    s = facts.where("fact = 'symbol'").groupBy("file", "id").agg(F.max_by(F.struct("name", "kind", "signature", "start_line", "end_line", "plugin_id"), F.struct("layer", "ord")).alias("s"), F.min("ord").alias("ord"))
    return s.select("id", "s.name", "s.kind", F.col("file").alias("file_path"), "s.signature", "s.start_line", "s.end_line", "ord", "s.plugin_id")


def relations(facts: DataFrame) -> DataFrame:
    """Of each key the top layer's relation, with unresolved specifiers."""
    key = ["file", "kind", "source_id", "specifier", "type", "from_symbol", "imported", "local", "member"]
    r = facts.where("fact = 'relation'").groupBy(*key).agg(F.max_by("plugin_id", F.struct("layer", "ord")).alias("plugin_id"), F.min("ord").alias("ord"))
    metadata = F.map_filter(F.create_map(F.lit("importedName"), F.col("imported"), F.lit("localName"), F.col("local"), F.lit("memberName"), F.col("member")), lambda k, v: v.isNotNull())
    return r.select("kind", "plugin_id", "source_id", F.col("file").alias("from_file"), "from_symbol", "specifier", "type", metadata.alias("metadata"), "ord")


def resolved(relations: DataFrame, files: DataFrame, candidates: Callable) -> DataFrame:
    """Adds resolved_path: the first of a relation's candidate paths that is a file.

    ``candidates`` gives an array of paths as a column, best first; they are joined with the files, not probed."""
    each = relations.select("*", F.monotonically_increasing_id().alias("_row"))
    tried = each.select("_row", F.posexplode(candidates()).alias("_nth", "_path"))
    hit = tried.join(files.select(F.col("path").alias("_path")).distinct(), "_path")
    best = hit.groupBy("_row").agg(F.min_by("_path", "_nth").alias("resolved_path"))
    return each.drop("resolved_path").join(best, "_row", "left").drop("_row")
