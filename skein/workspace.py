"""A workspace: a folder of files, its settings, its graph cache, and the questions that one asks of it."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.analyze.languages import builtin, javascript_candidates, python_candidates
from skein.analyze.registry import Registry, relations, symbols
from skein.export.documents import envelope
from skein.functions.glob import matches_any
from skein.graph import Graph, closed, written
from skein.functions.ordering import COMMAND_LIMITS, DEFAULT_LIMIT, Pages, page, paged
from skein.operators import facts, project, refresh, traverse
from skein.operators.scope import Scope, apply_scope, expanded, saved_scope
from skein.plans import reports, search, task_map
from skein.schema import EDGE, NODE, RELATION, SCHEMA_VERSION, SYMBOL, VISIBLE_EDGES
from skein.sources import cache, discovery
from skein.streaming import watch

#: How the relations of a plugin are resolved; others name a file by its end.
RULES = {"core:python": python_candidates, "core:javascript": javascript_candidates}
#: Times that an index or update begins again because files, settings or the cache have changed meanwhile.
ATTEMPTS = 3
AGAIN = object()


@dataclass
class Analysis:
    """Symbols, resolved relations, what these would try, and the digest of each file's facts; ``paths``: all files there are;
    ``grams``: what the texts hold, as a search looks them up."""

    symbols: DataFrame
    links: DataFrame
    tried: DataFrame
    digests: DataFrame | None = None
    paths: DataFrame | None = None
    grams: DataFrame | None = None


@dataclass
class Settings:
    """Kept as JSON; unknown fields are left out, missing ones take these defaults."""

    version: int = 1
    max_files: int = discovery.MOST_FILES
    include: list[str] = field(default_factory=lambda: ["**/*"])
    respect_gitignore: bool = True
    filter_patterns: list[str] = field(default_factory=list)
    node_visibility: dict[str, bool] = field(default_factory=dict)
    edge_visibility: dict[str, bool] = field(default_factory=dict)
    plugins: dict[str, bool] = field(default_factory=dict)
    #: Without them the cache has files, their links, and no symbols.
    keep_symbols: bool = True

    @classmethod
    def load(cls, path: str) -> Settings:
        if not os.path.exists(path):
            return cls()
        with open(path) as f:
            said = json.load(f)
        return cls(**{x.name: said[x.name] for x in fields(cls) if x.name in said})

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2, sort_keys=True)

    def scope(self, edge_kinds: list[str]) -> Scope:
        """The saved scope: edge kinds as saved, else by their defaults."""
        return Scope(dict(self.node_visibility), {k: self.edge_visibility.get(k, k in VISIBLE_EDGES) for k in edge_kinds})


class Workspace:
    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, registry: Registry | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.home = folder or f"{self.root}/.skein"
        self.settings = Settings.load(f"{self.home}/settings.json")
        self.registry = registry or Registry(builtin())
        self.cache = cache.GraphCache(spark, f"file://{self.home}/cache")
        self._begun = self._told = False

    def _begin(self) -> None:
        """Tell plugins once that the workspace is in use."""
        if not self._begun:
            self._begun = True
            self.registry.notify("initialize", switches=self.settings.plugins)

    def _ready(self, version: str | None) -> str | None:
        """Tell plugins once that there is an index."""
        if not self._told:
            self._told = True
            self.registry.notify("workspace_ready", self.graph(), switches=self.settings.plugins)
        return version

    # ------------------------------------------------------------------ index

    def listing(self) -> DataFrame:
        """path, folder, size and mtime of all below the root but this package's own folder."""
        return written(discovery.walked(self.spark, self.root).where("path <> '.skein' and not startswith(path, '.skein/')"), "listing")

    def eligible(self, listing: DataFrame | None = None) -> DataFrame:
        """path, size and mtime of the files that count."""
        listing = self.listing() if listing is None else listing
        files, ignored = listing.where("not folder").select("path", "size", "mtime"), None
        if self._by_git():
            known = discovery.git_listed(self.spark, self.root)
            ignored = files.select("path").join(known, "path", "left_anti")
        return discovery.discovered(files, self.settings.include, self.settings.filter_patterns, ignored=ignored, most=self.settings.max_files)[0]

    def _by_git(self) -> bool:
        return self.settings.respect_gitignore and os.path.isdir(f"{self.root}/.git")

    def folders(self, listing: DataFrame, files: DataFrame) -> DataFrame:
        """Nodes of listed folders that no file implies, and of ignored ones."""
        fit = discovery.eligible_folders(listing, files, listing.where("not folder").where(discovery.included_by_default(F.col("path"))))
        none = self.spark.createDataFrame([], "path string")
        ignored = discovery.git_ignored_folders(self.spark, self.root) if self._by_git() else none
        shown = fit.unionByName(discovery.below(listing.where("folder").select("path"), ignored)).distinct()
        out = project.folder_nodes(shown, files.select(F.col("path").alias("id")), ignored)
        known = {"id": F.col("id"), "label": F.col("label"), "node_type": F.lit("folder"), "source": F.when(F.col("ignored"), "ignored"), "ord": F.xxhash64("id")}
        return out.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])

    def files(self) -> DataFrame:
        """Eligible files with their bytes."""
        return discovery.with_content(self.eligible(), self.root)

    def scan(self) -> tuple[DataFrame, Observation]:
        """Texts of the eligible files as they are, and how many were scanned, skipped and changed since the index."""
        return discovery.scanned(self.files(), self.cache.load()["files"])

    def fingerprints(self, files: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """path, content_hash, size, mtime of files (path, size, mtime); of those whose size and mtime are as ``before`` the
        hash is taken over, only the others are read."""
        if before is None:
            same = files.select("path", "size", "mtime", F.lit(None).cast("string").alias("content_hash")).where("false")
        else:
            old = before.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "content_hash")
            same = files.join(old, "path").where("size = _size and mtime = _mtime").select("path", "size", "mtime", "content_hash")
        read = discovery.with_content(files.join(same, "path", "left_anti"), self.root)
        return same.unionByName(discovery.with_hashes(read).join(files.select("path", "mtime"), "path"))

    def signatures(self) -> dict[str, str]:
        """Of the active plugins and of the settings: what an index depends on besides the files."""
        plugins = json.dumps([p.id for p in self.registry.active(self.settings.plugins)])
        settings = json.dumps(asdict(self.settings), sort_keys=True)
        return {n: hashlib.sha256(x.encode()).hexdigest() for n, x in (("plugin", plugins), ("settings", settings))}

    def _meta(self) -> dict:
        return {**self.signatures(), "indexed_at": time.time() * 1000}

    def analysed(self, files: DataFrame, paths: DataFrame) -> Analysis:
        """What the texts of ``files`` (path, size) say; links are resolved among ``paths`` (path)."""
        texts = discovery.texts(discovery.with_content(files, self.root))
        held = written(search.postings(texts), "grams")
        for more in self.registry.notify("pre_analyze", files, switches=self.settings.plugins):
            # a plugin may give other texts (path, content) for files that are analysed
            if {"path", "content"} <= set(more.columns):
                texts = texts.join(more.select("path"), "path", "left_anti").unionByName(more.select("path", "content").join(files.select("path"), "path", "left_semi"))
        found = written(self.registry.facts(texts, self.settings.plugins), "facts")
        declared = written(reports.occurrence_ids(symbols(found)), "symbols")
        canonical = declared.select(F.col("id").alias("_id"), "canonical_id")
        links = relations(found).withColumns({c: F.lit(None).cast("string") for c in ("to_file", "to_symbol", "from_node", "to_node", "variant")})
        # a symbol that no file declares is named after the file that speaks of it
        bare = F.when(F.col("from_symbol").startswith(F.concat("from_file", F.lit(":"))), F.expr("substr(from_symbol, length(from_file) + 2)")).otherwise(F.col("from_symbol"))
        links = links.join(canonical, F.col("from_symbol") == F.col("_id"), "left")
        links = links.withColumn("from_symbol", F.coalesce("canonical_id", F.concat("from_file", F.lit("#"), bare))).drop("_id", "canonical_id")
        tried = written(refresh.candidates(links, RULES), "candidates")
        links = written(refresh.resolved(links, tried, paths), "relations")
        declared = declared.withColumn("id", F.col("canonical_id")).drop("canonical_id", "base", "nth")
        return Analysis(declared, links, tried, refresh.fact_digests(found), grams=held)

    def index(self) -> str:
        """Analyse all files and replace the cache; returns its version.

        If another writer or a change of the files comes in between, it is done again, ``ATTEMPTS`` times at most."""
        self._begin()
        for _ in range(ATTEMPTS):
            state, listing = self.cache.state(), self.listing()
            files = written(self.eligible(listing), "eligible")
            meta = self._meta()
            own = self.analysed(files, files.select("path"))
            tables = self.derived(own, files, own.symbols, own.links)
            self.registry.notify("post_analyze", Graph(tables["nodes"], closed(tables["edges"], tables["nodes"])), switches=self.settings.plugins)
            tables["nodes"] = tables["nodes"].unionByName(self.folders(listing, files))
            now = written(self.fingerprints(files), "fingerprints")
            prints = now.join(own.digests.withColumnRenamed("digest", "fact_digest"), F.col("path") == F.col("file"), "left").drop("file")
            if not self._as_seen(files, meta):
                continue
            try:
                return self._ready(self.cache.save(expect=(state or {}).get("version"), meta=meta, files=prints, grams=own.grams, **tables))
            except cache.Overtaken:
                continue
        raise cache.Overtaken("files, settings or the cache kept changing")

    def _as_seen(self, files: DataFrame, meta: dict) -> bool:
        """Whether files and settings are still as they were when the work began."""
        same = facts.difference(files.select("path", "size", "mtime"), self.eligible().select("path", "size", "mtime")).isEmpty()
        return same and all(meta[k] == v for k, v in self.signatures().items())

    def derived(self, own: Analysis, files: DataFrame, every: DataFrame, exports: DataFrame) -> dict[str, DataFrame]:
        """Rows of the cache's tables that follow from an analysis: of the files (path, size) that it covers.

        ``every``: the symbols of all files; ``exports``: the relations of all files, of which those that re-export count."""
        paths = own.paths if own.paths is not None else files.select("path")
        links = own.links
        for c in ("resolved_path", "from_symbol"):
            links = links.withColumn(c, facts.relative(F.col(c), self.root))
        # kept under the kinds that they have; only edges count a re-export as an import
        links = project.connections(links.withColumn("_kind", F.col("kind"))).withColumn("kind", F.col("_kind")).drop("_kind")
        links = project.with_targets(links, paths).withColumn("to_file", F.col("target")).drop("target")
        links = written(project.with_target_symbols(links, every, exports), "links")
        lost = own.links.join(links.select("from_file", "ord", "plugin_id"), ["from_file", "ord", "plugin_id"], "left_anti")

        final = F.when(~F.col("to_file").startswith("pkg:"), F.col("to_file"))
        final = links.withColumns({"resolved_path": final, "to_file": final})
        base = project.graph_of(final, files.select("path", "size"), paths)
        # of the namespaces of a name one stands for all
        spaces = every.where("kind = 'namespace'").select("id", "kind", "name", "file_path")
        shown = own.symbols
        if not spaces.isEmpty():
            first = project.canonical_namespaces(spaces, project.incoming_includes(exports.unionByName(links, allowMissingColumns=True).dropDuplicates(["from_file", "ord", "plugin_id"])))
            shown = shown.where("kind <> 'namespace'").unionByName(shown.where("kind = 'namespace'").join(first.select("id"), "id", "left_semi").select(*shown.columns))
        types = tuple(t for p in self.registry.active(self.settings.plugins) for t in p.types)
        variable = F.col("kind").isin("constant", "variable", "field", "global", "local", "parameter")
        fallback = F.when(variable, "variable").otherwise("symbol")
        typed = shown.withColumns({c: F.lit(None).cast("string") for c in ("language", "plugin_kind", "plugin_id") if c not in shown.columns})
        kept_type = facts.stored_type(fallback, types) if types else fallback
        names = {
            "id": F.col("id"), "label": F.col("name"), "symbol_name": F.col("name"), "symbol_kind": F.col("kind"), "symbol_file": F.col("file_path"),
            "node_type": kept_type, "signature": F.col("signature"), "ord": F.col("ord"),
        }
        nodes = typed.select(*[names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])
        inside = project.containment(shown, links)
        # a symbol that relations name but no file declares is an end of its own
        known = every.select("id").unionByName(links.where("from_symbol is not null").select(F.col("from_symbol").alias("id"))).distinct()
        named = project.symbol_edges(links, known.withColumn("canonical_id", F.col("id")))
        edges = base.edges.unionByName(inside.withColumn("sources", F.lit(None).cast(EDGE["sources"].dataType))).unionByName(named)
        nodes = base.nodes.unionByName(nodes)
        told = written(links.where("from_symbol is not null").join(every.select("id"), F.col("from_symbol") == F.col("id"), "left_anti").groupBy("from_symbol").agg(F.min("from_file").alias("symbol_file")), "undeclared")
        if not told.isEmpty():
            ends = facts.endpoint_nodes(told.select(F.col("from_symbol").alias("src"), F.col("symbol_file").alias("dst")), nodes, paths)
            ends = ends.join(told, F.col("id") == F.col("from_symbol")).withColumn("symbol_name", F.regexp_extract("id", r"([^/#:]*)\z", 1)).withColumn("ord", F.xxhash64("id"))
            nodes = nodes.unionByName(ends.select(*[(F.col(f.name) if f.name in ends.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields]))
        declared = own.symbols
        if not self.settings.keep_symbols:
            links, declared = facts.without_symbols(links), declared.where("false")
            edges, nodes = edges.where("instr(src, '#') = 0 and instr(dst, '#') = 0"), nodes.where("symbol_file is null")
        return {"nodes": written(nodes, "nodes"), "symbols": declared, "edges": written(edges, "edges"), "relations": links, "open": lost, "candidates": own.tried}

    def update(self) -> str | None:
        """Bring the cache up to date with the files as they are: None if nothing has changed.

        Read and analysed are only files that are new or of another content. Where their facts are the same as before, only
        their metrics and grams are written. Else links are resolved again that would try an added or removed path, and derived again is
        what may name a symbol of a changed file. All is analysed anew only if plugins, settings or the format have changed,
        or if a plugin asks for it. What another writer commits meanwhile, or a change of the files, begins it again."""
        self._begin()
        for _ in range(ATTEMPTS):
            state = self.cache.state()
            if state is None or state["schema"] != SCHEMA_VERSION or any(state["meta"].get(k) != v for k, v in self.signatures().items()):
                return self.index()
            try:
                done = self._updated(state)
            except cache.Overtaken:
                continue
            if done is not AGAIN:
                return self._ready(done)
        return self.index()

    def _updated(self, state: dict) -> str | None | object:
        before, listing, meta = self.cache.load(), self.listing(), self._meta()
        files = written(self.eligible(listing), "eligible")
        now = written(self.fingerprints(files, before["files"]), "fingerprints")
        moved = written(cache.changed(before["files"], now), "changes")
        folders = self.folders(listing, files)
        old_folders = before["nodes"].where("node_type = 'folder'")
        turned = written(facts.difference(old_folders.select("id", "source"), folders.select("id", "source")), "folder-changes")
        if moved.isEmpty() and turned.isEmpty():
            return None
        extra = self.registry.notify("files_changed", moved.where("change <> 'removed'").select("path"), switches=self.settings.plugins, restrict=True)
        if any("full_refresh" in t.columns for t in extra):
            return self.index()
        fresh = moved.where("change <> 'removed'").select("path")
        for more in extra:
            fresh = fresh.union(more.select("path"))
        fresh = written(files.join(fresh.distinct(), "path", "left_semi"), "fresh")
        own = self.analysed(fresh, files.select("path"))
        digests = written(fresh.select("path").join(own.digests, F.col("path") == F.col("file"), "left").select("path", F.col("digest").alias("fact_digest")), "digests")
        prints = now.join(digests, "path")
        same = written(refresh.with_same_facts(before["files"], digests), "same-facts")
        others = written(fresh.join(same, "path", "left_anti").select("path"), "other-facts")
        came = moved.where("change <> 'changed'").select("path")
        if others.isEmpty() and came.isEmpty() and turned.isEmpty():
            if not self._as_seen(files, meta):
                return AGAIN
            new = {"files": prints.join(same, "path", "left_semi"), "grams": own.grams.join(same, "path", "left_semi")}
            return self.cache.patch(same, meta=meta, only=set(new), expect=state["version"], **new)
        return self._patched(state, before, files, now, own, others, digests, moved, meta, folders, turned)

    def _patched(self, state, before, files, now, own, others, digests, moved, meta, folders, turned) -> str | object:
        """Replace what belongs to ``others`` (path) by ``own``, and what depends on files that came, went or have other facts."""
        stored = before["relations"].unionByName(before["open"])
        gone = moved.where("change = 'removed'").select("path")
        came = moved.where("change <> 'changed'").select("path")
        # relations that would try a path that came or went, and those that may name a symbol of a file with other facts
        asking = refresh.asked_again(self.cache.at("candidates", refresh.names(came).select(F.col("name").alias("path"))), came)
        asking = written(asking.select(F.col("from_file").alias("path")).distinct(), "asking")
        passing = stored.where("kind = 'reexport'").join(asking, F.col("from_file") == F.col("path"), "left_semi").select(F.col("from_file").alias("path"))
        linked = refresh.reaches(stored, others.union(gone).union(passing).distinct())
        spaces = before["symbols"].where("kind = 'namespace'").select("file_path").distinct()
        touched = asking.union(linked)
        if not spaces.isEmpty() or not own.symbols.where("kind = 'namespace'").isEmpty():
            touched = touched.union(spaces.select(F.col("file_path").alias("path")))
        touched = touched.distinct().join(others, "path", "left_anti").join(files, "path", "left_semi")
        touched = written(touched.select("path"), "touched")
        again = stored.join(touched, F.col("from_file") == F.col("path"), "left_semi").withColumn("to_file", F.lit(None).cast("string")).withColumn("to_symbol", F.lit(None).cast("string"))
        tried = refresh.candidates(again, RULES)
        again = refresh.resolved(again, tried, files.select("path")).select(*again.columns)
        kept = before["symbols"].join(touched, F.col("file_path") == F.col("path"), "left_semi")
        theirs = others.withColumnRenamed("path", "_path")
        mine = lambda df, of: df.join(theirs, F.col(of) == F.col("_path"), "left_semi")
        align = lambda df, schema: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        whole = Analysis(
            written(align(mine(own.symbols, "file_path"), SYMBOL).unionByName(kept), "symbols"),
            written(align(mine(own.links, "from_file"), RELATION).unionByName(align(again, RELATION)), "relations"),
            written(mine(own.tried, "from_file").unionByName(tried), "candidates"),
            paths=files.select("path"),
        )
        anew = written(others.union(touched).union(gone).distinct(), "anew")
        rest = lambda df, of: df.join(anew, F.col(of) == F.col("path"), "left_anti")
        every = rest(before["symbols"], "file_path").unionByName(whole.symbols)
        exports = rest(before["relations"], "from_file").unionByName(whole.links)
        scope = files.join(anew, "path", "left_semi")
        tables = self.derived(whole, scope, every, exports)
        self.registry.notify("graph_rebuild", Graph(tables["nodes"], closed(tables["edges"], tables["nodes"])), switches=self.settings.plugins)
        # packages come and go with the last edge that leads to them
        packages = lambda df: df.where(F.col("dst").startswith("pkg:")).select(F.col("dst").alias("path")).distinct()
        others_edges = before["edges"].withColumn("path", self.cache.key("edges")).join(anew, "path", "left_anti")
        lost = before["nodes"].where("node_type = 'package'").select(F.col("id").alias("path")).join(packages(others_edges), "path", "left_anti")
        dropped = anew.union(lost).union(turned.select(F.col("id").alias("path"))).distinct()
        held = before["nodes"].where("node_type = 'package'").select("id").join(lost, F.col("id") == F.col("path"), "left_anti")
        nodes = tables.pop("nodes").join(held, "id", "left_anti")
        nodes = nodes.unionByName(folders.join(turned.where("side = 'now'").select("id"), "id", "left_semi"))
        prints = now.join(anew.unionByName(digests.select("path")).distinct(), "path", "left_semi")
        known = before["files"].select("path", "fact_digest").join(digests, "path", "left_anti").unionByName(digests)
        prints = prints.join(known, "path", "left")
        if not self._as_seen(files, meta):
            return AGAIN
        stale = refresh.candidates(stored.join(anew, F.col("from_file") == F.col("path"), "left_semi"), RULES)
        # files whose facts are the same have new metrics only
        metrics = written(dropped.unionByName(digests.select("path")).distinct(), "metrics")
        unread = gone.union(digests.select("path")).distinct()
        return self.cache.patch(dropped, meta=meta, stale=stale, gone_files=metrics, gone_grams=unread, grams=own.grams, expect=state["version"], files=prints, nodes=nodes, **tables)

    def switch(self, plugin: str, on: bool) -> str | None:
        """Turn a plugin on or off, and do what it says that this asks for."""
        impact = self.registry.impact(plugin)
        if not on:
            self.registry.notify("unload", switches={p.id: p.id == plugin for p in self.registry.plugins})
        self.settings.plugins = {**self.settings.plugins, plugin: on}
        state = self.cache.state()
        if state is None or impact == "requires-full-index":
            return self.index()
        if impact != "reanalyze-plugin-files":
            return self.cache.save(meta=self._meta())
        before, listing = self.cache.load(), self.listing()
        files = written(self.eligible(listing), "eligible")
        plugin_ = next(p for p in self.registry.plugins if p.id == plugin)
        return self.refresh(files.where(plugin_.analyzes(F.col("path"))).select("path"), state, before, listing, files)

    def refresh(self, paths: DataFrame, state=None, before=None, listing=None, files=None) -> str:
        """Analyse some files (path) anew, whether or not they have changed: those of a plugin, or of a part of the tree."""
        state = state or self.cache.state()
        before, listing = before or self.cache.load(), listing if listing is not None else self.listing()
        files = files if files is not None else written(self.eligible(listing), "eligible")
        now, folders = written(self.fingerprints(files, before["files"]), "fingerprints"), self.folders(listing, files)
        moved = written(cache.changed(before["files"], now), "changes")
        turned = written(facts.difference(before["nodes"].where("node_type = 'folder'").select("id", "source"), folders.select("id", "source")), "folder-changes")
        others = written(files.join(paths.union(moved.where("change <> 'removed'").select("path")).distinct(), "path", "left_semi"), "refreshed")
        own = self.analysed(others, files.select("path"))
        digests = written(others.select("path").join(own.digests, F.col("path") == F.col("file"), "left").select("path", F.col("digest").alias("fact_digest")), "digests")
        out = self._patched(state, before, files, now, own, others.select("path"), digests, moved, self._meta(), folders, turned)
        return self.index() if out is AGAIN else out

    def watch(self, emit: Callable[[dict], None], checkpoint: str | None = None) -> StreamingQuery:
        """Follow the changes of the files until the returned query is stopped; ``emit`` gets the events."""
        return watch.watch(self, emit, checkpoint or f"file://{self.home}/watch")

    # ------------------------------------------------------------------ questions

    def scope(self) -> Scope:
        """The saved scope, with defaults for what the cached graph holds."""
        seen = [tuple(r) for r in reports.observed(self.graph()).select("of", "type").collect()]  # types, a few dozen
        types, kinds = ([t for of, t in seen if of == side] for side in ("node", "edge"))
        declared = [self.registry.types(side, self.settings.plugins) for side in ("node", "edge")]
        return saved_scope(self.settings.node_visibility, self.settings.edge_visibility, types, kinds, *declared)

    def graph(self, patterns: list[str] = ()) -> Graph:
        """The cached graph without the nodes that a path pattern excludes."""
        state = self.cache.load()
        # sizes are metrics of the files, which are patched alone
        sizes = state["files"].select(F.col("path").alias("id"), F.col("size").alias("_size"))
        nodes = state["nodes"].join(sizes, "id", "left").withColumn("file_size", F.coalesce("_size", "file_size")).select(*state["nodes"].columns)
        if patterns:
            nodes = nodes.where(~matches_any(F.coalesce("symbol_file", "id"), list(patterns), "full"))
        return Graph(nodes, closed(state["edges"], nodes))

    def facts_for(self, graph: Graph) -> tuple[DataFrame, DataFrame]:
        """Cached symbols and relations of active plugins, restricted to the graph's files."""
        state = self.cache.load()
        active = [p.id for p in self.registry.active(self.settings.plugins)]
        files = graph.nodes.where("symbol_file is null").select(F.col("id").alias("path"))
        return facts.of_files(state["symbols"], facts.of_active_plugins(state["relations"], active), files)

    def query(
        self, report: str, patterns: list[str] = (), saved: bool = False, offset: int = 0, limit: int | None = None, as_json: bool = False,
        types: list[str] = (), defaults: bool = False, **arguments,
    ):
        """One of nodes, edges, relationships, symbols, paths, search, task-map, overview, dependencies, dependents.

        ``saved``: only what the saved scope shows, instead of the complete graph; ``types``: with it, node types that are
        shown as well, and what a question about them covers; ``limit``: a page of that many rows, or for task-map of files;
        ``defaults``: the limits of a command line where none is given; ``as_json``: a JSON text a row, with the report's
        name. Reports that say more than a table give it beside the table, which is paged all the same: paths (whether they
        are complete), task-map (the terms used, and tables of links among the files and of their best symbols)."""
        if self.cache.state() is None:
            raise LookupError("graph_cache_not_found")
        if defaults:
            limit = limit if limit is not None else COMMAND_LIMITS.get(report)
            if report == "paths":
                arguments = {"max_depth": COMMAND_LIMITS["path_depth"], "max_paths": COMMAND_LIMITS["paths"], **arguments}
        g = self.graph(patterns)
        if saved:
            scope = self.scope()
            shown = expanded(list(types), scope.types) if types else []
            g = apply_scope(g, replace(scope, nodes={**scope.nodes, **dict.fromkeys(shown, True)}))
        declared, links = self.facts_for(self.graph(patterns))
        text = lambda: discovery.texts(self.files())

        def task_map_report():
            best, terms = task_map.task_map(g, text(), limit=limit, **arguments)
            best = written(best.withColumn("ord", F.monotonically_increasing_id()), "task-map")
            paths = [r.path for r in best.select("path").collect()]  # MOST_FILES at most
            own = declared.where(F.col("file_path").isin(paths))
            return best.orderBy("ord").drop("ord"), terms, task_map.map_relationships(g, paths), task_map.top_symbols(own, terms)

        out = {
            "nodes": lambda: reports.nodes_report(g, **arguments),
            "edges": lambda: reports.edges_report(g, **arguments),
            "relationships": lambda: reports.relationships_report(g, links, declared, **arguments),
            "symbols": lambda: reports.symbols_report(g, declared, links, **arguments),
            "paths": lambda: traverse.path_report(g, **arguments),
            "search": lambda: search.search_report(g.nodes, declared, text(), near=self.near(arguments["pattern"]), **arguments),
            "task-map": task_map_report,
            "overview": lambda: reports.overview_report(g, declared, **arguments),
            "dependencies": lambda: reports.dependencies(g, **arguments),
            "dependents": lambda: reports.dependents(g, **arguments),
        }[report]()
        table, *more = out if isinstance(out, tuple) else (out,)
        if isinstance(table, DataFrame):
            info = None
            if limit is not None and as_json:
                table, info = paged(table, offset, limit)
            elif limit is not None:
                table = page(table, offset, limit)
            table = envelope(report, table, info) if as_json else table
        return (table, *more) if more else table

    def near(self, pattern: str) -> DataFrame | None:
        """Texts (path, content) that may hold a pattern, by the index of grams; None if it can't tell.

        Files that are new or of another size or time than in the index are among them, so what is found is as the files
        are. Only these texts are read."""
        state = self.cache.load()
        found = search.holding(state["grams"], pattern)
        if found is None:
            return None
        files = self.eligible()
        other = files.select("path", "size", "mtime").join(state["files"].select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
        return discovery.texts(discovery.with_content(files.join(found.union(other.select("path")).distinct(), "path", "left_semi"), self.root))

    def pages(self, report: str, **arguments) -> Pages:
        """A report written once, from which pages are cut at any depth."""
        out = self.query(report, **arguments)
        return Pages(out[0] if isinstance(out, tuple) else out)

    def page_of(self, report: str, offset: int = 0, limit: int = DEFAULT_LIMIT, **arguments) -> tuple[DataFrame, dict]:
        """A page of a report, and its metadata: offset, limit, returned, total, nextOffset."""
        out = self.query(report, **arguments)
        return paged(out[0] if isinstance(out, tuple) else out, offset, limit)

    def pending(self, changes: DataFrame) -> DataFrame:
        """Of told changes (path, mtime in milliseconds; null where unknown) those that the last index doesn't cover."""
        state = self.cache.state()
        return cache.pending(changes, state["meta"].get("indexed_at") if state else None)

    def status(self) -> tuple[str, list[str]]:
        before = self.cache.load()["files"]
        return self.cache.status(self.fingerprints(self.eligible(), before), **self.signatures())

    def doctor(self) -> dict:
        """State of the cache, counts of its tables, and broken references."""
        broken = {r["check"]: r["violations"] for r in cache.violations(self.graph()).collect()}
        return {"state": self.status()[0], "counts": self.cache.counts(), "violations": broken}
