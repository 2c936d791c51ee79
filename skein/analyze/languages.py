"""Small analyzers: Python by its own parser, JavaScript and others by patterns, wiki links in Markdown."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.analyze.registry import Fact, Plugin
from skein.functions.paths import parent


def _symbol(path: str, kind: str, name: str, start: int, end: int, signature: str | None = None) -> Fact:
    return {"fact": "symbol", "kind": kind, "name": name, "id": f"{path}:{kind}:{name}", "start_line": start, "end_line": end, "signature": signature}


def _relation(kind: str, source: str, specifier: str, **more) -> Fact:
    return {"fact": "relation", "kind": kind, "source_id": source, "specifier": specifier, **more}


def python(path: str, content: str) -> Iterator[Fact]:
    """Classes, functions and methods; imports, bases, and calls of what is imported."""
    tree = ast.parse(content)
    bound: dict[str, tuple[str, str | None]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                bound[a.asname or a.name.split(".")[0]] = (a.name, None)
                yield _relation("import", "import", a.name, local=a.asname or a.name)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                bound[a.asname or a.name] = (module, a.name)
                yield _relation("import", "import-from", module, imported=a.name, local=a.asname or a.name)

    def walk(body: list[ast.stmt], owner: str | None, in_class: bool) -> Iterator[Fact]:
        for node in body:
            if isinstance(node, ast.ClassDef):
                yield _symbol(path, "class", node.name, node.lineno, node.end_lineno)
                own = f"{path}:class:{node.name}"
                for base in node.bases:
                    name = base.id if isinstance(base, ast.Name) else base.value.id if isinstance(base, ast.Attribute) and isinstance(base.value, ast.Name) else None
                    if name in bound:
                        yield _relation("inherit", "base", bound[name][0], imported=bound[name][1], from_symbol=own, member=getattr(base, "attr", None))
                yield from walk(node.body, own, True)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if in_class else "function"
                yield _symbol(path, kind, node.name, node.lineno, node.end_lineno, f"({', '.join(a.arg for a in node.args.args)})")
                own = f"{path}:{kind}:{node.name}"
                for call in ast.walk(node):
                    if isinstance(call, ast.Call):
                        f = call.func
                        name = f.id if isinstance(f, ast.Name) else f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
                        if name in bound:
                            yield _relation("call", "call", bound[name][0], imported=bound[name][1], from_symbol=own, member=getattr(f, "attr", None))
                yield from walk([n for n in node.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], own, False)

    yield from walk(tree.body, None, False)


def python_candidates() -> Column:
    """Paths that a Python import may mean: the name as a module of the module, then the module itself, near and from the root."""
    level = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.split("from_file", "/")
    up = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.greatest(level, F.lit(1)), F.lit(0))), "/")
    join = lambda *parts: F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])
    roots = F.when(level > 0, F.array(up)).otherwise(F.array(F.lit(""), F.lit("src"), up))
    name = F.coalesce(F.col("metadata")["importedName"], F.lit(""))
    stems = F.flatten(F.transform(roots, lambda r: F.array(F.when(name != "", join(r, rest, name)), join(r, rest))))
    return F.flatten(F.transform(F.array_compact(stems), lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))


_JS_IMPORT = re.compile(r"""^\s*import\s+(type\s+)?(?:([\w$*{][^'";]*?)\s+from\s+)?['"]([^'"]+)['"]""", re.M)
_JS_EXPORT = re.compile(r"""^\s*export\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""", re.M)
_JS_LOAD = re.compile(r"""\b(import|require)\(\s*['"]([^'"]+)['"]\s*\)""")
_JS_SYMBOL = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|enum|type)\s+([\w$]+)", re.M)
_JS_EXTENDS = re.compile(r"\bclass\s+([\w$]+)(?:<[^>{]*>)?\s+extends\s+([\w$]+)")
_JS_CALL = re.compile(r"(?<![\w$.])([\w$]+)(?:\.([\w$]+))?\(")


def javascript(path: str, content: str) -> Iterator[Fact]:
    """Imports, re-exports, dynamic loads, declarations, bases, and calls of what is imported; comments are left out."""
    plain = re.sub(r"/\*.*?\*/|(?<![:'\"])//[^\n]*", lambda m: "\n" * m[0].count("\n"), content, flags=re.S)
    line = lambda at: plain.count("\n", 0, at) + 1
    bound: dict[str, tuple[str, str | None]] = {}
    for m in _JS_IMPORT.finditer(plain):
        whole_type, names, specifier = bool(m[1]), m[2] or "", m[3]
        each = []
        if star := re.search(r"\*\s+as\s+([\w$]+)", names):
            each.append(("*", star[1], whole_type))
        if braces := re.search(r"\{([^}]*)\}", names):
            for part in filter(None, map(str.strip, braces[1].split(","))):
                name, _, local = part.removeprefix("type ").partition(" as ")
                each.append((name.strip(), (local or name).strip(), whole_type or part.startswith("type ")))
        if default := re.match(r"([\w$]+)", names):
            each.append(("default", default[1], whole_type))
        for name, local, is_type in each or [(None, None, whole_type)]:
            if local and not is_type:
                bound[local] = (specifier, name)
            yield _relation("type-import" if is_type else "import", "es-import", specifier, imported=name, local=local)
    for m in _JS_EXPORT.finditer(plain):
        if m[1].startswith("*"):
            yield _relation("reexport", "es-export", m[2])
        for part in filter(None, map(str.strip, m[1].strip("{} *").split(",") if m[1].startswith("{") else [])):
            name, _, out = part.partition(" as ")
            yield _relation("reexport", "es-export", m[2], imported=name.strip(), local=(out or name).strip())
    for m in _JS_LOAD.finditer(plain):
        yield _relation("import", "dynamic-import" if m[1] == "import" else "require", m[2], type="dynamic" if m[1] == "import" else "require")
    for m in _JS_SYMBOL.finditer(plain):
        yield _symbol(path, m[1].rstrip("*"), m[2], line(m.start(2)), line(m.start(2)))
    for m in _JS_EXTENDS.finditer(plain):
        if m[2] in bound:
            yield _relation("inherit", "extends", bound[m[2]][0], imported=bound[m[2]][1], from_symbol=f"{path}:class:{m[1]}")
    for m in _JS_CALL.finditer(plain):
        if m[1] in bound:
            yield _relation("call", "call", bound[m[1]][0], imported=bound[m[1]][1], member=m[2])


def javascript_candidates() -> Column:
    """Paths that a relative JavaScript specifier may mean: as it is, with an extension, or a folder's index."""
    joined = F.concat_ws("/", F.nullif(parent(F.col("from_file"), ""), F.lit("")), F.col("specifier"))
    steps = F.filter(F.split(joined, "/"), lambda s: (s != ".") & (s != ""))
    path = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))), "/")
    bare = F.regexp_replace(path, r"\.[cm]?jsx?$", "")
    ends = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    every = F.array(path, *[F.concat(path, F.lit(e)) for e in ends], *[F.concat(bare, F.lit(e)) for e in ends[:4]])
    return F.when(F.col("specifier").startswith("."), every).otherwise(F.array().cast("array<string>"))


def wikilinks(path: str, content: str) -> Iterator[Fact]:
    """``[[target]]``, ``[[target|label]]`` and ``![[target]]`` outside code."""
    plain = re.sub(r"```.*?```|`[^`\n]*`", "", content, flags=re.S)
    for m in re.finditer(r"!?\[\[([^\]|#\n]+)(?:#[^\]|\n]*)?(?:\|[^\]\n]*)?\]\]", plain):
        yield _relation("reference", "wikilink", m[1].strip())


#: Import statements of languages without an analyzer of their own: extensions, kind, pattern with one group.
PATTERNS = (
    ((".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"), "include", r'^\s*#\s*include\s*["<]([^">]+)[">]'),
    ((".m", ".mm"), "import", r'^\s*#\s*(?:import|include)\s*["<]([^">]+)[">]'),
    ((".cs",), "using", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"),
    ((".java", ".scala", ".sc", ".kt", ".kts"), "import", r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    ((".dart",), "import", r"^\s*(?:import|export|part)\s+['\"]([^'\"]+)['\"]"),
    ((".go",), "import", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'),
    ((".hs", ".lhs"), "import", r"^import\s+(?:qualified\s+)?([\w.]+)"),
    ((".lua",), "import", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]"),
    ((".pas", ".pp"), "import", r"(?i)^\s*uses\s+([\w.]+)"),
    ((".php",), "import", r"^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"])"),
    ((".rb",), "import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    ((".rs",), "import", r"^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)"),
    ((".swift",), "import", r"^\s*import\s+(\w+)"),
    ((".gd", ".tscn", ".tres"), "load", r"""["'](res://[^"']+)["']"""),
)


def by_pattern(kind: str, pattern: str):
    compiled = re.compile(pattern, re.M)

    def analyze(path: str, content: str) -> Iterator[Fact]:
        for m in compiled.finditer(content):
            yield _relation(kind, "pattern", next(g for g in m.groups() if g))

    return analyze


def builtin() -> list[Plugin]:
    out = [
        Plugin("core:python", (".py", ".pyi"), python),
        Plugin("core:javascript", (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte"), javascript),
        Plugin("core:markdown", (".md", ".mdx"), wikilinks),
    ]
    return out + [Plugin(f"core:{exts[0][1:]}", exts, by_pattern(kind, p)) for exts, kind, p in PATTERNS]
