"""The data model: schemas, vocabularies and the identities of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 12

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(t, t) if isinstance(t, str) else t) for n, t in fields.items()])


def _strings(names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), "string")


_METADATA = T.MapType(T.StringType(), T.StringType())

NODE = _struct(**_strings("id label node_type symbol_name symbol_kind symbol_file plugin_kind language source signature"), file_size="bigint", ord="bigint")
SOURCE = T.ArrayType(_struct(**_strings("id plugin_id source_id label")))
EDGE = _struct(**_strings("id src dst kind"), sources=SOURCE, ord="bigint")
RELATION = _struct(
    **_strings("kind plugin_id source_id from_file to_file from_node to_node from_symbol to_symbol specifier type variant resolved_path"),
    metadata=_METADATA,
    ord="bigint",
)
SYMBOL = _struct(**_strings("id name kind file_path signature plugin_id"), start_line="int", end_line="int", metadata=_METADATA, ord="bigint")
FILE = _struct(path="string", mtime="double", size="bigint", content_hash="string", fact_digest="string")
#: A path (or ``*/`` and the end of one) that an import may mean, by rank, and what asks for it.
CANDIDATE = _struct(**_strings("path plugin_id from_file specifier imported"), rank="int")
#: Three characters that stand together in a file's text.
GRAM = _struct(**_strings("path gram"))

# Fixed values of the vocabulary.
NODE_TYPES = ("file", "folder", "package", "symbol", "variable")
EDGE_KINDS = (
    "nests", "include", "import", "using", "type-import", "type", "call", "inherit", "implements", "event", "reexport",
    "reference", "load", "contains", "overrides",
)
VISIBLE_EDGES = frozenset({"include", "import", "using", "nests"})
VARIABLE_KINDS = ("constant", "field", "global", "local", "parameter", "variable")
ROOT = "(root)"

#: Fixed values. Node types of symbols: id, parent, symbol kinds that it matches.
SYMBOL_TYPES = (
    ("symbol", None, None),
    ("symbol:function", "symbol", ("function", "method")),
    ("symbol:namespace", "symbol", ("namespace",)),
    ("symbol:callable", "symbol", ("function",)),
    ("symbol:method", "symbol", ("method",)),
    *((f"symbol:{k}", "symbol", (k,)) for k in (
        "constructor", "prototype", "class", "mixin", "extension", "interface", "record", "delegate", "property", "event",
        "type", "struct", "union", "enum", "typedef", "alias", "template", "module", "trait",
    )),
    ("variable", "symbol", None),
    ("variable:plain", "variable", ("variable",)),
    *((f"symbol:{k}", "variable", (k,)) for k in VARIABLE_KINDS),
)


def package_id(specifier: Column) -> Column:
    """``pkg:<name>`` of an external specifier, null of one that isn't external."""
    bare = F.regexp_replace(specifier, "^node:", "")
    name = F.when(bare.startswith("@"), F.regexp_extract(bare, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(bare, "/", 1))
    external = specifier.startswith("node:") | (~specifier.contains(":") & specifier.rlike(r"^(?![./#])(?:@[\w-]+/)?[\w-]"))
    return F.when(external & (name != ""), F.concat(F.lit("pkg:"), name))


def edge_id(src: Column, dst: Column, kind: Column, type_: Column | None = None, variant: Column | None = None) -> Column:
    parts = [src, F.lit("->"), dst, F.lit("#"), kind]
    if type_ is not None:
        parts.append(F.when(type_.isNotNull(), F.concat(F.lit(":"), type_)).otherwise(""))
    if variant is not None:
        parts.append(F.when(variant.isNotNull(), F.concat(F.lit("~"), variant)).otherwise(""))
    return F.concat(*parts)


def uri_component(text: Column) -> Column:
    """A text as in a component of a URI: everything but letters, digits and ``-_.!~*'()`` percent-encoded."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
