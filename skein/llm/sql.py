"""DuckDB SQL of the operators on vectors, shingle sets and conversations."""

from __future__ import annotations


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    near = """
SELECT v.vec_id, v.label, v.part, v.x, unnest(arg_min(struct_pack(entry := b.entry, d := {d}), ({d}, b.entry)))
FROM v JOIN {book} b ON b.part = v.part GROUP BY v.row, v.vec_id, v.label, v.part, v.x"""
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(d=distance, book=f"b{r}")}),
m{r} AS (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {{size}}) t(i) GROUP BY ALL),
c{r} AS (SELECT part, entry, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(c.x, b.x) AS x FROM b{r} b LEFT JOIN c{r} c USING (part, entry))""")
    body = ",\n".join(steps).replace("{size}", f"(SELECT any_value(len(embedding)) // {parts} + 1 FROM e)")
    return f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT e.row, vec_id, label, p::BIGINT AS part,
        list_transform(embedding[p * len(embedding) // {parts} + 1 : (p + 1) * len(embedding) // {parts}], lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
      FROM e, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM v WHERE row <= {entries}),
{body},
z AS MATERIALIZED ({near.format(d=distance, book=f"b{rounds}").replace("v.vec_id,", "v.row, v.vec_id,", 1)}),
f AS (SELECT row, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       sha256((SELECT string_agg(array_to_string(x, ','), ',' ORDER BY part, entry) FROM b{rounds})) AS codebooks_sha256
FROM f
"""


_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i : i + 4], ' '))) AS grams
      FROM w WHERE len(words) > 0),
g AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y)
SELECT d.doc_id, coalesce(len(s.grams), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN s USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY ALL
"""

_TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END),
        4294967295::BIGINT)) % 4 AS h FROM t),
u AS (SELECT c.conv_id, 0 AS part, t.i, t.mark, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
      UNION ALL SELECT c.conv_id, 1, t.i, t.mark, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
r AS (SELECT conv_id, row_number() OVER o AS depth, string_agg(mark, '/') OVER o || '/' AS path,
        len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
      FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY part, i)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS last FROM r),
n AS MATERIALIZED (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
        substr(path, 1, 33 * (any_value(depth) - 1)) AS up, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY path),
k AS MATERIALIZED (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.up = a.path AND b.depth = a.depth + 1 GROUP BY a.path),
q AS (SELECT a.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
      FROM n a JOIN n b ON starts_with(b.path, a.path) JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, q.n_leaves, q.saved_tokens::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN k USING (path) JOIN q USING (path) LEFT JOIN n p ON p.path = n.up AND n.depth = p.depth + 1
"""

SQL = {"op11_vector_codes": _vector_codes(), "op12_jaccard_join": _JACCARD, "op13_prefix_trie": _TRIE}
