"""SQL twins (DuckDB) of the registered queries that SQL can express."""

from __future__ import annotations

from .mixing import SCHEDULES, WEIGHTS
from .web_archives import FIRST_CAPTURE

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(name: str, table: str, key: str, where: str = "true") -> str:
    """CTEs ``name``: distinct five-word shingles by ``id``."""
    return f"""
{name}_w AS (SELECT {key} AS id, {_WORDS} AS w FROM {table} WHERE {where}),
{name} AS (
  SELECT DISTINCT id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM {name}_w)"""


DECONTAMINATION = f"""
WITH {_shingles('d', 'documents', 'doc_id', 'doc_id IS NOT NULL')}, {_shingles('b', 'benchmark', 'item_id', 'item_id IS NOT NULL AND text IS NOT NULL')},
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS item_shingles, count(*) AS shared_shingles
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 1000 * count(*) >= 800 * any_value(n.n)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_shingles('d', 'documents', 'doc_id')},
n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM d x JOIN d y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id),
link AS (
  SELECT a, b FROM common JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT a, b FROM twoway UNION SELECT r.id, l.b FROM reach r JOIN twoway l ON r.other = l.a),
low AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low.low, doc_id)) AS component_id,
  doc_id <= coalesce(low.low, doc_id) AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN low ON low.id = doc_id"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
WEB_ARCHIVES = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to,
  strftime(make_timestamp((page_id + {FIRST_CAPTURE}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, true AS intact
FROM p JOIN f USING (h)"""


def _case(values: tuple, i: int) -> str:
    return "CASE nth " + " ".join(f"WHEN {k} THEN {v[i]!r}::DOUBLE" for k, v in enumerate(values)) + " END"


def _time(x: str) -> str:
    """Inverse of the integral of the three-knot schedule k0, k1, k2 at the share ``x`` of the demand."""
    a1, a2 = "((k0 + k1 + 0.0) - (k0 + k1) / 2.0)", "((k0 + k1 + k2) - (k0 + k2) / 2.0)"
    want = f"({x} * {a2})"
    late = f"({want} >= {a1})"
    rest = f"({want} - CASE WHEN {late} THEN {a1} ELSE 0.0 END)"
    lo, hi = f"(CASE WHEN {late} THEN k1 ELSE k0 END)", f"(CASE WHEN {late} THEN k2 ELSE k1 END)"
    inside = f"(CASE WHEN {rest} <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {rest} / ({lo} + sqrt(greatest({lo} * {lo} + 2.0::DOUBLE * ({hi} - {lo}) * {rest}, 0.0::DOUBLE))) END)"
    return f"round(least((CASE WHEN {late} THEN 1 ELSE 0 END + {inside}) / 2.0::DOUBLE, 1.0::DOUBLE), 9)"


MIXING = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS nth FROM s),
w AS (SELECT *, CASE nth {' '.join(f'WHEN {k} THEN {v!r}::DOUBLE' for k, v in enumerate(WEIGHTS))} END AS weight,
  {_case(SCHEDULES, 0)} AS k0, {_case(SCHEDULES, 1)} AS k1, {_case(SCHEDULES, 2)} AS k2 FROM n),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rank,
  (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level FROM w),
l AS (SELECT arg_min(level, rank) AS level FROM r WHERE level * weight < 2.0::DOUBLE * source_size),
t AS (SELECT source, source_size, k0, k1, k2,
  coalesce(least(l.level * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM r LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal, k0, k1, k2,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(d.o, 1, 4))::BIGINT % 4096, d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS times FROM p),
v AS (SELECT *, (times * size + greatest(least(goal - times * source_size - start, size), 0))::BIGINT AS taken FROM u)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
  CASE WHEN taken > 0 THEN {_time('(start / goal::DOUBLE)')} END AS position,
  CASE WHEN taken > size THEN {_time('((start + source_size) / goal::DOUBLE)')} END AS repeat_position
FROM v"""

SIMILAR_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, len(v) AS n, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
low AS (SELECT id, min(other) AS low FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.low, vec_id)) AS component_id, vec_id <= coalesce(low.low, vec_id) AS kept
FROM e LEFT JOIN n ON n.id = vec_id LEFT JOIN low ON low.id = vec_id"""

#: crc32 of decimal ids by its polynomial, a table entry at a time.
_CRC = """
crc_t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
crc AS (
  SELECT id, xor(list_reduce(list_transform(range(1, length(id) + 1), lambda k: ord(id[k])), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE conv_id IS NOT NULL), crc_t)"""

PREFIX_TRIE = f"""
WITH {_CRC},
own AS (
  SELECT conv_id, list(struct_pack(id := octet_length(encode(role)) || ':' || role || text, w := len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, CASE WHEN h = 0 THEN c.t ELSE coalesce(b.t[1:h], []) || c.t[h + 1:] END AS t
  FROM (SELECT o.*, crc % 4 AS h FROM own o JOIN crc ON id = CAST(conv_id AS VARCHAR)) c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
member AS (SELECT conv_id, len(t) AS n, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt),
node AS (
  SELECT list_transform(t[1:depth], lambda x: x.id) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE t[depth].w END) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM member GROUP BY ALL),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT path[1:d] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node.path, unnest(range(depth + 1)) AS d, (n_convs - 1) * w AS saved, (kids.path IS NULL)::INT AS leaf FROM node LEFT JOIN kids ON kids.path = node.path)
  GROUP BY 1)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves::BIGINT AS n_leaves,
  below.saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below ON below.path = node.path LEFT JOIN kids ON kids.path = node.path LEFT JOIN node up ON node.depth > 0 AND up.path = node.path[1:node.depth - 1]"""

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op3_web_archives": WEB_ARCHIVES,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op7_mixing": MIXING,
    "op10_similar_vectors": SIMILAR_VECTORS,
    "op12_prefix_trie": PREFIX_TRIE,
}
