"""SQL twins of the operators that SQL can express, for DuckDB on small tables (they compare all pairs)."""

from __future__ import annotations

from pagequarry.llm.line_dedup import MIN_WORDS
from pagequarry.llm.minhash_dedup import SHINGLE, THRESHOLD
from pagequarry.llm.quality_rules import BOILERPLATE, LineRules
from pagequarry.llm.suffix_dedup import PASSAGE, WIDTH

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_count = lambda x, chars: f"(length({x}) - length(regexp_replace({x}, '[{chars}]', '', 'g')))"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL"


def quality_rules(r: LineRules = LineRules()) -> str:
    phrases = " OR ".join(f"contains(lower(line), '{p.decode()}')" for p in BOILERPLATE)
    stops = r"""[.!?:;"'')\]}。！？…”’]$"""
    return f"""WITH l AS ({_LINES}), w AS (SELECT *, {_WORDS.format("line")} AS ws FROM l),
  j AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS stutter FROM w),
  f AS (SELECT doc_id, n, again AND n > 0 AS dup, n > 0 AND (NOT regexp_matches(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), '{stops}') OR again OR {_count("line", "#*$%&|<>")} > {r.symbols} * n OR {_count("line", "|<>")} > {r.navigation} * n
    OR {_count("line", "!")} > greatest(1, {r.shouts} * n) OR ({_count("line", "A-Z")} > {r.capitals} * greatest({_count("line", "A-Za-z")}, 1) AND n >= {r.short}) OR stutter > {r.stutter} * n OR {phrases}) AS failed FROM j),
  g AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (failed), 0) AS BIGINT) AS n_lost_words FROM f GROUP BY doc_id),
  d AS (SELECT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  x AS (SELECT doc_id, unnest(range(1, len(ws) - {r.window} + 2)) AS k, ws FROM d WHERE len(ws) >= {r.window}),
  y AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, list_slice(ws, k, k + {r.window - 1})) AS c FROM x),
  z AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + {r.window})) AS p FROM y WHERE c > 1) q GROUP BY doc_id),
  t AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda a: length(a))), 0) AS BIGINT) AS word_chars, {_count("coalesce(text, '')", "#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id)
SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat} * n_words AS base_failed, NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat} * n_words) AND n_lost_words <= {r.max_lost} * n_words AS kept FROM t"""


def suffix_dedup(width: int = WIDTH, passage: int = PASSAGE) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hash(doc_id, text) AS own, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  w AS (SELECT r, i, hash(substr(h, 2 * i + 1, {2 * width})) AS k FROM (SELECT r, h, unnest(range(0, n - {width - 1})) AS i FROM d WHERE n >= {width}) q),
  hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) q WHERE c > 1),
  g AS (SELECT r, i, sum(CASE WHEN i <= before + {width} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit) q),
  s AS (SELECT r, min(i) AS a, max(i) + {width} AS b FROM g GROUP BY r, run),
  p AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT s.r, max(b), max(d.n) FROM s JOIN d ON d.r = s.r GROUP BY s.r),
  k AS (SELECT p.r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM p JOIN d ON d.r = p.r GROUP BY p.r),
  t AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY r),
  v AS (SELECT r, own, k, hash(array_to_string(list_slice(ws, k, k + {passage - 1}), ' ')) AS x FROM (SELECT r, own, ws, unnest(range(1, len(ws) - {passage - 2})) AS k FROM d WHERE len(ws) >= {passage}) q),
  u AS (SELECT r, count(DISTINCT c) AS n FROM (SELECT r, unnest(range(k, k + {passage})) AS c FROM (SELECT r, k, min(own) OVER (PARTITION BY x) AS lo, max(own) OVER (PARTITION BY x) AS hi FROM v) q WHERE lo < hi) q GROUP BY r)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(u.n, 0) AS n_passage_words
FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN k ON k.r = d.r LEFT JOIN u ON u.r = d.r"""


def warc() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(concat('0x', substr(h, 5 * (i // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)"
    return f"""SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, target
FROM (SELECT page_id, url AS target, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages) p"""


def line_dedup(min_words: int = MIN_WORDS) -> str:
    return f"""WITH l AS ({_LINES}), w AS (SELECT *, len({_WORDS.format("line")}) AS n FROM l),
  e AS (SELECT doc_id, i, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w WHERE n > 0),
  r AS (SELECT a.doc_id, a.pos, min(b.pos) AS last FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + {min_words} AND b.upto - a.upto + a.n >= {min_words} GROUP BY a.doc_id, a.pos),
  c AS (SELECT r.doc_id, r.pos, r.last, string_agg(b.line, chr(10) ORDER BY b.pos) AS run FROM r JOIN e b ON b.doc_id = r.doc_id AND b.pos BETWEEN r.pos AND r.last GROUP BY r.doc_id, r.pos, r.last),
  k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS rank FROM c),
  x AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM k WHERE rank > 1),
  g AS (SELECT e.doc_id, e.i FROM e JOIN x ON x.doc_id = e.doc_id AND x.pos = e.pos),
  t AS (SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.i) FILTER (g.i IS NULL) AS kept, count(*) FILTER (w.n > 0) AS n_lines, count(g.i) AS n_removed_lines FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""


def _components(links: str, nodes: str) -> str:
    return f"""reach(a, b) AS (SELECT id, id FROM ({nodes}) n UNION SELECT r.a, l.b FROM reach r JOIN ({links}) l ON l.a = r.b),
  part AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)"""


def embedding_dedup(threshold: float = 0.9) -> str:
    norm = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / {norm}) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) q),
  link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x, e y WHERE x.vec_id <> y.vec_id AND list_dot_product(x.u, y.u) >= {threshold}),
  {_components("SELECT a, b FROM link", "SELECT vec_id AS id FROM e")}
SELECT p.id AS vec_id, (SELECT count(*) FROM link WHERE a = p.id) AS n_links, p.root AS component_id, p.id = p.root AS kept FROM part p"""


def minhash_dedup(size: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  s AS (SELECT doc_id, list_slice(ws, k, k + {size - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) AS k FROM d WHERE len(ws) > 0) q),
  c AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM s GROUP BY doc_id, g), t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS m FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  link AS MATERIALIZED (SELECT a, b FROM p JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE m >= {threshold} * (ta.n + tb.n - m)),
  {_components("SELECT a, b FROM link", "SELECT doc_id AS id FROM d")}
SELECT id AS doc_id, root AS class_id, count(*) OVER (PARTITION BY root) AS class_size, id = root AS kept FROM part"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup(), "op2_quality_rules": quality_rules(), "op4_warc": warc(), "op7_line_dedup": line_dedup(), "op9_embedding_dedup": embedding_dedup(), "op10_minhash_dedup": minhash_dedup()}
