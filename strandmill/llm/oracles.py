"""SQL for DuckDB, for the operators' queries that SQL can express."""

from __future__ import annotations

from strandmill.llm.sharding import FIRST, SECOND, SHARDS, Permutation

REPEATS = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) s FROM w WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) rn FROM win) WHERE rn > 1),
hit AS (SELECT doc_id, list(DISTINCT i) h FROM (SELECT doc_id, unnest(range(s, s + 20)) i FROM dup) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(len(h), 0) AS BIGINT) n_removed,
  sha256(CASE WHEN h IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(h, i)], ' '), '') END) kept_sha256
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id
"""

LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum([x * x FOR x IN e]) > 0),
ln AS (SELECT a.vec_id a, c.vec_id b FROM ok a JOIN ok c ON a.vec_id <> c.vec_id AND list_cosine_similarity(a.e, c.e) >= 0.95),
re(a, b) AS (SELECT a, b FROM ln UNION SELECT re.a, ln.b FROM re JOIN ln ON ln.a = re.b),
co AS (SELECT a, min(b) m FROM re GROUP BY a), nl AS (SELECT a, count(*) n FROM ln GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id = least(vec_id, coalesce(m, vec_id)) kept
FROM embeddings LEFT JOIN co ON co.a = vec_id LEFT JOIN nl ON nl.a = vec_id
"""

_WORDS = r"CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END ws"
CONTAMINATION = f"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') k FROM (SELECT item, ws, least(10, len(ws)) n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) s FROM it WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, dw.n, s, item FROM dw JOIN iw ON iw.n = dw.n AND iw.k = dw.k),
hw AS (SELECT doc_id, count(DISTINCT i) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) i FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, list_sort(list(DISTINCT item)) items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(len(items), 0) AS BIGINT) n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""



def _feistel(x: str) -> str:
    """The network of the permutation over x, whose bits the table z has as `half`."""
    low, rest = f"({x} >> half)", f"({x} & mask)"
    left, right = low, rest
    for k, key in enumerate(Permutation(1).keys):
        h = f"xor(r{k}, {key}::UBIGINT)"
        left, right = f"r{k}", f"xor(l{k}, (xor(m{k}, m{k} >> 16)) & mask)"
        yield_ = f"SELECT *, {left} l{k + 1}, {right} r{k + 1} FROM (SELECT *, (xor(b{k}, b{k} >> 13) * {SECOND}::UBIGINT) & 4294967295 m{k} FROM (SELECT *, (xor(a{k}, a{k} >> 16) * {FIRST}::UBIGINT) & 4294967295 b{k} FROM (SELECT *, {h} a{k} FROM ("
        low = yield_ + (low if k else f"SELECT *, {low} l0, {rest} r0 FROM {{}}") + "))))"
    return f"SELECT id, half, mask, rows, (l{k + 1} << half) | r{k + 1} v FROM ({low})"


_BYTES = "[CAST('0x' || substr(h, 2 * i - 1, 2) AS INTEGER) FOR i IN range(1, len(h) // 2 + 1)]"
#: The table of the 32-bit cyclic redundancy check, from its polynomial.
_CRC = "SELECT list(list_reduce(list_concat([i::BIGINT], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) t FROM range(256) r(i)"
SHARDED = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') text, row_number() OVER (ORDER BY doc_id) - 1 id FROM documents),
z AS (SELECT CAST(ceil(ceil(log2(count(*))) / 2) AS INTEGER) half, CAST((1 << CAST(ceil(ceil(log2(count(*))) / 2) AS BIGINT)) - 1 AS UBIGINT) mask, count(*) AS rows FROM d),
crc AS ({_CRC}),
w(id, half, mask, rows, v) AS (
  {_feistel("id").format("(SELECT d.id::UBIGINT id, half, mask, rows FROM d, z)")}
  UNION ALL {_feistel("v").format("(SELECT id, half, mask, rows, v FROM w WHERE v >= rows)")}),
s AS (SELECT doc_id, id, h, xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) c FROM (SELECT doc_id, id, hex(encode(text)) h FROM d), crc)
SELECT doc_id, CAST(len(h) // 2 + 8 AS BIGINT) size, CAST(c AS BIGINT) text_crc32, 'rows' law, CAST(v % {SHARDS} AS INTEGER) shard, CAST(v // {SHARDS} AS BIGINT) slot, CAST(NULL AS INTEGER) grown_shard
FROM s JOIN w ON w.id = s.id WHERE v < rows
"""

_FAILS = {
    "A": "len(ws) < 100",
    "B": "100 * len(list_distinct(ws)) < 80 * len(ws)",
    "C": "100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text)",
    "D": "regexp_matches(text, '[#$%&*|]')",
    "E": "coalesce(least_id < e.doc_id, false)",
}
FILTERED = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY text) least_id FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY doc_id),
m AS (SELECT e.part, [{", ".join(f"CASE WHEN {x} THEN '{c}' ELSE '' END" for c, x in _FAILS.items())}] fails, coalesce(good, false) good, coalesce(toxic, false) toxic FROM e LEFT JOIN g ON g.doc_id = e.doc_id),
c AS (SELECT part, fails, count(*) n, count(*) FILTER (WHERE good) good, count(*) FILTER (WHERE toxic) toxic FROM m GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step:step] f, filter_order[1:step - 1] before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, f, n, good, toxic, list_contains(fails, f) hit, len(list_filter(fails, lambda y: y <> '' AND contains(before, y))) > 0 gone, len(list_filter(fails, lambda y: y <> '')) times FROM c, s),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT gone AND NOT hit) kept, sum(n) FILTER (WHERE NOT gone AND hit) removed, sum(n) FILTER (WHERE gone AND hit) redundant, sum(n) FILTER (WHERE hit AND times = 1) unique_fails,
  sum(good) FILTER (WHERE NOT gone AND hit) good_lost, sum(toxic) FILTER (WHERE NOT gone AND hit) toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) shapley FROM r
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} k, ws[i:i + {k - 1}] p FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) i FROM w WHERE len(ws) >= {k})" for k in range(1, 6))
COLLOCATIONS = rf"""
WITH t AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') ws FROM t),
f AS MATERIALIZED (SELECT lang, k, array_to_string(p, ' ') phrase, any_value(p) p, count(*) a FROM ({_GRAMS}) GROUP BY lang, k, array_to_string(p, ' ') HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) n FROM w GROUP BY lang),
u AS (SELECT lang, k, phrase, p, a, unnest(range(1, k)) cut FROM f WHERE k > 1),
s AS (SELECT u.lang, u.k, u.phrase, u.p, u.a, cut, x.a l, y.a r, n, CAST(1000::HUGEINT * u.a * n // (x.a::HUGEINT * y.a) AS BIGINT) score FROM u JOIN n ON n.lang = u.lang
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.p[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.p[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
c AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.k > b.k AND g.a >= b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM c QUALIFY rank <= 2000
"""

ORACLE_SQL = {
    "op4_difference_cover_anchors": REPEATS,
    "op6_collision_counting": LINKS,
    "op7_winnowing": CONTAMINATION,
    "op11_feistel_shards": SHARDED,
    "op12_filter_interaction": FILTERED,
    "op13_positional_collocations": COLLOCATIONS,
}
