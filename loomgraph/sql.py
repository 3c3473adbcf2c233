"""DuckDB SQL that recomputes the core queries on the same tables."""

from __future__ import annotations

_W = r"'[\s\x0B\x85\p{Z}]+'"
_TRIM = r"regexp_replace({c}, '^[\s\x0B\x85\p{{Z}}]+|[\s\x0B\x85\p{{Z}}]+$', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), {_W}), lambda x: x <> '')"


def _norm(c: str) -> str:
    return f"translate(lower({c}), ' -', '__')"


_CHUNKS = """c AS (SELECT id, any_value(text) AS text, any_value(summary) AS summary, any_value(entities) AS entities, any_value(relations) AS relations
    FROM chunked_output WHERE id IS NOT NULL GROUP BY id),
ok AS (SELECT * FROM c WHERE coalesce(text, '') <> '' AND coalesce(summary, '') <> '' AND coalesce(len(entities), 0) > 0 AND coalesce(len(relations), 0) > 0),
ent AS (SELECT * FROM (SELECT id, unnest(entities) AS e, generate_subscripts(entities, 1) - 1 AS pos FROM ok) WHERE e IS NOT NULL),
rel AS (SELECT id, pos, 'R_' || md5(id || '|' || pos) AS rid, r."Source" AS s, r."Relationship" AS p, r."Destination" AS d
    FROM (SELECT id, unnest(relations) AS r, generate_subscripts(relations, 1) - 1 AS pos FROM ok) WHERE r IS NOT NULL)"""

_NODES = f"""{_CHUNKS},
m AS (SELECT 'T_' || id AS node, 'T' AS type, text, id AS k1, 0 AS k2, 0 AS k3, 0 AS k4 FROM ok
    UNION ALL SELECT 'S_' || id, 'S', summary, id, 1, 0, 0 FROM ok
    UNION ALL SELECT 'N_' || {_norm("e")}, 'N', e, id, 2, pos, 0 FROM ent
    UNION ALL SELECT rid, 'R', p, id, 3, pos, 0 FROM rel
    UNION ALL SELECT 'N_' || {_norm("s")}, NULL, NULL, id, 3, pos, 1 FROM rel WHERE s IS NOT NULL
    UNION ALL SELECT 'N_' || {_norm("d")}, NULL, NULL, id, 3, pos, 2 FROM rel WHERE d IS NOT NULL),
nodes AS (SELECT node AS id, type, text, k1, k2, k3, k4 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY k1, k2, k3, k4) AS rn FROM m) WHERE rn = 1),
edges AS (SELECT 'T_' || id AS src, 'S_' || id AS dst, 'derived_from' AS label, id AS k1, 1 AS k2, 0 AS k3, 0 AS k4 FROM ok
    UNION ALL SELECT 'S_' || id, 'N_' || {_norm("e")}, 'mentions', id, 2, pos, 0 FROM ent
    UNION ALL SELECT rid, 'N_' || {_norm("s")}, 'subj', id, 3, pos, 1 FROM rel WHERE s IS NOT NULL
    UNION ALL SELECT rid, 'N_' || {_norm("d")}, 'obj', id, 3, pos, 2 FROM rel WHERE d IS NOT NULL),
g4 AS (SELECT 'T_' || id AS src, 'S_' || id AS dst, 'derived_from' AS label FROM c WHERE coalesce(text, '') <> '' AND 'S_' || id IN (SELECT id FROM nodes WHERE type = 'S')
    UNION ALL SELECT 'T_' || id, 'N_' || e, 'mentions_entity' FROM (SELECT id, unnest(entities) AS e FROM c WHERE coalesce(text, '') <> '' AND 'S_' || id IN (SELECT id FROM nodes WHERE type = 'S')) WHERE 'N_' || e IN (SELECT id FROM nodes))"""

_SNR = f"""{_NODES},
snr AS (SELECT id FROM nodes WHERE type IN ('S', 'N', 'R')),
snr_edges AS (SELECT * FROM edges WHERE src IN (SELECT id FROM snr) AND dst IN (SELECT id FROM snr)),
two AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM snr_edges UNION ALL SELECT dst, src FROM snr_edges) WHERE a <> b)"""


def _round(k: int) -> str:
    return f"""v{k} AS (SELECT a, community, count(*) AS n FROM two JOIN l{k - 1} ON two.b = l{k - 1}.id GROUP BY a, community),
b{k} AS (SELECT a, community FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, community) AS rn FROM v{k}) WHERE rn = 1),
l{k} AS (SELECT l{k - 1}.id, coalesce(b{k}.community, l{k - 1}.community) AS community FROM l{k - 1} LEFT JOIN b{k} ON l{k - 1}.id = b{k}.a)"""


_COMM = f"{_SNR},\nl0 AS (SELECT id, id AS community FROM snr),\n{_round(1)},\n{_round(2)}"
_CONTEXT = f"""{_COMM},
lasts AS (SELECT src, arg_max(dst, (k1, k2, k3, k4)) AS s FROM edges WHERE label = 'subj' GROUP BY src),
lasto AS (SELECT src, arg_max(dst, (k1, k2, k3, k4)) AS o FROM edges WHERE label = 'obj' GROUP BY src),
ctx AS (SELECT community, 'summary' AS kind, text, k1, k2, k3, k4 FROM nodes JOIN l2 USING (id) WHERE type = 'S' AND trim(coalesce(text, '')) <> ''
    UNION ALL SELECT community, 'relation', a.text || ' ' || nodes.text || ' ' || b.text, nodes.k1, nodes.k2, nodes.k3, nodes.k4
    FROM nodes JOIN l2 USING (id) JOIN lasts ON lasts.src = nodes.id JOIN lasto ON lasto.src = nodes.id JOIN nodes a ON a.id = s JOIN nodes b ON b.id = o
    WHERE nodes.type = 'R' AND trim(coalesce(nodes.text, '')) <> '' AND coalesce(a.text, '') <> '' AND coalesce(b.text, '') <> '')"""
_HO = f"""{_CONTEXT},
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY kind DESC, k1, k2, k3, k4) AS r FROM ctx) WHERE r <= 150),
hl AS (SELECT community, array_to_string(list_slice({_words("string_agg(text, ' ' ORDER BY r)")}, 1, 150), ' ') AS hl_summary FROM few GROUP BY community),
word AS (SELECT community, w, count(*) AS n FROM (SELECT community, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM ctx) WHERE length(w) > 3 GROUP BY community, w),
ttl AS (SELECT community, string_agg(w, ' ' ORDER BY r) AS title FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, w) AS r FROM word) WHERE r <= 8 GROUP BY community),
ho AS (SELECT community, hl_summary, title FROM hl JOIN ttl USING (community) WHERE hl_summary <> '' AND title <> '')"""

_QUESTIONS = """q AS (SELECT id AS uid, any_value(question) AS question FROM musique WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id)"""


def _jaccard(q: str, nodes: str = "nodes") -> str:
    return f"""qt AS (SELECT uid, list_distinct({_words("lower(question)")}) AS qt FROM {q}),
nt AS (SELECT id, list_distinct({_words("lower(text)")}) AS nt FROM {nodes} WHERE type IN ('N', 'O')),
lex AS (SELECT uid, id, len(list_intersect(qt, nt)) / len(list_distinct(list_concat(list_concat(qt, nt), ['.']))) AS score FROM qt, nt WHERE len(list_intersect(qt, nt)) > 0)"""


def _embed(name: str, src: str, key: str, text: str) -> str:
    return f"""{name}_n AS (SELECT {key} AS k, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({_words(f"lower({text})")}) AS w FROM {src}) GROUP BY 1, 2),
{name} AS (SELECT k, b, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM {name}_n)"""


def _near(table: str, key: str, k: int, skip: bool) -> str:
    return f"""SELECT query_id, id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM (
    SELECT a.{key} AS query_id, b.{key} AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS score FROM {table} a, {table} b
    WHERE a.{key} % 100 = 0{f" AND a.{key} <> b.{key}" if skip else ""})) WHERE rank <= {k}"""


_VEC = """v AS (SELECT vec_id, any_value(id) AS id, any_value(embedding) AS embedding FROM graph_embeddings WHERE id IS NOT NULL AND vec_id IS NOT NULL GROUP BY vec_id),
u AS (SELECT * FROM v WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"""
_GNEAR = f"gn AS (SELECT a.id AS src, b.id AS dst, n.score FROM ({_near('u', 'vec_id', 10, True)}) n JOIN u a ON a.vec_id = n.query_id JOIN u b ON b.vec_id = n.id)"

_FINAL = f"""{_HO},
{_VEC},
{_GNEAR},
fnodes AS (SELECT * FROM nodes UNION ALL SELECT 'H_' || community, 'H', hl_summary, '~H_' || community, 6, 0, 0 FROM ho UNION ALL SELECT 'O_' || community, 'O', title, '~O_' || community, 6, 0, 0 FROM ho),
axis AS (SELECT id, arg_min(list_position(list_transform(embedding, lambda x: abs(x)), list_max(list_transform(embedding, lambda x: abs(x)))), vec_id) AS cluster FROM u GROUP BY id),
grp AS (SELECT axis.id, cluster, community FROM axis JOIN l2 USING (id) JOIN nodes USING (id) WHERE nodes.type = 'S'),
pr AS (SELECT DISTINCT gn.src, gn.dst FROM gn LEFT JOIN l2 a ON a.id = gn.src LEFT JOIN l2 b ON b.id = gn.dst WHERE gn.src <> gn.dst AND a.community IS NOT DISTINCT FROM b.community),
alle AS (SELECT src, dst, label FROM edges UNION ALL SELECT src, dst, label FROM g4 UNION ALL SELECT 'O_' || community, 'H_' || community, 'overview_of' FROM ho
    UNION ALL SELECT 'H_' || ho.community, nodes.id, 'summarizes' FROM nodes JOIN l2 USING (id) JOIN ho ON ho.community = l2.community WHERE nodes.type = 'S'),
srel AS (SELECT pr.src, pr.dst FROM pr JOIN grp a ON a.id = pr.src JOIN grp b ON b.id = pr.dst AND b.cluster = a.cluster AND b.community = a.community WHERE pr.src < pr.dst),
fedges AS (SELECT src, dst, label, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM pr) THEN 2 ELSE 1 END::INT AS weight FROM alle
    UNION ALL SELECT src, dst, 'semantically_related', 2 FROM srel
    UNION ALL SELECT src, dst, 'semantic_hnsw', 1 FROM pr WHERE (src, dst) NOT IN (SELECT (src, dst) FROM alle) AND (src, dst) NOT IN (SELECT (src, dst) FROM srel))"""

_ENTRY = f"""{_FINAL},
{_QUESTIONS},
qs AS (SELECT * FROM q WHERE TRY_CAST(regexp_extract(uid, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
{_jaccard("qs", "fnodes")},
src_nodes AS (SELECT id, text FROM fnodes WHERE type IN ('T', 'S', 'H')),
{_embed("ne", "src_nodes", "id", "text")},
{_embed("qe", "qs", "uid", "question")},
cosv AS (SELECT qe.k AS uid, ne.k AS id, round(sum(qe.x * ne.x), 6) AS score FROM qe JOIN ne USING (b) GROUP BY 1, 2),
near AS (SELECT uid, id FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS r FROM cosv) WHERE r <= 10),
entry0 AS (SELECT uid, id FROM near UNION SELECT uid, id FROM lex WHERE score > 0.3),
entry AS (SELECT uid, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY uid) AS weight FROM entry0)"""
_PPR = f"""{_ENTRY},
w AS (SELECT src, dst, sum(weight)::DOUBLE AS w FROM fedges GROUP BY src, dst),
p AS (SELECT src, dst, w / (sum(w) OVER (PARTITION BY src) + 1e-8) AS p FROM w),
s1 AS (SELECT uid, id, sum(s) AS s FROM (SELECT uid, id, 0.5 * weight AS s FROM entry UNION ALL SELECT uid, dst, 0.5 * weight * p FROM entry JOIN p ON entry.id = p.src) GROUP BY uid, id),
s2 AS (SELECT uid, id, round(sum(s), 9) AS score FROM (SELECT uid, id, 0.5 * weight AS s FROM entry UNION ALL SELECT uid, dst, 0.5 * s * p FROM s1 JOIN p ON s1.id = p.src) GROUP BY uid, id),
cand AS (SELECT u.uid, nodes.id, nodes.type, coalesce(s2.score, 0) AS score, k1, k2, k3, k4 FROM (SELECT DISTINCT uid FROM s2) u CROSS JOIN (SELECT * FROM fnodes WHERE type IN ('T', 'S', 'H', 'R')) nodes LEFT JOIN s2 ON s2.uid = u.uid AND s2.id = nodes.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, type ORDER BY score DESC, k1, k2, k3, k4) AS rank FROM cand) WHERE rank <= 5),
ev AS (SELECT DISTINCT x.uid, nodes.id, nodes.type, nodes.text, k1, k2, k3, k4 FROM (SELECT uid, id FROM entry UNION SELECT uid, id FROM top) x JOIN fnodes nodes USING (id) WHERE nodes.type IN ('T', 'S', 'H', 'R')),
eve AS (SELECT a.uid, e.src, e.dst, e.label FROM fedges e JOIN ev a ON a.id = e.src JOIN ev b ON b.id = e.dst AND b.uid = a.uid)"""
_LINES = f"""{_PPR},
lines AS (SELECT uid, 0 AS k, id AS o1, '' AS o2, '' AS o3, '[' || type || ': ' || id || '] ' || replace(trim(coalesce(text, '')), chr(10), ' ') AS line FROM ev
    UNION ALL SELECT uid, 1, src, dst, label, '[EDGE: ' || src || ' → ' || dst || '] ' || label FROM eve),
gt AS (SELECT uid, string_agg(line, chr(10) ORDER BY k, o1, o2, o3) AS graph_text FROM lines GROUP BY uid)"""
_ALIGN = f"""{_PPR},
chain AS (SELECT uid, string_agg(text, ' ' ORDER BY id) AS chain FROM ev WHERE type = 'S' GROUP BY uid),
hits AS (SELECT ev.*, CASE WHEN coalesce(text, '') = '' THEN length(lower(chain)) + 1 ELSE (length(lower(chain)) - length(replace(lower(chain), lower(text), ''))) // length(lower(text)) END AS hits FROM ev JOIN chain USING (uid)),
prs AS (SELECT *, round((hits + 1e-6) / sum(hits + 1e-6) OVER (PARTITION BY uid), 9) AS p_reason FROM hits),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p_reason DESC, k1, k2, k3, k4) AS r FROM prs) WHERE r <= 5),
keep AS (SELECT uid, id FROM best UNION SELECT eve.uid, eve.dst FROM best JOIN eve ON eve.uid = best.uid AND eve.src = best.id)"""

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _normal(c: str) -> str:
    x = f"translate(lower({c}), '{_PUNCT}', '')"
    for _ in range(2):  # neighbouring articles share their separator
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return rf"trim(regexp_replace({x}, {_W}, ' ', 'g'))"


_PAIRS = f"""d AS (SELECT id AS uid, any_value(answer) AS prediction, any_value(answers) AS answers FROM eval_dump WHERE id IS NOT NULL AND answer IS NOT NULL GROUP BY id),
pairs AS (SELECT uid, prediction, gold FROM (SELECT uid, prediction, unnest(flatten(list_filter(answers, lambda x: x IS NOT NULL))) AS gold FROM d) WHERE gold IS NOT NULL),
nrm AS (SELECT uid, gold, {_normal("prediction")} AS p, {_normal("gold")} AS g FROM pairs),
tok AS (SELECT uid, gold, p, g, {_words("p")} AS pt, {_words("g")} AS gt FROM nrm),
sm AS (SELECT *, len(list_intersect(list_distinct(pt), list_distinct(gt))) AS same FROM tok),
sc AS (SELECT uid, gold, CASE WHEN same = 0 THEN 0.0::DOUBLE ELSE round((2.0 * same / len(pt) * same / len(gt)) / (same::DOUBLE / len(pt) + same::DOUBLE / len(gt)), 6) END AS f1,
    CASE WHEN same = 0 THEN 0.0::DOUBLE ELSE round(same::DOUBLE / len(pt), 6) END AS precision, CASE WHEN same = 0 THEN 0.0::DOUBLE ELSE round(same::DOUBLE / len(gt), 6) END AS recall,
    (p = g)::INT AS exact_match, contains(p, g)::INT AS accuracy FROM sm),
bst AS (SELECT uid, max(f1) AS f1, max(precision) AS precision, max(recall) AS recall, max(exact_match) AS exact_match, max(accuracy) AS accuracy FROM sc GROUP BY uid)"""

_SENT = rf"""s0 AS (SELECT doc_id, list_filter(string_split(regexp_replace({_TRIM.format(c="text")}, '([.!?])[\s\x0B\x85\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS sent_no, unnest(a) AS sentence FROM s0)"""


_P7 = r"""WITH mu AS (SELECT id, any_value(paragraphs) AS ps, any_value(answer_aliases) AS al FROM musique WHERE id IS NOT NULL GROUP BY id),
par AS (SELECT id AS record_id, unnest(ps) AS x, unnest(range(len(ps))) AS pos FROM mu),
ali AS (SELECT id AS record_id, unnest(al) AS x, unnest(range(len(al))) AS pos FROM mu),
raws AS (SELECT id::VARCHAR AS id, any_value(g_raw) AS raw FROM eval_dump WHERE id IS NOT NULL GROUP BY id),
once AS (SELECT id, raw::JSON AS g FROM raws WHERE json_valid(raw)),
twice AS (SELECT id, CASE WHEN json_type(g) <> 'VARCHAR' THEN g WHEN json_valid(g ->> '$') THEN (g ->> '$')::JSON END AS g FROM once),
tree0 AS (SELECT t.id AS rid, j.* FROM twice t, json_tree(t.g) j WHERE t.g IS NOT NULL),
within AS (SELECT rid, id AS at, (value ->> '$')::JSON AS g FROM tree0 WHERE type = 'VARCHAR' AND NOT regexp_matches(fullkey, '\.(nodes|edges|links)([.\[]|$)') AND regexp_matches(value ->> '$', '^[{\[]') AND json_valid(value ->> '$')),
tree AS (SELECT rid, -1 AS at, * EXCLUDE (rid) FROM tree0 UNION ALL SELECT w.rid, w.at, j.* FROM within w, json_tree(w.g) j),
obj AS (SELECT c.rid, c.value AS v, c.type, c.key, regexp_matches(c.fullkey, '\.nodes(\[[0-9]+\])*$') AS in_nodes, p.value AS pv, p.type AS pt, p.key AS pk, regexp_matches(p.fullkey, '\.nodes(\[[0-9]+\])*$') AS p_nodes, q.type AS qt,
        regexp_matches(q.fullkey, '\.(edges|links)(\[[0-9]+\])*$') AS q_edges, regexp_matches(p.fullkey, '\.(edges|links)(\[[0-9]+\])*$') AS p_edges
    FROM tree c LEFT JOIN tree p ON p.rid = c.rid AND p.at = c.at AND p.id = c.parent LEFT JOIN tree q ON q.rid = p.rid AND q.at = p.at AND q.id = p.parent),
node AS (SELECT rid, v ->> '$.id' AS k FROM obj WHERE in_nodes AND type = 'OBJECT' AND json_type(v, '$.id') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')
    UNION ALL SELECT rid, key FROM obj WHERE p_nodes AND pt = 'OBJECT' AND type = 'OBJECT' AND NOT list_has_any(json_keys(pv), ['id', 'nodes', 'edges', 'links', 'source'])),
ends AS (SELECT rid, CASE WHEN json_type(v, '$.source') = 'OBJECT' THEN v ->> '$.source.id' ELSE v ->> '$.source' END AS a, CASE WHEN json_type(v, '$.target') = 'OBJECT' THEN v ->> '$.target.id' ELSE v ->> '$.target' END AS b,
        coalesce(v ->> '$.label', CASE WHEN pt = 'ARRAY' AND qt = 'OBJECT' AND q_edges THEN pk WHEN pt = 'OBJECT' AND p_edges THEN key END, '') AS label
    FROM obj WHERE type = 'OBJECT' AND NOT in_nodes AND list_has_all(json_keys(v), ['source', 'target'])),
edge AS (SELECT rid, a || '>' || b || '>' || label AS k FROM ends WHERE a IS NOT NULL AND b IS NOT NULL)
"""

# the fold over sentences: word counts and texts of the open chunk's items; a chunk that is full leaves its last items, at least 40 words, as one item
_FULL = "len(cur) > 0 AND list_sum(cur) + n > 400"
_FROM = "len(cur) - least(len(cur), 1 + len(list_filter(range(1, len(cur) + 1), lambda j: list_sum(cur[len(cur) - j + 1:]) < 40))) + 1"
_CHUNKED = f"""WITH RECURSIVE {_SENT},
sw AS (SELECT doc_id, sent_no, sentence, len({_words("sentence")})::BIGINT AS n FROM s),
f AS (SELECT doc_id, -1::BIGINT AS sent_no, []::BIGINT[] AS cur, []::VARCHAR[] AS txt, NULL::BIGINT AS done, NULL::VARCHAR AS text, 0::BIGINT AS no FROM (SELECT DISTINCT doc_id FROM sw)
    UNION ALL SELECT f.doc_id, sw.sent_no::BIGINT,
        CASE WHEN {_FULL} THEN [list_sum(cur[{_FROM}:])::BIGINT, n] ELSE list_append(cur, n) END,
        CASE WHEN {_FULL} THEN [array_to_string(txt[{_FROM}:], ' '), sentence] ELSE list_append(txt, sentence) END,
        CASE WHEN {_FULL} THEN list_sum(cur)::BIGINT END, CASE WHEN {_FULL} THEN array_to_string(txt, ' ') END, CASE WHEN {_FULL} THEN no + 1 ELSE no END
    FROM f JOIN sw ON sw.doc_id = f.doc_id AND sw.sent_no = f.sent_no + 1)
SELECT doc_id, no - 1 AS chunk_no, done AS n_words, text FROM f WHERE done IS NOT NULL
UNION ALL SELECT doc_id, no, list_sum(cur)::BIGINT, array_to_string(txt, ' ') FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no DESC) AS r FROM f) WHERE r = 1 AND len(cur) > 0"""


def _blank(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{200B}}\\x{{FEFF}}]+', '', 'g'), '') = ''"


_LACKS = "array_to_string(list_filter([CASE WHEN x.idx IS NULL THEN 'idx' END, CASE WHEN x.title IS NULL THEN 'title' END, CASE WHEN x.is_supporting IS NULL THEN 'is_supporting' END], lambda k: k IS NOT NULL), ',')"


ORACLE: dict[str, str] = {
    "p7_found": _P7 + f"""SELECT DISTINCT rid AS record_id, 'node' AS child, k AS child_key FROM node UNION ALL SELECT DISTINCT rid, 'edge', k FROM edge
UNION ALL SELECT record_id, 'paragraph', pos::VARCHAR FROM par WHERE NOT {_blank("x.paragraph_text")} UNION ALL SELECT record_id, 'alias', pos::VARCHAR FROM ali WHERE NOT {_blank("x")}""",
    "p7_paragraphs": _P7 + f"""SELECT record_id, pos::VARCHAR AS child_key, CASE WHEN {_LACKS} = '' THEN 'whole' ELSE 'without ' || {_LACKS} END AS variant, x.idx AS idx, x.title AS title, x.paragraph_text AS paragraph_text, x.is_supporting AS is_supporting
FROM par WHERE NOT {_blank("x.paragraph_text")}""",
    "p7_aliases": _P7 + f"SELECT record_id, pos::VARCHAR AS child_key, x AS alias FROM ali WHERE NOT {_blank('x')}",
    "doc_concat": "SELECT coalesce(book_id, -1) AS book_id, doc_id, (sum(length(coalesce(text, ''))) OVER (PARTITION BY coalesce(book_id, -1) ORDER BY doc_id) - length(coalesce(text, '')))::BIGINT AS start_pos FROM documents",
    "sentence_split": f"WITH {_SENT} SELECT doc_id, sent_no::BIGINT AS sent_no, sentence FROM s",
    "word_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_words('text')}) AS token FROM documents) GROUP BY token",
    "chunk_stats": f"SELECT doc_id, chunk_no, n_words FROM ({_CHUNKED})",
    "chunk_range": f"WITH x AS ({_CHUNKED}) SELECT doc_id, chunk_no, n_words FROM x WHERE chunk_no >= 1 AND chunk_no < 3",
    "chunk": f"SELECT md5(doc_id || '|' || chunk_no) AS chunk_id, doc_id, chunk_no, n_words, text FROM ({_CHUNKED})",
    "page_text": "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) - 1 AS page_no, coalesce(text, '') AS text FROM documents WHERE book_id IS NOT NULL",
    "parse_entities": """SELECT DISTINCT rel_id, entity FROM (SELECT rel_id, unnest(regexp_extract_all(raw, '"([a-zA-Z][^"]*[a-zA-Z])"', 1)) AS entity FROM relations WHERE raw IS NOT NULL)""",
    "parse_relations": """WITH t AS (SELECT rel_id, raw, '[''"]?Source[''"]?\\s*:\\s*[''"]?([^,''"}]+)[''"]?\\s*,\\s*[''"]?Relationship[''"]?\\s*:\\s*[''"]?([^,''"}]+)[''"]?\\s*,\\s*[''"]?Destination[''"]?\\s*:\\s*[''"]?([^,''"}]+)[''"]?' AS p FROM relations WHERE raw IS NOT NULL)
SELECT DISTINCT rel_id, unnest(regexp_extract_all(raw, p, 1)) AS "Source", unnest(regexp_extract_all(raw, p, 2)) AS "Relationship", unnest(regexp_extract_all(raw, p, 3)) AS "Destination" FROM t""",
    "entity_normalize": f"SELECT DISTINCT source, {_norm('source')} AS key FROM relations WHERE source IS NOT NULL",
    "completeness": f"""WITH {_CHUNKS}, l AS (SELECT id AS doc_id, list_filter([CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN coalesce(summary, '') = '' THEN 'summary' END,
    CASE WHEN coalesce(len(entities), 0) = 0 THEN 'entities' END, CASE WHEN coalesce(len(relations), 0) = 0 THEN 'relations' END], lambda x: x IS NOT NULL) AS a FROM c)
SELECT doc_id, array_to_string(a, ',') AS missing FROM l WHERE len(a) > 0""",
    "retry_pending": f"WITH {_CHUNKS} SELECT id AS doc_id FROM c WHERE id NOT IN (SELECT id FROM ok) AND id NOT IN (SELECT chunk_id FROM relations WHERE source IS NOT NULL AND chunk_id IS NOT NULL)",
    "progress": f"""WITH {_CHUNKS}, x AS (SELECT unnest([{{'task': 'summary', 'ok': (coalesce(summary, '') <> '')::INT}}, {{'task': 'entity', 'ok': (coalesce(len(entities), 0) > 0)::INT}}, {{'task': 'relationship', 'ok': (coalesce(len(relations), 0) > 0)::INT}}]) AS x FROM c)
SELECT x.task AS task, sum(x.ok)::BIGINT AS processed, sum(1 - x.ok)::BIGINT AS unprocessed FROM x GROUP BY 1""",
    "nodes_g1": f"WITH {_NODES} SELECT id, type, text FROM nodes",
    "nodes_g1_promote": f"WITH {_NODES} SELECT node AS id, type, text FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type IS NULL, k1, k2, k3, k4) AS r FROM m) WHERE r = 1",
    "edges_g1": f"WITH {_NODES} SELECT src, dst, label FROM edges",
    "simple_graph": f"WITH {_NODES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges",
    "snr_subgraph": f"WITH {_SNR} SELECT src, dst, label FROM snr_edges",
    "out_degree": f"WITH {_NODES} SELECT src, count(*) AS degree FROM edges GROUP BY src",
    "g4_edges": f"WITH {_NODES} SELECT src, dst, label FROM g4",
    "upsert_edges": f"WITH {_NODES} SELECT DISTINCT src, dst, label FROM (SELECT src, dst, label FROM edges UNION ALL SELECT src, dst, label FROM g4)",
    "json_graph": f"WITH {_NODES} SELECT src, dst, label FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS r FROM edges) WHERE r = 1",
    "graph_json": f"WITH {_NODES} SELECT 'node' AS kind, to_json({{'id': id, 'type': type, 'text': text}})::VARCHAR AS json FROM nodes UNION ALL SELECT 'edge', to_json({{'source': src, 'target': dst, 'label': label, 'weight': NULL::INT}})::VARCHAR FROM edges",
    "components": f"""WITH RECURSIVE {_SNR},
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM snr UNION SELECT two.b, min(cc.comp) FROM cc JOIN two ON two.a = cc.id JOIN recurring.cc r ON r.id = two.b WHERE cc.comp < r.comp GROUP BY two.b)
SELECT id, comp AS component FROM cc""",
    "collapse_parallel": f"WITH {_NODES} SELECT src, dst, label FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS r FROM edges) WHERE r = 1",
    "label_propagation": f"WITH {_COMM} SELECT id, community FROM l2",
    "modularity": f"""WITH {_COMM}, e AS (SELECT a.community AS ca, b.community AS cb FROM snr_edges JOIN l2 a ON a.id = src JOIN l2 b ON b.id = dst), tot AS (SELECT count(*)::DOUBLE AS m FROM e),
x AS (SELECT c, sum(l) AS l, sum(d) AS d FROM (SELECT ca AS c, (ca = cb)::INT AS l, 1 AS d FROM e UNION ALL SELECT cb, 0, 1 FROM e) GROUP BY c)
SELECT round(sum(l / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM x, tot""",
    "community_context": f"WITH {_CONTEXT} SELECT community, kind, text FROM ctx",
    "ho_nodes": f"WITH {_HO} SELECT 'H_' || community AS id, 'H' AS type, hl_summary AS text FROM ho UNION ALL SELECT 'O_' || community, 'O', title FROM ho",
    "ho_edges": f"WITH {_HO} SELECT 'O_' || community AS src, 'H_' || community AS dst, 'overview_of' AS label FROM ho UNION ALL SELECT 'H_' || ho.community, nodes.id, 'summarizes' FROM nodes JOIN l2 USING (id) JOIN ho ON ho.community = l2.community WHERE nodes.type = 'S'",
    "semantic_groups": "SELECT label || '/' || (vec_id % 7) AS group_id, vec_id AS id FROM embeddings WHERE label IS NOT NULL QUALIFY count(*) OVER (PARTITION BY label, vec_id % 7) > 1",
    "knn": _near("embeddings", "vec_id", 10, False),
    "vector_topk": _near("embeddings", "vec_id", 30, True),
    "graph_knn": f"WITH {_VEC}, {_GNEAR} SELECT src, dst, score FROM gn",
    "g5_edges": f"WITH {_FINAL} SELECT src, dst, label, weight FROM fedges",
    "mean_pool": "SELECT label, pos::BIGINT AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY label, pos",
    "token_jaccard": f"WITH {_NODES}, {_QUESTIONS}, {_jaccard('q')} SELECT uid, id, round(score, 6) AS score FROM lex WHERE score > 0.3",
    "entry_points": f"WITH {_ENTRY} SELECT uid, id, round(weight, 6) AS weight FROM entry",
    "ppr": f"WITH {_PPR} SELECT uid, id, round(score, 6) AS score FROM s2",
    "topm_per_type": f"WITH {_PPR} SELECT uid, id, type, rank::INT AS rank FROM top",
    "induced_subgraph": f"WITH {_PPR} SELECT uid, src, dst, label FROM eve",
    "reasoning_hits": f"WITH {_ALIGN} SELECT uid, id, hits::BIGINT AS hits, p_reason FROM prs",
    "gnn_features": f"WITH {_FINAL} SELECT id, [(coalesce(type, '') = 'T')::DOUBLE, (coalesce(type, '') = 'S')::DOUBLE, (coalesce(type, '') = 'N')::DOUBLE, (coalesce(type, '') = 'R')::DOUBLE, (coalesce(type, '') = 'H')::DOUBLE, (coalesce(type, '') = 'O')::DOUBLE, 0.0::DOUBLE] AS x FROM fnodes",
    "align": f"WITH {_ALIGN} SELECT uid, id, p_reason FROM prs JOIN keep USING (uid, id)",
    "textualize": f"WITH {_LINES} SELECT uid, graph_text FROM gt",
    "prompt": f"WITH {_LINES} SELECT uid, 'Answer the question from the evidence graph alone.' || chr(10) || chr(10) || 'Evidence:' || chr(10) || graph_text || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM gt JOIN qs USING (uid)",
    "reasoning_prompt": f"WITH {_PPR}, cx AS (SELECT uid, string_agg(text, chr(10) ORDER BY id, text) AS context FROM ev WHERE coalesce(text, '') <> '' GROUP BY uid) SELECT uid, 'Question: ' || question || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Reason step by step from the context.' AS prompt FROM cx JOIN qs USING (uid)",
    "qa_load": """WITH m AS (SELECT id, any_value(question) AS question, any_value(answer) AS answer, any_value(answer_aliases) AS al, any_value(paragraphs) AS ps FROM musique WHERE id IS NOT NULL AND coalesce(answerable, true) GROUP BY id)
SELECT id, question, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([answer], coalesce(al, [])), lambda x: trim(x)), lambda x: coalesce(x, '') <> ''))), '|') AS answers,
    array_to_string(list_filter(list_transform(coalesce(ps, []), lambda p: trim(p.paragraph_text)), lambda x: coalesce(x, '') <> ''), ' ') AS context FROM m""",
    "normalize_answer": f"SELECT DISTINCT id, {_normal('answer')} AS normal FROM eval_dump WHERE answer IS NOT NULL",
    "qa_f1": f"WITH {_PAIRS} SELECT DISTINCT uid, gold, f1, precision, recall FROM sc",
    "qa_exact": f"WITH {_PAIRS} SELECT DISTINCT uid, gold, exact_match FROM sc",
    "qa_substring": f"WITH {_PAIRS} SELECT DISTINCT uid, gold, accuracy FROM sc",
    "qa_best": f"WITH {_PAIRS} SELECT * FROM bst",
    "qa_summary": f"WITH {_PAIRS} SELECT count(*) AS questions, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(exact_match), 6) AS exact_match, round(avg(accuracy), 6) AS accuracy FROM bst",
    "qa_samples": "SELECT id, any_value(question) AS question FROM musique WHERE id IS NOT NULL AND coalesce(answerable, true) GROUP BY id ORDER BY id LIMIT 50",
    "qa_bleu": f"""WITH {_PAIRS}, bt AS (SELECT DISTINCT uid, gold, {_words("prediction")} AS a, {_words("gold")} AS r FROM pairs),
gr AS (SELECT uid, gold, n, list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], chr(1))) AS ga, list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1))) AS gr FROM bt, range(1, 5) t(n)),
hit AS (SELECT uid, gold, n, greatest(len(ga), 1) AS total, coalesce(list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gr, lambda x: x = g))))), 0) AS h FROM gr),
pn AS (SELECT uid, gold, max(CASE WHEN n = 1 THEN h END) AS h1, max(CASE WHEN n = 1 THEN h / total END) AS p1, avg(ln(CASE WHEN h > 0 THEN h / total ELSE 2.2250738585072014e-308 END)) AS raw, avg(ln(CASE WHEN h > 0 THEN h / total ELSE 0.1 / total END)) AS smooth FROM hit GROUP BY uid, gold),
bp AS (SELECT uid, gold, CASE WHEN len(a) = 0 THEN 0 WHEN len(a) > len(r) THEN 1 ELSE exp(1 - len(r) / len(a)) END::DOUBLE AS bp FROM bt)
SELECT uid, gold, CASE WHEN h1 > 0 THEN round(bp * p1, 6) ELSE 0 END AS bleu_1, CASE WHEN h1 > 0 THEN round(bp * exp(raw), 6) ELSE 0 END AS bleu_4, CASE WHEN h1 > 0 THEN round(bp * p1, 6) ELSE 0 END AS bleu_1_smooth, CASE WHEN h1 > 0 THEN round(bp * exp(smooth), 6) ELSE 0 END AS bleu_4_smooth FROM pn JOIN bp USING (uid, gold)""",
    "answer_words": f"SELECT DISTINCT id, len({_words('answer')})::INT AS n FROM eval_dump WHERE answer IS NOT NULL",
}
