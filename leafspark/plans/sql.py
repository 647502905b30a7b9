"""DuckDB statements that define the same results on the same tables."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
HEADER = r"(?s)^(#{1,6})" + WS + r"+(.+)\z"
BOLD = r"(?s)^" + WS + r"*\*\*(.+?)\*\*" + WS + r"*\z"
LIST_LINE = "^" + WS + r"*[-*+]" + WS + r"+|\^" + WS + r"*\d+\." + WS + "+"
LIST_START = "^" + WS + r"*(?:[-*]|\d+\.)" + WS + "+"
HEADS = "h1, h2, h3, h4, h5, h6"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+\\z', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def tokens(c: str) -> str:
    return f"CAST(floor(coalesce(len({words(c)}), 0) * 1.3::DOUBLE) AS INTEGER)"


def lines(table: str = "documents") -> str:
    return f"lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {table} WHERE text IS NOT NULL)"


def headers(table: str = "documents") -> str:
    return f"""{lines(table)}, heads AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '{HEADER}') THEN CAST(length(regexp_extract(line, '{HEADER}', 1)) AS INTEGER) END AS level,
CASE WHEN regexp_matches(line, '{HEADER}') THEN {strip(f"regexp_extract(line, '{HEADER}', 2)")} END AS header FROM lines)"""


def cascade() -> str:
    to_here = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    h = ", ".join(f"CASE WHEN max(CASE WHEN level = {k} THEN line_no END) {to_here} > coalesce(max(CASE WHEN level < {k} THEN line_no END) {to_here}, -1) THEN last_value(CASE WHEN level = {k} THEN header END IGNORE NULLS) {to_here} END AS h{k}" for k in range(1, 7))
    return f"casc AS (SELECT *, {h} FROM heads)"


def split(table: str = "documents", levels: str = "1, 2, 3, 4, 5, 6") -> str:
    last = ", ".join(f"last(h{k} ORDER BY line_no) AS h{k}" for k in range(1, 7))
    return f"""{headers(table)}, {cascade()},
prev AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM casc),
pos AS (SELECT *, CAST(sum(CASE WHEN level IN ({levels}) AND level <= previous THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS original_position FROM prev),
whole AS (SELECT doc_id, original_position, string_agg(line, chr(10) ORDER BY line_no) AS content, {last} FROM pos GROUP BY doc_id, original_position),
split AS (SELECT doc_id, substr(sha256(content || CAST(original_position AS VARCHAR)), 1, 8) AS chunk_id, content, {HEADS}, original_position, {tokens("content")} AS token_count FROM whole WHERE {strip("content")} <> '')"""


def titles() -> str:
    to_here = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bare = strip("line")
    return f"""{lines()}, f AS (SELECT *, sum(CASE WHEN starts_with({bare}, '```') THEN 1 ELSE 0 END) {to_here} AS fences, {bare} = '' AS blank,
CASE WHEN starts_with({bare}, '#') THEN length(regexp_extract({bare}, '^(#+)', 1)) END AS hashes, CASE WHEN regexp_matches(line, '{BOLD}') THEN regexp_extract(line, '{BOLD}', 1) END AS b FROM lines),
g AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS pb, coalesce(lead(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS nb,
last_value(hashes IGNORE NULLS) {before} AS raw_level, regexp_replace(b, '[^\\p{{L}}]', '', 'g') AS letters, {words("b")} AS ws FROM f),
t AS (SELECT *, coalesce(b IS NOT NULL AND length(b) <= 80 AND fences % 2 = 0 AND NOT regexp_matches(line, '{LIST_LINE}') AND NOT contains(line, '|') AND pb AND nb AND regexp_matches(letters, '^\\p{{Lu}}')
AND (len(ws) = 1 OR (len(ws) > 1 AND len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len(ws) >= 0.5) OR length(regexp_replace(letters, '[^\\p{{Lu}}]', '', 'g')) / length(letters) >= 0.1), false) AS is_title FROM g),
n AS (SELECT *, coalesce(sum(CASE WHEN is_title THEN 1 ELSE 0 END) {before}, 0) AS nth FROM t),
titles AS (SELECT doc_id, line_no, line, CASE WHEN is_title THEN b END AS title, CASE WHEN is_title THEN CAST(CASE WHEN raw_level IS NOT NULL THEN least(raw_level + 1, 3) WHEN nth % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) END AS level FROM n),
prep AS (SELECT doc_id, string_agg(coalesce(repeat('#', level) || ' ' || title, line), chr(10) ORDER BY line_no) AS text FROM titles GROUP BY doc_id)"""


def items() -> str:
    return f"""il AS (SELECT doc_id, chunk_id, original_position, generate_subscripts(string_split(content, chr(10)), 1) AS n, unnest(string_split(content, chr(10))) AS line FROM split),
ix AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{LIST_START}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chunk_id, original_position ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS idx FROM il),
ig AS (SELECT doc_id, chunk_id, original_position, CAST(idx AS INTEGER) AS idx, string_agg(line, chr(10) ORDER BY n) AS item, regexp_extract(first(line ORDER BY n), '^([ \\t]*)', 1) AS lead FROM ix WHERE idx >= 0 GROUP BY ALL),
items AS (SELECT doc_id, chunk_id, original_position, idx, item, CAST(floor(length(replace(lead, chr(9), '    ')) / 2) AS INTEGER) AS dep, {tokens("item")} AS t FROM ig)"""


def paras() -> str:
    return f"""pl AS (SELECT doc_id, chunk_id, original_position, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS n, unnest(string_split(content, chr(10) || chr(10))) AS item FROM split),
paras AS (SELECT doc_id, chunk_id, original_position, CAST(row_number() OVER (PARTITION BY doc_id, original_position ORDER BY n) - 1 AS INTEGER) AS idx, item, 0 AS dep, {tokens("item")} AS t FROM pl WHERE {strip("item")} <> '')"""


def fold(name: str, source: str, limit: int, sep: str, by_depth: bool = False) -> str:
    alone = "false" if by_depth else f"x.t > {limit}"
    new = f"x.dep = 0 AND a.o AND a.s + x.t > {limit}" if by_depth else f"a.s + x.t > {limit}"
    return f"""{name}_f AS (SELECT doc_id, original_position, -1 AS idx, 0 AS s, 0 AS g, false AS o, -1 AS mine FROM {source} GROUP BY doc_id, original_position
UNION ALL SELECT x.doc_id, x.original_position, x.idx, CASE WHEN {alone} THEN 0 WHEN {new} THEN x.t ELSE a.s + x.t END, CASE WHEN {alone} THEN a.g + (CASE WHEN a.o THEN 2 ELSE 1 END) WHEN {new} THEN a.g + (CASE WHEN a.o THEN 1 ELSE 0 END) ELSE a.g END, NOT ({alone}),
CASE WHEN {alone} OR ({new}) THEN a.g + (CASE WHEN a.o THEN 1 ELSE 0 END) ELSE a.g END FROM {name}_f a JOIN {source} x ON x.doc_id = a.doc_id AND x.original_position = a.original_position AND x.idx = a.idx + 1),
{name} AS (SELECT doc_id, original_position, f.mine AS piece, string_agg(x.item, {sep} ORDER BY idx) AS content FROM {name}_f f JOIN {source} x USING (doc_id, original_position, idx) GROUP BY doc_id, original_position, f.mine)"""


def elements() -> str:
    to_here = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    title = f"CASE WHEN kind = 'Title' THEN {strip(f"regexp_extract(top, '{HEADER}', 2)")} ELSE raw END"
    return f"""{lines()}, f AS (SELECT *, {strip("line")} AS bare, starts_with({strip("line")}, '```') AS fence, sum(CASE WHEN starts_with({strip("line")}, '```') THEN 1 ELSE 0 END) {to_here} AS fences FROM lines),
k AS (SELECT *, CASE WHEN fences % 2 = 1 OR fence THEN 'CodeSnippet' WHEN bare = '' THEN '' WHEN regexp_matches(line, '{HEADER}') THEN 'Title' WHEN regexp_matches(line, '{LIST_START}') THEN 'ListItem' WHEN starts_with(bare, '|') THEN 'Table' ELSE 'NarrativeText' END AS kind FROM f),
l AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM k),
b AS (SELECT *, sum(CASE WHEN (kind = was AND kind IN ('NarrativeText', 'Table')) OR (kind = 'CodeSnippet' AND NOT (fence AND fences % 2 = 1)) OR (kind = 'NarrativeText' AND was = 'ListItem') THEN 0 ELSE 1 END) {to_here} AS block FROM l),
g AS (SELECT doc_id, block, first(kind ORDER BY line_no) AS kind, first(line ORDER BY line_no) AS top, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM b GROUP BY doc_id, block),
t AS (SELECT doc_id, block, kind, CASE WHEN kind = 'Title' THEN CAST(length(regexp_extract(top, '{HEADER}', 1)) AS INTEGER) END AS level, {title} AS content FROM g WHERE kind <> ''),
heads AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS line_no, CASE WHEN kind = 'Title' THEN content END AS header FROM t WHERE {strip("content")} <> ''), {cascade()}"""


NL, NN = "chr(10)", "chr(10) || chr(10)"
CHUNKS = f"c AS (SELECT DISTINCT doc_id, chunk_id, content, {HEADS}, original_position, token_count, element_type FROM chunks)"
PAIRS = """q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
SIM = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"


def named(h: str) -> str:
    return f"coalesce(nullif({h}, ''), '(No {h})')"


def statements(limit: int, threshold: float) -> dict[str, str]:
    w = "WITH "
    pairs = f"{PAIRS}, p AS (SELECT a.label AS block, a.vec_id AS i, b.vec_id AS j, {SIM} AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)"
    dups = f"{pairs}, d AS (SELECT * FROM p WHERE sim >= {threshold}), ud AS (SELECT block, i AS x, j AS y FROM d UNION SELECT block, j, i FROM d)"
    groups = f"{dups}, reach(block, x, y) AS (SELECT block, x, x FROM ud UNION SELECT r.block, r.x, u.y FROM reach r JOIN ud u ON r.block = u.block AND r.y = u.x), g AS (SELECT block, min(y) AS group_id, x AS item FROM reach GROUP BY block, x)"
    weight = " + ".join(f"(CASE WHEN item % {k + 1} = 0 THEN {7 - k} ELSE 0 END)" for k in range(1, 7))
    keep = lambda order: f"WITH RECURSIVE {groups} SELECT block, group_id, item, row_number() OVER (PARTITION BY block, group_id ORDER BY {order}) = 1 AS keep FROM g"
    first = f"WITH RECURSIVE {groups}, k AS (SELECT *, row_number() OVER (PARTITION BY block, group_id ORDER BY item) = 1 AS keep FROM g)"
    qsim = "list_inner_product(a.v, CAST(q.v AS DOUBLE[])) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(q.v AS DOUBLE[]))))"
    seq = r"TRY_CAST(nullif(regexp_extract(content, '(?i)(Stage|Step|Phase)\s+(\d+)', 2), '') AS BIGINT)"
    heads_used = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or(h{k} <> '') THEN 'h{k}' END" for k in range(1, 7)) + "], lambda x: x IS NOT NULL), ',')"
    head = lambda k: f"CASE WHEN vec_id % {k + 1} = 0 THEN 'H{k} ' || vec_id % 5 END AS h{k}"
    found = f"""{PAIRS}, z AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, {qsim} AS sim, 'vector ' || vec_id || repeat('.', vec_id % 17) AS content, {", ".join(map(head, range(1, 7)))} FROM e a, q),
f AS (SELECT *, row_number() OVER (ORDER BY sim DESC, chunk_id) AS rank FROM z WHERE sim >= 0.1 ORDER BY rank LIMIT 5)"""
    after = f"{w}{titles()}, {split('prep').replace('lines AS (', 'lines2 AS (', 1).replace('FROM lines)', 'FROM lines2)')} SELECT * FROM split"
    out = {
        "document_lines": f"{w}{lines()} SELECT doc_id, count(*) AS n_lines, CAST(max(length(line)) AS INTEGER) AS longest FROM lines GROUP BY doc_id",
        "header_lines": f"{w}{headers()} SELECT doc_id, line_no, level, header FROM heads WHERE level IS NOT NULL",
        "header_cascade": f"{w}{headers()}, {cascade()} SELECT doc_id, line_no, {HEADS} FROM casc WHERE level IS NOT NULL",
        "split_chunks": f"{w}{split()} SELECT * FROM split",
        "split_chunks_h1_h3": f"{w}{split(levels='1, 2, 3')} SELECT * FROM split",
        "split_stats": f"{w}{split()} SELECT doc_id, count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, max(token_count) AS max_chunk_tokens, {heads_used} AS headers_used FROM split GROUP BY doc_id",
        "blank_documents": f"SELECT doc_id, CASE WHEN text IS NULL THEN 'null text' ELSE 'blank text' END AS reason FROM documents WHERE text IS NULL OR {strip('text')} = ''",
        "header_path": f"{w}{split()} SELECT doc_id, original_position, concat_ws(' > ', {HEADS}) AS path FROM split",
        "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
        "chunk_id_hash": "SELECT doc_id, substr(sha256(text || '0'), 1, 8) AS chunk_id FROM documents",
        "text_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS short_hash, sha256(text) AS full_hash FROM documents",
        "bold_titles": f"{w}{titles()} SELECT doc_id, line_no, title, level FROM titles WHERE title IS NOT NULL",
        "preprocess_text": f"{w}{titles()} SELECT doc_id, text FROM prep",
        "preprocess_then_split": after,
        "list_items": f"{w}{split()}, {items()} SELECT doc_id, original_position, idx, item, dep AS depth, CASE WHEN dep > 0 THEN (SELECT max(b.idx) FROM items b WHERE b.doc_id = a.doc_id AND b.original_position = a.original_position AND b.idx < a.idx AND b.dep = a.dep - 1) END AS parent_idx, t AS tokens FROM items a",
        "pack_paragraphs": f"WITH RECURSIVE {split()}, {paras()}, {fold('r', 'paras', limit, NN)} SELECT * FROM r",
        "pack_list_items": f"WITH RECURSIVE {split()}, {items()}, {fold('r', 'items', limit, NL)} SELECT * FROM r",
        "pack_by_depth": f"WITH RECURSIVE {split()}, {items()}, {fold('r', 'items', limit, NL, True)} SELECT * FROM r",
        "split_oversized": f"""WITH RECURSIVE {split()}, {items()}, {paras()}, {fold('dp', 'items', limit, NL, True)}, {fold('fl', 'items', limit, NL)}, {fold('pa', 'paras', limit, NN)},
k AS (SELECT s.*, (SELECT count(*) FROM items i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS n_items, (SELECT max(dep) FROM items i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS deepest,
(SELECT count(*) FROM items i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position AND dep = 0) AS n_top, (SELECT count(*) FROM paras i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS n_paras,
(SELECT count(*) FROM dp i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS n_dp, (SELECT count(*) FROM fl i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS n_fl, (SELECT count(*) FROM pa i WHERE i.doc_id = s.doc_id AND i.original_position = s.original_position) AS n_pa FROM split s),
z AS (SELECT *, CASE WHEN token_count <= {limit} THEN 'keep' WHEN n_items >= 5 AND deepest > 0 AND n_top >= 2 AND n_dp > 1 THEN 'depth' WHEN n_items >= 5 AND n_fl > 1 THEN 'list' WHEN n_items >= 5 THEN 'keep' WHEN n_paras >= 3 AND n_pa > 1 THEN 'paragraph' ELSE 'keep' END AS strategy FROM k),
u AS (SELECT z.doc_id, chunk_id || '-d' || piece AS chunk_id, dp.content, {HEADS}, z.original_position, piece AS sub_index, {tokens('dp.content')} AS token_count, strategy FROM z JOIN dp ON z.doc_id = dp.doc_id AND z.original_position = dp.original_position WHERE strategy = 'depth'
UNION ALL SELECT z.doc_id, chunk_id || '-' || piece, fl.content, {HEADS}, z.original_position, piece, {tokens('fl.content')}, strategy FROM z JOIN fl ON z.doc_id = fl.doc_id AND z.original_position = fl.original_position WHERE strategy = 'list'
UNION ALL SELECT z.doc_id, chunk_id || '-' || piece, pa.content, {HEADS}, z.original_position, piece, {tokens('pa.content')}, strategy FROM z JOIN pa ON z.doc_id = pa.doc_id AND z.original_position = pa.original_position WHERE strategy = 'paragraph'
UNION ALL SELECT doc_id, chunk_id, content, {HEADS}, original_position, NULL, token_count, strategy FROM z WHERE strategy = 'keep') SELECT * FROM u""",
        "sequence_numbers": f"{w}{CHUNKS} SELECT doc_id, chunk_id, {seq} AS sequence_number FROM c",
        "element_rules": f"{w}{CHUNKS} SELECT doc_id, chunk_id, CAST(CASE WHEN length(regexp_extract(content, '^(#*)', 1)) BETWEEN 1 AND 6 THEN length(regexp_extract(content, '^(#*)', 1)) ELSE 1 END AS INTEGER) AS header_level, starts_with({strip('content')}, '```') AS is_code, CASE WHEN {seq} IS NOT NULL THEN 'procedure_step' WHEN starts_with(content, '#') THEN 'title' WHEN starts_with(content, '```') THEN 'code_snippet' WHEN starts_with(content, '- ') THEN 'list_item' ELSE 'narrative_text' END AS element_type FROM c",
        "element_parse": f"""{w}{elements()} SELECT doc_id, substr(sha256(content || line_no), 1, 8) AS chunk_id, content, {HEADS}, line_no AS original_position, {tokens("content")} AS token_count, CAST(coalesce(level - 1, 0) AS INTEGER) AS depth_level, {seq} AS sequence_number, starts_with({strip("content")}, '```') OR kind = 'CodeSnippet' AS is_inside_code_block,
CASE WHEN {seq} IS NOT NULL THEN 'procedure_step' WHEN kind = 'Title' THEN 'title' WHEN kind = 'ListItem' THEN 'list_item' WHEN kind = 'CodeSnippet' THEN 'code_snippet' ELSE 'narrative_text' END AS element_type FROM casc""",
        "cosine_pairs": f"{w}{pairs} SELECT block, i, j, round(sim, 6) AS sim FROM p",
        "batch_cosine": f"{w}{PAIRS} SELECT vec_id, round({qsim}, 6) AS sim FROM e a, q",
        "cosine_normalized": f"{w}{PAIRS} SELECT vec_id, round(list_inner_product(a.v, CAST(q.v AS DOUBLE[])), 6) AS sim FROM e a, q",
        "vector_norms": f"{w}{PAIRS}, u AS (SELECT vec_id, sqrt(list_inner_product(v, v)) AS n, list_transform(v, lambda x: CAST(x / sqrt(list_inner_product(v, v)) AS DOUBLE)) AS u FROM e) SELECT vec_id, round(n, 5) AS norm, round(sqrt(list_inner_product(u, u)), 5) AS unit_norm FROM u",
        "vector_bytes": f"{w}{PAIRS} SELECT vec_id, CAST(4 * len(v) AS INTEGER) AS n_bytes, round(list_sum(v), 6) AS total, round(list_inner_product(v, CAST(range(1, len(v) + 1) AS DOUBLE[])), 6) AS weighted FROM e",
        "search_topk": f"{w}{PAIRS}, s AS (SELECT vec_id, {qsim} AS sim FROM e a, q) SELECT CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.1 ORDER BY rank LIMIT 10",
        "search_topk_per_label": f"{w}{PAIRS}, s AS (SELECT vec_id, label, {qsim} AS sim FROM e a, q), r AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, round(sim, 6) AS sim FROM s) SELECT * FROM r WHERE rank <= 3",
        "dup_pairs": f"{w}{dups} SELECT block, i, j, round(sim, 6) AS sim FROM d",
        "dup_groups": f"WITH RECURSIVE {groups} SELECT * FROM g",
        "dedup_first": keep("item"),
        "dedup_longest": keep("7 + length(CAST(item AS VARCHAR)) + item % 17 DESC, item"),
        "dedup_best_metadata": keep(f"{weight} DESC, item"),
        "deduplicated": f"{first} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT item FROM k WHERE NOT keep)",
        "dedup_report": f"{first}, n AS (SELECT label AS block, count(*) AS original_count FROM embeddings GROUP BY label), r AS (SELECT block, sum(CASE WHEN keep THEN 0 ELSE 1 END) AS removed, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS groups FROM k GROUP BY block) SELECT block, original_count, CAST(original_count - coalesce(removed, 0) AS BIGINT) AS deduplicated_count, CAST(coalesce(removed, 0) AS BIGINT) AS removed_count, CAST(coalesce(groups, 0) AS BIGINT) AS n_groups, round(coalesce(removed, 0) / original_count * 100, 6) AS reduction_percentage FROM n LEFT JOIN r USING (block)",
        "dedup_exact_documents": "SELECT sha256(text) AS text_hash, min(doc_id) AS keep_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
        "similarity_matrix": f"{w}{pairs} SELECT block, i, j, round(sim, 6) AS sim FROM p UNION ALL SELECT block, j, i, round(sim, 6) FROM p",
        "adjacent_similarity": f"{w}{PAIRS}, o AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e) SELECT label AS block, count(*) AS n, round(coalesce(avg(CASE WHEN u IS NOT NULL THEN list_inner_product(u, v) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))) END), 1.0), 6) AS avg_adjacent FROM o GROUP BY label",
        "reconstruct_markdown": f"{w}{split()}, o AS (SELECT doc_id, {strip('content')} AS body, original_position, row_number() OVER (PARTITION BY doc_id ORDER BY original_position) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM split), t AS (SELECT doc_id, string_agg('<!-- Original position: ' || original_position || ', Reordered position: ' || place || ' -->' || chr(10) || chr(10) || body || (CASE WHEN place < n - 1 THEN chr(10) ELSE '' END), chr(10) ORDER BY place) AS t FROM o GROUP BY doc_id) SELECT doc_id, t || chr(10) AS text FROM t",
        "section_sizes": f"{w}{split()} SELECT doc_id, {named('h1')} AS s1, {named('h2')} AS s2, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(original_position) AS first_position, sum(token_count) > 200 AS oversized FROM split GROUP BY ALL",
        "largest_sections": f"{w}{split()} SELECT doc_id, {named('h1')} AS s1, {named('h2')} AS s2, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM split GROUP BY ALL ORDER BY tokens DESC, doc_id, s1, s2 LIMIT 10",
        "section_pack_h3": f"""WITH RECURSIVE {split()}, h AS (SELECT doc_id, {named('h1')} AS s1, {named('h2')} AS s2, {named('h3')} AS s3, CAST(sum(token_count) AS INTEGER) AS t, min(original_position) AS p FROM split GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s1, s2 ORDER BY p, s3) AS k FROM h),
f AS (SELECT doc_id, s1, s2, s3, k, t, t AS acc, 0 AS sub FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.s1, o.s2, o.s3, o.k, o.t, CASE WHEN f.acc + o.t > 150 THEN o.t ELSE f.acc + o.t END, CASE WHEN f.acc + o.t > 150 THEN f.sub + 1 ELSE f.sub END FROM f JOIN o ON o.doc_id = f.doc_id AND o.s1 = f.s1 AND o.s2 = f.s2 AND o.k = f.k + 1)
SELECT doc_id, s1, s2, s3 AS h3, CAST(sub AS INTEGER) AS subsection, t AS tokens FROM f""",
        "section_rollup": f"{w}{CHUNKS} SELECT {named('h1')} AS s1, {named('h2')} AS s2, count(*) AS n_chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM c GROUP BY ROLLUP ({named('h1')}, {named('h2')})",
        "type_histogram": f"{w}{CHUNKS} SELECT coalesce(lower(element_type), 'None') AS element_type, count(*) AS n FROM c GROUP BY ALL",
        "distinct_headers": f"{w}{CHUNKS} SELECT 1 AS level, h1 AS header FROM c WHERE h1 <> '' UNION SELECT 2, h2 FROM c WHERE h2 <> '' UNION SELECT 3, h3 FROM c WHERE h3 <> ''",
        "token_statistics": f"{w}{CHUNKS} SELECT round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM c",
        "oversized_chunks": f"{w}{CHUNKS} SELECT doc_id, chunk_id, token_count FROM c WHERE token_count > 200",
        "chunks_by_h1": f"{w}{CHUNKS} SELECT {named('h1')} AS s1, count(*) AS n_chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, count(DISTINCT h2) AS n_h2 FROM c GROUP BY ALL ORDER BY n_chunks DESC, s1 LIMIT 5",
        "chunks_by_h2": f"{w}{CHUNKS} SELECT {named('h1')} AS s1, {named('h2')} AS s2, count(*) AS n_chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM c GROUP BY ALL ORDER BY n_chunks DESC, s1, s2 LIMIT 10",
        "embed_cache_misses": f"{w}{CHUNKS} SELECT DISTINCT 'mdembed-base' AS model, substr(sha256(content), 1, 16) AS text_hash FROM c WHERE content IS NOT NULL AND substr(sha256(content), 1, 16) NOT IN (SELECT text_hash FROM emb_cache WHERE model = 'mdembed-base' AND text_hash IS NOT NULL)",
        "embed_cache_stats": f"{w}{CHUNKS}, a AS (SELECT substr(sha256(content), 1, 16) AS h, count(*) AS n FROM c WHERE content IS NOT NULL GROUP BY ALL), s AS (SELECT CAST(sum(n) AS BIGINT) AS requests, CAST(sum(CASE WHEN h IN (SELECT text_hash FROM emb_cache WHERE model = 'mdembed-base' AND text_hash IS NOT NULL) THEN 0 ELSE 1 END) AS BIGINT) AS misses FROM a) SELECT requests, requests - misses AS hits, misses, round((requests - misses) / requests, 6) AS hit_rate FROM s",
        "attach_embeddings": f"{w}{CHUNKS}, v AS (SELECT doc_id, chunk_id, max(embedding) AS v FROM chunks WHERE embedding IS NOT NULL GROUP BY ALL) SELECT c.doc_id, c.chunk_id, CAST(coalesce(len(v), -1) AS INTEGER) AS n, round(CASE WHEN v IS NOT NULL THEN coalesce(list_sum(list_transform(list_filter(v, lambda x: x IS NOT NULL AND NOT isnan(x)), lambda x: CAST(x AS DOUBLE))), 0.0) END, 4) AS total FROM c LEFT JOIN v ON c.doc_id = v.doc_id AND c.chunk_id = v.chunk_id",
        "chunk_dict_round_trip": f"SELECT DISTINCT doc_id, chunk_id, content, {HEADS}, original_position, token_count, parent_id, depth_level, sequence_number, is_inside_code_block, element_type FROM chunks",
        "search_json": f"""{w}{found} SELECT '{{"count":' || count(*) || ',"results":[' || string_agg('{{"chunk_id":"' || chunk_id || '","similarity":' || round(sim, 4) || ',"content":"' || content || '","metadata":{{' || array_to_string(list_filter([{", ".join(f"""'"h{k}":"' || h{k} || '"'""" for k in range(1, 7))}, '"original_position":' || chunk_id], lambda x: x IS NOT NULL), ',') || '}}}}', ',' ORDER BY rank) || ']}}' AS json FROM f""",
        "search_text": f"""{w}{found}, t AS (SELECT rank, '[' || rank || '] Similarity: ' || printf('%.3f', sim) || chr(10) || array_to_string(list_filter([{", ".join(f"'h{k}: ' || h{k}" for k in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS head, content FROM f)
SELECT 'Found ' || count(*) || ' result(s):' || chr(10) || chr(10) || string_agg(head || CASE WHEN ends_with(head, chr(10)) THEN '' ELSE chr(10) END || content || chr(10), chr(10) ORDER BY rank) AS text FROM t""",
        "section_reconstruct": f"""{w}{split()}, o AS (SELECT doc_id, h1, h2, {strip("content")} AS body, row_number() OVER k AS place, lag(h1) OVER k AS p1, lag(h2) OVER k AS p2 FROM split WINDOW k AS (PARTITION BY doc_id ORDER BY h1 NULLS FIRST, h2 NULLS FIRST, original_position, chunk_id)),
r AS (SELECT doc_id, place, array_to_string(list_filter([CASE WHEN h1 IS NOT NULL AND (place = 1 OR h1 IS DISTINCT FROM p1) THEN '# ' || h1 END, CASE WHEN h2 IS NOT NULL AND (place = 1 OR h1 IS DISTINCT FROM p1 OR h2 IS DISTINCT FROM p2) THEN '## ' || h2 END, CASE WHEN NOT starts_with(body, '#') AND body <> '' THEN body END], lambda x: x IS NOT NULL), {NN}) AS t,
(h1 IS NOT NULL AND (place = 1 OR h1 IS DISTINCT FROM p1)) OR (h2 IS NOT NULL AND (place = 1 OR h1 IS DISTINCT FROM p1 OR h2 IS DISTINCT FROM p2)) OR (NOT starts_with(body, '#') AND body <> '') AS has FROM o)
SELECT doc_id, coalesce(string_agg(t, {NN} ORDER BY place) FILTER (WHERE has), '') || chr(10) AS text FROM r GROUP BY doc_id""",
        "validate_preprocess": f"""{w}a AS (SELECT sha256(content) AS h, count(*) AS n, sum(token_count) AS t FROM ({w}{split()} SELECT * FROM split) GROUP BY h),
b AS (SELECT sha256(content) AS h, count(*) AS n, sum(token_count) AS t FROM ({after}) GROUP BY h)
SELECT CAST(coalesce(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)), 0) AS BIGINT) AS lost, CAST(coalesce(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)), 0) AS BIGINT) AS added, CAST(coalesce(sum(a.t), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(b.t), 0) AS BIGINT) AS tokens_after FROM a FULL JOIN b ON a.h = b.h""",
        "cluster_reorder": f"""WITH RECURSIVE {PAIRS}, k AS (SELECT label AS block, CASE WHEN count(*) <= 5 THEN least(count(*), 3) WHEN count(*) <= 20 THEN least(count(*) // 3, 5) ELSE least(count(*) // 5, 7) END AS k FROM e GROUP BY label),
d AS (SELECT a.label AS block, a.vec_id AS i, b.vec_id AS j, greatest(0.0, least(2.0, 1 - {SIM})) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT label AS block, vec_id AS item, vec_id AS c, 0 AS step FROM e UNION ALL
SELECT r.block, r.item, CASE WHEN r.c = m.c2 THEN m.c1 ELSE r.c END, r.step + 1 FROM r JOIN k ON k.block = r.block JOIN (SELECT block, count(DISTINCT c) AS n FROM r GROUP BY block) z ON z.block = r.block
JOIN (SELECT block, c1, c2 FROM (SELECT a.block, a.c AS c1, b.c AS c2, row_number() OVER (PARTITION BY a.block ORDER BY avg(d.d), a.c, b.c) AS q FROM r a JOIN r b ON a.block = b.block AND a.c < b.c JOIN d ON d.block = a.block AND d.i = a.item AND d.j = b.item GROUP BY a.block, a.c, b.c) WHERE q = 1) m ON m.block = r.block WHERE z.n > k.k),
f AS (SELECT * FROM r QUALIFY step = max(step) OVER (PARTITION BY block))
SELECT block, item, CAST(row_number() OVER (PARTITION BY block ORDER BY c, item) - 1 AS INTEGER) AS new_position FROM f""",
        "sequential_reorder": f"""WITH RECURSIVE {PAIRS}, s AS (SELECT label AS block, min(vec_id) AS item FROM e GROUP BY label), r AS (SELECT block, item, 0 AS new_position, [item] AS seen FROM s
UNION ALL SELECT block, item, new_position, list_append(seen, item) FROM (SELECT r.block, b.vec_id AS item, r.new_position + 1 AS new_position, r.seen, row_number() OVER (PARTITION BY r.block ORDER BY {SIM} DESC, b.vec_id) AS k FROM r JOIN e a ON a.vec_id = r.item JOIN e b ON b.label = r.block WHERE NOT list_contains(r.seen, b.vec_id)) WHERE k = 1)
SELECT block, item, CAST(new_position AS INTEGER) AS new_position FROM r""",
    }
    return out
