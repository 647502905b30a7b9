"""The queries pN_... of the training-data operators, over whole tables and whole texts, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import clusters, groups, leakage, markup, mixing, neighbours, pages, pieces, repetition, survivors, toxicity
from leafspark.session import cut

#: File of the public tokenizer that the queries in its tokens use.
TOKENIZER = os.environ.get("LEAFSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(_t(spark, d, "match_pairs"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_sizes(_t(spark, d, "match_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(_t(spark, d, "chunks"), repetition.language_references(_t(spark, d, "documents")))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(_t(spark, d, "chunks"), repetition.language_references(_t(spark, d, "documents")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.mutual_members(clusters.density_clusters(_t(spark, d, "chunks")))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described_clusters(_t(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.nearest(_t(spark, d, "emb_cache"), "text_hash", "vector", "model", k=5, least=0.85)
    return n.select(F.col("collection").alias("model"), F.col("id").alias("text_hash"), F.col("neighbour").alias("neighbour_hash"))


def p4_chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the chunks of documents whose id is divisible by 50, against all chunks."""
    n = neighbours.nearest(_t(spark, d, "chunks"), "chunk_id", "embedding", k=5, is_query=F.expr("doc_id % 50 = 0"), probes=neighbours.WIDE_SHARE)
    return n.select(F.col("id").alias("chunk_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(_t(spark, d, "chunks"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.converted(_t(spark, d, "chunks"))


def p5_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the lines that they share with the nearest title of their repository, as pages of a host by path."""
    return pages.differenced(_t(spark, d, "documents"), "repo", "title")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_t(spark, d, "chunks")).select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_t(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.winners(_t(spark, d, "dup_groups"), _t(spark, d, "chunks"))


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_t(spark, d, "dup_groups"), _t(spark, d, "chunks"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.rates(mixing.with_tokens(_t(spark, d, "documents")), _t(spark, d, "mix_targets")).where("not feasible").select("mix_id", "source")


def _sized(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens counted once, for the several uses of a mix."""
    return cut(mixing.with_tokens(_t(spark, d, "documents"), tokenizer))


def p9_shares(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    sized = _sized(spark, d, tokenizer)
    return mixing.reached(sized, cut(mixing.rates(sized, _t(spark, d, "mix_targets"))))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of every mix, once a copy."""
    sized = _sized(spark, d)
    return mixing.emit(sized, cut(mixing.rates(sized, _t(spark, d, "mix_targets"))))


def p9_tokenizer_shares(spark: SparkSession, d: str) -> DataFrame:
    """As p9_shares, in tokens of a public tokenizer."""
    return p9_shares(spark, d, TOKENIZER)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(toxicity.scores(_t(spark, d, "documents"), _t(spark, d, "labels")))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(_t(spark, d, "documents"), toxicity.scores(_t(spark, d, "documents"), _t(spark, d, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; those in tokens of a public tokenizer only where its file is."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and ("tokenizer" not in k or os.path.exists(TOKENIZER))}


_LINKS = r"""links AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (
  SELECT nullif(lower(regexp_replace(chunk_a, '^\s+|\s+$', '', 'g')), '') AS a, nullif(lower(regexp_replace(chunk_b, '^\s+|\s+$', '', 'g')), '') AS b, sim FROM match_pairs)
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND NOT isnan(sim) AND sim >= 0.85)"""
_WORDS = "CAST(floor(13 * len(list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+'), lambda w: w <> '')) / 10) AS BIGINT)"

_GROUPS = f"""WITH RECURSIVE {_LINKS}, both_ways AS (SELECT u AS x, v AS y FROM links UNION SELECT v, u FROM links),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
g AS (SELECT x, min(y) AS r FROM reach GROUP BY x)"""
_SIZED = f"""sized AS (SELECT doc_id, lower(trim(source)) AS source, coalesce({_WORDS.format("text")}, 0) AS tokens FROM documents),
per AS (SELECT source, sum(tokens) AS available FROM sized WHERE source IS NOT NULL GROUP BY source),
whole AS (SELECT sum(tokens) AS total FROM sized)"""


def _winners_sql() -> str:
    """CTEs up to r: every member's place for every field of its group."""
    trimmed = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    filled = lambda c: f"length({trimmed.format(c)}) > 0"
    return f"""m0 AS (SELECT group_id, chunk_id, max(CASE WHEN NOT isnan(trust) THEN trust END) AS trust FROM dup_groups GROUP BY ALL),
m AS (SELECT * FROM m0 WHERE group_id IN (SELECT group_id FROM m0 GROUP BY group_id HAVING count(*) >= 2)),
c AS (SELECT chunk_id, max(length({trimmed.format("content")})) AS n, min(original_position) AS p, max(CASE WHEN {filled("h1")} THEN 1 END) AS h1, max(CASE WHEN {filled("h2")} THEN 1 END) AS h2, max(CASE WHEN {filled("h3")} THEN 1 END) AS h3, max(CASE WHEN {filled("element_type")} THEN 1 END) AS e, max(updated_at) AS updated_at FROM chunks GROUP BY chunk_id),
j AS (SELECT * FROM m JOIN c USING (chunk_id)),
r AS (SELECT group_id, 'content' AS field_name, chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, chunk_id) AS k FROM j WHERE n > 0
UNION ALL SELECT group_id, 'original_position', chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY p, chunk_id) FROM j WHERE p IS NOT NULL
UNION ALL SELECT group_id, 'h1', chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, chunk_id) FROM j WHERE h1 = 1
UNION ALL SELECT group_id, 'h2', chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, chunk_id) FROM j WHERE h2 = 1
UNION ALL SELECT group_id, 'h3', chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, chunk_id) FROM j WHERE h3 = 1
UNION ALL SELECT group_id, 'element_type', chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC NULLS LAST, chunk_id) FROM j WHERE e = 1)"""


_FIELDS = ["content", "original_position", "h1", "h2", "h3", "element_type"]
_USABLE = "len({0}) = {1} AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
_CHUNK_VECTORS = f"e AS (SELECT chunk_id, min(doc_id % 50 = 0) AS q, CAST(min(embedding) AS DOUBLE[]) AS v FROM chunks WHERE {_USABLE.format('embedding', 64)} GROUP BY chunk_id)"
_SIMILAR = f"{_CHUNK_VECTORS}, p AS (SELECT a.chunk_id AS x, b.chunk_id AS y FROM e a JOIN e b ON a.chunk_id <> b.chunk_id AND {_COS} >= 0.85)"
_MUTUAL = f"{_SIMILAR}, n AS (SELECT x, list_sort(list_append(list(y), x)) AS around FROM p GROUP BY x), g AS (SELECT around, count(*) AS k FROM n GROUP BY around HAVING count(*) = len(around))"
_REPEATED = """w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '\\p{L}+') AS w FROM chunks WHERE content IS NOT NULL),
g AS (SELECT chunk_id, len(w) AS n, unnest(range(1, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 6),
f AS (SELECT chunk_id, n, i, list_slice(w, i, i + 5) AS six FROM g),
s AS (SELECT chunk_id, n, i, i > min(i) OVER (PARTITION BY chunk_id, n, six) AS again FROM f),
r AS (SELECT chunk_id, n, count(DISTINCT k) AS repeated FROM (SELECT chunk_id, n, unnest(range(i, i + 6)) AS k FROM s WHERE again) GROUP BY chunk_id, n)"""
_ALNUM = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_LEAKED = f"""i AS (SELECT DISTINCT item_id, {_ALNUM} AS w FROM eval_items WHERE text IS NOT NULL), ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
d AS (SELECT DISTINCT doc_id, {_ALNUM} AS w FROM documents WHERE text IS NOT NULL), dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))"""
_RATES = f"""{_SIZED}, t AS (SELECT DISTINCT mix_id, lower(trim(source)) AS source, target_share, max_repeats, size_ratio FROM mix_targets WHERE source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL AND size_ratio IS NOT NULL),
rates AS (SELECT mix_id, t.source, max_repeats, target_share * size_ratio * total AS wanted, coalesce(available, 0) AS available FROM t CROSS JOIN whole LEFT JOIN per ON per.source = t.source),
rated AS (SELECT *, CASE WHEN available > 0 THEN least(wanted / available, CAST(max_repeats AS DOUBLE)) ELSE 0.0 END AS rate FROM rates),
drawn AS (SELECT mix_id, doc_id, s.source, tokens, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix|' || mix_id || '|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM sized s JOIN rated r ON s.source = r.source)"""


def oracle_sql() -> dict[str, str]:
    value = lambda f: f"max(CASE WHEN field_name = '{f}' THEN {f} END) AS {f}"
    return {
        "p1_found": f"{_GROUPS} SELECT x AS chunk_id, r AS group_id FROM g",
        "p1_group_sizes": f"{_GROUPS} SELECT r AS group_id, CAST(count(*) AS BIGINT) AS n_members, CAST(any_value(n) AS BIGINT) AS n_links FROM g JOIN (SELECT g.r AS k, count(*) AS n FROM links JOIN g ON u = x GROUP BY g.r) ON k = r GROUP BY r",
        "p2_found": f"WITH {_REPEATED} SELECT DISTINCT chunk_id FROM r WHERE 2 * repeated >= n",
        "p3_found": f"WITH {_MUTUAL} SELECT around[1] AS cluster_id, unnest(around) AS chunk_id FROM g",
        "p3_clusters": f"""WITH RECURSIVE {_SIMILAR}, reach(x, y) AS (SELECT x, x FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x), g AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
l AS (SELECT c, CAST(count(*) / 2 AS BIGINT) AS n_links FROM p JOIN g USING (x) GROUP BY c), z AS (SELECT c, CAST(count(*) AS BIGINT) AS size FROM g GROUP BY c),
m AS (SELECT a.c, a.x, round(sum({_COS.replace("a.v", "u.v").replace("b.v", "w.v")}) / count(*), 9) AS mean FROM g a JOIN g b ON a.c = b.c JOIN e u ON u.chunk_id = a.x JOIN e w ON w.chunk_id = b.x GROUP BY a.c, a.x),
t AS (SELECT c, list(x ORDER BY mean DESC, x)[:3] AS typical FROM m GROUP BY c)
SELECT c AS cluster_id, size, n_links, 2 * n_links = size * (size - 1) AS mutual, typical FROM z JOIN l USING (c) JOIN t USING (c)""",
        "p4_found": f"""WITH k AS (SELECT model, len(vector) AS n, count(*) AS c FROM emb_cache WHERE len(vector) > 0 GROUP BY ALL), u AS (SELECT model, n FROM k QUALIFY row_number() OVER (PARTITION BY model ORDER BY c DESC, n DESC) = 1),
e AS (SELECT model, text_hash, CAST(min(vector) AS DOUBLE[]) AS v FROM emb_cache JOIN u USING (model) WHERE {_USABLE.format("vector", "n")} GROUP BY ALL),
p AS (SELECT a.model, a.text_hash, b.text_hash AS neighbour_hash, {_COS} AS s FROM e a JOIN e b ON a.model = b.model AND a.text_hash <> b.text_hash)
SELECT model, text_hash, neighbour_hash FROM p WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY model, text_hash ORDER BY round(s, 12) DESC, neighbour_hash) <= 5""",
        "p4_chunk_neighbours": f"""WITH {_CHUNK_VECTORS}, p AS (SELECT a.chunk_id, b.chunk_id AS neighbour_id, {_COS} AS s FROM e a JOIN e b ON a.q AND a.chunk_id <> b.chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY round(s, 12) DESC, neighbour_id) AS INTEGER) AS rank FROM p) SELECT chunk_id, rank, neighbour_id, round(s, 6) AS cosine FROM r WHERE rank <= 5""",
        "p6_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE {_WORDS.format('content')} > 1000",
        "p7_found": f"WITH {_winners_sql()} SELECT group_id, field_name, chunk_id FROM r WHERE k = 1",
        "p7_survivors": f"""WITH {_winners_sql()}, h AS (SELECT chunk_id, {", ".join(f"max({f}) AS {f}" for f in _FIELDS)} FROM chunks GROUP BY chunk_id),
v AS (SELECT group_id, max(CASE WHEN field_name = 'content' THEN chunk_id END) AS chunk_id, {", ".join(map(value, _FIELDS))} FROM r JOIN h USING (chunk_id) WHERE k = 1 GROUP BY group_id),
z AS (SELECT group_id, CAST(count(*) AS BIGINT) AS n_members FROM m GROUP BY group_id) SELECT * FROM z LEFT JOIN v USING (group_id)""",
        "p8_found": f"WITH {_LEAKED} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (run)",
        "p9_found": f"""WITH {_SIZED} SELECT DISTINCT mix_id, lower(trim(t.source)) AS source FROM mix_targets t CROSS JOIN whole LEFT JOIN per ON per.source = lower(trim(t.source))
WHERE target_share * size_ratio * total > max_repeats * coalesce(available, 0)""",
        "p9_shares": f"""WITH {_RATES}, s AS (SELECT mix_id, source, CAST(sum(copies * tokens) AS BIGINT) AS drawn_tokens, CAST(sum(copies) AS BIGINT) AS copies FROM drawn GROUP BY ALL),
j AS (SELECT mix_id, source, wanted AS wanted_tokens, coalesce(drawn_tokens, 0) AS drawn_tokens, coalesce(copies, 0) AS copies, wanted <= max_repeats * available AS feasible FROM rated LEFT JOIN s USING (mix_id, source))
SELECT *, CASE WHEN sum(drawn_tokens) OVER (PARTITION BY mix_id) > 0 THEN drawn_tokens / CAST(sum(drawn_tokens) OVER (PARTITION BY mix_id) AS DOUBLE) END AS drawn_share FROM j""",
        "p9_mix": f"WITH {_RATES} SELECT mix_id, doc_id, source, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy, tokens FROM drawn WHERE copies > 0",
    }
