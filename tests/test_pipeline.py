"""Files, the command line, embedding, and the kernels against the windows that state the same rules."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark import cli, profiling
from leafspark.functions import kernels
from leafspark.functions import vectors as V
from leafspark.operators import chunking, dedup, elements, embed, oversize, preprocess, reorder, search
from leafspark.sources import files

SHAPES = ["# A", "## B", "### C", "text here", "", "**Bold Title**", "**bold low**", "  **In**  ", "**A** x **B**", "***T***", "```", "#tag", "- item one", "  - deep item two", "1. num", "| **Cell** |", "**한글**", "**" + "A" * 81 + "**", "\t- tab", "##   ", "- **Item**", "+ plus", "w " * 9]


def texts(n, seed, most=30):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(SHAPES) for _ in range(rng.randrange(0, most))) for _ in range(n)]


def test_kernels_agree_with_windows(spark):
    d = spark.createDataFrame(list(enumerate(texts(200, 1))), "doc_id long, text string").withColumn("content", F.lit("clash"))
    for options in (preprocess.PreprocessOptions(), preprocess.PreprocessOptions(require_empty_lines=False, detect_title_case=False, preserve_lists=False, min_capitalization_ratio=0.5)):
        new = F.coalesce(preprocess.to_heading(F.col("title"), F.col("level")), F.col("line"))
        lines = preprocess.bold_titles(d, options).withColumn("line", new)
        want = {}
        for r in lines.orderBy("doc_id", "line_no").collect():
            want.setdefault(r.doc_id, []).append(r.line)
        assert {r.doc_id: r.text for r in preprocess.preprocess(d, options).collect()} == {k: "\n".join(v) for k, v in want.items()}
    for levels in (chunking.LEVELS, (2, 3)):
        want = sorted(map(tuple, chunking.raw_chunks(d, levels).collect()), key=str)
        got = chunking.split(d, levels).select("doc_id", "original_position", "content", *chunking.HEADS)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_pieces_agree_with_the_single_steps(spark):
    chunks = chunking.split(spark.createDataFrame(list(enumerate(texts(150, 2, 60))), "doc_id long, text string"))
    rows = {(r.doc_id, r.original_position): r for r in chunks.collect()}
    step = {name: {(r.doc_id, r.original_position): r.pieces for r in f(chunks, 20).collect()} for name, f in (("depth", oversize.pack_by_depth), ("list", oversize.pack_list_items), ("paragraph", oversize.pack_paragraphs))}
    seen = set()
    for k, r in rows.items():
        how, parts = kernels.pieces(r.content, 20)
        seen.add(how)
        if how != "keep":
            assert parts == step[how][k]
    assert seen == {"depth", "list", "paragraph", "keep"}
    whole = oversize.split_documents(spark.createDataFrame(list(enumerate(texts(150, 2, 60))), "doc_id long, text string"), 20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, oversize.split_oversized(chunks, 20).collect()))
    assert oversize.split_oversized(chunks.where("false"), 20).count() == 0
    odd = spark.createDataFrame([(1, "x", None, 5), (1, "y", "a b", None)], "doc_id long, chunk_id string, content string, token_count int").withColumns({h: F.lit(None).cast("string") for h in chunking.HEADS}).withColumn("original_position", F.lit(0))
    assert sorted(r.strategy for r in oversize.split_oversized(odd, 1).collect()) == ["keep", "keep"]


def test_list_items_keep_or_drop_what_stands_before(spark):
    d = chunking.split(spark.createDataFrame([(1, "intro\n- a\n  - b\nmore\n- c\n\t\t- d\n  - e"), (2, "no list"), (3, "\n- x")], "doc_id long, text string"))
    rows = lambda keep: [(r.doc_id, r.idx, r["item"], r.depth, r.parent_idx) for r in oversize.list_items(d, keep).orderBy("doc_id", "idx").collect()]
    assert rows(False) == [(1, 0, "- a", 0, None), (1, 1, "  - b\nmore", 1, 0), (1, 2, "- c", 0, None), (1, 3, "\t\t- d", 4, None), (1, 4, "  - e", 1, 2), (3, 0, "- x", 0, None)]
    assert rows(True)[:3] == [(1, 0, "intro", 0, None), (1, 1, "- a", 0, None), (1, 2, "  - b\nmore", 1, 1)] and (2, 0, "no list", 0, None) in rows(True) and (3, 0, "- x", 0, None) in rows(True)


def test_elements_carry_the_headers_that_windows_give(spark):
    d = spark.createDataFrame(list(enumerate(texts(80, 5, 40))), "doc_id long, text string")
    whole = elements.parse(d)
    again = elements.enrich(elements.blocks(d).drop(*chunking.HEADS))
    assert sorted(map(str, whole.collect())) == sorted(map(str, again.collect())) and whole.count() > 200


def test_plans_of_whole_texts_have_no_shuffle(spark):
    d = spark.createDataFrame([(1, "# A")], "doc_id long, text string")
    for df in (preprocess.preprocess(d), chunking.split(d), oversize.split_documents(d), elements.parse(d), oversize.list_items(chunking.split(d))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_markdown_and_chunks_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.md").write_text("# Top\n\n" + "\n\n".join(f"## S{k}\n\nword {i} {k}" for k in range(5)) + "\n" * (i % 2))
    d = files.read_markdown(spark, str(tmp_path / "in"))
    files.write_markdown(d, str(tmp_path / "md"))
    again = files.read_markdown(spark, str(tmp_path / "md"))
    assert {r.doc_id: r.text.rstrip("\n") + "\n" for r in d.collect()} == {r.doc_id: r.text for r in again.collect()}
    chunks = chunking.split(d)
    assert chunks.count() == 20
    for layout in ("lines", "array"):
        path = str(tmp_path / layout)
        files.write_chunk_json(chunks, path, full=layout == "lines", layout=layout)
        back = files.read_chunk_json(spark, path)
        assert {(r.doc_id, r.chunk_id, r.content, r.h2) for r in back.collect()} == {(r.doc_id, r.chunk_id, r.content, r.h2) for r in chunks.collect()}
    one = next((tmp_path / "array").glob("doc_id=*/part-*"))
    assert len(json.loads(one.read_text())) == 5
    files.save_documents(d, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    with pytest.raises(ValueError):
        files.write_chunk_json(chunks, str(tmp_path / "x"), layout="csv")


def test_commands_keep_all_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text("**Bold Title**\n\nintro\n\n" + "\n\n".join(f"## S{k}\n\nsame words here" if k < 2 else f"## S{k}\n\nother words {i} {k} alpha beta" for k in range(4)))
    at = lambda x: str(tmp_path / x)
    assert cli.main(["preprocess", at("in"), at("pre")]) == 0
    assert all(r.text.startswith("## Bold Title\n") for r in files.read_markdown(spark, at("pre")).collect())
    assert cli.main(["preprocess", at("in"), at("raw"), "--no-detect-bold-headers"]) == 0
    for layout in ("lines", "array"):
        assert cli.main(["split", at("in"), at("chunks"), "--layout", layout]) == 0
        assert files.read_chunk_json(spark, at("chunks")).count() == 12
    assert cli.main(["--profile", "embed", at("chunks"), at("vectors"), "--dim", "16"]) == 0
    v = files.read_embeddings(spark, at("vectors"))
    assert v.count() == 12 and v.select("doc_id").distinct().count() == 3
    for extra in (["--embeddings", at("vectors")], []):
        assert cli.main(["search", at("chunks"), at("found"), "--query", "same words", "--min-similarity", "0.1", "--dim", "16", *extra]) == 0
        assert (spark.read.text(at("found"), wholetext=True).first()[0]).startswith("Found 5 result(s)")
    assert cli.main(["search", at("chunks"), at("json"), "--query", "same words", "--min-similarity", "0.1", "--format", "json", "--top-k", "2"]) == 0
    assert json.loads(spark.read.text(at("json")).first()[0])["count"] == 2
    for strategy in ("sequential", "cluster"):
        assert cli.main(["reorder", at("chunks"), at("ordered"), "--strategy", strategy, "--embeddings", at("vectors")]) == 0
        got = files.read_markdown(spark, at("ordered")).collect()
        assert len(got) == 3 and all(r.text.count("## S") == 4 for r in got)
    assert cli.main(["dedup", at("chunks"), at("kept"), "--embeddings", at("vectors"), "--threshold", "0.6", "--report", at("report"), "--dry-run"]) == 0
    assert files.read_chunk_json(spark, at("kept")).count() == 12
    assert cli.main(["dedup", at("chunks"), at("kept"), "--embeddings", at("vectors"), "--threshold", "0.6", "--report", at("report")]) == 0
    left = files.read_chunk_json(spark, at("kept")).count()
    assert 3 <= left < 12 and "Groups of duplicates: " in "\n".join(r[0] for r in spark.read.text(at("report")).collect())
    assert cli.main(["reorder", at("chunks"), at("x"), "--model", "none"]) == 1 and cli.main(["search", at("chunks"), at("x"), "--query", " "]) == 1


def test_embedding_in_batches_with_fallback(spark):
    calls = spark.sparkContext.accumulator(0)
    asked = spark.sparkContext.accumulator(0)

    def load():
        def f(group):
            calls.add(1)
            if "bad" in group:
                raise ValueError("no bad")
            return [[float(len(t)), 1.0] for t in group]

        return f

    embed.register_model("counting", load)
    rows = [(i, "bad" if i == 7 else "" if i == 8 else None if i == 9 else "x" * (i + 1)) for i in range(20)]
    c = spark.createDataFrame(rows, "i int, content string").coalesce(1)
    got = {r.i: (r.embedding, r.embed_error) for r in embed.embed(c, "counting", batch_size=10, progress=asked).collect()}
    assert got[0] == ([1.0, 1.0], None) and got[7] == (None, "no bad") and got[8][1] == got[9][1] == "blank text"
    assert asked.value == 18 and calls.value == 2 + 10  # two batches, one of them again text by text
    with pytest.raises(ValueError):
        embed.load_model("missing")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return lambda g: g

    embed.register_model("flaky", flaky)
    assert embed.load_model("flaky", wait=0)(["a"]) == ["a"] and embed.model_exists("flaky") and "flaky" in embed.available_models()


def test_cache_cycle(spark):
    embed.register_model("length", lambda: lambda group: [[float(len(t))] for t in group])
    c = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (1, "b", "yyy"), (1, "c", None)], "doc_id long, chunk_id string, content string")
    cache = spark.createDataFrame([("length", None, [1.0]), ("other", "h", [2.0]), ("length", "z", None)], "model string, text_hash string, vector array<float>")
    out, new = embed.embed_cached(c, cache, "length")
    assert {(r.doc_id, r.chunk_id): r.embedding for r in out.collect()} == {(1, "a"): [2.0], (2, "a"): [2.0], (1, "b"): [3.0], (1, "c"): None} and new.count() == 2
    again, none = embed.embed_cached(c, cache.union(new), "length")
    assert none.count() == 0 and again.where("embedding is not null").count() == 3
    fresh, redone = embed.embed_cached(c, cache.union(new), "length", force_refresh=True)
    assert redone.count() == 2 and fresh.count() == 4
    twice = out.where("embedding is not null").withColumn("embedding", F.when(F.col("doc_id") == 2, F.array(F.lit(9.0).cast("float"))).otherwise(F.col("embedding")))
    assert {(r.doc_id, r.chunk_id): r.embedding for r in embed.attach(c, twice.select("doc_id", "chunk_id", "embedding")).collect()}[2, "a"] == [9.0]


def test_pairs_by_products_agree_with_a_loop(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PAIR_ROWS", 7)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5)) + 1.2
    rows = [(i % 3 if i % 3 else None, f"i{i:02d}", x[i].tolist() if i % 11 else [0.0] * 5) for i in range(60)] + [(1, "w", [1.0, 2.0]), (1, None, [1.0] * 5)]
    df = spark.createDataFrame([*rows, rows[4]], "b int, k string, embedding array<double>").withColumn("i", F.lit(0))
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] and b[1] and a[1] < b[1] and len(a[2]) == len(b[2]) and any(a[2]) and any(b[2]):
                want[a[1], b[1]] = float(np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2]))
    for t in (None, 0.8):
        got = {(r.i, r.j): r.sim for r in dedup.pairwise(df, "b", "k", threshold=t).collect()}
        some = {k: v for k, v in want.items() if t is None or v >= t}
        assert got.keys() == some.keys() and all(abs(got[k] - some[k]) < 1e-12 for k in got)
    assert dedup.pairwise(df.where("false"), "b", "k").count() == 0


def test_report_text(spark):
    chunks = spark.createDataFrame([("a", i, i, "c" * (i + 1)) for i in range(20)], "b string, k int, original_position int, content string")
    pairs = spark.createDataFrame([("a", 0, j, 0.9) for j in range(1, 13)] + [("a", 15, 16, 0.9)], "block string, i int, j int, sim double")
    chosen = dedup.representatives(chunks, dedup.duplicate_groups(pairs), "b", "k", "longest")
    text = dedup.report_text(chunks, chosen, "b").first().report
    assert text.splitlines() == ["Chunks: 20, after deduplication: 7, removed: 13 (65.0 %)", "Groups of duplicates: 2", "  13 chunks: 0, 1, 2, ...", "  2 chunks: 15, 16", "Removed: 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, and 3 more"]


def test_vectors_as_bytes(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), (None,), ([],), ([float("inf")],)], "v array<float>").withColumn("b", V.to_bytes(F.col("v")))
    got = rows.select("v", "b", V.from_bytes(F.col("b")).alias("w")).collect()
    assert [r.b for r in got] == [b"\x00\x00\xc0\x3f\x00\x00\x00\xc0", None, b"", b"\x00\x00\x80\x7f"] and [r.w for r in got] == [r.v for r in got]
    assert spark.range(1).select(V.from_bytes(F.lit(b"abc")).alias("w")).first().w is None


def test_memory(spark):
    held = profiling.executor_memory(spark)
    assert held and all(0 <= free <= most for most, free in held.values())
    total, free = profiling.system_memory()
    assert 0 < free <= total and profiling.memory_available(spark, 1) and not profiling.memory_available(spark, 1 << 60) and profiling.gpus(spark) == []


def test_boundaries(spark):
    d = spark.createDataFrame([(1, ""), (2, "no header"), (3, "# A\ntext\n"), (4, "# A\n### C\n## B"), (5, None), (None, "# A"), (6, "# A\n\n" + "w " * 40_000)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in preprocess.preprocess(d.where("doc_id < 5")).collect()} == {1: "", 2: "no header", 3: "# A\ntext\n", 4: "# A\n### C\n## B"}
    rows = {}
    for r in chunking.split(d).orderBy("doc_id", "original_position").collect():
        rows.setdefault(r.doc_id, []).append((r.original_position, r.content[:20], r.h1, r.h2, r.h3))
    assert rows[2] == [(0, "no header", None, None, None)] and rows[3] == [(0, "# A\ntext\n", "A", None, None)]
    assert rows[4] == [(0, "# A\n### C", "A", None, "C"), (1, "## B", "A", "B", None)] and set(rows) == {2, 3, 4, 6}
    n = chunking.split(d.where("doc_id = 6")).first().token_count
    assert n == int(40_002 * 1.3)
    assert oversize.split_documents(d.where("doc_id = 6"), n).first().strategy == "keep" == oversize.split_documents(d.where("doc_id = 6"), n - 1).first().strategy
    one = spark.createDataFrame([("a", 1, [1.0, 0.0])], "b string, k int, embedding array<double>").withColumn("original_position", F.lit(0))
    none = dedup.representatives(one, dedup.duplicate_groups(dedup.duplicate_pairs(one, "b", "k", 0.9)), "b", "k")
    assert dedup.report(one, none, "b").first().asDict() == {"block": "a", "original_count": 1, "deduplicated_count": 1, "removed_count": 0, "n_groups": 0, "reduction_percentage": 0.0}
    assert dedup.report_text(one, none, "b").first().report == "Chunks: 1, after deduplication: 1, removed: 0 (0.0 %)\nGroups of duplicates: 0\n"
    assert [r.item for r in reorder.reorder(one, "b", "k", "cluster").collect()] == [1]
    with pytest.raises(ValueError):
        reorder.reorder(one.where("false"), "b", "k", strict=True)
    assert search.search(one.withColumn("chunk_id", F.lit("x")), [0.0, 1.0], 3, 0.5).count() == 0


def test_search_by_a_chunk(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", None)]
    c = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    assert [(r.chunk_id, r["rank"]) for r in search.search_by_chunk(c, "a", 5, 0.5).orderBy("rank").collect()] == [("b", 1)]
    for missing in ("d", "x"):
        with pytest.raises(ValueError):
            search.search_by_chunk(c, missing)
