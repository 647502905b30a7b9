"""The training-data operators against brute force, and on nulls, empties, ties, repeats and clashing names."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.llm import clusters, groups, leakage, markup, mixing, neighbours, pages, pieces, repetition, survivors, toxicity


# 1 groups
def unions(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_agree_with_union_find(spark, seed):
    rng = random.Random(seed)
    ids = [f"{i:04d}" for i in rng.sample(range(9999), 150)]
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[i], ids[i + 1]) for i in range(70, 90)] + [(ids[90], ids[70])]
    edges += [(ids[100], ids[i]) for i in range(101, 120)] + [(rng.choice(ids), rng.choice(ids)) for _ in range(20)]
    rows = [(f" {a.upper()} ", b, 0.9, "extra") for a, b in edges] + [(None, ids[0], 1.0, ""), (ids[0], ids[140], float("nan"), ""), (ids[1], ids[141], 0.5, ""), (ids[2], ids[2], 1.0, ""), ("  ", ids[3], 1.0, ""), (ids[4], ids[5], None, "")]
    pairs = spark.createDataFrame(rows, "chunk_a string, chunk_b string, sim double, u string")
    assert {r.chunk_id: r.group_id for r in groups.match_groups(pairs).collect()} == unions([(a, b) for a, b in edges if a != b])


@pytest.mark.parametrize("core", [0, 200_000])
def test_groups_with_a_hub_rings_and_long_chains(spark, monkeypatch, core):
    """A hub with a third of all edges, split by salts; rings; a chain of 300; with and without contraction of the core."""
    monkeypatch.setattr(groups, "CORE_EDGES", core)
    monkeypatch.setattr(groups, "HOT_ROWS", 20)
    monkeypatch.setattr(groups, "HOT", 10)
    rng = random.Random(9)
    name = [f"{i:05d}" for i in rng.sample(range(99999), 2000)]
    edges = [(name[0], name[i]) for i in range(1, 300)] + [(name[i], name[i + 1]) for i in range(400, 700)]
    edges += [(name[i], name[700 + (i - 699) % 7]) for i in range(700, 707)] + [(name[i], name[710 + (i - 709) % 2]) for i in (710, 711)]
    edges += [(name[1], name[720]), (name[720], name[2]), (name[500], name[720])] + [(rng.choice(name[800:900]), rng.choice(name[800:900])) for _ in range(150)]
    rows = [(min(a, b), max(a, b)) for a, b in edges if a != b]
    df = spark.createDataFrame([*rows, *rows[:5]], "u string, v string")
    assert {r.x: r.group for r in groups.connected_groups(df).collect()} == unions(rows)
    number = {x: i for i, x in enumerate(sorted(name))}
    whole = spark.createDataFrame([(number[a], number[b]) for a, b in rows], "u long, v long")
    assert {r.x: r.group for r in groups.connected_groups(whole).collect()} == unions([(number[a], number[b]) for a, b in rows])


def test_groups_of_nothing(spark):
    assert groups.match_groups(spark.createDataFrame([], "chunk_a string, chunk_b string, sim double")).count() == 0


# 2 repetition
def test_repeated_words():
    w = "a b c d e f".split()
    assert repetition.repeated_words(w * 2) == 6
    assert repetition.repeated_words(["x"] * 7) == 6 and repetition.repeated_words(["x"] * 6) == 0 and repetition.repeated_words([]) == 0
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(40))]
        covered = {j for i in range(len(words) - 5) if any(words[k : k + 6] == words[i : i + 6] for k in range(i)) for j in range(i, i + 6)}
        assert repetition.repeated_words(words) == len(covered)


def test_repetition_edges(spark):
    rows = [("a", "one two three four five six " * 4, 1), ("a", "one two three four five six " * 4, 1), ("b", None, 1), ("c", "", 1), (None, "x", 1), ("d", "12 34", 1), ("e", "word " * 30_000, 1)]
    texts = spark.createDataFrame(rows, "chunk_id string, content string, id int")
    docs = spark.createDataFrame([("the cat and the dog " * 20, "en"), (None, None)], "text string, lang string")
    refs = repetition.language_references(docs)
    got = {r.chunk_id: r for r in repetition.measure(texts, refs).collect()}
    assert set(got) == set("abcde") and got["a"].repeated_share == 0.75 and got["b"].repeated_share == 0 and got["b"].js_words is None
    assert {r.chunk_id for r in repetition.repetitive(texts, []).collect()} == {"a", "e"}
    assert repetition.language_references(docs.where("false")) == []


def test_js_distance():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    d = repetition.js_distance(p, np.array([0.5, 0.5, 0.0]))
    assert d[0] == 0 and d[1] == 1


# 3 clusters
def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def blobs(n, d, sizes, seed=0):
    rng = np.random.default_rng(seed)
    parts = [unit(rng.standard_normal((1, d)) + 0.1 * rng.standard_normal((k, d)) / 1) if k == 1 else unit(rng.standard_normal((1, d)) + 0.25 * rng.standard_normal((k, d))) for k in sizes]
    return np.concatenate([*parts, unit(rng.standard_normal((n, d)))])


def brute_clusters(x, cosine=0.85):
    """(degree, smallest member) of every row, by the whole matrix."""
    x = unit(x.astype(float))
    s = x @ x.T >= cosine - 1e-12
    root = np.arange(len(x))
    while True:
        low = np.where(s, root, len(x)).min(axis=1)
        if (low == root).all():
            return s.sum(axis=1) - 1, root
        root = low


def test_clusters_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    monkeypatch.setattr(clusters, "BIN", 100)
    x = blobs(200, 64, [2, 3, 5, 80, 2, 4] * 2)
    rows = [(f"{i:04d}", [float(y) * (1 + i % 3) for y in v], "x") for i, v in enumerate(x)]
    bad = [("n1", None, "x"), ("n2", [0.0] * 64, "x"), ("n3", [float("nan")] * 64, "x"), ("n4", [1.0] * 3, "x"), (None, [1.0] * 64, "x")]
    df = spark.createDataFrame(rows + rows[:20] + bad, "chunk_id string, embedding array<float>, cluster string")
    degree, root = brute_clusters(np.array([r[1] for r in rows], np.float32))
    size = np.bincount(root, minlength=len(rows))
    want = {(rows[i][0], rows[root[i]][0], degree[i]) for i in range(len(rows)) if size[root[i]] > 1}
    assert {(r.record, r.cluster, r.degree) for r in clusters.density_clusters(df).collect()} == want and want
    s = unit(np.array([r[1] for r in rows], np.float32).astype(float))
    for r in clusters.described_clusters(df).collect():
        members = [i for i in range(len(rows)) if size[root[i]] > 1 and rows[root[i]][0] == r.cluster_id]
        mean = np.round(s[members] @ s[members].mean(axis=0), 6)
        assert r.size == len(members) and r.n_links == degree[members].sum() // 2 and r.mutual == (r.n_links == r.size * (r.size - 1) // 2)
        assert [m for m, _ in zip(r.typical, range(3))] == [rows[members[k]][0] for k in np.lexsort((members, -mean))[:3]]


def test_clusters_with_a_hot_cell_and_copies(spark, monkeypatch):
    """A third of all rows in one group, a third copies of one vector, over several blocks and pivots."""
    monkeypatch.setattr(clusters, "BLOCK", 100)
    monkeypatch.setattr(clusters, "OPEN_BLOCK", 90)
    rng = np.random.default_rng(3)
    one = unit(rng.standard_normal((1, 64)))
    x = np.concatenate([unit(rng.standard_normal((1, 64))) * 8 + 0.36 * rng.standard_normal((500, 64)), np.repeat(one, 500, axis=0), rng.standard_normal((500, 64))])
    x = x[rng.permutation(len(x))].astype(np.float32)
    df = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<float>").repartition(5)
    degree, root = brute_clusters(x)
    got = {r.record: (r.degree, r.cluster) for r in clusters.density_clusters(df).collect()}
    assert got == {f"{i:04d}": (n, f"{root[i]:04d}") for i, n in enumerate(degree.tolist()) if n}


def test_clusters_send_a_vector_once_however_many_blocks(spark, monkeypatch):
    """Thirty blocks of open vectors and a hot cell of twenty: what is shuffled stays near the rows."""
    for name, n in (("BLOCK", 20), ("OPEN_BLOCK", 20), ("SIDE", 3), ("OPEN_SIDE", 4)):
        monkeypatch.setattr(clusters, name, n, raising=False)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((600, 64)), unit(rng.standard_normal((1, 64))) * 8 + 0.3 * rng.standard_normal((400, 64))]).astype(np.float32)
    x[:40] = x[40:80] * 1.5 + 0.1  # pairs of open vectors
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<float>")

    def sent():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = sent()
    got = {r.record: (r.degree, r.cluster) for r in clusters.density_clusters(df).collect()}
    # stages of other queries may go from the store, so only new ones count; the largest is the one that places the vectors
    assert max(n for k, n in sent().items() if k not in before) <= 3 * len(x)
    degree, root = brute_clusters(x)
    assert got == {f"{i:04d}": (n, f"{root[i]:04d}") for i, n in enumerate(degree.tolist()) if n} and len(got) > 450


def test_links_by_tiles_and_axes(monkeypatch):
    monkeypatch.setattr(clusters, "TILE", (16, 24))
    x = blobs(150, 64, [40, 3, 2, 60]).astype(np.float32)
    degree, root = brute_clusters(x)
    for axes in (None, clusters.fit_axes(x.astype(float), 0.85), np.eye(64, 8, dtype=np.float32)):
        for cut_at in (None, 100):
            links = clusters.Links(x * 3, np.ones(len(x)), 0.85, axes)
            if cut_at:
                links.compare(np.arange(cut_at))
                links.compare(np.arange(cut_at, len(x)))
                links.compare(np.arange(cut_at), np.arange(cut_at, len(x)))
            else:
                links.compare(np.arange(len(x)))
            assert (links.degree == degree).all() and (links.root == root).all()


def test_clusters_of_nothing(spark):
    assert clusters.density_clusters(spark.createDataFrame([], "chunk_id string, embedding array<float>")).count() == 0
    assert clusters.density_clusters(spark.createDataFrame([("a", [0.0] * 64)], "chunk_id string, embedding array<float>")).count() == 0


# 4 neighbours
@pytest.mark.parametrize("most", [256, 3])
def test_neighbours_recall_and_ties(spark, monkeypatch, most):
    """Ties and odd rows, with one classifier and with a second one in each of three parts."""
    monkeypatch.setattr(neighbours, "MOST_PARTS", most)
    monkeypatch.setattr(neighbours, "PART", 60 if most > 3 else 20)
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 40)
    x = blobs(300, 16, [6, 4, 9, 3] * 6)
    rows = [("m", f"{i:04d}", [float(y) for y in v]) for i, v in enumerate(x)] + [("m", "9998", [1.0] * 16), ("m", "9999", [2.0] * 16), ("m", "9997", [3.0] * 16)]
    bad = [("m", "b1", None), ("m", "b2", [0.0] * 16), ("m", "b3", [1.0] * 2), ("m", None, [1.0] * 16), (None, "z", [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:9] + bad, "model string, text_hash string, vector array<float>")
    got = {(r.id, r.neighbour): r.rank for r in neighbours.nearest(df, "text_hash", "vector", "model", 5).collect()}
    y = unit(np.array([r[2] for r in rows]))
    s = np.round(y @ y.T, 12)
    np.fill_diagonal(s, -3)
    ids = [r[1] for r in rows]
    order = [sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5] for i in range(len(ids))]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in order[i]}
    near = {(ids[i], ids[j]) for i in range(len(ids)) for j in order[i] if s[i, j] >= 0.85}
    assert len(want & got.keys()) / len(want) >= 0.9 and len(near & got.keys()) / len(near) >= 0.99
    assert got["9999", "9997"] == 1 and got["9999", "9998"] == 2


def test_neighbours_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "id string, v array<float>"), "id", "v").count() == 0


# 5 markup
@pytest.mark.parametrize(
    ("text", "clean", "kinds"),
    [
        ("a <b>c</b> &amp; d<!-- x -->", "a c & d", ["html"]),
        ("<h2>T</h2>\n<ul>\n<li>x</li>\n</ul>", "## T\n\n- x", ["html"]),
        ("== Head ==\n[[a|b]] '''c''' {{x}}", "## Head\nb c", ["wiki"]),
        ("\\section{S}\n\\begin{itemize}\n\\item x\n\\end{itemize}", "# S\n\n- x", ["latex"]),
        ("**b** _i_ ~~s~~ [t](u) ![i](p) n[^1]", "b i s t i n", ["markdown"]),
        ("# H\n\n- a\n* b\n\n2 * 3 * 4 snake_case_name 3 < 7", None, []),
        ("```\n<b>x</b> **y**\n```\n`<br>` $a_1 \\le b_2$", None, []),
        ("```\nopen <b>", None, []),
        ("", None, []),
    ],
)
def test_markup(text, clean, kinds):
    assert markup.clean(text) == (text if clean is None else clean, kinds)


def test_markup_edges(spark):
    rows = [("a", "<b>x</b>", 1), ("a", "<b>x</b>", 1), ("b", None, 1), ("c", "", 1), (None, "<b>", 1), ("d", "*" * 5000 + "[[" * 2000 + "<" * 5000 + "\\" * 500, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, kinds int")
    assert {(r.chunk_id, r.clean, tuple(r.kinds)) for r in markup.converted(df).collect() if r.chunk_id != "d"} == {("a", "x", ("html",)), ("b", None, ()), ("c", "", ())}
    assert ("a", "html") in {tuple(r) for r in markup.markup_kinds(df).collect()}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice(["a", "b", "c", "d", ""]) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y and x else max(best[i][j + 1], best[i + 1][j])
        got = sorted(pages.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


def test_pages_lose_the_lines_of_their_host(spark):
    menu, foot = "Home | About", "All rights reserved"
    rows = [(i, " Host " if i % 2 else "host", f"/{'ab'[i % 4 // 2]}/{i:02d}", f"{menu}\n\npage {i}\n{foot}") for i in range(40)]
    rows += [(90, "lonely", "/x", "alone"), (91, None, "/a", "x"), (92, "host", None, "x"), (None, "host", "/a", "x"), (93, "host", "/a/93", None), (94, "host", "/z", ""), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, repo string, title string, text string").withColumns({"h": F.lit(0), "t": F.lit(0)})
    got = {r.doc_id: r for r in pages.differenced(df, "repo", "title").collect()}
    assert set(got) <= {*range(40), 94} and len(got) >= 38
    full = [r for k, r in got.items() if k < 40 and r.other < 40]
    assert len(full) >= 36 and all(r.own_text == f"\npage {r.doc_id}" and (r.n_lines, r.n_shared) == (4, 2) for r in full)
    order = sorted(range(40), key=lambda i: rows[i][2])
    near = {r.doc_id: r.other for r in pages.neighbours_by_path(df.where("doc_id < 40"), "repo", "title").collect()}
    assert all(abs(order.index(k) - order.index(o)) == 1 for k, o in near.items()) and len(near) == 40
    one = {r.doc_id: r.other for r in pages.neighbours_by_path(df.where("doc_id < 40").coalesce(1), "repo", "title").collect()}
    assert one == near and pages.differenced(df.where("false"), "repo", "title").count() == 0


# 6 pieces
def test_pieces_cover_and_fit():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Ende. ", "\n", "\n\n", "\n- item ", "x" * 50 + " ", "\u00a0a "]) for _ in range(rng.randrange(400)))
        cuts = pieces.cut_points(text, 60, 0)
        if len(text.split()) * 13 // 10 > 60:
            assert "".join(text[a:z] for a, z, _ in cuts) == text and len(cuts) > 1
            assert all(len(text[a:z].split()) * 13 // 10 == n <= 60 for a, z, n in cuts)
        else:
            assert cuts == []
        over = pieces.cut_points(text, 60, 10)
        assert all(b[0] < a[1] and len(text[b[0] : a[1]].split()) * 13 // 10 <= 10 for a, b in zip(over, over[1:]))


def test_pieces_prefer_strong_boundaries_and_edges(spark):
    text = "w " * 30 + "end. " + "w " * 10 + "\n- " + "w " * 30
    assert text[pieces.cut_points(text, 60, 0)[1][0]] == "-"
    rows = [("a", "w " * 2000, 7), ("a", "w " * 2000, 7), ("b", None, 7), ("c", "", 7), (None, "w " * 2000, 7), ("d", "w" * 9000, 7)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, piece int")
    got = pieces.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {"a"} and len(got) == got[0].n_pieces and max(r.tokens for r in got) <= 1000
    with pytest.raises(ValueError):
        pieces.split_oversized(df, 10, 10)


# 7 survivors
def test_survivors(spark):
    g = spark.createDataFrame([(1, "a", 0.1), (1, "b", None), (1, "a", 0.1), (2, "a", 1.0), (3, None, 1.0), (4, "x", 1.0), (4, "y", 1.0), (None, "a", 1.0), (5, "b", 0.5), (5, "c", float("nan"))], "group_id long, chunk_id string, trust double")
    c = spark.createDataFrame(
        [("a", " ab ", 5, "", None, "H3", None, "2024-01-01", 1), ("b", "ab\n\n", 5, "x", None, "h3", "title", None, 1), ("b", "ab\n\n", 5, "x", None, "h3", "title", None, 1), ("c", None, None, None, None, None, "code", None, 1)],
        "chunk_id string, content string, original_position int, h1 string, h2 string, h3 string, element_type string, updated_at string, rank_key int",
    ).withColumn("updated_at", F.to_timestamp("updated_at"))
    got = {(r.group_id, r.field_name): r.chunk_id for r in survivors.winners(g, c).collect()}
    assert got == {(1, "content"): "a", (1, "original_position"): "a", (1, "h1"): "b", (1, "h3"): "a", (1, "element_type"): "b", (5, "content"): "b", (5, "original_position"): "b", (5, "h1"): "b", (5, "h3"): "b", (5, "element_type"): "b"}
    s = {r.group_id: r for r in survivors.survivors(g, c).collect()}
    assert set(s) == {1, 4, 5} and s[1].chunk_id == "a" and s[1].h1 == "x" and s[4].content is None
    assert survivors.winners(g.where("false"), c).count() == 0


# 8 leakage
def leak_tables(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 14, 30, 60])))) for i in range(60)]
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary + ["zz", "the"]) for _ in range(rng.randrange(5, 120))]
        if k % 2:
            src = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 13, 25])
            at = rng.randrange(max(1, len(src) - n + 1))
            words[rng.randrange(len(words)) : 0] = [w.upper() for w in src[at : at + n]]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(words)))
    return items, docs


def test_leaks_agree_with_brute_force(spark):
    items, docs = leak_tables(spark)
    gram = lambda t: {tuple(w[i : i + 12]) for w in [leakage.words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if gram(t) & gram(s)}
    di = spark.createDataFrame(docs + docs[:5] + [(999, None), (None, "x"), (998, "")], "doc_id long, text string").withColumn("item_id", F.lit(1))
    ii = spark.createDataFrame(items + items[:5] + [(77, None), (78, "...")], "item_id long, text string")
    got = leakage.leaks(di, ii)
    assert {(r.doc_id, r.item_id) for r in got.where("kind = 'verbatim'").collect()} == want and want
    assert leakage.leaks(di, ii.where("false")).count() == 0 and leakage.leaks(di.where("false"), ii).count() == 0


def test_paraphrase_needs_the_answer(spark):
    item = "In the town of Belford the clerk Mirwyck sealed 844 copper jars beside the old mill during the winter of 1745 and went home"
    near = item.replace("the old mill", "an old mill").replace("sealed", "closed").replace("the clerk", "a clerk")
    other = near.replace("844", "12").replace("Mirwyck", "Someone").replace("Belford", "Elsewhere").replace("1745", "1")
    fill = [(10 + i, f"some other text of the town and the mill number {i} with many more words in it to count") for i in range(30)]
    docs = spark.createDataFrame([(1, near), (2, other), *fill], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got.get(1) == "paraphrase" and 2 not in got


def test_paraphrase_behind_a_closer_window_and_under_the_verbatim_bound(spark):
    item = "In the town of Belford the clerk Mirwyck sealed 844 copper jars beside the old mill during the winter of 1745 and went home"
    near = item.replace("the old mill", "an old mill").replace("sealed", "closed").replace("the clerk", "a clerk")
    decoy = "1745 winter during mill beside jars copper 844 sealed Mirwyck clerk Belford"
    fill = [(10 + i, f"some other text of the town and the mill number {i} with many more words in it to count") for i in range(30)]
    docs = spark.createDataFrame([(1, f"{decoy} {'of the and in ' * 20} {near}"), (2, decoy), *fill], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got.get(1) == "paraphrase" and 2 not in got
    block = leakage._Items([(7, item)], spark, docs)
    block.bound = np.full(len(block.owner), 1.1)
    ids = np.array([block.vocabulary.get(w, -1) for w in leakage.words(near)], np.int32)
    assert leakage.search(ids, block)[0][0] == "paraphrase"


def test_common_subsequence():
    assert leakage.common_subsequence([1, 2, 3, 4], [2, 9, 3, 4, 1]) == 3 and leakage.common_subsequence([], [1]) == 0


# 9 mixing
def test_mixing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " A " if i % 2 else "a", "w " * 10) for i in range(2000)] + [(5000 + i, "b", "w " * 10) for i in range(100)] + [(9000, None, "w"), (9001, "a", None), (9002, "a", "")], "doc_id long, source string, text string")
    t = spark.createDataFrame([(1, "A", 0.5, 1, 0.5), (1, "b", 0.5, 2, 0.5), (1, "A", 0.5, 1, 0.5), (2, "none", 0.5, 3, 0.1), (3, "b", 0.08, 3, 1.0), (4, None, 0.1, 1, 1.0)], "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    sized = mixing.with_tokens(docs)
    total = 2100 * 13 + 1
    r = mixing.rates(sized, t)
    assert {(x.mix_id, x.source) for x in r.where("not feasible").collect()} == {(1, "b"), (2, "none")}
    got = {(x.mix_id, x.source): x for x in mixing.reached(sized, r).collect()}
    assert abs(got[1, "a"].drawn_tokens / (0.25 * total) - 1) < 0.1 and got[1, "b"].drawn_tokens == 2 * 1300 and got[2, "none"].drawn_tokens == 0
    copies = [x.copies for x in mixing.draw(sized, r).where("mix_id = 3").collect()]
    assert set(copies) <= {1, 2} and abs(sum(copies) * 13 / (0.08 * total) - 1) < 0.15
    assert mixing.draw(sized, r).orderBy("mix_id", "doc_id").collect() == mixing.draw(sized.repartition(7), r).orderBy("mix_id", "doc_id").collect()
    assert mixing.rates(sized.where("false"), t).where("rate > 0").count() == 0
    emitted = {(x.mix_id, x.doc_id): x["count"] for x in mixing.emit(sized, r).groupBy("mix_id", "doc_id").count().collect()}
    drawn = {(x.mix_id, x.doc_id): x.copies for x in mixing.draw(sized, r).collect()}
    assert emitted == drawn
    monkeypatch.setattr(mixing, "TARGET_ROWS", 1)
    assert {(x.mix_id, x.doc_id): x.copies for x in mixing.draw(sized, r).collect()} == drawn


def test_mixing_by_a_public_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None)], "doc_id long, source string, text string")
    assert {r.doc_id: r.tokens for r in mixing.with_tokens(docs, path).collect()} == {1: 2, 2: 0}


# 10 toxicity
def said(text):
    """The votes on the sentences of a text, in order."""
    tokens = toxicity.Tokens()
    return toxicity.self_votes(tokens, tokens.entries(toxicity.prepared(text)), toxicity.hints())


@pytest.mark.parametrize("word", ["id1ot", "i-d-i-o-t", "i d i o t", "idiooooot", "id*ot", "IDIOT", "idiots", "i.d.i.o.t", "id\u200biot", "#diot", "idio_", "(idiot)..."])
def test_disguised_terms(word):
    (v,) = said(f"Fine so far. You are an {word}! More here.")
    assert v["abuse"][0] == "+" and v["at"] == 1
    assert (v["abuse"][1] == "+") == (word.strip("().").lower().rstrip("s") != "idiot" and "\u200b" not in word)


def test_no_disguise_escapes():
    digits = str.maketrans("oieast", "013457")
    for t in toxicity.CLASSES:
        for i in range(len(t)) if len(t) > 2 else ():
            for x in ["@", "#", "*", "$", "_", "%", "&", "+", t[i].translate(digits)]:
                token = f"{t[:i]}{x}{t[i + 1 :]}"
                assert any("+" in v[c][0] for v in said(f"they are {token} to us") for c in toxicity.CLASSES[t]), token
    assert said("ich will dich g e i l e in meinem bett")[0]["sexual"][:2] == "++"
    assert said("너는 쓰 레 기 야")[0]["abuse"][0] == "+"


def test_quotes_and_contexts():
    (v,) = said("the guide removes 'you are an idiot' from posts.")
    assert v["abuse"][0] == "0" and v["abuse"][-1] == "-"
    assert said("the index counts the rows.") == [] and said("") == []
    hit = toxicity.hints()
    for s in ("shut your mouth", "we know where you live", "옷을 벗고", "breed like"):
        assert next(hit.iter(s), None) is not None


def test_sentences_and_ids(spark):
    text = "One two. Three!\n- four\n- five\n\nsix | seven 1.5 ... eight"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "!!! 12"), (None, "x"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.votes) for r in toxicity.read(rows).collect()}
    ids = got[1][0]
    assert [len(list(g)) for k, g in itertools.groupby(ids, lambda x: x == toxicity.END) if not k] == [2, 1, 1, 1, 1, 1, 1] and ids[-1] == toxicity.END
    assert got[2] == ([], []) and got[3] == ([], []) and set(got) == {1, 2, 3}
    assert toxicity.share(np.array([1, 24, 48])).tolist() == [1, 1, 0.5]


def test_classifier_learns_what_no_voter_names(spark):
    """Annotators name a category for documents with a sentence that no list holds; others with it are found."""
    rng = random.Random(4)
    plain = [f"The {a} of the {b} counts its {c}." for a in ("index", "ledger", "owner") for b in ("table", "page", "queue") for c in ("rows", "files", "marks")]
    docs, labels = [], []
    for i in range(400):
        body = rng.sample(plain, 4)
        kind = "implied" if i % 8 == 0 else "insult" if i % 8 == 1 else ""
        if kind:
            body.insert(rng.randrange(4), {"implied": "Somebody ought to visit that writer with a rope.", "insult": "You are a worthless idiot!"}[kind])
        docs.append((i, " ".join(body)))
        if i % 3 == 0:
            labels.append((i, "x", "abuse" if kind else "none"))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, annotator string, category string")
    got = {r.doc_id for r in toxicity.flagged(toxicity.scores(d, lab)).where("category = 'abuse'").collect()}
    assert got == {i for i in range(400) if i % 8 < 2}


def test_scores_learn_from_votes(spark):
    rng = random.Random(6)
    plain = ["The index counts the rows of the table.", "Each owner reviews one page.", "Nobody expected the filter to break."]
    bad = ["You are a worthless idiot and everyone here knows it!", "Shut your mouth, you moron."]
    tech = ["The word filter lists idiot and moron as examples of blocked terms."]
    docs, labels = [], []
    for i in range(300):
        kind = rng.choice(["plain", "plain", "bad", "tech"])
        docs.append((i, " ".join([*rng.sample(plain, 2), *([rng.choice(bad)] if kind == "bad" else tech if kind == "tech" else [])]), "S" if i % 2 else " s "))
        labels += [(i, "x", "abuse" if kind == "bad" else "none")] * 2 if i % 3 == 0 else []
    docs += [(1000, None, None), (1001, "", "s"), (1002, "!!!", "s"), (None, "x", "s"), (0, docs[0][1], docs[0][2]), (1003, "word " * 50_000, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("h", F.lit(1))
    lab = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, annotator string, category string")
    s = toxicity.scores(d, lab).persist()
    got = {r.doc_id for r in toxicity.flagged(s).where("category = 'abuse'").collect()}
    assert got == {i for i, t, _ in docs if t and any(b in t for b in bad)}
    assert s.count() == 304 and s.where("doc_id in (1000, 1001, 1002) and abuse + hate + sexual > 0.1").count() == 0
    rates = {(r.source, r.category): r.n_flagged for r in toxicity.source_rates(d, s).collect()}
    assert rates["s", "abuse"] == len(got)
    assert toxicity.flagged(toxicity.scores(d.where("false"), lab)).count() == 0


def test_label_model_weighs_voters():
    patterns = collections.Counter({"+0++": 40, "+0+0": 200, "-0--": 40, "+0--": 60, "+0-0": 150})
    m = toxicity.LabelModel(list(patterns), list(patterns.values()))
    assert m.posterior("+0+0") > 0.8 and m.posterior("+0-0") < 0.3
