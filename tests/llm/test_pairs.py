"""Jaccard join, fuzzy lines and substring dedup against brute force, with their edges."""

import random

from pyspark.sql import functions as F

from broadloom.llm import linkage
from broadloom.llm.fuzzy_lines import line_classes, line_report, without_line_copies
from broadloom.llm.jaccard_join import jaccard_components, one_of_each
from broadloom.llm.linkage import CountTree, count_vector, enough
from broadloom.llm.substrings import dedup_substrings
from tests.llm import brute
from tests.llm.helpers import SCHEMA, corpus, frame


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_jaccard_join_matches_brute_force(spark):
    rows = corpus()
    want = brute.jaccard_components([(r[0], r[1]) for r in rows])
    assert sum(d != c for d, _, c in want) > 25
    assert as_set(jaccard_components(frame(spark, rows))) == want


def test_a_blocks_large_component_is_not_paired_with_itself(spark):
    """600 members of one component, 20 others, a small block: all pairs across components
    meet in a piece, and rows grow with the members, not with their square."""
    of = {n: 1 if n <= 600 else n for n in range(1, 621)}
    rows = [(7, n, c, 39) for n, c in of.items()] + [(8, 1, 1, 1), (8, 605, 605, 1)]
    made = linkage.chunk_pairs(spark.createDataFrame(rows, "block long, node long, c long, k long"), 16).collect()
    assert len(made) <= 2 * 600 + 20 * 41 + 2
    pieces = {}
    for r in made:
        pieces.setdefault((r.block, r.i, r.j), []).append(r)
    met = set()
    for (block, i, j), members in pieces.items():
        for x in members:
            met |= {(block, x.node, y.node) for y in members if x.c != y.c and (i == j or x.chunk != y.chunk)}
    want = {(7, a, b) for a in of for b in of if of[a] != of[b]} | {(8, 1, 605), (8, 605, 1)}
    assert met == want


def test_jaccard_join_with_streamed_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LARGE", 3)
    monkeypatch.setattr(linkage, "HELD", 50)
    rows = corpus(seed=2)
    assert as_set(jaccard_components(frame(spark, rows))) == brute.jaccard_components([(r[0], r[1]) for r in rows])


def test_jaccard_join_edges(spark):
    extra = frame(spark, corpus(n=5)).withColumn("component_id", F.lit("x")).withColumn("node", F.lit(1)).withColumn("n", F.lit(2))
    assert jaccard_components(extra).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard_components(frame(spark, [])).count() == 0
    text = "a b c d e f g"
    rows = [(9, text), (4, text), (4, text), (None, text), (4, "x y z"), (7, "X y z"), (2, None), (3, "")]
    got = as_set(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id IS NOT NULL")))
    assert got == [(2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 3, 4), (4, 3, 4), (7, 1, 4), (9, 3, 4)]
    none = [r for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is None]
    assert len(none) == 1 and none[0].component_id is None
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4]


def test_line_overlaps_in_bulk():
    import numpy as np
    import pyarrow as pa

    from broadloom.llm.fuzzy_lines import line_overlaps, line_sets
    from broadloom.llm.tokens import WordHasher

    left = ["a plain line of words", "short", "Grüße aus München, alle", "x", "aaaaaaaaaaaaaaaaaaaa", "ABC def ghi jkl"]
    right = ["a plain line of word", "short", "Grüße aus Münchem, alle", "y", "aaaaaaaaaaaaa", "abc def ghi jkm"]
    hasher = WordHasher()
    text = [{x.lower()[i : i + 8] for i in range(max(1, len(x) - 7))} for x in left + right]
    want = [(len(a & b), len(a), len(b)) for a, b in zip(text[:6], text[6:], strict=True)]
    for budget in (1, 1 << 19):
        assert [len(s) for s in line_sets([x.encode() for x in left + right], 8, hasher, budget)] == [len(s) for s in text]
        got = line_overlaps(*(pa.array([x.encode() for x in ["pad", *side]]).slice(1) for side in (left, right)), 8, hasher, budget)
        assert [tuple(x) for x in got.T.tolist()] == want


def test_count_tree_returns_every_pair_that_may_link():
    import numpy as np

    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)) for n in rng.integers(5, 90, size=40)]
    sets = base + [np.unique(np.concatenate([s[: len(s) * 9 // 10], s[:1] + np.uint64(1)])) for s in base]
    vectors, sizes = np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = CountTree(vectors, sizes)
    for i, s in enumerate(sets):
        near = set(tree.search(vectors[i], sizes[i], 75, 100).tolist())
        assert near >= {j for j, t in enumerate(sets) if enough(len(np.intersect1d(s, t)), len(s), len(t), 75, 100)}
        assert near == {j for j in range(len(sets)) if enough(np.minimum(vectors[i], vectors[j]).sum(), sizes[i], sizes[j], 75, 100)}


def test_substring_dedup_matches_brute_force(spark):
    for seed, options in ((1, {"group_windows": 20}), (3, {"group_windows": 300}), (5, {"anchor": 8, "lengths": (8, 12, 20)}), (6, {})):
        rows = corpus(seed)
        got = as_set(dedup_substrings(frame(spark, rows, 5), **options).select("doc_id", "n_words", "n_removed", "kept_sha256"))
        want = brute.substring_dedup([(r[0], r[1]) for r in rows])
        assert sum(r[2] for r in want) > 300
        assert got == want


def test_suffix_subtree_in_pieces(spark):
    import numpy as np

    from broadloom.llm.substrings import Subtree, grow

    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 4000).astype(np.uint8)
    anchor, off = np.arange(20, 3900), np.arange(20, 3900) % 5
    path = [(o, *words[a : a + 9 - o], *words[a - o : a][::-1]) for a, o in zip(anchor.tolist(), off.tolist(), strict=True)]
    left, node = grow(words, anchor, off, np.zeros(len(anchor), np.uint64), 9)
    alike: dict = {}
    for i, p in enumerate(path):
        alike.setdefault(p, set()).add(i)
    assert {frozenset(left[node == n].tolist()) for n in set(node.tolist())} == {frozenset(v) for v in alike.values() if len(v) > 1}
    tree, found = Subtree(9, 50), []
    for doc in range(300):  # each brings one window of ten, and one of its own
        section = (np.array([doc, doc]), np.array([0, 50]), np.array([1, 1]), np.concatenate([np.arange(9) + doc % 10 * 9, np.full(9, 100 + doc)]).astype(np.uint8), np.array([0, 1 + doc], np.uint64))
        found += list(tree.add(*section))
    found += list(tree.solve())
    assert sorted(d for ids, _ in found for d in ids.tolist()) == list(range(10, 300)) and tree.n == 310


def test_windows_whose_words_share_all_letters_are_told_apart_by_the_last_edge():
    import numpy as np

    from broadloom.llm.substrings import grow

    anchor, off = np.arange(20, 420, 20), np.zeros(20, np.int64)
    last = np.arange(20, dtype=np.uint64) // np.uint64(2) << np.uint64(32)  # only the uppermost bits differ
    left, node = grow(np.zeros(440, np.uint8), anchor, off, last, 20)
    assert sorted(map(sorted, (left[node == n].tolist() for n in set(node.tolist())))) == [[i, i + 1] for i in range(0, 20, 2)]


def test_maximal_repeats(spark):
    from broadloom.llm.substrings import maximal_repeats

    passage = " ".join(f"p{i}" for i in range(57))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(30)) + " " + passage + f" end{i}") for i in range(3)]
    assert as_set(maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 30, 57), (2, 30, 57)]


def test_substring_dedup_edges(spark):
    loop = " ".join("a b c".split() * 30)
    rows = [(5, loop), (5, loop), (8, loop), (None, loop), (1, None), (2, " \n"), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit(1)).withColumn("marks", F.lit("x"))
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in dedup_substrings(df).collect())
    inner = next(r[2] for r in brute.substring_dedup([(5, loop)]))
    assert got == [(0, 90, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (5, 90, inner), (5, 90, inner), (8, 90, 90)]
    assert dedup_substrings(frame(spark, [])).count() == 0
    own = " ".join(f"w{i}" for i in range(30))
    mixed = [(1, own), (2, "x y"), (2, own + " " + own), (2, " ".join(f"v{i}" for i in range(70)))]
    got = as_set(dedup_substrings(spark.createDataFrame(mixed, "doc_id long, text string")).select("doc_id", "n_words", "n_removed"))
    assert got == [(1, 30, 0), (2, 2, 0), (2, 60, 60), (2, 70, 0)]


def line_classes_plainly(rows, k=8):
    """{(doc_id, line number)} of the first line of each class (single links by exact Jaccard)."""
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    distinct = sorted({x for _, _, x in lines})
    low = [x.translate({c: c + 32 for c in range(65, 91)}) for x in distinct]
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in low]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    first: dict = {}
    number = {x: i for i, x in enumerate(distinct)}
    for d, i, x in sorted(lines):
        first.setdefault(find(number[x]), (d, i))
    return set(first.values())


def brute_lines(rows, k=8):
    """Lines of each document that are not the first of their class."""
    first, gone = line_classes_plainly(rows, k), {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if brute.WORD.search(x) and (d, i) not in first:
                gone[d] = gone.get(d, 0) + 1
    return gone


def test_fuzzy_lines_match_brute_force(spark):
    rows = corpus(seed=4)
    want = brute_lines([(r[0], r[1]) for r in rows])
    got = {r.doc_id: r.n_removed for r in line_report(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    total = sum(want.values())
    assert total > 200
    assert abs(sum(got.values()) - total) <= 0.02 * total  # banding recalls nearly all near copies
    exact: dict = {}
    for d, _, _, x in sorted((r[0], 0, 0, x) for r in rows for x in (r[1] or "").split("\n") if x.strip()):
        exact.setdefault(x, []).append(d)
    assert all(sum(got[d] for d in set(v)) >= len(v) - 1 for v in exact.values())  # equal lines always


def test_fuzzy_lines_meet_at_the_threshold(spark):
    rng, n, rows = random.Random(8), 2000, []
    for i in range(n):  # 280 shingles, 240 of them common: similarity 240 / 320
        line = [rng.choice("bcdfghklmnprstvz") for _ in range(287)]
        near = ["a" if at in (47, 95, 143, 191, 239) else c for at, c in enumerate(line)]
        rows.append((i, "".join(line) + "\n" + "".join(near), "en", "src0", 0))
    found = line_classes(frame(spark, rows)).groupBy("component").count()
    assert found.filter("count > 2").isEmpty()
    assert found.count() >= 0.985 * n  # 0.989 by the formula for 12 bands, 0.967 for 9


def test_fuzzy_lines_edges(spark):
    rows = [(2, "same line here\n\n \nother text of this row"), (1, "same line here"), (3, "SAME line here"), (4, "x\ny"), (5, "x"), (None, "same line here"), (6, None), (7, ""), (1, "same line here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("line", F.lit(1)).withColumn("tie", F.lit(1))
    out = {(r.doc_id, r.text) for r in without_line_copies(df).collect()}
    assert out == {(2, "\n \nother text of this row"), (1, "same line here"), (3, ""), (4, "x\ny"), (5, ""), (None, "same line here"), (6, None), (7, "")}
    assert without_line_copies(df).count() == len(rows)
    assert without_line_copies(spark.createDataFrame([], SCHEMA)).count() == 0
