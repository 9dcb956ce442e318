"""Operators and the pipeline against single-process versions on small documents."""

import math
import random
import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from broadloom.llm import mixing, quality_net, toxicity
from broadloom.llm.decontaminate import MASKS, SHORT_MASKS, contaminated
from broadloom.llm.fuzzy_lines import without_line_copies
from broadloom.llm.tokens import WordHasher
from tests.llm import brute
from tests.llm.helpers import corpus, frame, prose
from tests.llm.test_pairs import line_classes_plainly
from tests.llm.test_rows import longest_overlap

#: Names that operators use inside.
CLASHES = ["y", "_gone", "_id", "_tie", "_t", "_leak", "_quality_score", "n", "node", "component", "kept", "gone", "tie", "words", "lines", "score", "x", "key", "seed", "sid", "block", "marks", "group", "u", "v", "c", "text_", "mix_words_"]


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def leaks_plainly(docs, items, overlap=13, tolerance=0.25):
    """Every alignment of every document and item."""
    low = lambda t: brute.WORD.findall((t or "").lower())
    found = set()
    for d, text in docs:
        w = low(text)
        for i, passage in items:
            p = low(passage)
            for offset in range(1 - len(p), len(w)):
                a, b = max(0, -offset), min(len(p), len(w) - offset)
                same = [p[k] == w[offset + k] for k in range(a, b)]
                if not any(same):
                    continue
                n, equal = (len(same), sum(same)) if sum(same) >= (1 - tolerance) * len(p) else longest_overlap(same, tolerance)
                if n >= min(overlap, len(p)) and n - equal <= tolerance * n:
                    found.add((d, i))
    return found


def leak_case(seed, n=60):
    rng = random.Random(seed)
    items = [(i, prose(rng, k)) for i, k in enumerate((40, 25, 18, 14, 9, 7, 4, 2))] + [(50, None), (51, "")]
    docs = []
    for k in range(n):
        words = prose(rng, rng.randrange(3, 60)).split()
        if k % 2:
            p = items[rng.randrange(8)][1].split()
            cut = p[rng.randrange(len(p)) // 2 :]
            words += [w if rng.random() > 0.15 else "CHANGED" for w in cut] + prose(rng, 8).split()
        docs.append((k, " ".join(words)))
    return docs + [(90, None), (91, "")], items


def test_leaks_match_all_alignments(spark):
    docs, items = leak_case(3, 120)
    want = leaks_plainly(docs, items)
    assert len(want) > 20
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 0):
        assert {(r.doc_id, r.item_id) for r in contaminated(d, i, least=1, broadcast_words=words).collect()} == want
    assert {(r.doc_id, r.item_id) for r in contaminated(d, i).collect()} == leaks_plainly(docs, [x for x in items if len((x[1] or "").split()) >= 8])


def test_no_placement_of_changed_words_hides_all_seeds():
    def lost(masks, n, k):
        seeds = [sum(1 << (at + j) for j, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]
        return sum(all(gone & s for s in seeds) for gone in (sum(1 << i for i in c) for c in combinations(range(n), k)))

    assert [lost(MASKS, n, n // 4) for n in range(13, 22)] == [0] * 9
    assert [lost(SHORT_MASKS, n, n // 4) for n in range(4, 13)] == [0] * 9


def test_a_text_full_of_exception_phrases():
    measure = toxicity.matcher({"idiot": 5.0, "trash": 5.0}, ["trash can"], toxicity.folding())
    began = time.perf_counter()
    total, words, top, hits = measure("trash can idiot " * 100_000)
    assert (total, top, hits) == (500_000.0, 5.0, 100_000) and time.perf_counter() - began < 20


def mix_plainly(docs, block, weights=(3, 1, 2), share=1.5, most=2.0, seed=17):
    """(doc_id, taken): each source's stream, its quota of slots and the blocks that they read."""
    sizes, streams = {}, {}
    for d, text, source in sorted(docs):
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
        streams.setdefault(source, []).append((d, len(brute.WORD.findall(text or ""))))
    goal = mixing.targets(list(sizes.items()), list(weights), share, most)
    taken = {}
    for sid, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        n = -(-sizes[source] // block)
        reads = [0] * n
        wanted = goal[source] / block if sizes[source] % block == 0 else goal[source] * n / sizes[source] if n else 0
        for i in range(min(round(wanted), int(most * n))):
            reads[int(mixing.permuted(np.array([i % n]), n, seed * 1_000_003 + sid * 1009 + i // n)[0])] += 1
        at = 0
        for d, size in streams[source]:
            taken[d] = sum(reads[k // block] for k in range(at, at + size))
            at += size
    return taken


def test_mix_matches_a_single_process(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["a", "b", "b", "é", None])) for i in range(120)] + [(500, None, "a"), (501, " ", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix_report(df, block=16, shard_slots=64).collect()}
    assert got == mix_plainly(docs, 16)
    kept = {r.doc_id: r.mix_words for r in mixing.mixed_documents(with_clashes(df), block=16, shard_slots=64).collect()}
    assert kept == {d: n for d, n in got.items() if n}


def test_fuzzy_lines_keep_the_text_of_brute_force(spark):
    rng = random.Random(14)
    rows = [(r[0], r[1]) for r in corpus(seed=9, n=40)]
    base = [prose(rng, 14).replace("\n", " ") for _ in range(30)]
    for i in range(60):
        lines = [rng.choice(base) for _ in range(3)] + [prose(rng, 12).replace("\n", " ")]
        lines = [x if rng.random() < 0.5 else x.replace(x.split()[3], "other", 1) for x in lines]
        rows.append((1000 + i, "\n".join(lines) + "\n\n"))
    first = line_classes_plainly(rows)
    want = {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if not brute.WORD.search(x) or (d, i) in first) for d, t in rows}
    got = {r.doc_id: r.text or "" for r in without_line_copies(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    wrong = [d for d in want if want[d] != got[d]]
    assert len(wrong) <= 0.02 * len(want)  # banding may miss a pair
    assert all(set(want[d].split("\n")) <= set(got[d].split("\n")) for d in want)  # what is removed has a copy


def test_word_table_and_network_match_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a", "B c\nd", "", None, "x", "one TWO 3 four! five six"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    buckets, dims, nonzero = 32, 8, 2
    got = quality_net.word_table(df, buckets, dims, nonzero)
    want = np.zeros_like(got)
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        word, shape, h, _ = quality_net.word_rows(data, np.array([0, len(data)]), WordHasher(), buckets)
        for i in range(len(h)):
            for row, keys in ((word[i], h), (buckets + shape[i], shape.astype(np.uint64))):
                want[row, dims] += 1
                for j in (i - 1, i + 1):
                    if 0 <= j < len(h):
                        place, sign = quality_net.index_places(keys[j : j + 1], dims, nonzero)
                        for p, s in zip(place[:, 0], sign[:, 0], strict=True):
                            want[row, p] += s
    assert np.array_equal(got, want)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    net = quality_net.TwoLayerNet(hidden=4, epochs=5).fit(x, (x[:, 0] > 0).astype(float))
    for v, p in zip(x[:20], net(x[:20]), strict=True):
        z = [(a - m) / s for a, m, s in zip(v, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, net.p[0][:, k], strict=True)) + net.p[1][k]) for k in range(4)]
        logit = sum(a * w for a, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]
        assert abs(p - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9


def test_quality_scores_do_not_hang_on_the_dealing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) if i % 2 else "BUY NOW!!! " * 20) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 2)] + [(i, 1, 0) for i in range(1, 80, 3)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in quality_net.quality_scores(x, labels).collect()} for x in (df.repartition(2), df.repartition(7)))
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)
    kept = quality_net.good_documents(with_clashes(df), labels)
    assert set(kept.columns) == {"doc_id", "text", *CLASHES} and {r.doc_id for r in kept.collect()} == {d for d, s in a.items() if s >= 0.3}


def hits_plainly(weights, exceptions, text):
    """Every entry at every place, without an automaton."""
    folded = toxicity.fold(text, toxicity.folding())
    ends = lambda i: i >= len(folded) or not folded[i].isalnum()
    begins = lambda i: i == 0 or not folded[i - 1].isalnum()
    quiet = set()
    for e in exceptions:
        for i in range(len(folded)):
            if folded.startswith(e, i) and begins(i) and ends(i + len(e)):
                quiet |= set(range(i, i + len(e)))
    best = {}
    for w, weight in weights.items():
        bare = w.rstrip()
        for i in range(len(folded)):
            if folded.startswith(bare, i) and begins(i) and (w == bare or ends(i + len(bare))) and i not in quiet:
                best[i] = max(best.get(i, -9e9), weight)
    return sum(best.values()), folded.count(" ") + 1, max(best.values(), default=0.0), len(best)


def test_lexicon_matches_a_plain_search():
    rng = random.Random(4)
    weights = {"idiot": 5.0, "idi": 1.5, "scum ": 4.0, "trash": 3.0, "trashy": 3.5, "lo ": 0.5}
    exceptions = ["trash can", "scum of the pond"]
    measure = toxicity.matcher(weights, exceptions, toxicity.folding())
    parts = ["idiot", "1d10t", "scum", "scum of the pond", "trash", "trash can", "trashy", "TRASH CAN", "lo", "low", " ", "-", "х", "idiоt", "​"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", ",", "\n"]) for _ in range(rng.randrange(0, 9)))
        assert measure(text) == hits_plainly(weights, exceptions, text), text


def test_scores_on_odd_tables(spark):
    schema = "doc_id long, text string"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "you idiot " * 20_000), (1, "you idiot " * 20_000), (None, None), (3, "word " * 200_000)]
    df = with_clashes(spark.createDataFrame(rows, schema))
    out = toxicity.toxicity_scores(df, labels).collect()
    assert len(out) == 4 and len({(r.doc_id, r.score) for r in out}) == 3
    assert toxicity.toxicity_scores(df.limit(0), labels).count() == 0


def write_tables(spark, folder, docs, items, labels):
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def pipeline_plainly(docs, items):
    """Stages 2 to 5 over documents that the classifier keeps."""
    first = line_classes_plainly([(d, t) for d, t, *_ in docs])
    kept = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not brute.WORD.search(x) or (d, i) in first) for d, t, *_ in docs}
    source = {d: s for d, _, _, s, _ in docs}
    stay = [d for d, _, c in brute.jaccard_components(list(kept.items())) if d == c]
    leaks = {d for d, _ in leaks_plainly([(d, kept[d]) for d in stay], items)}
    clean = [d for d in stay if d not in leaks]
    taken = mix_plainly([(d, kept[d], source[d]) for d in clean], 64)
    return {d: (kept[d], taken[d]) for d in clean if taken[d]}


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    docs, items = leak_case(5, n=40)
    items = [x for x in items if len(brute.WORD.findall(x[1] or "")) > 7]
    texts = ["\n".join(x.strip() for x in t.replace(" ", "  ").split("\n")).replace("  ", " ") for _, t in docs if t]
    texts += ["\n".join(prose(rng, 20).replace("\n", " ") for _ in range(6)) for _ in range(25)]
    texts += [t + "\nshared license line of all these documents" for t in texts[-12:]]  # near copies
    texts += texts[:6] + ["a short one", "a short one"]
    rows = [(i * 2 + 1, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    write_tables(spark, tmp_path, rows, items, [(1, None, None)])
    want = pipeline_plainly(rows, items)
    got = {r.doc_id: (r.text, r.mix_words) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 20 < len(want) < len(rows) and got == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    odd = [(None, "no id at all", "en", "s", 1), (1, None, None, None, None), (1, "twice", "en", "s", 5), (1, "twice", "en", "s", 5), (2, "", "en", None, 0), (3, "w " * 300_000, "en", "s", 600_000)]
    for name, rows in (("empty", []), ("odd", odd)):
        write_tables(spark, f"{tmp_path}/{name}", rows, [], [])
        docs = with_clashes(spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"))
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.materialize(stage(spark, docs, f"{tmp_path}/{name}"))
            assert set(docs.columns) <= set(out.columns) and (i == 4 or out.columns == docs.columns)
            docs = out
        assert docs.filter("_gone = 'own _gone'").count() == docs.count()
