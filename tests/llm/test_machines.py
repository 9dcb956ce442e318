"""Token counts, turn repair and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.brute import WORD
from tests.llm.helpers import SCHEMA, corpus, frame

SF = "/root/testdata/sf0.01"


# ---- op11


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def counts(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def odd_texts(rng):
    atoms = ["a", "b", "s", "t", "'", " ", "  ", "\n", "\t", "re", "ve", "ll", "d", "12", "!", "?", "é", "中", "\xa0", "'s", "'re", "'r", "'l", " ", "\x1c", "\x85", "٣", "Ⅷ", "́", "\U0001f600", "<|endoftext|>", "<|endof"]
    out = ["".join(rng.choice(atoms) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(0, 40))) for _ in range(1000)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    return out + [c * n for c in "a= é中'" for n in (1, 2, 63, 64, 65, 1000)] + ["", "x" * 200_000, " " * 100_000 + "x", "ab" * 50_000]


def test_token_counts_equal_the_librarys(spark, tokenizer):
    from broadloom.llm.token_counts import token_counts
    import public_tokenizers

    texts = odd_texts(random.Random(5))
    docs = spark.createDataFrame([(i, t, "x", None, i) for i, t in enumerate(texts)], SCHEMA)
    got = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).sort("doc_id").collect()
    want = counts(tokenizer, texts)
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(i, len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want, strict=True))]


def test_token_counts_of_the_documents(spark, tokenizer):
    from broadloom.llm.queries import LLM_QUERIES

    got = {r.doc_id: r.n_tokens for r in LLM_QUERIES["op11_token_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], counts(tokenizer, [r.text or "" for r in rows]), strict=True))


def test_a_full_table_changes_no_count(tokenizer):
    import public_tokenizers

    from broadloom.llm.token_counts import count_tokens
    from broadloom.llm.token_machine import Machine, Splitter

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        machine = Machine(f.read(), most=50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 300))) for _ in range(300)] + ["".join(rng.choice("abcdefgh") for _ in range(20_000))]
    assert count_tokens(texts, Splitter(), machine).tolist() == counts(tokenizer, texts)


def test_splitting_by_chunk_maps_equals_the_pattern(tokenizer):
    import public_tokenizers
    import regex

    from broadloom.llm.token_machine import Splitter

    splitter, rng = Splitter(), random.Random(7)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["'", "s", "r", "e", "l", "x", " ", "\n", "1", "."]) for _ in range(rng.randrange(1, 300)))
        kinds = splitter.kinds(np.array([ord(c) for c in text] + [0x110000]))
        assert np.flatnonzero(splitter.borders(kinds)[:-1]).tolist() == [m.start() for m in pattern.finditer(text)]


# ---- op12

EDITS = {"K": 0, "R": 1, "D": 2, "I": 5}


def least_repair(rows):
    """rows: [(role, text, must_go, cut_off)] -> (cost, audit, lines), by all edits of each row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("p", "u"): "u", ("u", "a"): "p"}
    made = {"": "user", "s": "user", "p": "user", "u": "assistant"}
    layer = {"": (0, "", ())}  # grammar state -> least (cost, audit) and its lines

    def better(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(layer):
        todo = list(layer.items())
        while todo:
            state, (c, a, w) = todo.pop()
            role = made[state]
            new, value = step[state, role[0]], (c + 5, a + "I", (*w, f"{role}:"))
            if c < 4 * len(rows) + 20 and (new not in layer or value[:2] < layer[new][:2]):
                layer[new] = value
                todo.append((new, value))
        return layer

    layer = inserted(layer)
    for role, text, must_go, cut_off in rows:
        nxt = {}
        for state, (c, a, w) in layer.items():
            better(nxt, state, (c + 2, a + "D", w))
            if not must_go:
                if (new := step.get((state, role[:1]))) is not None:
                    better(nxt, new, (c + 5 * cut_off, a + "K", (*w, f"{role}:{text}")))
                better(nxt, step[state, made[state][0]], (c + 1 + 5 * cut_off, a + "R", (*w, f"{made[state]}:{text}")))
        layer = inserted(nxt)
    return min(layer[s] for s in ("", "p") if s in layer)


def plain_report(rows):
    """rows: [(conv_id, turn, role, text)] before damage."""
    out, by = [], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, n = set(), [], [0, 0, 0]
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else 3
            if fault < 3:
                n[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault < 2, fault == 2))
        cost, audit, lines = least_repair(judged)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n, longest=9):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No", "  \n", "", None, "So? ", "Well! \n", "a. b"])))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def report(spark, rows, parts=3):
    from broadloom.llm.conversations import damaged, repair_report

    return sorted((tuple(r) for r in repair_report(damaged(spark.createDataFrame(rows, TURNS).repartition(parts))).collect()), key=str)


def test_repair_equals_all_edits(spark):
    rows = conversations(random.Random(4), 400)
    assert report(spark, rows) == plain_report(rows)


def test_repair_of_the_conversations(spark):
    from broadloom.llm.queries import LLM_QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in LLM_QUERIES["op12_repair_turns"](spark, SF).collect()), key=str) == plain_report(rows)


def test_a_conversation_over_many_packs(spark):
    """One with half of all turns, cut by tasks and by size."""
    rng = random.Random(8)
    rows = conversations(rng, 60)
    for turn in range(9000):
        rows.append((7777, turn, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice('abcdef')}{rng.randrange(4000)}{rng.choice(['.', '', ''])}"))
    assert report(spark, rows) == plain_report(rows)


def test_repeated_rows_and_dropped_conversations(spark):
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(1, 1, "user", "a.")] * 6000 + [(2, None, None, None)] * 3 + [(dropped, 0, "user", "gone.")] + [(3, 5, "user", "Q?"), (3, 6, "assistant", "A.")]
    got = report(spark, rows)
    assert got == plain_report(rows)
    assert next(r for r in got if r[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(spark, rows[:1]) == plain_report(rows[:1])


def test_no_conversations_at_all(spark):
    from broadloom.llm.conversations import damaged, repair_report

    assert repair_report(damaged(spark.createDataFrame([], TURNS))).collect() == []


def test_repaired_turns_follow_the_grammar(spark):
    from broadloom.llm.conversations import counted, repaired_conversations

    rows = conversations(random.Random(9), 80) + [(500, i, "user", f"t{i}.") for i in range(5000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", place int, roles string")
    by = {}
    for r in repaired_conversations(counted(frame)).collect():
        by.setdefault(r.conv_id, []).append((r.part, r.place, r.role))
    for turns in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, _, r in sorted(turns)))
    assert len(by[500]) == 5000  # every other one made the assistant's


def test_chunks_compose_to_the_whole():
    from broadloom.llm import turns as T

    rng = random.Random(3)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 5, 6, 9, 10]) for _ in range(rng.randrange(0, 300)))
        whole = T.repair(codes)
        cut = rng.randrange(0, len(codes) + 1)
        end = T.behind(T.matrix(codes[cut:]), T.FINAL)
        a, state, cost = T.repair(codes[:cut], T.NOTHING, end)
        b, _, _ = T.repair(codes[cut:], state)
        assert (a + b, cost) == (whole[0], whole[2])


# ---- op13


def plain_runs(words, least=24):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 3 * q) and not any(all(words[j] == words[j + p] for j in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_report(docs):
    from fractions import Fraction

    out = []
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        n = len(w)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((doc_id, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def periodic_texts(rng, n):
    out = []
    for _ in range(n):
        size = rng.randrange(0, 140)
        w = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(size)]
        if size and rng.random() < 0.7:
            a, p = rng.randrange(size), rng.randrange(1, 12)
            w[a:] = [w[min(size - 1, a + (i - a) % p)] for i in range(a, size)]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def test_runs_equal_plain_search(spark):
    from broadloom.llm.runs import periodic_runs

    texts = periodic_texts(random.Random(6), 900) + [None, "", " \n", "a " * 5000, "é中 " * 30, "x"]
    rows = [(i - 3, t, "en", None, 0) for i, t in enumerate(texts)] + [(None, "b " * 40, None, None, None), (5, texts[8], "en", "s", 1)]
    got = periodic_runs(frame(spark, rows), damage=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_run_report([(r[0], r[1]) for r in rows])


def test_runs_of_the_documents(spark):
    from broadloom.llm.queries import LLM_QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    ids = {d for d, _ in rows}
    got = [tuple(r) for r in LLM_QUERIES["op13_periodic_runs"](spark, SF).collect() if r.doc_id in ids]
    assert sorted(got, key=str) == plain_run_report(rows)


def test_without_runs_and_empty_tables(spark):
    from broadloom.llm.runs import periodic_runs, without_runs

    docs = spark.createDataFrame([(1, "go  on\nnow", "x", None, 0), (2, "a b c " * 20 + "end", "x", None, 0), (3, None, None, None, None)], SCHEMA)
    assert {(r.doc_id, r.text, r.n_dropped) for r in without_runs(docs).collect()} == {(1, "go  on\nnow", 0), (2, "a b c end", 57), (3, "", 0)}
    assert periodic_runs(docs.limit(0)).collect() == []


def test_a_long_periodic_text(spark):
    from broadloom.llm.runs import periodic_runs

    text = "one two three four five six seven " * 40_000
    row = periodic_runs(spark.createDataFrame([(1, text, None, None, None)], SCHEMA)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 280_000, 7)


def test_machines_take_odd_tables(spark):
    """Clashing names and the usual fixture of odd documents."""
    from pyspark.sql import functions as F

    from broadloom.llm.runs import periodic_runs
    from broadloom.llm.token_counts import token_counts
    import public_tokenizers

    docs = frame(spark, corpus()).withColumns({c: F.lit(None).cast("string") for c in ("n_tokens", "n_runs", "start", "word", "part", "text_2", "key")})
    n = docs.count()
    assert periodic_runs(docs, damage=True).count() == n
    assert token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n
