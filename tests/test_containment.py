"""Containment of names in texts, against looking everywhere."""

import random
import re

from broadloom.operators import containment as C

WORD = re.compile(r"[^\W_]+")


def plain(texts, names):
    out = {}
    for i, text in texts:
        w = WORD.findall((text or "").lower())
        for name in set(names) - {None}:
            own = WORD.findall(name.lower())
            at = [k for k in range(len(w) - len(own) + 1) if own and w[k : k + len(own)] == own]
            if at and i is not None:
                out[i, name] = sorted(set(out.get((i, name), [])) | set(at))
    return out


def found(spark, texts, names):
    df = C.contained(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", "body", "name")
    return {(r.id, r.name): r.places for r in df.collect()}


def test_containment_equals_looking_everywhere(spark):
    rng = random.Random(3)
    pool = ["the", "the", "the", "of", "red", "Star", "real", "été", "20", "x"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    texts = [(i, say(rng.randrange(0, 40))) for i in range(80)] + [(90, None), (None, "red star"), (5, "red, STAR; real the of"), (91, "The  (Red)\nStar."), (92, "red")]
    names = [say(rng.randrange(1, 6)) for _ in range(60)] + [None, "", "--", "Red Star", "red star", "nowhere", "the the", "the"]
    want = plain(texts, names)
    assert found(spark, texts, names) == want and len(want) > 200
    assert found(spark, [], names) == {} and found(spark, texts, []) == {}


def test_a_common_word_and_a_long_text(spark):
    text = "a " * 50_000 + "a b c d"
    assert found(spark, [(1, text)], ["a b c", "b c d", "d a", "c d"]) == {(1, "a b c"): [50_000], (1, "b c d"): [50_001], (1, "c d"): [50_002]}


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """The steps read stored words, and all words and pairs come out of one pass."""
    stored = []
    kept = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: (stored.append(df.columns), kept(df))[1])
    assert found(spark, [(1, "Red, star of the RED star"), (2, "star"), (3, ""), (4, None)], ["red star of", "star", "the red"]) == {(1, "red star of"): [0], (1, "star"): [1, 5], (1, "the red"): [3], (2, "star"): [0]}
    assert ["_id", "_words"] in stored
    body = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "_id long, _words array<string>")
    got = sorted((r._id, r.pos, r.gram) for r in C._occurrences(body).collect() if r.gram is not None)
    assert got == [(1, 0, "a"), (1, 0, "a b"), (1, 1, "b"), (1, 1, "b a"), (1, 2, "a"), (2, 0, "c")]
