"""Small documents: prose, exact and near copies, shared passages, edges."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru sa te vi zo".split() for b in "n r s t l mo ka ti".split()]


def prose(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
    return " ".join(words)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    texts += [rng.choice(texts) for _ in range(8)]  # exact copies
    base = prose(rng, 220)
    texts += [changed(rng, base, rng.randrange(1, 9)) for _ in range(25)]  # a group of near copies
    passage = prose(rng, 60)
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(6)]
    long = [prose(rng, 300) for _ in range(3)]
    texts += long + [changed(rng, t, k) for t in long for k in (2, 12, 25)]
    texts += ["", None, " \t\n", "one", "one", "ONE", "one two three four", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "en", f"src{i % 4}" if i % 3 else "src0", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
