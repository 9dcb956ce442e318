"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit
substitutions, normalised by length, with exception phrases.

The lexicon starts from a short list of insults and grows by word beginnings and whole words
that labelled toxic documents hold far more often than clean ones; a logistic curve over the
summed weights, their density per word and the strongest hit gives the score.

Defined cases: null or empty text scores as a text without hits; rows that repeat a doc_id
are scored each; of several labels of one doc_id the smallest counts; a null doc_id is
scored, held_out false. Without labels of both kinds the listed words alone decide by a
fixed curve. Empty tables give an empty result. Texts of any length are matched whole, n log n
in their hits. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.quality_net import held_out, sampled_labels
from broadloom.llm.shared import materialize, texts

#: Insults that start the lexicon.
SEED_WORDS = ["idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "loser", "clown", "disgusting", "imbecile", "vermin", "filth", "retard", "bastard", "dumbass", "subhuman"]
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "clown fish", "clownfish", "idiot proof", "idiot-proof", "pathetic fallacy", "sore loser rule", "scum of the pond", "stupid simple"]
#: Characters drawn alike, and the Latin letter each stands for.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "м": "m", "т": "t", "к": "k", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ⅼ": "l", "ɡ": "g"}
#: Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

WORD = re.compile(r"[^\W_]+")


def folding() -> dict[int, str]:
    """One table for str.translate: full-width forms, homoglyphs, substitutions, and
    characters of no width, which go."""
    table = {ord(k): v for k, v in (HOMOGLYPHS | LEET).items()}
    table |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
    return table | {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def fold(text: str, table: dict[int, str]) -> str:
    return text.lower().translate(table)


def matcher(weights: dict[str, float], exceptions: list[str], table: dict[int, str]):
    """text -> (summed weight, words, strongest weight, hits). An entry counts where a word
    begins; one that ends in a space counts only where the word ends too. Of the entries
    that match at one place the heaviest counts; an exception phrase silences what it
    covers."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w, weight in weights.items():
        auto.add_word(w.rstrip(), (len(w.rstrip()), weight, w.endswith(" ")))
    for phrase in exceptions:
        auto.add_word(fold(phrase, table), (len(fold(phrase, table)), None, True))
    if len(auto):
        auto.make_automaton()

    def measure(text: str) -> tuple[float, int, float, int]:
        folded = fold(text, table)
        best: dict[int, float] = {}
        quiet: list[tuple[int, int]] = []
        for last, (n, weight, whole) in auto.iter(folded) if len(auto) else ():
            at = last - n + 1
            if at and folded[at - 1].isalnum() or whole and last + 1 < len(folded) and folded[last + 1].isalnum():
                continue
            if weight is None:
                quiet.append((at, last))
            else:
                best[at] = max(best.get(at, -9e9), weight)
        if quiet:
            quiet.sort()
            begins = [a for a, _ in quiet]
            reach = list(accumulate((b for _, b in quiet), max))  # of the phrases up to each
            best = {at: w for at, w in best.items() if not ((i := bisect_right(begins, at)) and reach[i - 1] >= at)}
        return sum(best.values()), folded.count(" ") + 1, max(best.values(), default=0.0), len(best)

    return measure


def features(measured: tuple[float, int, float, int]) -> list[float]:
    total, words, top, hits = measured
    return [math.log1p(max(0.0, total)), min(3.0, 20 * total / (words + 20)), top / 5, math.log1p(hits), hits / (words + 20) * 20]


def learn_words(rows: DataFrame, toxic: int, clean: int, least: int = 3, odds: float = 2.5, most: int = 20_000) -> dict[str, float]:
    """Word beginnings (4 to 12 letters) and whole words by smoothed log odds of being in a
    toxic document. rows: text, y. Counted by Spark; at most ``most`` entries return."""
    table = folding()

    def found(batches):
        for batch in batches:
            entries, ys = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for w in set(WORD.findall(fold(text, table))):
                    own.update(w[:k] for k in range(4, min(12, len(w)) + 1))
                    if 3 <= len(w) <= 24:
                        own.add(w + " ")
                entries += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(ys, pa.int32())], names=["entry", "y"])

    counted = rows.mapInArrow(found, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    score = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = counted.filter(F.col("t") >= least).withColumn("w", score).filter(F.col("w") >= odds)
    top = {r["entry"]: (r["w"], r["t"], r["c"]) for r in kept.orderBy(F.desc("w"), "entry").limit(most).collect()}
    # a longer beginning that adds no certainty to a shorter one is the same evidence
    return {e: w for e, (w, t, c) in top.items() if not any(e[:k] in top and top[e[:k]][0] >= w - 0.35 for k in range(4, len(e.rstrip())))}


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge penalty; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ b)
        b = b + move
        if np.abs(move).max() < 1e-8:
            break
    return b


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seeds=tuple(SEED_WORDS), exceptions=tuple(EXCEPTIONS), cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, a row per row.
    Learns from at most about ``sample`` labelled rows outside the held-out fold."""
    chosen = sampled_labels(labels, "toxic", 3, 1, sample)
    rows = materialize(texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "y"))  # the sample, read several times
    count = rows.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(count["t"] or 0), int(count["n"] - (count["t"] or 0))
    weights = {fold(w, folding()): 5.0 for w in seeds}
    curve = np.array([1.0, 0.0, 1.0, 0.0, 2.0, -4.0])
    if toxic and clean:
        # words are learnt on one half and the curve on the other, so that the curve sees
        # the lexicon err as it will on new documents
        half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)) == 0
        curve_lexicon = weights | learn_words(rows.filter(half), max(1, toxic // 2), max(1, clean // 2))
        got = rows.filter(~half).mapInArrow(_measured(curve_lexicon, exceptions, "y"), "key long, x array<double>").collect()
        x, y = np.array([r["x"] for r in got]), np.array([r["key"] for r in got], float)
        if len(set(y)) == 2:
            curve = logistic(x, y)
        weights |= learn_words(rows, toxic, clean)
    scored = texts(docs).mapInArrow(_measured(weights, exceptions, "doc_id"), "key long, x array<double>")
    z = F.lit(float(curve[-1]))
    for i, c in enumerate(curve[:-1].tolist()):
        z = z + F.col("x")[i] * F.lit(c)
    scored = scored.select(F.col("key").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _measured(weights: dict[str, float], exceptions, key: str):
    def run(batches):
        measure = matcher(weights, list(exceptions), folding())
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
            x = [features(measure(t.as_py())) for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(x, pa.list_(pa.float64()))], names=["key", "x"])

    return run
