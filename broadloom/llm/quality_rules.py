"""Quality rules: learned decision lists. Built-in functions only.

Statistics of each text are Spark expressions. From labelled rows, sequential covering grows
a conjunction of thresholds that singles out bad texts, prunes it on rows it was not grown
on, keeps it if it stays precise, removes what it covers and starts again. The list becomes
one ordered Spark conditional expression, so scoring is a plain projection.

Defined cases: null, empty and word-free texts have zero for every statistic and fail the
base rule; rows that repeat a doc_id are judged each; of several labels of one doc_id the
smallest counts; without labels of both kinds the list is empty and the base rule decides
alone. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.shared import materialize, texts

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8


def repeated_words(words: Column) -> Column:
    """Words in the 8-word windows that occur twice or more in the text.

    Windows are hashed; a text whose hashes are all different (most are) ends there. Else
    equal hashes are brought together by sorting, and the places covered are added up."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        alike = F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["p"]))
        return F.sort_array(F.filter(alike, lambda p: p.isNotNull()))

    def count(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        places = F.transform(F.array(by_hash), twice)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(F.transform(places, covered)[0])

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def hashed(w: Column) -> Column:
        return F.transform(w, lambda x: F.xxhash64(x))

    # each transform over an array of one binds a value once for the function below it
    bound = F.transform(F.transform(F.transform(F.array(words), hashed), windows), count)[0]
    return F.when(F.size(words) >= WINDOW + 1, bound).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    text = F.col("text")
    rows = texts(docs).withColumn("words", F.filter(F.split(text, GAP, -1), lambda x: x != ""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length(text) - without("!?")).cast("long").alias("n_exclaim"),
        (F.length(text) - without("0123456789")).cast("long").alias("n_digits"),
    )


#: What rules may test: name, and the expression over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

Rule = list[tuple[str, str, float]]


def matches(rule: Rule, row: dict) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def learn_rules(rows: list[dict], most_rules: int = 12, most_terms: int = 4, cuts: int = 24, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Sequential covering over rows with the features and ``bad``. Rules in order."""
    names = list(FEATURES)
    x = np.array([[r[f] for f in names] for r in rows], float).reshape(-1, len(names))
    bad = np.array([r["bad"] for r in rows], bool)

    def holds(term: tuple[str, str, float], at: np.ndarray) -> np.ndarray:
        f, op, cut = term
        value = x[at, names.index(f)]
        return value <= cut if op == "<=" else value > cut

    def covered(rule: Rule, at: np.ndarray) -> np.ndarray:
        inside = np.ones(len(at), bool)
        for term in rule:
            inside &= holds(term, at)
        return inside

    rules: list[Rule] = []
    left = np.arange(len(rows))
    while len(rules) < most_rules and bad[left].sum() >= least:
        apart = np.arange(len(left)) % 3 == 0
        grow, prune = left[~apart], left[apart]
        terms = []
        for j, f in enumerate(names):
            values = np.unique(x[grow, j])
            for i in range(1, min(cuts, len(values))):
                at = i * len(values) // min(cuts, len(values))
                cut = float((values[at - 1] + values[at]) / 2)
                terms += [(f, "<=", cut), (f, ">", cut)]
        rule: Rule = []
        inside = grow
        while len(rule) < most_terms and not bad[inside].all() and terms:
            p0 = bad[inside].sum()
            if not p0:
                break
            masks = np.stack([holds(t, inside) for t in terms])
            n, p = masks.sum(1), masks[:, bad[inside]].sum(1)
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - math.log2(p0 / len(inside))), 0.0)
            best = int(np.argmax(gain))
            if gain[best] <= 1e-9:
                break
            rule.append(terms[best])
            inside = inside[masks[best]]

        def worth(r: Rule) -> float:
            got = bad[prune[covered(r, prune)]]
            return (2 * int(got.sum()) - len(got)) / (len(got) + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        caught = covered(rule, left) if rule else np.zeros(len(left), bool)
        n, p = int(caught.sum()), int(bad[left[caught]].sum())
        if n < least or p < precision * n:
            break
        rules.append(rule)
        left = left[~caught]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: 0 if no rule matches, else its number."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, op, cut in rule:
            value = F.expr(FEATURES[f])
            test = test & (value <= cut if op == "<=" else value > cut)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_rows(stats: DataFrame, labels: DataFrame, sample: int) -> list[dict]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    limit = int(min(1.0, sample / max(1, known.count())) * 1_000_000)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < limit)
    few = stats.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *(F.expr(e).alias(f) for f, e in FEATURES.items()))  # at most about ``sample`` ids
    rows = [{f: r[f] for f in FEATURES} | {"bad": 1 - r["y"], "id": r["doc_id"]} for r in few.collect()]
    return sorted(rows, key=lambda r: (r["id"], *(r[f] for f in FEATURES)))  # repeated ids too have one order


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample: int = 5000) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, rule (0: none), a row per row. Rules
    are learnt from at most about ``sample`` labelled rows, chosen by a hash. Statistics are
    computed once and written to the shared folder, for learning and for judging."""
    stats = materialize(statistics(docs))
    rules = learn_rules(labelled_rows(stats, labels, sample))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
