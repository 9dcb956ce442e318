"""PII by weak-supervision aggregation. Built-in functions only.

Base kinds (email, ip, card, phone) are certain by format. Further candidates (local phone
numbers, bank account and social security numbers, names after a title) are uncertain: a
format labeler, a gazetteer labeler and a context labeler each vote yes, no or abstain.
Expectation maximisation over the counted vote patterns of the whole corpus estimates how
reliable each labeler is. Its posteriors train a logistic span classifier over the votes and
over features of the span that no labeler looks at (length, share of digits and capitals,
words, what stands before), emitted as a Spark expression. In training each vote is hidden
in turn, so that the features learn to stand in for a labeler that abstains. Votes and
features take few values each, so the driver sees their counts, a table of bounded size (at
most 28,350 rows a kind) whatever the corpus.

Defined cases: null or empty text has no spans; spans of different base kinds may overlap,
added ones never overlap a base span; rows that repeat a doc_id are searched each; a null
doc_id is an ordinary row; an empty table gives an empty result, and a kind without
candidates has no classifier and adds nothing. Columns other than doc_id and text are
ignored. Texts and single matches of any length are searched in time n log n.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.native_spans import apart, bind, find_spans, named
from broadloom.llm.shared import materialize, texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats (what follows a repeat is never one of its own
#: characters, so nothing is to give back) and starts only where a run begins or the last
#: match ended: the same matches, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: The runs of `[0-9]([\x20-]?[0-9])+` that have 16 to 19 digits: a run begins where no digit,
#: nor a digit and one separator, stands before, and ends where none follows.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9]([\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: First names and titles of the gazetteer, and country codes of bank accounts.
FIRST_NAMES = ["Anna", "Carlos", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Juan", "Laura", "Maria", "Marie", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Thomas"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
ACCOUNT_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]

#: kind: (candidates, strict format, gazetteer, words that speak for it just before)
WEAK = {
    "tel": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", r"^(\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}[.-])[2-9]", r"^\(?(800|888|877|866|212|310|415|617)", r"(?i)(tel|phone|call|fax|mobile|cell)[a-z.:\x20]*$"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){3,7}(\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(\x20?[0-9]){11,}", "^(" + "|".join(ACCOUNT_COUNTRIES) + ")", r"(?i)(iban|account|konto|compte|cuenta|bank)[a-z.:\x20]*$"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^[0-7]", r"(?i)(ssn|social|security)[a-z.:\x20#]*$"),
    "name": (r"(?<![\p{L}])(" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{Ll}+(\x20\p{Lu}\p{Ll}+)?", r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$", r"\x20(" + "|".join(FIRST_NAMES) + r")\b", r"(?i)(dear|name|contact|signed|from|by|by\x20the)[:,\x20]*$"),
}


def luhn(card: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(card, "[^0-9]", "")), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0)))
    return F.aggregate(F.transform(F.filter(digits, lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_in(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    def octets(x: Column) -> Column:
        # longer parts than 9 digits cannot be cast, and are above 255 unless zeros lead
        return F.forall(F.split(x["text"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))

    return {
        "email": find_spans(text, EMAIL),
        "ip": F.filter(find_spans(text, IP), octets),
        "card": F.filter(find_spans(text, CARD), lambda x: luhn(x["text"])),
        "phone": F.filter(find_spans(text, PHONE), lambda x: digits_in(x["text"]).between(8, 15)),
    }


def votes(kind: str, x: Column) -> list[Column]:
    """1 yes, -1 no, 0 abstain, of the format, gazetteer and context labelers."""
    _, strict, gazetteer, context = WEAK[kind]
    return [F.when(x["text"].rlike(strict), F.lit(1)).otherwise(F.lit(-1)), F.when(x["text"].rlike(gazetteer), F.lit(1)).otherwise(F.lit(0)), F.when(x["before"].rlike(context), F.lit(1)).otherwise(F.lit(0))]


#: Features of a span: number of values, and the value (0 to one less).
FEATURES = {
    "digits": (5, lambda x: F.floor(4 * digits_in(x["text"]) / F.length(x["text"]))),
    "capitals": (5, lambda x: F.floor(4 * (F.length(x["text"]) - F.length(F.regexp_replace(x["text"], r"\p{Lu}", ""))) / F.length(x["text"]))),
    "words": (2, lambda x: F.least(F.lit(1), F.length(x["text"]) - F.length(F.translate(x["text"], " ", "")))),
    "length": (7, lambda x: F.least(F.lit(6), F.floor(F.log2(F.length(x["text"]).cast("double"))))),
    "before": (3, lambda x: F.when(x["before"].rlike(r"[:=]\x20*$"), F.lit(2)).when(x["before"].rlike(r"\p{L}\x20*$"), F.lit(1)).otherwise(F.lit(0))),
}


def measured(kind: str, spans: Column) -> Column:
    """Spans with their votes v0, v1, v2 and feature values f0, f1 ..."""
    def one(x: Column) -> Column:
        seen = [v.alias(f"v{i}") for i, v in enumerate(votes(kind, x))] + [f(x).cast("int").alias(f"f{i}") for i, (_, f) in enumerate(FEATURES.values())]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), *seen)

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind (start, end), and the measured weak candidates
    that overlap none of them. Written to the shared folder, so texts are searched once."""
    rows = texts(docs)
    found = rows.select("doc_id", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), *(find_spans(F.col("text"), WEAK[k][0], context=24).alias(f"weak_{k}") for k in WEAK))
    places = found.select("doc_id", *(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS), *(f"weak_{k}" for k in WEAK))
    base = F.concat(*KINDS)

    def free(kind: str) -> Column:
        # bound, so that no lambda computes the arrays again
        return bind(F.struct(F.col(f"weak_{kind}").alias("weak"), base.alias("base")), lambda s: measured(kind, apart(s["weak"], s["base"])))

    return materialize(places.select("doc_id", *KINDS, *(free(k).alias(f"weak_{k}") for k in WEAK)))


def pattern_counts(found: DataFrame) -> dict[str, list[tuple[tuple[int, ...], tuple[int, ...], int]]]:
    """(votes, features, count) by kind, over the candidates of the whole corpus."""
    keys = [f"v{i}" for i in range(3)] + [f"f{i}" for i in range(len(FEATURES))]
    rows = found.select(F.explode(F.concat(*(f"weak_{k}" for k in WEAK))).alias("s")).groupBy("s.kind", *(f"s.{k}" for k in keys)).count()
    out: dict[str, list] = {}
    for kind, *values, n in sorted(tuple(r) for r in rows.collect()):
        out.setdefault(kind, []).append((tuple(values[:3]), tuple(values[3:]), n))
    return out


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.5) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """Posterior that a span is personal, by vote pattern, and each labeler's reliability.

    A labeler speaks for (1), against (-1) or abstains (0), with probabilities that depend on
    the truth; they and the share of true spans are fitted by EM from a start at which every
    labeler is right in four of five cases. Counts are smoothed by one."""
    m = len(counts[0][0])
    true, false = ([{1: a, 0: 0.3, -1: b} for _ in range(m)] for a, b in ((0.56, 0.14), (0.14, 0.56)))
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v, _ in counts:
            yes = prior * math.prod(true[i][x] for i, x in enumerate(v))
            no = (1 - prior) * math.prod(false[i][x] for i, x in enumerate(v))
            post[v] = yes / (yes + no)
        total = sum(n for _, n in counts)
        prior = min(0.95, max(0.05, sum(post[v] * n for v, n in counts) / total))
        for i in range(m):
            for table, weight in ((true, lambda v: post[v]), (false, lambda v: 1 - post[v])):
                mass = {x: 1.0 + sum(weight(v) * n for v, n in counts if v[i] == x) for x in (1, 0, -1)}
                table[i] = {x: mass[x] / sum(mass.values()) for x in mass}
    return post, [prior * true[i][1] + (1 - prior) * false[i][-1] for i in range(m)]


def train(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], post: dict[tuple[int, ...], float], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights over the votes, then each value of each feature, constant last,
    fitted to the posteriors; each vote is hidden in turn."""
    values = [n for n, _ in FEATURES.values()]
    votes_, feats = np.array([p[0] for p in patterns], float), np.array([p[1] for p in patterns])
    weight, want = np.array([p[2] for p in patterns], float), np.array([post[p[0]] for p in patterns])
    hot = np.concatenate([np.eye(n)[feats[:, i]] for i, n in enumerate(values)], axis=1)
    seen = [votes_] + [np.where(np.arange(votes_.shape[1]) == i, 0, votes_) for i in range(votes_.shape[1])]
    x = np.concatenate([np.column_stack([v, hot, np.ones(len(v))]) for v in seen])
    y, weight = np.tile(want, len(seen)), np.tile(weight / weight.sum() / len(seen), len(seen))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w += rate * (x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-3 * w)
    return w.tolist()


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, a row per row.

    base_sha256 covers the base spans by kind, then start; spans lists all, base kinds first,
    then added kinds by name."""
    found = candidates(docs)
    weights = {}
    for kind, patterns in pattern_counts(found).items():
        by_votes: dict[tuple[int, ...], int] = {}
        for v, _, n in patterns:
            by_votes[v] = by_votes.get(v, 0) + n
        weights[kind] = train(patterns, estimate(sorted(by_votes.items()))[0])

    def accepted(kind: str) -> Column:
        own = weights[kind]

        def sure(x: Column) -> Column:
            z, at = F.lit(own[-1]), 3
            for i in range(3):
                z = z + x[f"v{i}"] * F.lit(own[i])
            for i, (n, _) in enumerate(FEATURES.values()):
                z = z + F.get(F.array(*(F.lit(c) for c in own[at : at + n])), x[f"f{i}"])
                at += n
            return z > 0

        return F.filter(F.col(f"weak_{kind}"), sure)

    added = [named(k, accepted(k)) for k in sorted(weights)]
    base = F.array_join(F.concat(*(named(k, F.col(k)) for k in KINDS)), ",")
    out = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), (F.concat(*added) if added else F.array().cast("array<string>")).alias("more"))
    spans = F.when(F.size("more") == 0, F.col("base")).otherwise(F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.array_join("more", ",")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size("more").cast("long").alias("n_added"))
