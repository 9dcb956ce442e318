"""Secret scans by sliding-window entropy. Built-in functions only.

Base kinds are formats: assignments, access keys and long hex runs. Besides them, candidate
strings (long runs of key characters that hold a digit) are measured by the Shannon entropy
of a window that slides along them. Counts per character are kept up to date as one
character enters and one leaves, so a step costs the same whatever the window. The entropy a
candidate must reach depends on its character class (hex, upper-case, mixed), and an
allow-list silences strings that look random and are not secret.

Defined cases: null or empty text has no spans; base spans of different kinds may overlap,
entropy spans never overlap a base span; rows that repeat a doc_id are searched each; a null
doc_id is an ordinary row; an empty table gives an empty result. A candidate may be as long
as its text: time is linear in its length. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.native_spans import apart, bind, find_spans
from broadloom.llm.shared import texts

KINDS = ("assign", "access", "hex")
#: Keywords and values match in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: character class: (pattern, bits a window must reach); the first that matches holds.
CLASSES = {"digits": (r"^[0-9+/_=-]+$", 99.0), "hexadecimal": (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), "upper": (r"^[A-Z0-9_=-]+$", 3.3), "mixed": (r"", 3.6)}
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers
    r"(?i)^(sha1|sha256|sha384|sha512|md5)[-=]",  # checksums
    r"(?i)(example|sample|placeholder|your[-_]|xxxx|0123456789|abcdefgh)",  # documentation
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",  # dates
    r"^([a-z]+[-_/=])+[a-z0-9]{1,8}$",  # slugs and paths
]


#: Counts of 12 alphabet characters, 5 bits each, share one long.
PACKED, BITS = 12, 5


def window_entropy(candidate: Column, window: int) -> Column:
    """The highest entropy (bits a character) of any ``window`` (31 at most) consecutive
    characters of a string over ALPHABET, null for a shorter one.

    The string is split once into alphabet places. State: n, how often each alphabet
    character is in the window, packed into six longs; total, the sum of c log2 c over it;
    least, the smallest total of a full window, from which the highest entropy follows."""
    if not 0 < window < 1 << BITS:
        raise ValueError("a window has 1 to 31 characters")

    def weigh(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def slide(places: Column) -> Column:
        def change(a: Column, place: Column, by: int) -> Column:
            slot, shift = F.floor(place / PACKED).cast("int"), (place % PACKED) * BITS
            one = F.call_function("shiftleft", F.lit(by).cast("long"), shift)

            def moved(old: Column) -> Column:
                counts = F.transform(a["n"], lambda c, k: F.when(k == slot, c + one).otherwise(c))
                return F.struct(counts.alias("n"), (a["total"] - weigh(old) + weigh(old + by)).alias("total"), a["least"].alias("least"))

            count = F.call_function("shiftright", F.get(a["n"], slot), shift).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
            return bind(count, moved)

        def step(a: Column, i: Column) -> Column:
            # the leaving character goes first, so that no count passes its five bits
            left = F.when(i >= window, change(a, F.get(places, i - window), -1)).otherwise(a)
            entered = bind(left, lambda b: change(b, F.get(places, i), 1))
            return bind(entered, lambda d: F.struct(d["n"].alias("n"), d["total"].alias("total"), F.when(i >= window - 1, F.least(d["least"], d["total"])).otherwise(d["least"]).alias("least")))

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED)).alias("n"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), zero, step, lambda a: F.log2(F.lit(float(window))) - a["least"] / window)

    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(F.length(candidate) >= window, bind(places, slide))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(find_spans(text, ASSIGN, part=2), lambda x: F.length(x["part"]) >= 8),
        "access": find_spans(text, ACCESS),
        "hex": find_spans(text, HEX),
    }


def suspicious(x: Column, window: int) -> Column:
    """Is the entropy of a candidate enough for its character class, and is it not allowed?"""
    need = None
    for pattern, bits in CLASSES.values():
        test = x["text"].rlike(pattern) if pattern else F.lit(True)
        need = F.when(test, F.lit(bits)) if need is None else need.when(test, F.lit(bits))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | x["text"].rlike(pattern)
    return ~allowed & (window_entropy(x["text"], window) >= need)


def secret_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, a row per row.

    base_sha256 covers the base spans by start, then kind; spans lists all in that order,
    entropy last of equal starts."""
    text = F.col("text")
    found = texts(docs).select("doc_id", *(c.alias(k) for k, c in base_spans(text).items()), find_spans(text, CANDIDATE).alias("candidate"))
    base = F.concat(*KINDS)
    free = bind(F.struct(F.col("candidate").alias("c"), base.alias("base")), lambda s: apart(s["c"], s["base"]))
    more = F.when(F.size("candidate") == 0, F.col("candidate")).otherwise(F.filter(free, lambda x: suspicious(x, window)))
    found = found.select("doc_id", *KINDS, more.alias("entropy"))

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("name")))

    def ordered(kinds) -> Column:
        return F.array_join(F.transform(F.sort_array(F.concat(*(tagged(r, k) for r, k in enumerate(kinds)))), lambda x: x["name"]), ",")

    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(ordered(KINDS), 256).alias("base_sha256"), ordered((*KINDS, "entropy")).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))
