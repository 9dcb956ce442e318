"""Repair of the turn structure of conversations at the least cost (``turns`` has the method).

Turns are counted by value first (copies of one turn become one row with a number), the first
turn of each text in its conversation is found by an aggregate over digests, and all turns are
dealt by ranges of (conversation, turn), so that a conversation of any length spreads over
tasks. A task repairs the conversations that lie wholly inside it. The first and the last of a
task, and those beyond ``PACK`` turns, leave as packs with a matrix of least costs; a second
stage reads the matrices of a conversation backwards, which gives every pack the costs behind
it, and then its packs forwards, one at a time. A digest of a whole conversation is sequential
by nature, so that stage walks a conversation in one task; it holds one pack, the matrices (128
bytes for ``PACK`` turns) and the audit.

Defined results: null conv_ids form a conversation; null roles and texts are one space; null
turns come first; turns of one number stand by role, then text (its first 256 characters, then
a digest), copies beside each other; conversations without a turn have zeros, an empty audit
and the digest of an empty text; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm import turns as T
from broadloom.llm.shared import materialize, shuffle_width

PACK = 4096
PACK_CHARS = 1 << 20
LEGAL = ("su", "ua", "au")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARTS = "conv_id long, part long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>, low long, high long, n_turns long, first_role string, last_role string, matrix array<long>, codes binary"
NAMES = [c.split()[0] for c in PARTS.split(", ")]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: each turn with the number of times it stands there after
    damage by a rule over crc32(conv_id:turn). n = 0: the turn is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(h == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    n = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def counted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of undamaged conversations: each turn once."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))


def _ordered(turns: DataFrame) -> DataFrame:
    """All turns by conversation and place, with their faults, dealt by ranges."""
    some = F.col("n") > 0
    bare = turns.select("conv_id", F.when(some, F.col("turn")).alias("turn"), F.when(some, F.col("role")).otherwise("").alias("role"), F.when(some, F.col("text")).otherwise("").alias("text"), "n")
    one = materialize(bare.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    keyed = one.withColumn("digest", digest)
    firsts = keyed.filter("n > 0").groupBy("conv_id", "digest").agg(F.count("*").alias("_times"), F.min("turn").alias("_low"), F.max(F.col("turn").isNull()).alias("_bare"))
    firsts = materialize(firsts.filter("_times > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_low", "_bare"))
    joined = keyed.join(firsts, keyed["conv_id"].eqNullSafe(F.col("_conv")) & (keyed["digest"] == F.col("_digest")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("_bare") | (F.col("turn") > F.col("_low"))), F.lit(False))
    rows = joined.select(
        "conv_id", "turn", "role", "text", "n", "digest", later.alias("later"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    order = ["conv_id", "turn", "role", F.substring("text", 1, 256), "digest"]
    return rows.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order).drop("digest")


class Stretch:
    """Turns of one conversation in order, up to a pack."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.codes, self.roles, self.texts = bytearray(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.chars = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, n: int, later: bool, blank: bool, truncated: bool) -> None:
        initial = role[:1]
        kind = T.KINDS.get(initial, 3)
        if turn is not None and turn != self.high:
            self.n_turns, self.low, self.high = self.n_turns + 1, turn if self.low is None else self.low, turn
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if blank:
            self.blank += n
        else:
            self.duplicate += n if later else n - 1
            self.truncated += truncated and not later
        if blank or later:
            self.codes += bytes([kind | T.MUST_GO]) * n
            return
        self.codes += bytes([kind | T.CUT_OFF * truncated]) + bytes([kind | T.MUST_GO]) * (n - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.codes) >= PACK or self.chars >= PACK_CHARS

    def solved(self, rows: bool) -> dict:
        letters, state, cost = T.repair(bytes(self.codes))
        more, _ = T.closing(state)
        roles, texts = T.applied(letters + more, T.NOTHING, self.roles, self.texts, self.codes)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode()).hexdigest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        found = {"conv_id": self.conv_id, "part": -1, "whole": True, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": letters + more, "repaired_sha256": digest}
        return found | ({"roles": roles, "texts": texts} if rows else {})

    def packed(self, part: int) -> dict:
        cells = [x for column in T.matrix(bytes(self.codes)) for x in column]
        return {
            "conv_id": self.conv_id, "part": part, "whole": False, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "roles": self.roles, "texts": self.texts,
            "low": self.low, "high": self.high, "n_turns": self.n_turns, "first_role": self.first, "last_role": self.last, "matrix": cells, "codes": bytes(self.codes),
        }


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _types(ddl: str) -> pa.Schema:
    known = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], known[c.split()[1]]) for c in ddl.split(", ")])


class Batches:
    """Rows put out in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.weight = schema, [], 0

    def add(self, row: dict, weight: int) -> bool:
        self.rows.append(row)
        self.weight += weight + 100
        return self.weight > 1 << 22

    def take(self) -> pa.RecordBatch:
        out, self.rows, self.weight = _arrow(self.rows, self.schema), [], 0
        return out


def _first_stage(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    out = Batches(_types(PARTS))
    now: Stretch | None = None
    begins = True  # the conversation may have begun in the task before
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "later", "blank", "truncated")]
        for conv_id, turn, role, text, n, later, blank, truncated in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    part += 1
                    if out.add(now.packed(part) if begins else now.solved(rows), now.chars):
                        yield out.take()
                    begins = False
                now = Stretch(conv_id)
            while n > 0:
                if now.full():
                    part += 1
                    if out.add(now.packed(part), now.chars):
                        yield out.take()
                    begins, now = True, Stretch(conv_id)
                some = min(n, PACK)
                now.add(turn, role, text, some, later, blank, truncated)
                n, later = n - some, True
    if now is not None:
        out.add(now.packed(part + 1), now.chars)
    if out.rows:
        yield out.take()


def _second_stage(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    """Packs by (conversation, heavy, part): first all matrices of a conversation, then its
    turns."""
    out = Batches(_types(PARTS))
    conv: object = batches  # none yet
    light: list[dict] = []
    ends: list[tuple[int, ...]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, light, ends, nth = row["conv_id"], [], [], 0
            if not row["heavy"]:
                light.append(row)
                continue
            if not nth:
                end = T.FINAL
                for x in reversed(light):
                    ends.append(end)
                    end = T.behind([tuple(x["matrix"][4 * f : 4 * f + 4]) for f in range(4)], end)
                total, state, digest, audit = end[T.NOTHING], T.NOTHING, hashlib.sha256(), []
                wrote = False
            letters, after, _ = T.repair(row["codes"], state, ends[len(light) - 1 - nth])
            nth += 1
            last = nth == len(light)
            if last:
                letters += T.closing(after)[0]
            roles, texts = T.applied(letters, state, row["roles"], row["texts"], row["codes"])
            state = after
            audit.append(letters)
            for r, t in zip(roles, texts, strict=True):
                digest.update(f"{chr(10) * wrote}{r}:{t}".encode())
                wrote = True
            found = {"conv_id": conv, "part": row["part"], "whole": last} | ({"roles": roles, "texts": texts} if rows else {})
            if last:
                found |= _totals(light) | {"cost": total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            if (last or rows) and out.add(found, sum(map(len, texts)) if rows else len(found.get("audit", ""))):
                yield out.take()
    if out.rows:
        yield out.take()


def _totals(packs: list[dict]) -> dict:
    """Counts of a conversation from those of its packs in order."""
    found = {k: sum(x[k] for x in packs) for k in ("blank", "duplicate", "truncated", "illegal")}
    n_turns, low, high, last = 0, None, None, None
    for x in packs:
        if x["first_role"] is not None:
            found["illegal"] += last is not None and last + x["first_role"] not in LEGAL
            last = x["last_role"]
        if x["low"] is not None:
            n_turns += x["n_turns"] - (x["low"] == high)
            low, high = x["low"] if low is None else low, x["high"]
    return found | {"gaps": 0 if low is None else high - low + 1 - n_turns}


def _repaired(turns: DataFrame, rows: bool) -> DataFrame:
    """Parts of all conversations; a row with ``whole`` ends each and has its figures."""
    parts = materialize(_ordered(turns).mapInArrow(lambda b: _first_stage(b, rows), PARTS))
    packs = parts.filter("NOT whole")
    heavy = packs.select("conv_id", "part", F.lit(True).alias("heavy"), "roles", "texts", "codes")
    small = ["blank", "duplicate", "truncated", "illegal", "low", "high", "n_turns", "first_role", "last_role", "matrix"]
    both = packs.select("conv_id", "part", F.lit(False).alias("heavy"), *small).unionByName(heavy, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "heavy", "part")
    return parts.filter("whole").unionByName(dealt.mapInArrow(lambda b: _second_stage(b, rows), PARTS))


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``damaged`` or ``counted``: faults, gaps, the cost of
    the cheapest repair, its edits' letters (of equal cost the least), a digest of the result."""
    return _repaired(turns, False).filter("whole").select(*(c.split()[0] for c in REPORT.split(", ")))


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text): the repaired turns, ordered by part and place."""
    parts = _repaired(turns, True).select("conv_id", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    return parts.select("conv_id", "part", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))
