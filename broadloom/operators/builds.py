"""The difference of two builds of the listing: every game of the old one gets one fate.

The fates are tried in order, each over what the earlier ones left: 'same' and 'changed' (key
in both; a digest over all fields says whether, the list of fields says which), 'renamed' (at the
same time under other names, or the same pair beside it), 'retimed' (the same pair, nearer to
the reference's time), 'absorbed' (its channels or its pair went into a game that was matched
already), 'explained' (the book of cases excuses all its channels), 'lost'. Games meet by pair
and time bucket, or by time bucket and compare their channels; a new game is taken by one old game.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from broadloom.operators.intervals import seconds, within
from broadloom.sources.shared import materialize

FATE = "old_id", "fate", "new_id", "fields"


def changed_fields(fields: list[str], old: str, new: str) -> Column:
    """Names of the fields whose values differ (nulls are values) between two structs."""
    return F.filter(F.array(*(F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())


def record_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, state, fields) of a full outer join by key: 'added', 'gone', 'same' or 'changed'
    with the names of all fields that differ."""
    fields = [c for c in old.columns if c not in key]
    side = lambda df, p: df.select(*key, F.struct(*fields).alias(p), F.xxhash64(*fields).alias(f"{p}_h"))
    both = side(old, "_o").join(side(new, "_n"), key, "full_outer")
    differ = F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), changed_fields(fields, "_o", "_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "gone").when((F.col("_o_h") == F.col("_n_h")) & (F.size(differ) == 0), "same").otherwise("changed")
    return both.select(*key, state.alias("state"), F.coalesce(differ, F.array().cast("array<string>")).alias("fields"))


def _by_pair(old: DataFrame, new: DataFrame, minutes: int, both: bool = True) -> DataFrame:
    """(old_id, new_id, gap): of the games of one pair, so many minutes apart at most, each old
    game's nearest (then smallest) and, if ``both``, each new game's. Games of one pair and start
    meet others as one, by their smallest, so pairs do not grow with the square of the copies.
    Gaps are microseconds."""
    met = _met(old, new, minutes, [])
    met = materialize(met) if both else met

    def nearest(games, mine, at, other):
        best = met.groupBy("pair", at).agg(F.min(F.struct("gap", other)).alias("_b")).withColumnRenamed(at, "start")
        return games.select(mine, "pair", "start").join(best, ["pair", "start"]).select(mine, F.col(f"_b.{other}").alias(other), F.col("_b.gap").alias("gap"))

    of_old = nearest(old, "old_id", "_os", "new_id")
    return of_old.unionByName(nearest(new, "new_id", "_ns", "old_id")) if both else of_old


def _met(old: DataFrame, new: DataFrame, minutes: int, more: list[str], extra: Column | None = None) -> DataFrame:
    """(old_id, new_id, pair, _os, _ns, gap): games of one pair near in time, of those equal in
    pair, start and ``more`` the smallest alone."""
    o = old.groupBy("pair", F.col("start").alias("_os"), *more).agg(F.min("old_id").alias("old_id"))
    n = new.groupBy("pair", F.col("start").alias("_ns")).agg(F.min("new_id").alias("new_id"))
    met = within(o, n, ["pair"], "_os", "_ns", -60 * minutes, 60 * minutes, extra=extra)
    return met.select("old_id", "new_id", "pair", "_os", "_ns", _apart("_ns", "_os").alias("gap"))


def _closer(old: DataFrame, new: DataFrame, minutes: int) -> DataFrame:
    """(old_id, new_id, gap): games of one pair where the new one is nearer to the reference's
    time; copies of a game have the same choice and are never chosen before the smallest."""
    return _met(old, new, minutes, ["ref_start"], _apart("_ns", "ref_start") < _apart("_os", "ref_start")).select("old_id", "new_id", "gap")


def _apart(a: str, b: str) -> Column:
    return F.abs(_micros(a) - _micros(b))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _by_channels(old: DataFrame, new: DataFrame, minutes: int, need: Column, both: bool = True) -> DataFrame:
    """(old_id, new_id, gap): of the games so many minutes apart at most that share at least
    ``need`` (over ``_n``, how many channels the old one has) of the old one's channels, each old
    game's nearest (then smallest) and, if ``both``, each new game's. Games meet by time bucket,
    where sets of bits are compared; no pair of games becomes a row. A busy bucket is cut into
    pieces that meet each other, so a task holds a bounded number of games. A pair may come more
    than once."""
    reach = 60 * minutes
    wide = max(1, 4 * reach)
    held = F.filter(F.array_distinct("channels"), lambda x: x.isNotNull())
    bucket = lambda x: F.floor(x / wide + 0.5)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    o = old.withColumn("_n", F.size(F.array_distinct("channels"))).select("old_id", none(new, "new_id"), _micros("start").alias("_at"), held.alias("_c"), F.greatest(need, F.lit(1)).cast("int").alias("_need"), F.explode(F.array_distinct(F.array(bucket(seconds("start") - reach), bucket(seconds("start") + reach)))).alias("_b"))
    n = new.select(none(old, "old_id"), "new_id", _micros("start").alias("_at"), held.alias("_c"), F.lit(1).alias("_need"), bucket(seconds("start")).alias("_b"))
    rows = o.union(n).filter("_at IS NOT NULL AND size(_c) >= _need")
    pieces = lambda c: F.ceil(F.count(c) / PIECE)
    busy = materialize(rows.groupBy("_b").agg(pieces("old_id").alias("_i"), pieces("new_id").alias("_j")).filter("_i > 0 AND _j > 0"))
    mine = F.when(F.col("old_id").isNotNull(), F.pmod(F.xxhash64("old_id"), "_i")).otherwise(F.pmod(F.xxhash64("new_id"), "_j"))
    others = F.sequence(F.lit(0), F.when(F.col("old_id").isNotNull(), F.col("_j")).otherwise(F.col("_i")) - 1)
    spread = rows.join(busy, "_b").withColumn("_own", mine).withColumn("_other", F.explode(others))
    i = F.when(F.col("old_id").isNotNull(), F.col("_own")).otherwise(F.col("_other"))
    j = F.when(F.col("old_id").isNotNull(), F.col("_other")).otherwise(F.col("_own"))
    dealt = spread.select("_b", i.alias("_i"), j.alias("_j"), "old_id", "new_id", "_at", "_c", "_need").repartition("_b", "_i", "_j").sortWithinPartitions("_b", "_i", "_j")
    schema = StructType([old.schema["old_id"], new.schema["new_id"], StructField("gap", LongType())])
    return dealt.mapInArrow(lambda it: _nearest(it, reach * 1_000_000, both), schema)


#: Games of one build that meet those of the other in one piece of a time bucket.
PIECE = 4096


def _nearest(batches, reach: int, both: bool):
    """Nearest games of each stretch of whole pieces, of a thousand rows or so. What is near
    enough and shares enough is right in whatever stretch it is found."""
    held: list = []

    def cut(last):
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = [whole.column(c).to_numpy() for c in ("_b", "_i", "_j")]
        ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        ends = np.append(ends, len(whole)) if last else ends
        done = 0
        for end in (int(e) for k, e in enumerate(ends) if k + 1 == len(ends) or ends[k + 1] - done > 1024):
            yield from _nearest_of(whole.slice(done, end - done), reach, both)
            done = end
        held[:] = whole.slice(done).to_batches()

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 8192:
            yield from cut(False)
            n = 0
    if held:
        yield from cut(True)


def _nearest_of(part: pa.Table, reach: int, both: bool):
    """Both sides in order of their ids, so the first of the nearest is the smallest."""
    def side(name):
        own = part.filter(pc.is_valid(part.column(name)))
        return own.take(pc.sort_indices(own.column(name))).combine_chunks()

    old, new = side("old_id"), side("new_id")
    if not len(old) or not len(new):
        return
    lists = [t.column("_c").combine_chunks() for t in (old, new)]
    names = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes, words = names.indices.to_numpy(), -(-len(names.dictionary) // 64)
    bits, at = [], 0
    for x in lists:
        n = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        code, at = codes[at : at + n.sum()], at + int(n.sum())
        own = np.zeros((words, len(n)), np.uint64)
        np.bitwise_or.at(own, (code >> 6, np.repeat(np.arange(len(n)), n)), np.uint64(1) << (code & 63).astype(np.uint64))
        bits.append(own)
    old_at, new_at = (t.column("_at").to_numpy() for t in (old, new))
    small = np.uint8 if words == 1 else np.int32
    need = old.column("_need").to_numpy().astype(small)
    by_time = np.argsort(new_at, kind="stable")
    sorted_at = new_at[by_time]
    far = np.iinfo(np.int64).max
    best, of_old = np.full(len(old), far), np.zeros(len(old), np.int64)
    least, of_new = np.full(len(new), far), np.zeros(len(new), np.int64)
    rows = max(16, (1 << 16) // len(new))
    # what is found near by need not be sought further off
    for radius in (reach,) if both else (reach // 16, reach):
        left = np.flatnonzero(best == far)
        left = left[np.argsort(old_at[left], kind="stable")]
        for mine in (np.sort(left[s : s + rows]) for s in range(0, len(left), rows)):
            low, high = np.searchsorted(sorted_at, old_at[mine].min() - radius), np.searchsorted(sorted_at, old_at[mine].max() + radius, "right")
            theirs = np.sort(by_time[low:high])
            if not len(theirs):
                continue
            common = sum((np.bitwise_count(a[mine, None] & b[None, theirs]).astype(small, copy=False) for a, b in zip(*bits, strict=True)), small(0))
            gap = np.abs(old_at[mine, None] - new_at[None, theirs])
            gap[(common < need[mine, None]) | (gap > radius)] = far
            j = gap.argmin(1)
            best[mine], of_old[mine] = gap[np.arange(len(j)), j], theirs[j]
            if both:
                i = gap.argmin(0)
                found, i = gap[i, np.arange(len(i))], mine[i]
                nearer = (found < least[theirs]) | ((found == least[theirs]) & (i < of_new[theirs]))
                least[theirs[nearer]], of_new[theirs[nearer]] = found[nearer], i[nearer]
    i = np.concatenate([np.arange(len(old)), of_new])
    j = np.concatenate([of_old, np.arange(len(new))])
    gap = np.concatenate([best, least])
    near = gap < far
    yield pa.RecordBatch.from_arrays([old.column("old_id").take(pa.array(i[near])).combine_chunks(), new.column("new_id").take(pa.array(j[near])).combine_chunks(), pa.array(gap[near])], names=["old_id", "new_id", "gap"])


def _mutual(pairs: DataFrame) -> DataFrame:
    """(old_id, new_id) of those that are each other's nearest, then smallest. A pair may come
    more than once."""
    best = lambda mine, other: pairs.groupBy(mine).agg(F.min(F.struct("gap", other)).alias("_b")).select(mine, F.col(f"_b.{other}").alias(other))
    return best("old_id", "new_id").join(best("new_id", "old_id"), ["old_id", "new_id"])


def fates(old: DataFrame, new: DataFrame, cases: DataFrame, fields: list[str], same_minutes: int = 10, far_minutes: int = 180) -> DataFrame:
    """(old_id, fate, new_id, fields, missing): one row for each old game. ``missing``: its
    channels that the game it became does not have.

    old: old_id, pair, start, channels (array), ref_start (the reference's time or null) and
    ``fields``; new: new_id, pair, start, channels and ``fields``; cases: channel. Games with a
    null pair or start meet nothing and are explained or lost. ``old`` and ``new`` are read
    several times."""
    values = F.struct(*fields)
    key = ["pair", "start"]
    o = old.withColumn("_o", values)
    first = Window.partitionBy(*key).orderBy("new_id")
    keyed = new.filter("pair IS NOT NULL AND start IS NOT NULL").select(*key, "new_id", values.alias("_n")).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    mine = Window.partitionBy(*key).orderBy("old_id")
    ranked = o.filter("pair IS NOT NULL AND start IS NOT NULL").withColumn("_rn", F.row_number().over(mine)).filter("_rn = 1")
    kept = materialize(ranked.join(keyed, key).select("old_id", "new_id", changed_fields(fields, "_o", "_n").alias("fields")))
    done = kept.select("old_id", F.when(F.size("fields") == 0, "same").otherwise("changed").alias("fate"), "new_id", "fields")
    none = F.array().cast("array<string>").alias("fields")
    left = materialize(old.select("old_id", "pair", "start", "channels", "ref_start").join(kept.select("old_id"), "old_id", "left_anti"))
    fresh = materialize(new.select("new_id", "pair", "start", "channels").join(kept.select("new_id"), "new_id", "left_anti"))
    most = F.floor(F.col("_n") / 2) + 1
    close = min(same_minutes, far_minutes)
    near = _by_pair(left, fresh, close).union(_by_channels(left, fresh, close, most))
    renamed = materialize(_mutual(materialize(near)).select("old_id", F.lit("renamed").alias("fate"), "new_id", none))
    free = lambda df, c: df.join(renamed.select(c), c, "left_anti")
    closer = materialize(_closer(free(left, "old_id"), free(fresh, "new_id"), far_minutes))
    retimed = materialize(_mutual(closer).select("old_id", F.lit("retimed").alias("fate"), "new_id", none))
    moved = renamed.union(retimed)
    rest = left.join(moved.select("old_id"), "old_id", "left_anti")
    taken = kept.select("new_id").union(moved.select("new_id")).distinct()
    rest, matched = materialize(rest), materialize(new.select("new_id", "pair", "start", "channels").join(taken, "new_id", "left_semi"))
    hosts = _by_pair(rest, matched, far_minutes, both=False).union(_by_channels(rest, matched, far_minutes, F.col("_n"), both=False))
    absorbed = hosts.groupBy("old_id").agg(F.min_by("new_id", F.struct("gap", "new_id")).alias("new_id")).select("old_id", F.lit("absorbed").alias("fate"), "new_id", none)
    absorbed = materialize(absorbed)
    gone = rest.join(absorbed.select("old_id"), "old_id", "left_anti").select("old_id", "channels")
    listed = gone.select("old_id", F.explode("channels").alias("channel")).join(cases.select("channel").distinct(), "channel", "left_anti").select("old_id").distinct()
    excused = gone.join(listed.withColumn("_bad", F.lit(True)), "old_id", "left")
    last = excused.select("old_id", F.when(F.col("_bad") | (F.size("channels") <= 0) | F.col("channels").isNull(), "lost").otherwise("explained").alias("fate"), F.lit(None).cast(new.schema["new_id"].dataType).alias("new_id"), none)
    told = done.union(moved).union(absorbed).union(last)
    out = told.join(old.select("old_id", "channels"), "old_id").join(new.select("new_id", F.col("channels").alias("_nc")), "new_id", "left")
    return out.select("old_id", "fate", "new_id", "fields", F.array_sort(F.array_except(F.coalesce("channels", F.array().cast("array<string>")), F.coalesce("_nc", F.array().cast("array<string>")))).alias("missing"))
