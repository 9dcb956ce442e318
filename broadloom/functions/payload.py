"""Payloads inside pages: index-array JSON, cell labels, page probes, moved sites."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.functions.text import domain


def unflatten(text: str) -> str | None:
    """JSON of an index-array payload: a list whose first entry is the root, in which every
    number inside a container is an index into the list. Shared entries are written out where
    they are used; a loop, or a payload of another form, gives null."""
    try:
        table = json.loads(text)
    except (TypeError, ValueError):
        return None
    if not isinstance(table, list) or not table:
        return None

    def build(i, above):
        if i in above or not 0 <= i < len(table):
            raise ValueError
        v = table[i]
        if isinstance(v, dict):
            return {k: build(x, above | {i}) for k, x in v.items()}
        if isinstance(v, list):
            if v and isinstance(v[0], str):  # a typed wrapper: its last entry is the value
                return build(v[-1], above | {i}) if len(v) > 1 else None
            return [build(x, above | {i}) for x in v]
        return v

    try:
        return json.dumps(build(0, frozenset()), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None


def unflattened(payload: Column) -> Column:
    """``unflatten`` over a column; read the result with ``from_json``."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(unflatten)

    return run(payload)


def cell_label(cell: Column) -> Column:
    """The channel label of an HTML cell: a data attribute, else the title or alt text, else
    the visible text; null if none is there."""
    attribute = lambda name: F.nullif(F.trim(F.regexp_extract(cell, rf'(?i)\s{name}="([^"]*)"', 1)), F.lit(""))
    visible = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(cell, r"<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    return F.coalesce(attribute("data-channel"), attribute("title"), attribute("alt"), visible)


def page_state(html: Column, least_times: int = 3) -> Column:
    """What a fetched page is: 'empty', 'protected', 'schedule' or 'no schedule'."""
    body = F.coalesce(html, F.lit(""))
    guard = body.rlike(r"(?i)(captcha|checking your browser|access denied|attention required)")
    times = F.regexp_count(body, F.lit(r"(?<![0-9:])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?![0-9:])"))
    return F.when(F.trim(body) == "", "empty").when(guard, "protected").when(times >= least_times, "schedule").otherwise("no schedule")


def moved_candidates(links: DataFrame, home: Column, hints: list[str]) -> DataFrame:
    """Per page, the link to another site that most likely is its new home: one whose address
    or label holds a hint word, the first of those. links: url, pos, href, label."""
    words = "|".join(hints)
    away = links.withColumn("_d", domain(F.col("href"))).filter((F.col("_d") != "") & (F.col("_d") != domain(home)))
    score = F.col("href").rlike(f"(?i)({words})").cast("int") + F.col("label").rlike(f"(?i)({words})").cast("int")
    return away.withColumn("_s", score).filter("_s > 0").groupBy("url").agg(F.min_by("href", F.struct(-F.col("_s"), F.col("pos"))).alias("href"))


def suggested_name(name: Column) -> Column:
    """A display name: words capitalised, club forms and Roman numerals in capitals."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    shape = lambda w: F.when(w.rlike(r"(?i)^(fc|cf|sc|ac|afc|fk|sk|bk|cd|ud|sv|us|ss|ii|iii|iv|vi{0,3}|u[0-9]{2})$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200))))
    return F.array_join(F.transform(words, shape), " ")


def abbreviates(short: Column, full: Column) -> Column:
    """Are the letters of ``short`` the initials of ``full``'s words, or is each word of
    ``short`` the start of the word in its place?"""
    bare = F.lower(F.regexp_replace(short, r"[.\s]", ""))
    words = F.split(F.lower(F.trim(full)), r"[\s\-]+")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    parts = F.split(F.lower(F.trim(F.regexp_replace(short, r"\.", " "))), r"\s+")
    starts = (F.size(parts) == F.size(words)) & F.forall(F.zip_with(parts, words, lambda p, w: F.startswith(w, p)), lambda ok: F.coalesce(ok, F.lit(False)))
    return ((F.length(bare) > 1) & (bare == initials)) | (starts & (F.lower(short) != F.lower(full)))


def foreign_words(side: Column, spellings: Column) -> Column:
    """Words of a side that no spelling of the team has, in order."""
    known = F.flatten(F.transform(spellings, lambda s: F.split(F.lower(s), r"\s+")))
    return F.filter(F.split(F.lower(F.trim(side)), r"\s+"), lambda w: ~F.array_contains(known, w))


def names_in_json(value: Column) -> Column:
    """Names of a JSON list, lower-cased, with single spaces, sorted, each once; broken or blank
    values give none."""
    words = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    clean = F.transform(words, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def merged_state(known: DataFrame, fresh: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Nested state with what is new added: no key and no entry of a list ever goes. ``is_new``
    tells the keys that were not known. ``lists``: array columns of both sides."""
    side = lambda df, new: df.filter(F.col(key).isNotNull()).select(key, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists), F.lit(new).alias("_new"))
    rows = side(known, 1).unionByName(side(fresh, 2))
    return rows.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists), (F.min("_new") == 2).alias("is_new"))
