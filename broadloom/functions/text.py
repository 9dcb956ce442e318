"""Text functions as Spark expressions: whole words, pairs, leagues, labels, addresses.

Regular expressions carry ``(?iuU)`` where the words may be in any language: case is folded
and word characters are those of Unicode. Vocabularies are parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = r"(?<!\w)", r"(?!\w)"


def words_pattern(words: list[str]) -> str:
    """Matches any of the words as a whole, longest first."""
    inner = "|".join(re.escape(w).replace(r"\ ", r"\s+").replace(" ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"(?iuU){BEFORE}(?:{inner}){AFTER}"


def found_word(text: Column, words: list[str], keep: list[str] | None = None) -> Column:
    """The first of the words that stands in the text, or null. Protected names are taken
    out first, so that a word inside one is not found."""
    if not words:
        return F.lit(None).cast("string")
    body = F.regexp_replace(text, words_pattern(keep), " ") if keep else text
    return F.nullif(F.regexp_extract(body, words_pattern(words), 0), F.lit(""))


def has_word(text: Column, words: list[str], keep: list[str] | None = None) -> Column:
    return found_word(text, words, keep).isNotNull()


EPISODE = r"(?i)(?<![a-z0-9])s[0-9]{1,3}\s?e[0-9]{1,4}(?![a-z0-9])"


def episode_code(text: Column) -> Column:
    return text.rlike(EPISODE)


SPLITTER = r"(?iu)\s+(?:-|–|—|x|vs?\.?|contra|@)\s+"


def pair_sides(text: Column) -> Column:
    """array(home, away) of a title that holds exactly one pair, else null.

    Brackets go first; a lead up to the last ': ' goes; sides that are equal or empty make no
    pair; several dashes mean several matches or none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]", " "), r"^.*:\s+", "")
    sides = F.transform(F.split(bare, SPLITTER, -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    one, two = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    whole = (F.size(sides) == 2) & (one != "") & (two != "") & (F.lower(one) != F.lower(two))
    return F.when(whole, sides)


def pair_guesses(text: Column) -> Column:
    """All pairs that a title may hold, best guess first: parts between ' | ' or ' / ' that
    hold one, else the whole title without what precedes the last ': '; then a tight dash."""
    parts = F.split(text, r"\s[|/]\s", -1)
    by_part = F.filter(F.transform(parts, pair_sides), lambda p: p.isNotNull())
    tight = F.transform(F.split(text, r"(?<=\S)-(?=\S)", -1), lambda s: F.trim(s))
    tight = F.when((F.size(tight) == 2) & (F.get(tight, F.lit(0)) != "") & (F.get(tight, F.lit(1)) != ""), F.array(tight)).otherwise(F.array().cast("array<array<string>>"))
    whole = F.filter(F.array(pair_sides(text)), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(F.when((F.size(parts) > 1) & (F.size(by_part) > 0), by_part).otherwise(whole), tight))


def category(name: Column) -> Column:
    """Age, gender and reserve marks of a team name: 'U19 W B', in that order, or ''."""
    age = F.regexp_extract(name, r"(?iu)(?<!\w)(?:u|under|sub)[-\s]?([0-9]{2})(?!\w)", 1)
    women = name.rlike(r"(?iu)(?<!\w)(?:women|ladies|femenino|féminines|frauen)(?!\w)|\((?:w|f)\)\s*$|\sw$")
    reserve = name.rlike(r"(?iu)(?<!\w)(?:b|ii|reserves?)\s*$")
    return F.concat_ws(" ", F.when(age != "", F.concat(F.lit("U"), age)), F.when(women, F.lit("W")), F.when(reserve, F.lit("B")))


def clean_league(name: Column, sports: list[str]) -> Column:
    """A league label without the sport before it, the season, the round and the air mark."""
    out = F.regexp_replace(name, rf"(?iu)^(?:{'|'.join(map(re.escape, sports))})\s*[:.\-–]\s*", "")
    out = F.regexp_replace(out, r"(?<![0-9])(?:19|20)[0-9]{2}(?:\s?[/\-–]\s?(?:19|20)?[0-9]{2})?(?![0-9])", "")
    out = F.regexp_replace(out, r"(?iu)[,.\-–]?\s*(?:round|matchday|runde|jornada|journée)\s*[0-9]+.*$", "")
    out = F.regexp_replace(out, r"(?iu)\s*\(?(?:live|en vivo|direct)\)?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"[\s,.\-–:]+$", ""))


def translated(text: Column, words: dict[str, str]) -> Column:
    """Whole words by dictionary, longest phrase first."""
    out = text
    for phrase in sorted(words, key=lambda w: (-len(w), w)):
        out = F.regexp_replace(out, words_pattern([phrase]), words[phrase])
    return out


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def domain(url: Column) -> Column:
    """Host without www. and port, lower-cased; '' if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def page_kind(url: Column) -> Column:
    """Address without its variable part: host and path, digits as 0."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(domain(url), F.regexp_replace(path, "[0-9]+", "0"))


def unreadable(text: Column) -> Column:
    """More than half of the letters are outside Latin, Cyrillic and Greek."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    known = F.regexp_count(text, F.lit(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"))
    return 2 * (letters - known) > letters


def clock_times(text: Column) -> Column:
    """Minutes of the day of every HH:MM, H.MM or 21h10 that is a time."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9:.])(?:[01]?[0-9]|2[0-3])[:.hH][0-5][0-9](?![0-9:.])"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_extract(t, "^([0-9]+)", 1).cast("int") * 60 + F.right(t, F.lit(2)).cast("int"))


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first pattern that a value matches."""
    out = None
    for name, pattern in rules:
        out = F.when(value.rlike(pattern), F.lit(name)) if out is None else out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def link(template: Column, key: Column, table: Column, otherwise: Column) -> Column:
    """A link template filled from a map: a value with '://' replaces the page, an unknown key
    gives ``otherwise``, a placeholder left over gives ''."""
    value = F.element_at(table, key)
    filled = F.when(value.isNull(), otherwise).when(value.contains("://"), value).otherwise(F.replace(template, F.lit("{key}"), value))
    return F.when(filled.rlike(r"\{[a-z]+\}"), F.lit("")).otherwise(filled)
