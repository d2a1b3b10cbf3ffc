"""String and JSON column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def fits(c: Column, most: int) -> Column:
    """Trimmed text of 1 to ``most`` characters."""
    return F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))


def slug(c: Column, replacement: str = "_") -> Column:
    """Every run of characters outside letters, digits, dot, dash and underscore becomes one ``replacement``."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", replacement)


def is_safe_id(c: Column, most: int = 128) -> Column:
    """Letters, digits, dot, dash, underscore; starts with a letter or digit."""
    return F.coalesce(c.rlike(rf"^[A-Za-z0-9][A-Za-z0-9._-]{{0,{most - 1}}}$"), F.lit(False))


def with_particle(c: Column, after_final: str, after_vowel: str) -> Column:
    """A Korean word and the particle its last syllable asks for; other endings take the form after a final consonant."""
    code = F.ascii(F.right(c, F.lit(1)))
    open_syllable = code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 == 0)
    return F.concat(c, F.when(open_syllable, after_vowel).otherwise(after_final))


def label(code: Column, name: Column) -> Column:
    """``code name``, or whichever of them there is, or null."""
    return blank_to_null(F.concat_ws(" ", blank_to_null(code), blank_to_null(name)))


def mask_credentials(url: Column) -> Column:
    """user:password of a URL replaced by ***."""
    return F.regexp_replace(url, r"(?<=://)[^/@\s]+@", "***@")


def key_values(c: Column) -> Column:
    """``a=x,b=y`` as a map; null where a key repeats or an entry has no ``=``."""
    entries = F.split(c, ",")
    pairs = F.transform(entries, lambda e: F.struct(F.trim(F.substring_index(e, "=", 1)).alias("key"), F.trim(F.substring(e, F.instr(e, "=") + 1, F.length(e))).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    sound = F.forall(entries, lambda e: e.contains("=")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(sound, F.map_from_entries(pairs))


def object_key(camera: Column, ts: Column, suffix: str) -> Column:
    """``camera/yyyy-MM-dd/yyyyMMddTHHmmssSSS<suffix>``."""
    return F.concat(camera, F.lit("/"), F.date_format(ts, "yyyy-MM-dd"), F.lit("/"), F.date_format(ts, "yyyyMMdd'T'HHmmssSSS"), F.lit(suffix))


def parse_object_key(key: Column, suffix: str) -> Column:
    """struct<camera, ts> of an object key; null where it has another form."""
    form = rf"^([^/]+)/\d{{4}}-\d{{2}}-\d{{2}}/(\d{{8}}T\d{{9}})\Q{suffix}\E$"
    ts = F.try_to_timestamp(F.regexp_extract(key, form, 2), F.lit("yyyyMMdd'T'HHmmssSSS"))
    return F.when(key.rlike(form) & ts.isNotNull(), F.struct(F.regexp_extract(key, form, 1).alias("camera"), ts.alias("ts")))


def event_id(camera: Column, ts: Column, sequence: Column) -> Column:
    """``camera-yyyyMMddTHHmmssSSSZ-sequence``; milliseconds are cut, not rounded."""
    return F.concat_ws("-", camera, F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmssSSS"), F.lit("Z")), sequence.cast("string"))


def entry_event_id(camera: Column, ts: Column, sequence: Column) -> Column:
    return F.concat_ws("-", camera, F.unix_millis(ts).cast("string"), sequence.cast("string"), F.lit("entry-face"))


def code_number(code: Column, prefix: str = "S") -> Column:
    """The number of a code like ``S07``; null for other codes."""
    digits = F.regexp_extract(code, rf"^{prefix}(\d{{1,9}})$", 1)
    return F.when(digits != "", digits.cast("int"))


def padded(number: Column, prefix: str = "S") -> Column:
    """``S07``; from 100 on as many digits as it takes."""
    return F.concat(F.lit(prefix), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))


def json_object(c: Column) -> Column:
    """The text of a JSON object: the whole text if it is one, else from its first ``{`` to its last ``}``; null for arrays and all else."""
    whole = F.trim(c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    whole_array = F.try_parse_json(whole).isNotNull() & whole.startswith("[")
    return F.when(is_object(whole), whole).when(whole_array, F.lit(None)).when((inner != "") & is_object(inner), inner)


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Top-level keys that are not allowed."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


#: The sentences of a search's summary. {0} is the period, the target or the person with their particle, {1} a count.
FOUND_IN, NOTHING, ALL, CUT = "{0} 동안 {1}에서 찾았어요.", "결과는 없어요.", "총 {0}건의 결과가 있어요.", "상한에 걸려 {0}건까지만 보여드려요. 이게 전부는 아니에요."
SEVERAL, UNKNOWN_NAME = "{0} {1}명이라 누구인지 정하지 못했고, ", "{0} 학생 명부에서 찾지 못해 인물 조건은 걸지 못했고, "
NOT_APPLIED, ABSENT, PRESENT = "얼굴 인식이 아직 연결되지 않아 {0} 있었는지는 확인하지 못했고, ", "{0} 보이지 않는 기록만 골랐고, ", "{0} 보이는 기록만 골랐고, "


def filled(template: str, *values: Column) -> Column:
    """A text with {0}, {1} ... replaced by columns."""
    parts = re.split(r"\{(\d)\}", template)
    return F.concat(*[values[int(p)].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def sentence(period: Column, target: Column, person: Column, matches: Column, applied: Column, absent: Column, count: Column, truncated: Column) -> Column:
    """A search's summary: period and target; then the person's clause, where there is one, and the count's.

    matches: how many people have the name; applied: whether the filter could be applied.
    """
    subject, object_ = with_particle(person, "이", "가"), with_particle(person, "을", "를")
    clause = (
        F.when(person.isNull(), "").when(matches > 1, filled(SEVERAL, subject, matches)).when(matches == 0, filled(UNKNOWN_NAME, object_))
        .when(~applied, filled(NOT_APPLIED, subject)).when(absent, filled(ABSENT, subject)).otherwise(filled(PRESENT, subject))
    )
    found = F.when(truncated, filled(CUT, count)).when(count == 0, NOTHING).otherwise(filled(ALL, count))
    return F.concat(filled(FOUND_IN, period, target), F.lit(" "), clause, found)
