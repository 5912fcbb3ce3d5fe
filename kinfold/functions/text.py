"""Normalisation of names and addresses as column expressions.

Patterns use Java's Unicode classes where they meet letters, so accented text is cut as the definitions ask.
Only Unicode decomposition and transliteration need Python; both run as Arrow UDFs over distinct strings at most.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

PUNCT = r"[^\p{L}\p{N}]+"


def _words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def keep(words: Column, drop: list[str]) -> Column:
    """The words that aren't empty and not in ``drop``."""
    stop = F.array(*[F.lit(w) for w in drop])
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def mapped(words: Column, table: dict[str, str]) -> Column:
    """Each word replaced by its entry in ``table``, if it has one."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w))


def joined(words: Column, sep: str = " ") -> Column:
    return F.array_join(words, sep)


def simple_norm(c: Column) -> Column:
    """Lower case, all but letters and digits to spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCT, " "))


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without the Latin combining marks (U+0300 to U+036F)."""
    return s.map(lambda x: re.sub("[̀-ͯ]+", "", unicodedata.normalize("NFKD", x)), na_action="ignore")


@F.pandas_udf(StringType())
def strip_all_marks(s: pd.Series) -> pd.Series:
    """Decomposition without any combining mark."""
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)), na_action="ignore")


def base_clean(c: Column, decompose: Callable[[Column], Column] = strip_accents) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"n\s*[°º]\s*", " no ")
    for letter, plain in L.SPECIAL_LETTERS.items():
        x = F.replace(x, F.lit(letter), F.lit(plain))
    x = F.regexp_replace(decompose(x), "['`‘’]", "")
    x = F.regexp_replace(x, r"\bn/a\b|\bm/s\b", " ")
    return F.regexp_replace(x, r"[&+]", " and ")


def is_handle(raw: Column, cleaned: Column) -> Column:
    return F.trim(raw).rlike(r"^[@#]") | cleaned.rlike(L.DOMAIN_RE) | cleaned.rlike(r"^\s*www\b")


def has_phone(cleaned: Column) -> Column:
    return cleaned.rlike(r"\d{7,}")


def scrub_name(cleaned: Column) -> Column:
    """Phone numbers, web addresses and punctuation go; digits read for letters come back."""
    for pattern, to in L.NAME_SCRUB:
        cleaned = F.regexp_replace(cleaned, pattern, to)
    return F.trim(cleaned)


def repair_legal(name: Column) -> Column:
    """Legal words as transliteration spells them."""
    return F.regexp_replace(F.regexp_replace(name, L.PRIVATE_RE, "pvt"), L.LIMITED_RE, "ltd")


def scrub_address(cleaned: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cleaned, r"\b[cswd]\s*/\s*o\b", " "), r"\bh\s*\.?\s*no\b", " no ")


def segments(address: Column) -> Column:
    return F.transform(F.split(address, ","), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, PUNCT, " "), r"\s+", " ")))


def state_codes(segs: Column, cty: Column) -> Column:
    """For each segment, the code of the state that it names in full, marked by ``~``; else the segment."""
    out = segs
    for names in {id(v): v for v in L.STATES.values()}.values():
        labels = [k for k, v in L.STATES.items() if v is names]
        out = F.when(cty.isin(*labels), mapped(segs, {k: "~" + v for k, v in names.items()})).otherwise(out)
    return out


def alias_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, L.ALIAS_RE, 2), F.lit(""))


def skeleton(c: Column) -> Column:
    """Consonant classes: spellings that sound alike meet."""
    x = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("x"), F.lit("ks")), r"[^a-z]", "")
    for pattern, to in L.CONSONANTS:
        x = F.regexp_replace(x, pattern, to)
    return x


def context_legal(legal: Column) -> Column:
    """Distinct sorted legal words in their short forms."""
    return joined(F.array_sort(F.array_distinct(mapped(F.split(legal, " "), L.CONTEXT_LEGAL))))


def first_number(num: Column) -> Column:
    """Digits only, no leading zeros, nine at most."""
    return F.substring(F.ltrim(F.regexp_replace(F.coalesce(num, F.lit("")), r"[^0-9]", ""), F.lit("0")), 1, 9)


#: Latin readings by offset within an Indic block; the blocks share one layout (fixed values).
_VOWELS = {0x05: "a", 0x06: "ā", 0x07: "i", 0x08: "ī", 0x09: "u", 0x0A: "ū", 0x0B: "ṛ", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_SIGNS = {0x3E: "ā", 0x3F: "i", 0x40: "ī", 0x41: "u", 0x42: "ū", 0x43: "ṛ", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
_CONSONANTS = dict(
    zip(range(0x15, 0x3A), "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n ṉ p ph b bh m y r ṟ l ḷ ḻ v ś ṣ s h".split(), strict=True)
)
_MARKS = {0x01: "m̐", 0x02: "ṃ", 0x03: "ḥ"}
_BLOCKS = range(0x0900, 0x0D80, 0x80)
_INDIC = re.compile("[ऀ-ൿ]")
_FINAL_A = re.compile(L.FINAL_A_RE)


def romanise(text: str) -> str:
    """Indic letters in Latin; an unspoken final a goes, and the abbreviation of private limited is written out."""
    out, pending = [], False
    for ch in unicodedata.normalize("NFC", text):
        code = ord(ch)
        off = (code - 0x0900) % 0x80 if _BLOCKS[0] <= code < _BLOCKS[-1] + 0x80 else None
        if pending and off not in _SIGNS and off not in (0x4D, 0x3C):
            out.append("a")
        if off == 0x3C and pending:
            continue
        pending = False
        if off is None:
            out.append(ch)
        elif off in _CONSONANTS:
            out.append(_CONSONANTS[off])
            pending = True
        elif 0x66 <= off <= 0x6F:
            out.append(str(off - 0x66))
        elif off != 0x4D:
            out.append((_VOWELS | _SIGNS | _MARKS).get(off, ch))
    if pending:
        out.append("a")
    return re.sub(L.PVT_LTD_RE, "pvt ltd", _FINAL_A.sub("", "".join(out)))


@F.pandas_udf(StringType())
def _romanised(s: pd.Series) -> pd.Series:
    return s.map(romanise, na_action="ignore")


def transliterate(df: DataFrame, column: str, only_without_latin: bool = False) -> DataFrame:
    """``column`` with Indic text in Latin.  Each distinct string is converted once, on its own small table."""
    todo = F.col(column).rlike("[ऀ-ൿ]")
    if only_without_latin:
        todo = todo & ~F.col(column).rlike("[A-Za-z]")
    unique = df.where(todo).select(F.col(column).alias("_kf_from")).distinct().withColumn("_kf_to", _romanised("_kf_from"))
    return df.join(unique, F.col(column) == F.col("_kf_from"), "left").withColumn(column, F.coalesce("_kf_to", column)).drop("_kf_from", "_kf_to")


def replace_states(c: Column, names: dict[str, str] | None = None) -> Column:
    """Native state names in either normal form replaced by their English ones, the longest first; by default those of the lexicon."""
    names = names or {native: english for english, listed in L.NATIVE_STATES.items() for native in listed}
    table = {unicodedata.normalize(form, k): v for k, v in names.items() for form in ("NFC", "NFD")}
    for k in sorted(table, key=len, reverse=True):
        c = F.replace(c, F.lit(k), F.lit(table[k]))
    return c


def normalize_records(df: DataFrame, decompose: Callable[[Column], Column] = strip_accents) -> DataFrame:
    """Records (id, src, name, addr, country) with all normalised forms, in one pass over all countries."""
    foreign = r"[\p{L}&&[^\p{IsLatin}]]"
    d = df.select(
        "id", "src", F.trim(F.lower("country")).alias("cty"), "name",
        F.coalesce(F.col("name"), F.lit("")).rlike(foreign).alias("name_nonlatin"),
        F.coalesce(F.col("addr"), F.lit("")).rlike(foreign).alias("addr_nonlatin"),
        base_clean(F.col("name"), decompose).alias("n"), base_clean(F.col("addr"), decompose).alias("a"),
    )
    d = d.select(
        "*", is_handle(F.coalesce("name", F.lit("")), F.col("n")).alias("is_handle"), has_phone(F.col("n")).alias("name_phone"),
        scrub_name(F.col("n")).alias("scrubbed"), scrub_address(F.col("a")).alias("address"),
    )
    d = d.select(
        "id", "src", "cty", "name_nonlatin", "addr_nonlatin", "is_handle", "name_phone",
        F.col("address").rlike(L.LANDMARK_RE).alias("has_landmark"),
        F.when(F.col("name_nonlatin"), repair_legal(F.col("scrubbed"))).otherwise(F.col("scrubbed")).alias("n"),
        state_codes(segments(F.col("address")), F.col("cty")).alias("segs"),
    )
    plain = F.filter("segs", lambda s: ~s.startswith("~") & ~s.rlike(r"[^\x00-\x7f]") & (s != ""))
    d = d.select(
        "*", keep(_words(F.col("n")), L.NULL_WORDS).alias("nt"),
        joined(F.array_sort(F.array_distinct(F.transform(F.filter("segs", lambda s: s.startswith("~")), lambda s: F.substring(s, 2, 9))))).alias("addr_state"),
        joined(plain).alias("a"), alias_of(F.col("n")).alias("name_alias"),
    )
    d = d.select(
        "*", joined(F.array_distinct("nt")).alias("name_norm"), F.array_distinct(mapped(F.col("nt"), L.NAME_WORDS)).alias("ne"),
        joined(keep(F.col("nt"), L.SQUASH_DROP), "").alias("sq"),
        F.array_distinct(
            keep(mapped(F.transform(_words(F.col("a")), lambda w: F.regexp_replace(w, r"^0+(\d)", "$1")), L.ADDRESS_WORDS), L.ADDRESS_STOP + L.NULL_WORDS)
        ).alias("at"),
    )
    legal = F.array(*[F.lit(w) for w in L.LEGAL])
    numbers = F.filter(F.transform("at", lambda w: F.regexp_extract(w, r"^(\d+)", 1)), lambda w: w != "")
    d = d.select(
        "*", joined(F.col("ne")).alias("name_exp"), joined(keep(F.col("ne"), L.LEGAL + L.WEAK + L.NAME_STOP)).alias("core"),
        joined(F.array_sort(F.filter("ne", lambda w: F.array_contains(legal, w)))).alias("legal"),
        joined(F.col("at")).alias("addr_norm"), F.array_distinct(numbers).alias("addr_nums"),
    )
    return d.select(
        "id", "src", "cty", "name_norm", "name_exp",
        F.when(F.col("core") == "", F.col("name_exp")).otherwise(F.col("core")).alias("name_core"),
        F.when(F.col("sq") == "", F.replace("name_norm", F.lit(" "), F.lit(""))).otherwise(F.col("sq")).alias("name_sq"),
        "name_alias", "legal", "name_nonlatin", "is_handle", "name_phone", "addr_norm", "addr_state", "addr_nums",
        F.get("addr_nums", F.lit(0)).alias("addr_num1"), "addr_nonlatin", (F.col("addr_norm") == "").alias("addr_empty"), "has_landmark",
    )
