"""Column expressions for names, terms and texts. All run in the JVM, but for NFC, which Spark lacks."""

from __future__ import annotations

import difflib
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vowel marks, letters and blocks of the Hebrew script.
MARKS = "[ְ-ׇ]"
HEBREW_LETTER = "[א-ת]"
HEBREW = "[֐-׿יִ-ﭏ]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC; ASCII texts are never sent to Python."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_nfc(F.when(F.octet_length(text) != F.length(text), text)))


def clean_text(text: Column, compose: bool = True) -> Column:
    """Marks and control characters go, runs of blanks and empty lines shrink."""
    t = F.regexp_replace(text, MARKS, "")
    t = nfc(t) if compose else t
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return F.trim(t, F.lit(" \t\r\n"))


def normal_english(term: Column) -> Column:
    return F.translate(F.trim(F.lower(term)), "-_", "  ")


def normal_hebrew(term: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(term, MARKS, ""), "[״\"]", "")
    return F.trim(F.regexp_replace(F.lower(nfc(t)), "\\s+", " "))


def normal_term(term: Column) -> Column:
    return F.when(term.rlike(HEBREW_LETTER), normal_hebrew(term)).otherwise(normal_english(term))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters; equal strings need no Python."""
    return F.when(a == b, F.lit(1.0)).otherwise(_ratio(a, b))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def term_id(normal: Column, language: Column) -> Column:
    return uuid5(F.concat_ws("::", normal, language))


def class_id(name: Column) -> Column:
    return uuid5(F.concat(F.lit("class::"), F.lower(name)))


def asset_id(qualified_name: Column) -> Column:
    return uuid5(qualified_name)


def split_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def edge_type(name: Column) -> Column:
    return F.upper(F.translate(name, " ", "_"))


# Labels that an extracted end of an edge may have, and the one that any other label becomes.
NODE_LABELS, OTHER_LABEL = ["Site", "Facility", "Component", "System", "Department"], "Facility"


def node_label(kind: Column) -> Column:
    """First letter upper case, the rest lower case, if that is a known label."""
    label = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1 << 30)))
    return F.when(label.isin(NODE_LABELS), label).otherwise(F.lit(OTHER_LABEL))


def display(hebrew: Column, base: Column) -> Column:
    """The Hebrew text if there is any, else the other one."""
    return F.when(F.length(hebrew) > 0, hebrew).otherwise(base)


def short_quote(quote: Column, most: int = 500) -> Column:
    return F.substring(quote, 1, most)


def asset_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "\\."), -1)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), "\\s+")))


# Kinds of concepts that are open within the organisation, and the sensitivity of these and of all others.
OPEN_KINDS, OPEN, CLOSED = ("ROLE", "TERM"), "INTERNAL", "CONFIDENTIAL"


def default_sensitivity(concept_type: Column) -> Column:
    return F.when(concept_type.isin(*OPEN_KINDS), OPEN).otherwise(CLOSED)


def low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.7)) < 0.6


# Words that a section header begins or ends with.
HEADER_WORDS = ["נוהל", "פרק", "סעיף", "חלק", "נספח", "מבוא", "רקע", "הגדרות", "אחריות", "הוראות", "כללי", "מטרה", "הפעלה"]


def is_header(line: Column) -> Column:
    """At most 80 characters once stripped and numbered (digits and a full stop), beginning or ending with a header word,
    or at most 40 characters with a letter and none that upper case would change."""
    t = F.trim(line, F.lit(" \t\r\n"))
    numbered = t.rlike(r"^(\p{Nd}+\.|א\.-ת\.)")
    keyed = F.lit(False)
    for w in HEADER_WORDS:
        keyed = keyed | t.startswith(w) | t.endswith(w)
    capitals = (F.length(t) <= 40) & (t == F.upper(t)) & t.rlike(r"\p{L}")
    return (F.length(t) > 0) & (F.length(t) <= 80) & (numbered | keyed | capitals)


def quoted_abbreviations(text: Column) -> Column:
    """Abbreviations written as Hebrew letters, a quotation mark and letters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('([א-ת]+"[א-ת]+)'), F.lit(1))


def windows(text: Column, size: int = 1500, overlap: int = 200, least: int = 20) -> Column:
    """Windows of `size` characters, each starting size - overlap after the last, without those too short when stripped."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.filter(parts, lambda p: F.length(F.trim(p["text"], F.lit(" \t\r\n"))) >= least)


def is_hierarchical(kind: Column, text: Column, signals: list[str]) -> Column:
    hits = sum((F.when(F.contains(F.lower(text), F.lit(s)), 1).otherwise(0) for s in signals), F.lit(0))
    return kind.isin("dictionary", "catalog") | (hits >= 2)
