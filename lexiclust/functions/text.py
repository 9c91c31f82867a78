"""Column expressions for line text: normalisation, blank test, letter ratios.

Everything here is a JVM expression except NFKC, which Spark lacks. NFKC runs
in an Arrow-batched pandas UDF, and only rows that hold a character NFKC can
change are handed to Python (the rest travel as nulls).
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (cleaning rules).
# URL and e-mail patterns, the kept-character class, the Cyrillic range and the
# letters that mark Macedonian text.
URL_PATTERN = r"https?://\S+|www\.\S+"
EMAIL_PATTERN = r"\b[\w.\-+]+@[\w.\-]+\.\w+\b"
REFERENCE_KEEP_CLASS = r"[^0-9A-Za-zА-Яа-яЀ-ӿ\s]+"
CYRILLIC_CLASS = r"[А-Яа-яЀ-ӿ]"
MACEDONIAN_LETTERS = "ЃѓЌќЉљЊњЏџЅѕ"
MIN_SCRIPT_RATIO = 0.6
MIN_LINE_LENGTH = 20
# ---------------------------------------------------------------------------

# Keep-class for profiles outside the Cyrillic range: letters, digits, spaces.
UNICODE_KEEP_CLASS = r"[^\p{L}\p{N}\s]+"


@dataclass(frozen=True)
class LanguageProfile:
    """Script letters (a regex class), the distinctive letters, the keep-class
    used by normalisation, and the minimum share of script letters."""

    name: str
    script_class: str
    distinctive: str
    keep_class: str
    min_ratio: float = MIN_SCRIPT_RATIO


MACEDONIAN = LanguageProfile("mk", CYRILLIC_CLASS, MACEDONIAN_LETTERS, REFERENCE_KEEP_CLASS)
# A second profile, so the filter can be exercised on Latin-script text.
LATIN_ACCENTED = LanguageProfile("latin", r"\p{IsLatin}", "éèêàçñüß", UNICODE_KEEP_CLASS)


def _u(pattern: str) -> str:
    """Unicode-aware Java regex (\\w, \\s, \\b follow Unicode like Python 3)."""
    return "(?U)" + pattern


@functools.lru_cache(maxsize=1)
def nfkc_sensitive_chars() -> str:
    """The code points NFKC may change in some context, as one string.

    Built by rule from the Unicode database: a character is listed when NFKC
    changes it on its own, when it has a non-zero combining class, or when it
    can be the second half of a canonical composition. A string free of all
    of them is already in NFKC.
    """
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul V, T
    for cp in range(0x80, sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2:
                seconds.add(int(parts[1], 16))
    flagged = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if cp in seconds or unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch:
            flagged.append(ch)
    return "".join(flagged)


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(col: Column) -> Column:
    """Unicode NFKC; rows already in NFKC never leave the JVM."""
    # translate() looks characters up in a hash map: one pass, any alphabet; ASCII holds none
    sensitive = (F.octet_length(col) != F.length(col)) & (
        F.length(F.translate(col, nfkc_sensitive_chars(), "")) != F.length(col))
    return F.coalesce(_nfkc_udf(F.when(sensitive, col)), col)


def unicode_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(col, _u(r"^\s+|\s+$"), "")


def is_blank(col: Column) -> Column:
    return col.rlike(_u(r"^\s*$"))


def normalize_text(col: Column, lowercase: bool = True,
                   keep_class: str = REFERENCE_KEEP_CLASS, use_nfkc: bool = True) -> Column:
    """NFKC, URLs and e-mails to a space, characters outside the keep-class to a
    space, white space collapsed and stripped, then lower case.

    The two patterns run on the texts that hold what each of their matches holds. A
    keep-class that is one character class is replaced together with white space."""
    s = nfkc(col) if use_nfkc else col
    marked = s.contains("@") | s.contains("://") | s.contains("www.")
    cut = F.regexp_replace(F.regexp_replace(s, _u(URL_PATTERN), " "), _u(EMAIL_PATTERN), " ")
    s = F.when(marked, cut).otherwise(s)
    if keep_class in (REFERENCE_KEEP_CLASS, UNICODE_KEEP_CLASS):
        spaces = "[" + keep_class.removesuffix("+") + r"\s]+"
    else:
        s, spaces = F.regexp_replace(s, _u(keep_class), " "), r"\s+"
    s = F.trim(F.regexp_replace(s, _u(spaces), " "))
    if lowercase:
        s = F.lower(s)
    return s


def letter_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}]", ""))


def script_letter_count(col: Column, script_class: str) -> Column:
    letters = F.regexp_replace(col, r"[^\p{L}]", "")
    return F.length(F.regexp_replace(letters, "(?s)(?!" + script_class + ").", ""))


def matches_profile(col: Column, profile: LanguageProfile = MACEDONIAN) -> Column:
    """True when the text has letters, the script share is at least the
    profile's minimum, and one distinctive letter occurs anywhere."""
    letters = letter_count(col)
    script = script_letter_count(col, profile.script_class)
    distinctive = col.rlike("[" + profile.distinctive + "]")
    # CASE WHEN: no division is evaluated for a text without letters (ANSI mode)
    ratio_ok = F.when(letters > 0, (script / letters) >= F.lit(profile.min_ratio)).otherwise(F.lit(False))
    return ratio_ok & distinctive
