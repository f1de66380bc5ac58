"""Numbers and names out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source system trims it (ASCII blanks plus
# the Unicode space separators; Spark's own trim only removes U+0020).
BLANKS = (
    " \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Formats of the landed texts.
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
SIGNED_PREFIX = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
GAP = r"[\s\x{A0}\x{202F}]*"
# Polish initials of the macro nutrients in the info line.
MACRO_LETTERS = {"protein_g": "B", "carbs_g": "W", "fat_g": "T"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def fold_case(c: Column | str) -> Column:
    return F.lower(strip(c))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def money(c: Column | str) -> Column:
    """``"1 234,50 zł"`` -> 1234.5; NULL when no number starts the text.

    Only the first comma is a decimal point, everything but digits, dots and
    minus signs is noise, and the longest numeric prefix of the rest counts.
    """
    dotted = F.regexp_replace(col(c).cast("string"), r"^([^,]*),", "$1.")
    digits = F.regexp_replace(dotted, r"[^0-9.\-]", "")
    return F.regexp_substr(digits, F.lit(SIGNED_PREFIX)).try_cast("double")


def number(c: Column | str) -> Column:
    """Lenient number: text that is none becomes NULL."""
    return strip(col(c).cast("string")).try_cast("double")


def first_number(c: Column | str) -> Column:
    """First unsigned number of a text such as ``"18,87g"`` or ``"300.4 kcal / 1257 kJ"``."""
    return _number(F.regexp_substr(col(c).cast("string"), F.lit(NUMBER)))


def _captured(c: Column, pattern: str) -> Column:
    return _number(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))


def info_kcal(c: Column | str) -> Column:
    return _captured(col(c), rf"(?i)({NUMBER}){GAP}kcal")


def info_macro(c: Column | str, macro: str) -> Column:
    letter = MACRO_LETTERS[macro]
    return _captured(col(c), rf"(?i){letter}:{GAP}({NUMBER}){GAP}g")


def macros(info: Column | str) -> Column:
    """``"300 kcal • B:19g • W:30g • T:11g"`` -> struct(kcal, protein_g, carbs_g, fat_g)."""
    return F.struct(
        info_kcal(info).alias("kcal"),
        *[info_macro(info, name).alias(name) for name in MACRO_LETTERS],
    )


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def joined_line(*parts: Column | str) -> Column:
    """Non-empty parts joined with a middle dot."""
    kept = F.filter(F.array(*[col(p) for p in parts]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(kept, " · ")
