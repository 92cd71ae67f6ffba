"""Cleaners: raw text -> typed value, as column expressions inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Tokens, formats and replacements.
# ---------------------------------------------------------------------------

FLOAT_NULLS = ("", "None", "NULL", "null", "NA", "N/A", "na", "n/a", "<NA>")
TRUE_WORDS = ("yes", "y", "true", "t", "1", "on", "completed", "success")
FALSE_WORDS = ("no", "n", "false", "f", "0", "off", "failed", "failure")

SOURCE_DATE_FORMATS = {
    "tamara": ("M/d/yyyy H:m", "M/d/yyyy"),
    "payfort": ("yyyy-M-d",),
    "metabase": ("yyyy-M-d H:m:s", "M/d/yyyy"),
    "checkout_v1": ("M/d/yyyy", "yyyy-M-d H:m:s"),
    "checkout_v2": ("yyyy-M-d H:m:s", "M/d/yyyy"),
    "bank": ("d-M-yyyy",),
    "portal": ("d/M/yyyy",),
}
DATE_FORMATS = (
    "d/M/yyyy", "M/d/yyyy", "yyyy-M-d", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "M.d.yyyy", "d MMM yyyy",
    "MMM d yyyy", "yyyyMMdd", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m:s",
)
TIME_FORMATS = ("H:m:s", "H:m", "h:m:s a", "h:m a")

SPREADSHEET_EPOCH = "1899-12-30"
SPREADSHEET_LAST_DAY = 106751

MOJIBAKE = {"Ã˜": "ا", "Ù†": "ن", "Ø¹": "ع", "Ø§": "ا", "Ù…": "م"}
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}

# What counts as blank at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")

ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"

# ---------------------------------------------------------------------------

_SHAPES = {
    "yyyy": r"\d{4}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}",
    "H": r"\d{1,2}", "h": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "a": "[AaPp][Mm]",
}


def _shape(fmt: str) -> str:
    """Regex for the texts a datetime pattern can accept.

    Testing it first keeps the parser away from texts it would reject with a (costly) exception.
    """
    parts = re.findall(r"yyyy|MMM|MM|dd|[MdHhmsa]|.", fmt)
    return "^" + "".join(_SHAPES.get(p, re.escape(p)) for p in parts) + "$"


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(c: Column) -> Column:
    return F.lower(c).isin("none", "nan") | (c == "<NA>")


def clean_integer(c: Column, source: str | None = None, on_fraction: str = "null") -> Column:
    """64-bit integer. A value with a fraction becomes NULL, its floor, or an error."""
    number = F.when(
        strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(c).try_cast("decimal(38,18)"))
    whole = F.floor(number)
    if on_fraction == "floor":
        kept = whole
    elif on_fraction == "null":
        kept = F.when(number == whole, whole)
    elif on_fraction == "error":
        kept = F.when(number != whole, F.raise_error(F.concat(F.lit("not an integer: "), c))).otherwise(whole)
    else:
        raise ValueError(f"on_fraction must be null, floor or error, not {on_fraction!r}")
    return kept.try_cast("bigint")


def clean_float(c: Column, source: str | None = None) -> Column:
    """Double after dropping everything but digits, dots and minus signs."""
    digits = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(~strip(c).isin(*FLOAT_NULLS), digits.try_cast("double"))


def spreadsheet_date(c: Column, leap_adjust: bool = True) -> Column:
    """Date of a spreadsheet day number; ``leap_adjust`` takes one day off behind day 59."""
    serial = F.when(c.rlike(r"^\d+(\.\d*)?$"), c.try_cast("double"))
    days = F.when(serial > 59, serial - 1).otherwise(serial) if leap_adjust else serial
    days = F.floor(days)
    return F.when(
        days <= SPREADSHEET_LAST_DAY, F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), days.cast("int")))


def clean_date(c: Column, source: str | None = None, excel_leap_adjust: bool = True) -> Column:
    """Date: day number, then the source's formats, then the general ones, then ISO 8601."""
    by_shape: dict[str, list[str]] = {}
    for fmt in dict.fromkeys(SOURCE_DATE_FORMATS.get(source or "", ()) + DATE_FORMATS):
        by_shape.setdefault(_shape(fmt), []).append(fmt)
    # Shapes exclude each other, so only the order of formats within one matters. The ISO shape
    # is wider than the one with a full time; what that one rejects is no ISO date either.
    parsed = F
    for shape, formats in by_shape.items():
        parsed = parsed.when(c.rlike(shape), F.coalesce(*[F.try_to_date(c, f) for f in formats]))
    parsed = parsed.when(c.rlike(ISO_DATE), c.try_cast("date"))
    return F.when(~is_null_token(c), F.coalesce(spreadsheet_date(c, excel_leap_adjust), parsed))


def clean_time(c: Column, source: str | None = None) -> Column:
    """Time of day as 'HH:mm:ss'; a day fraction such as 0.5 counts too."""
    text = strip(c)
    fraction = F.when(c.rlike(r"^\d*\.\d+$"), c.try_cast("double"))
    second = F.floor((fraction % 1) * 86400)
    from_fraction = F.format_string(
        "%02d:%02d:%02d", F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60)
    attempts = [
        F.when(text.rlike(_shape(f)), F.date_format(F.try_to_timestamp(text, F.lit(f)), "HH:mm:ss"))
        for f in TIME_FORMATS
    ]
    return F.when(
        ~is_null_token(c), F.coalesce(F.when(fraction.isNotNull(), from_fraction), *attempts))


def clean_string(c: Column, source: str | None = None) -> Column:
    text = F.regexp_replace(c, r'^="(.*)"$', "$1")
    text = F.regexp_replace(strip(text), r"\r\n|\n\r|\r|\n", " ")
    return strip_control(text)


def clean_boolean(c: Column, source: str | None = None) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def clean_uuid(c: Column, source: str | None = None) -> Column:
    """Canonical lower-case 8-4-4-4-12 form, NULL when the value is no UUID."""
    digits = F.replace(F.replace(strip(c), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.replace(F.regexp_replace(digits, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))
    digits = F.lower(digits)
    dashed = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)


def clean_text(c: Column, source: str | None = None) -> Column:
    text = clean_string(c)
    for broken, letter in {**MOJIBAKE, **ENTITIES}.items():
        text = F.replace(text, F.lit(broken), F.lit(letter))
    return F.regexp_replace(text, r"(?U)\s+", " ")


Cleaner = Callable[..., Column]

CLEANERS: dict[str, Cleaner] = {
    "integer": clean_integer,
    "float": clean_float,
    "date": clean_date,
    "time": clean_time,
    "string": clean_string,
    "boolean": clean_boolean,
    "uuid": clean_uuid,
    "text": clean_text,
}


def register_cleaner(name: str, fn: Cleaner) -> None:
    """Add or replace the cleaner of a type; ``fn(column, source=...)`` returns a column."""
    CLEANERS[name] = fn


def cleaner_for(py_type: str) -> Cleaner:
    return CLEANERS.get(py_type, clean_string)
