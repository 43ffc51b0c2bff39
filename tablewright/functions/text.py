"""Text: how values print, and patterns written for Python run on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions import looks
from tablewright.functions.values import BOOL, FLOAT, INT, NULL, TEXT, TIME, Value

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Regex characters a LIKE pattern takes literally.
_LIKE_LITERALS = set("\\.^$*+?{}[]|()")


def as_text(frame: DataFrame, value: Value, unit: Column | None = None) -> Column:
    """A value as it prints: 10, 255.0, 1e+16, True, 2024-01-15.

    ``unit`` is the answer to ``finest_unit``; without it the frame is asked.
    """
    if value.kind == TEXT:
        return value.column
    if value.kind == BOOL:
        return F.when(value.column, F.lit("True")).when(~value.column, F.lit("False"))
    if value.kind == FLOAT:
        return double_text(value.clean())
    if value.kind == TIME:
        return time_text(value.column, looks.ask(frame, [finest_unit(value.column)])["answer0"] if unit is None else unit)
    if value.kind in (INT, NULL):
        return value.column.cast("string")
    raise TransformError("Nested and binary values have no text form")


def double_text(number: Column) -> Column:
    """A double in Python's shortest form.

    Spark and Python find the same digits. Spark writes an exponent from 1.0E7 up and
    below 1.0E-3, Python only from 1e+16 up and below 1e-4.
    """
    # Each branch makes the text once and needs no pattern: short code is compiled to fast code.
    text, size = number.cast("string"), F.abs(number)
    # No whole number lies between a fraction and its shortest digits, so the digits before the point are those of `whole`.
    whole = number.try_cast("bigint").cast("string")
    behind = F.substr(_significand(text), F.length(whole) + 2)
    fraction = F.when(number == F.rint(number), F.lit("0")).otherwise(behind)
    zeros = F.when(number < 0, F.lit("-0.000")).otherwise(F.lit("0.000"))
    digits = F.rtrim(F.replace(_significand(size.cast("string")), F.lit("."), F.lit("")), F.lit("0"))
    power = F.replace(text, F.lit(".0E"), F.lit("E"))
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), text)
        .when((size >= 1e7) & (size < 1e16), F.concat(whole, F.lit("."), fraction))
        .when((size >= 1e-4) & (size < 1e-3), F.concat(zeros, digits))
        .when(size == float("inf"), F.replace(text, F.lit("Infinity"), F.lit("inf")))
        .when(size >= 1e16, F.replace(power, F.lit("E"), F.lit("e+")))
        .when(size >= 1e-9, F.replace(power, F.lit("E-"), F.lit("e-0")))
        .otherwise(F.replace(power, F.lit("E-"), F.lit("e-")))
    )


def _significand(text: Column) -> Column:
    """What stands before the exponent."""
    return F.substring_index(text, "E", 1)


def finest_unit(moment: Column) -> looks.Question:
    """How exact the timestamps of a column are: 0 dates alone, 1 seconds, 2 milliseconds, 3 microseconds."""
    # By numbers: printing every timestamp would cost many times as much. Time zones differ by whole seconds,
    # so the session's does not matter here.
    micros = F.unix_micros(moment.cast("timestamp"))
    # What needs a unit can be written in all finer ones: a bit for each.
    units = (
        F.when(moment == moment.cast("date").cast("timestamp_ntz"), 0b1111)
        .when(micros % 1_000_000 == 0, 0b1110)
        .when(micros % 1000 == 0, 0b1100)
        .when(moment.isNotNull(), 0b1000)
    )
    return looks.Question(units, lambda bits: bits.cast("bigint"), looks.first_bit([F.lit(u) for u in range(4)]))


def time_text(moment: Column, finest: Column) -> Column:
    """Timestamps in the shortest layout that fits the whole column, whose finest unit that is."""
    # Cut from the printed form: date_format would go through the session's time zone.
    text = moment.cast("string")
    seconds, micros = F.substring(text, 1, 19), F.rpad(F.substring(text, 21, 6), 6, "0")
    return (
        F.when(finest == 0, moment.cast("date").cast("string"))
        .when(finest == 1, seconds)
        .otherwise(F.concat(seconds, F.lit("."), F.when(finest == 2, F.left(micros, F.lit(3))).otherwise(micros)))
    )


def like_pattern(pattern: str) -> str:
    """``%`` and ``_`` as a regular expression; nothing escapes them."""
    wild = {"%": ".*", "_": "."}
    body = "".join(wild.get(c) or ("\\" + c if c in _LIKE_LITERALS else c) for c in pattern)
    return f"^{body}$"


def like(text: Column, pattern: str, *, stored_text: bool) -> Column:
    """LIKE over rendered text. What it says of fixed parts is also said in ways a scan understands."""
    matched = text.rlike("(?d)" + like_pattern(pattern))
    prefix, *others = re.split("[%_]", pattern)
    longest = max(others, key=len, default="")
    if stored_text and longest:
        matched = text.contains(longest) & matched
    if stored_text and prefix:
        matched = text.startswith(prefix) & matched
    return matched


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's notation, with Python's line ends and letters of all scripts."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda found: "(?<" + _group(found[1]) + ">", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda found: "\\k<" + _group(found[1]) + ">", pattern)
    flags = "(?dU)" if re.search(r"\\[wWdDsSbB]", pattern) else "(?d)"
    return flags + pattern.replace(r"\Z", r"\z")


def java_replacement(replacement: str) -> str:
    r"""A Python replacement in Java's notation: ``\1`` is ``$1``, ``$`` is itself."""

    def rewrite(found: re.Match[str]) -> str:
        if found["dollar"]:
            return r"\$"
        group = found["number"] or found["name"]
        if group:
            return "$" + group if group.isdigit() else "${" + _group(group) + "}"
        return {"n": "\n", "t": "\t", "r": "\r"}.get(found["other"], "\\" + found["other"])

    parts = r"(?P<dollar>\$)|\\(?P<number>\d+)|\\g<(?P<name>\w+)>|\\(?P<other>.)"
    return re.sub(parts, rewrite, replacement, flags=re.DOTALL)


def _group(name: str) -> str:
    """Java group names are letters and digits only."""
    return name.replace("_", "U95")


def regexp_replace(text: Column, pattern: str, replacement: str) -> Column:
    try:
        re.compile(pattern)
    except re.error as problem:
        raise TransformError(f"Invalid pattern '{pattern}': {problem}", phase="derivations") from problem
    return F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement)))
