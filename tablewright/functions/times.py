"""Reading timestamps from text when the layout is not known beforehand.

A value is split into its date and its time of day. Each has a short list of
layouts; the first of each that reads every value of the column is used, so one
column never mixes layouts. Which ones fit is found by a look at the whole column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import looks

_CLOCK = r"[ T](\d{1,2}(?::.*)?)$"
# A layout is a pattern and the ISO text made from its groups. Month before day wins,
# as in the first two slash layouts. Braces hold a month name.
_YEAR_FIRST = r"^(\d{4})%s(\d{1,2})%s(\d{1,2})$"
_YEAR_LAST = r"^(\d{1,2})%s(\d{1,2})%s(\d{4})$"
Layouts = tuple[tuple[str, str], ...]
_DATES: Layouts = (
    *((_YEAR_FIRST % (mark, mark), "$1-$2-$3") for mark in ("-", "/", r"\.")),
    (r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"),
    *((_YEAR_LAST % (mark, mark), "$3-$1-$2") for mark in ("/", "-", r"\.")),
    *((_YEAR_LAST % (mark, mark), "$3-$2-$1") for mark in ("/", "-", r"\.")),
    (r"^(\d{1,2})[ -]([A-Za-z]+)[ -](\d{4})$", "$3-{$2}-$1"),
    (r"^([A-Za-z]+) (\d{1,2}),? (\d{4})$", "$3-{$1}-$2"),
    (r"^(\d{4})-(\d{1,2})$", "$1-$2-01"),
    (r"^(\d{4})$", "$1-01-01"),
)
_TIMES: Layouts = (
    (r"^$", "00:00:00"),
    (r"^(\d{1,2}:\d{2}:\d{2})$", "$1"),
    (r"^(\d{1,2}:\d{2})$", "$1:00"),
    (r"^(\d{1,2}:\d{2}:\d{2}\.\d{1,6})\d{0,3}$", "$1"),
    (r"^(\d{1,2})$", "$1:00:00"),
)
# Texts that stand for no timestamp at all, month names, the range of
# signed 64-bit nanoseconds.
BLANKS = ("", "NaT")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_EARLIEST, _LATEST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"
_NANOS_PER_MICRO = 1000


def layouts_of(text: Column) -> list[looks.Question]:
    """Which layout the dates of a column have, and which its times of day: pattern and ISO text."""
    day, clock = _split(F.when(_filled(text), text))
    return [_question(day, _DATES, _day), _question(clock, _TIMES, _clock)]


def read_guessing(
    frame: DataFrame, text: Column, name: str, answers: list[Column] | None = None
) -> tuple[DataFrame, Column]:
    """Timestamps from text in one of the known layouts; NULL where unreadable.

    ``answers`` are those to ``layouts_of``; without them the frame is asked. Intermediate
    results become columns of the returned frame, under the given name, so that none is
    computed twice.
    """
    if answers is None:
        frame, answers = looks.asked(frame, layouts_of(text), f"{name}_told")
    texts, moment = dict(zip(("day", "clock"), _split(text))), f"{name}_moment"
    frame = frame.withColumns({f"{name}_{part}": column for part, column in texts.items()})
    frame = frame.withColumns(
        {f"{name}_{part}": _rewritten(F.col(f"{name}_{part}"), layout) for part, layout in zip(("day", "clock"), answers, strict=True)}
    )
    day, clock = F.col(f"{name}_day"), F.col(f"{name}_clock")
    numbered = F.when(F.contains(day, F.lit("{")), _number_month(day)).otherwise(day)
    frame = frame.withColumn(moment, F.concat(numbered, F.lit(" "), clock).try_cast("timestamp_ntz"))
    return frame, F.when(_filled(text), in_range(F.col(moment)))


def read_layout(text: Column, layout: str) -> Column:
    """Timestamps from text in a stated Spark datetime pattern; NULL where unreadable."""
    # Read as UTC and rebuilt from the epoch, so the session's time zone has no say.
    instant = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(layout + " X"))
    return F.when(_filled(text), in_range(from_micros(F.unix_micros(instant))))


def from_nanos(number: Column) -> Column:
    """Timestamps from nanoseconds since 1970, cut to microseconds."""
    micros = F.floor(number.cast("decimal(38,6)") / _NANOS_PER_MICRO).cast("bigint")
    return in_range(from_micros(micros))


def from_micros(micros: Column) -> Column:
    days = F.floor(micros / 86_400_000_000).cast("int")
    rest = (micros - days.cast("bigint") * 86_400_000_000).cast("decimal(18,6)") / 1_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days, F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def in_range(moment: Column) -> Column:
    """Only what fits signed 64-bit nanoseconds."""
    low, high = (F.lit(bound).cast("timestamp_ntz") for bound in (_EARLIEST, _LATEST))
    return F.when((moment >= low) & (moment <= high), moment)


def _filled(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(*BLANKS)


def _split(text: Column) -> tuple[Column, Column]:
    """The date and the time of day in a text."""
    day = F.regexp_replace(text, _CLOCK, "")
    return day, F.regexp_extract(text, _CLOCK, 1)


def _question(texts: Column, layouts: Layouts, read: Callable[..., Column]) -> looks.Question:
    """The first layout that fits every text. The answer is the pattern itself, so that each row is matched only once."""
    bits: dict[str, list[tuple[int, str]]] = {}
    for i, (pattern, iso) in enumerate(layouts):
        bits.setdefault(pattern, []).append((1 << i, iso))

    def fits(text: Column) -> Column:
        # No text matches two patterns, so a row is matched until one does.
        found = F
        for pattern, ways in bits.items():
            read_so = (F.when(read(text, pattern, iso).isNotNull(), F.lit(bit)).otherwise(0) for bit, iso in ways)
            found = found.when(text.rlike(pattern), reduce(lambda a, b: a.bitwiseOR(b), read_so).cast("bigint"))
        return found.otherwise(F.lit(0).cast("bigint"))

    return looks.Question(
        texts, fits, looks.first_bit([F.struct(F.lit(pattern).alias("pattern"), F.lit(iso).alias("iso")) for pattern, iso in layouts])
    )


def _rewritten(text: Column, layout: Column) -> Column:
    """Text in its layout as ISO text. The layout is known to fit, so it is not matched again."""
    return F.regexp_replace(text, layout["pattern"], layout["iso"])


def _number_month(read: Column) -> Column:
    """``2024-{Jan}-15`` as ``2024-1-15``."""
    name = F.lower(F.regexp_extract(read, r"\{(\w{3})\w*\}", 1))
    number = F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("string")
    return F.concat(F.substring_index(read, "{", 1), number, F.substring_index(read, "}", -1))


def _day(text: Column, pattern: str, iso: str) -> Column:
    """The date in a text that matches the pattern."""
    read = F.regexp_replace(text, pattern, iso)
    if "{" in iso:
        read = _number_month(read)
    return read.try_cast("date")


def _clock(text: Column, pattern: str, iso: str) -> Column:
    """The time of day in a text that matches the pattern."""
    return F.concat(F.lit("2000-01-01 "), F.regexp_replace(text, pattern, iso)).try_cast("timestamp_ntz")
