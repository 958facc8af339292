"""Scalar functions over text, time and scores, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
BLANK = r"^\s*$"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def not_blank(c: Column) -> Column:
    """The value itself where it holds more than white space, else null."""
    return F.when(~F.coalesce(c, F.lit("")).rlike(BLANK), c)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def short_id(c: Column) -> Column:
    """The last eight characters; shorter ids whole."""
    return F.right(c, F.lit(8))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy年MM月dd日")


def day_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy年MM月dd日 HH:mm")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def iso(ts: Column) -> Column:
    """ISO 8601 text; microseconds only where they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = micros(ts) % SECOND
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(part.cast("string"), 6, "0")))


def parse_iso(text: Column) -> Column:
    """Zone-less timestamp of ISO text (``Z`` allowed); null where it does not parse."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


NUMBER = r"(?U)\b(\d+(?:\.\d+)?)\b"


def parse_score(reply: Column) -> Column:
    """A score from 0 to 10 in free text.

    Lines from the last up: the last number of a line counts if it is in range,
    and other numbers of that line are not tried.  If no line gives one, all
    numbers are tried from the end; else 0.
    """
    text = strip(F.coalesce(reply, F.lit("")))
    in_range = lambda x: (x >= 0) & (x <= 10)
    lasts = F.transform(F.reverse(F.split(text, "\n")), lambda line: F.get(F.reverse(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(1))), F.lit(0)).cast("double"))
    by_line = F.get(F.filter(lasts, lambda x: x.isNotNull() & in_range(x)), F.lit(0))
    every = F.transform(F.reverse(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))), lambda x: x.cast("double"))
    return F.coalesce(by_line, F.get(F.filter(every, in_range), F.lit(0)), F.lit(0.0))


def sample_key(instruction: Column, given: Column, output: Column) -> Column:
    """Content key of a training sample."""
    parts = [F.coalesce(c, F.lit("")) for c in (instruction, given, output)]
    return F.md5(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]))


def render(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled; values are not scanned again."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def percent(part: Column, whole: Column) -> Column:
    """Percent of a total; 0 where there is none."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
