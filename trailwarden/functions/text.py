"""Text helpers as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Characters at or below U+0020 on either end.
EDGE_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+\z"
# Java's whitespace characters (no-break spaces are not among them).
WHITESPACE = r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
# A quoted literal (doubled quote and backslash escapes, an open one runs to
# the end of the text) or a number that does not continue an identifier.
SQL_LITERAL = (
    r"(?s)'(?:\\.|''|[^'])*+(?:'|\z)"
    r'|"(?:\\.|""|[^"])*+(?:"|\z)'
    r"|(?<![\p{L}\p{Nd}_$])\p{Nd}[\p{Nd}.]*+"
)
REDACTED_MAX = 500
ELLIPSIS = "\u2026"
OVERLONG = rf"(?s)\A(.{{{REDACTED_MAX}}}).+\z"
# Characters that are two UTF-16 units; the mark stands for the second one.
PAIRS = r"[\x{10000}-\x{10FFFF}]"
MARK = "\uffff"
# ----------------------------------------------------------------------------


def strip_blanks(text: Column) -> Column:
    """Remove control characters and spaces from both ends."""
    return F.regexp_replace(text, F.lit(EDGE_BLANKS), F.lit(""))


def is_blank(text: Column) -> Column:
    """True for text without any non-whitespace character; null stays null."""
    return ~F.regexp_like(text, F.lit(f"[^{WHITESPACE}]"))


def is_missing(text: Column) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(is_blank(text), F.lit(True))


def redact_sql(sql: Column) -> Column:
    """Keep the shape of a statement, replace every literal by ``?``."""
    masked = F.regexp_replace(sql, F.lit(SQL_LITERAL), F.lit("?"))
    spaced = F.regexp_replace(masked, F.lit(f"[{WHITESPACE}]+"), F.lit(" "))
    # Each step refers to the one before just once, so nothing is evaluated twice.
    return _cut(strip_blanks(spaced))


def _cut(text: Column) -> Column:
    """At most ``REDACTED_MAX`` UTF-16 units and an ellipsis; a pair that the cut would halve goes."""

    def cut(whole: Column) -> Column:
        return F.regexp_replace(whole, F.lit(OVERLONG), F.lit("$1" + ELLIPSIS))

    def once(x: Column) -> Column:
        counted = cut(F.regexp_replace(x, F.lit(f"({PAIRS})"), F.lit("$1" + MARK)))
        whole = F.regexp_replace(counted, F.lit(f"{PAIRS}{ELLIPSIS}\\z"), F.lit(ELLIPSIS))
        units = F.regexp_replace(whole, F.lit(f"({PAIRS}){MARK}"), F.lit("$1"))
        return F.when(F.regexp_like(x, F.lit(PAIRS)), units).otherwise(cut(x))

    return F.element_at(F.transform(F.array(text), once), 1)


def iso_instant(ts: Column) -> Column:
    """ISO-8601 in UTC with 0, 3 or 6 fraction digits, e.g. ``...:07.125Z``."""
    micros, shown = F.unix_micros(ts), lambda fraction: F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss{fraction}'Z'")
    return F.when(micros % 1_000_000 == 0, shown("")).when(micros % 1000 == 0, shown(".SSS")).otherwise(shown(".SSSSSS"))


def parse_instant(text: Column) -> Column:
    """ISO text with a zone, or decimal epoch seconds; anything else is null."""
    epoch = F.timestamp_micros(
        (text.try_cast("decimal(20,9)") * F.lit(1000000)).cast("decimal(38,9)").try_cast("bigint")
    )
    return F.when(F.regexp_like(text, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), epoch).when(
        F.regexp_like(text, F.lit(r"^-?\d{4,6}-\d\d-\d\dT\d\d:\d\d.*(?:Z|[+-]\d\d:?\d\d)$")),
        F.try_to_timestamp(text),
    )
