"""Fields of a database query-log row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailwarden.functions.text import is_missing, iso_instant, strip_blanks

# --- Fixed values -----------------------------------------------------------
NOISE_CONTAINS = ("general_log", "information_schema", "performance_schema", "@@")
NOISE_PREFIXES = ("set ", "show ", "use ")
# The same rules over the untrimmed text, as one pattern.
NOISE_PATTERN = (
    r"(?i)\A[\x00-\x20]*+(?:\z|(?:set|show|use) [\x00-\x20]*+[^\x00-\x20])"
    r"|general_log|information_schema|performance_schema|@@"
)
LOG_COMMANDS = ("Query", "Execute")
LOG_ID_PREFIX = "mysql-"
UNKNOWN_USER = "unknown"
# ----------------------------------------------------------------------------


def statement_text(argument: Column) -> Column:
    """Trimmed statement, empty for null."""
    return strip_blanks(F.coalesce(argument, F.lit("")))


def is_noise(argument: Column) -> Column:
    """Whether a log row is dropped; one scan of the text, true for null."""
    return F.coalesce(F.regexp_like(argument, F.lit(NOISE_PATTERN)), F.lit(True))


def noise_reason(statement: Column) -> Column:
    """Why a statement is not worth keeping, or null when it is."""
    lowered = F.lower(statement)
    reason = F.when(statement == "", F.lit("empty"))
    for word in NOISE_CONTAINS:
        reason = reason.when(F.contains(lowered, F.lit(word)), F.lit(word))
    for prefix in NOISE_PREFIXES:
        reason = reason.when(F.startswith(lowered, F.lit(prefix)), F.lit(prefix.strip()))
    return reason


def log_user(user_host: Column) -> Column:
    """``boris[boris] @ host`` -> ``boris``; nothing usable -> ``unknown``."""
    name = F.when(F.instr(user_host, "[") > 1, F.substring_index(user_host, "[", 1)).otherwise(
        user_host
    )
    return F.when(is_missing(name), F.lit(UNKNOWN_USER)).otherwise(strip_blanks(name))


def statement_keyword(statement: Column) -> Column:
    """Upper-cased text before the first space (other blanks do not end it)."""
    return F.upper(F.substring_index(statement, " ", 1))


def log_event_id(event_time: Column, thread_id: Column, statement: Column) -> Column:
    """Same row, same id: a digest of time, thread and statement."""
    identity = F.concat_ws(
        "|",
        iso_instant(event_time),
        F.coalesce(thread_id, F.lit(0)).cast("string"),
        statement,
    )
    return F.concat(F.lit(LOG_ID_PREFIX), F.substring(F.sha2(identity, 256), 1, 32))
