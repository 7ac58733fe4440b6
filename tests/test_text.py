"""Redaction, instants and query-log fields."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trailwarden.functions import logtext, text

# own statements with results worked out by hand
REDACTIONS = {
    "DELETE FROM basket WHERE owner = 'k.lund' AND slot IN (7, 12)": "DELETE FROM basket WHERE owner = ? AND slot IN (?, ?)",
    "UPDATE shelf SET label = 'it''s', note = 'back\\'slash' WHERE h2o < 0.75": "UPDATE shelf SET label = ?, note = ? WHERE h2o < ?",
    "CALL\tarchive_v3 (\n  2024 )": "CALL archive_v3 ( ? )",
    "": "",
    "\x00 v = 'never closed \\": "v = ?",
    '"two ""quoted"" words"||8.8.8.8': "?||?",
    "3d e4 _5 $6 .7 8e9": "?d e4 _5 $6 .? ?e9",
}


def test_redaction_examples(spark):
    frame = spark.createDataFrame([(t,) for t in REDACTIONS], "sql string")
    assert {r.sql: r.out for r in frame.select("sql", text.redact_sql(F.col("sql")).alias("out")).collect()} == REDACTIONS


def test_redaction_properties(spark):
    """Nothing of a literal survives, whatever the text; a second pass changes nothing more."""
    rng = random.Random(7)
    alphabet = ["'", '"', "\\", "1", "23", ".", "a", "_", "$", " ", "\n", "\t", "é", "٣", "-", "''", "x=1", "(", "\x00", "\x1f", "\U0001f600"]
    fuzz = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    fuzz += ["SELECT " + "x, " * 400 + "y FROM t", "'" + "a" * 200_000, "\\'" * 30_000]
    out = F.col("out")
    frame = spark.createDataFrame([(t,) for t in fuzz], "sql string").select("sql", text.redact_sql(F.col("sql")).alias("out"))
    rows = frame.select("sql", "out", text.redact_sql(out).alias("again")).collect()
    for r in rows:
        assert not set(r.out) & set("'\"\n\t") and "  " not in r.out, r
        assert not re.search(r"(?<![^\W_])(?<![_$])\d", r.out), r
        assert r.out == r.again or len(r.out) > 500, r
        assert len(r.out.encode("utf-16-le")) // 2 <= 501, r
    assert {len(r.out) for r in rows if r.sql.startswith("SELECT")} == {501}


def test_redaction_is_cut_by_utf16_units(spark):
    cases = {
        "x " + "\U0001f600" * 600: "x " + "\U0001f600" * 249 + "…",
        "xy " + "\U0001f600" * 600: "xy " + "\U0001f600" * 248 + "…",
        "x" * 498 + "\U0001f600": "x" * 498 + "\U0001f600",
        "x" * 499 + "\U0001f600": "x" * 499 + "…",
    }
    frame = spark.createDataFrame([(t,) for t in cases], "sql string")
    assert {r.sql: r.out for r in frame.select("sql", text.redact_sql(F.col("sql")).alias("out")).collect()} == cases


def test_redacting_null_is_null(spark):
    assert spark.range(1).select(text.redact_sql(F.lit(None).cast("string"))).first()[0] is None


def test_instants(spark):
    cases = {
        "2024-01-01T00:00:07.179575Z": "2024-01-01T00:00:07.179575Z",
        "2024-01-01T00:00:07.120Z": "2024-01-01T00:00:07.120Z",
        "2024-01-01T00:00:07.100100Z": "2024-01-01T00:00:07.100100Z",
        "2024-01-01T02:00:00+02:00": "2024-01-01T00:00:00Z",
        "1704067200.250000000": "2024-01-01T00:00:00.250Z",
        "1.70406720025E9": "2024-01-01T00:00:00.250Z",
        "86400": "1970-01-02T00:00:00Z",
        "2024-01-01T00:00:00": None,
        "yesterday": None,
        "": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.out for r in frame.select("v", text.iso_instant(text.parse_instant(F.col("v"))).alias("out")).collect()}
    assert got == cases


def test_log_fields(spark):
    users = {
        "nils[nils] @ localhost [127.0.0.1]": "nils", "plainuser": "plainuser", "  ": "unknown",
        " [x]": "unknown", "[x] @ h": "[x] @ h", " a [x]": "a",
    }
    noise = {
        "SELECT MAX(event_time) FROM mysql.general_log": "general_log", "SELECT * FROM information_schema.tables": "information_schema",
        "SET autocommit=1": "set", "SHOW VARIABLES": "show", "select @@session.tx_isolation": "@@", "": "empty",
        "use db": "use", "SELECT 1 FROM performance_schema.x": "performance_schema", "SET\tx=1": None, "SELECT 1": None,
    }
    frame = spark.createDataFrame([(u,) for u in users], "v string")
    assert {r.v: r.o for r in frame.select("v", logtext.log_user(F.col("v")).alias("o")).collect()} == users
    frame = spark.createDataFrame([(u,) for u in noise], "v string")
    assert {r.v: r.o for r in frame.select("v", logtext.noise_reason(F.col("v")).alias("o")).collect()} == noise
    rng = random.Random(5)
    pieces = ["set", "SHOW", "use", " ", "  ", "\t", "\x00", "@@", "@", "general_log", "x", "Information_Schema", ""]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in [*texts, *noise, None]], "v string")
    both = frame.where(
        logtext.is_noise(F.col("v")) != logtext.noise_reason(logtext.statement_text(F.col("v"))).isNotNull()
    )
    assert both.collect() == []
    row = spark.range(1).select(
        logtext.log_user(F.lit(None).cast("string")).alias("user"),
        logtext.statement_keyword(F.lit("select\n* FROM t")).alias("word"),
        logtext.statement_text(F.lit("\t x \x00")).alias("stmt"),
    ).first()
    assert (row.user, row.word, row.stmt) == ("unknown", "SELECT\n*", "x")
