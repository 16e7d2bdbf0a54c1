import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vectors as VX
from colloquy.operators import filters


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "first, want",
    [("", "Untitled"), (None, "Untitled"), ("plain", "plain"), ("  padded ", "padded"), ("a" * 200, "a" * 77 + "..."), ("a" * 80, "a" * 80), ("# Heading", "# Heading")],
)
def test_title(spark, first, want):
    assert one(spark, X.title("t"), t=first) == want


def test_first_message_passes_over_noise(spark):
    rows = [("a", 0, "user", "<command-message>x"), ("a", 1, "assistant", "no"), ("a", 2, "user", "  # New session - 1"), ("a", 3, "user", "real"), ("b", 0, "user", "<local-command-caveat>"), ("b", 1, "user", "# New session - 2")]
    got = spark.createDataFrame(rows, "s string, seq int, role string, content string").groupBy("s").agg(X.first_user_message().alias("f"))
    assert dict(map(tuple, got.collect())) == {"a": "real", "b": "<local-command-caveat>"}


@pytest.mark.parametrize("hours, want", [(0, "<1h"), (1, "1h"), (23, "23h"), (24, "1d"), (24 * 29, "29d"), (24 * 30, "1mo"), (24 * 65, "2mo"), (-5, "<1h")])
def test_age(spark, hours, want):
    assert one(spark, X.age_label(F.lit(10**12 - hours * 3_600_000), 10**12)) == want


@pytest.mark.parametrize("text, days", [("3d", 3), ("2w", 14), ("1m", 30), ("x", None), ("d", None), ("", None)])
def test_relative_time(spark, text, days):
    assert one(spark, X.relative_cutoff("t", 10**12), t=text) == (None if days is None else 10**12 - days * X.DAY_MS)


def test_small_expressions(spark):
    assert one(spark, X.decode_directory("k"), k="-home-user--config-x") == "/home/user/.config/x"
    assert one(spark, X.sanitize("k"), k="a\tb\x07c") == "a    bc"
    assert one(spark, X.flatten("k"), k=" a \n b c ") == "a b c"
    assert one(spark, X.rfc3339_ms("k"), k="2024-01-02T03:04:05.678Z") == 1704164645678
    assert one(spark, X.rfc3339_ms("k"), k="2024-01-02T03:04:05+02:00") == 1704157445000
    assert one(spark, X.rfc3339_ms("k"), k="yesterday") is None
    assert one(spark, X.match_offsets("k", "an"), k="Banana AN") == [1, 3, 7]
    assert one(spark, X.match_offsets("k", ""), k="x") == []
    assert one(spark, X.match_offsets("k", "i"), k="İi") == []
    assert one(spark, X.contains_line("k", "A  b"), k="x\nza\x07  B") is True
    assert one(spark, X.contains_line("k", "xz"), k="x\nz") is False
    assert one(spark, X.export_name(F.lit("CC"), F.lit("a/b c:d-é_"))) == "CC-a_b_c_d-é_.txt"
    assert one(spark, X.date_range(F.lit(None).cast("bigint"), F.lit(0).cast("bigint"))) == "- -> 1970-01-01"
    assert one(spark, X.message_time(F.lit(None).cast("bigint"))) == ""
    assert one(spark, X.percentage(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, X.tokens("k"), k="Crème-brûlée x_y 3") == ["creme", "brulee", "x", "y", "3"]
    assert one(spark, X.query_words("k"), k=" Foo-Bar  a_b -- _ Café") == [["foobar"], ["a", "b"], ["cafe"]]
    for text in ("snake_case Café", "a__b_ _c", "x", "--", "ÀÉ_î 3_4"):
        assert one(spark, X.query_words("k"), k=text) == [w for w in X.rewrite_query(text) if w]


def test_vectors(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, VX.l2(lit([0, 3]), lit([4, 0]))) == 5.0
    assert one(spark, VX.normalize(lit([3, 4]))) == [0.6, 0.8]
    assert one(spark, VX.normalize(lit([0, 0]))) == [0.0, 0.0]
    assert one(spark, VX.masked_mean(F.array(lit([1, 2]), lit([3, 4]), lit([9, 9])), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 3.0]
    assert one(spark, VX.masked_mean(F.array(lit([1, 2])), F.array(F.lit(0)))) is None


def test_arguments():
    assert filters.resolve_source("cc") == ["claude-code"] == filters.resolve_source("Claude-Code")
    assert filters.resolve_source("nobody") is None and filters.resolve_source(None) is None
    assert [filters.resolve_range(x) for x in ("today", "7d", "week", "30d", "month", "soon", None)] == ["today", "week", "week", "month", "month", "all", "all"]
    assert filters.enabled_sources() == filters.SOURCE_IDS == filters.enabled_sources(disabled=filters.SOURCE_IDS)
    assert filters.enabled_sources(disabled=["codex", "nobody"]) == [s for s in filters.SOURCE_IDS if s != "codex"]
    assert filters.default_scope(filters.SOURCE_IDS) is None and filters.default_scope(["codex"]) == ["codex"]
    assert filters.time_cutoff("week", 10**12) == 10**12 - 7 * X.DAY_MS and filters.time_cutoff("all", 5) is None


def test_resume_commands(spark):
    got = filters.source_table(spark).select("source", filters.resume_command(F.col("source"), F.lit("i")).alias("c"))
    assert dict(map(tuple, got.collect())) == {"claude-code": "claude --resume i", "opencode": "opencode --session i", "codex": "codex resume i", "copilot-cli": "copilot --resume=i", "gemini-cli": None, "kiro-cli": None, "cursor": None}


def test_pooling_gathers_no_group(spark):
    """Means by group, and no array of a group's vectors in the registered query's plan."""
    rows = spark.createDataFrame([(1, [1.0, 2.0], True), (1, [3.0, 4.0], True), (1, [9.0, 9.0], False), (2, [5.0, 5.0], False)], "label int, embedding array<float>, used boolean")
    assert [(r[0], r[1]) for r in VX.mean_by(rows, "label", "embedding", F.col("used")).collect()] == [(1, [2.0, 3.0])]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_pooled_query_sums_in_parts(spark):
    from colloquy.plans.catalog import QUERIES

    plan = QUERIES["pooled_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(embedding" not in plan and "avg(" in plan
