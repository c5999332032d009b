"""What queries over many short texts may cost: long expressions are compiled, and nothing dear is worked out twice."""

import pytest
from pyspark.sql import functions as F

from maskwright.frames import small_functions
from maskwright.operators import fields
from maskwright.operators.masking import mask_plain
from maskwright.rules import BUILT_IN

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture
def default_limit(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_long_expressions_are_not_one_function(default_limit):
    rows = default_limit.createDataFrame([("npm_" + "a1" * 18,)], "text string")
    out = mask_plain(rows, "text", rules=[r for r in BUILT_IN if r.id.startswith("secret_")])
    assert default_limit.conf.get(LIMIT) == "8000"
    assert out.first()["text"] == "npm_" + "*" * 32 + "a1a1"


def test_a_limit_that_was_set_stays(default_limit):
    default_limit.conf.set(LIMIT, "9000")
    small_functions(default_limit)
    assert default_limit.conf.get(LIMIT) == "9000"


def test_only_rules_that_may_match_are_gone_through(spark):
    rows = spark.createDataFrame([("a@b.org 10.0.0.1",), ("nothing",), (None,), ("",)], "text string")
    rules = [r for r in BUILT_IN if r.id in ("email", "ipv4", "secret_npm_token")]
    out = mask_plain(rows, "text", rules=rules)
    assert [r["text"] for r in out.collect()] == ["a***@b.org 10.***.***.1", "nothing", None, ""]
    assert "array_remove" in _plan(out)


def test_a_fields_type_is_found_once(spark):
    rows = spark.createDataFrame([("q", "a@b.org"), ("name", "Bob"), ("q", None), ("q", "0")], "name string, value string")
    out = rows.withColumn("value", fields.mask_value(F.col("name"), F.col("value")))
    assert [r["value"] for r in out.collect()] == ["a***@b.org", "B**", None, "0"]
    assert _plan(out).count("THEN hosting") == 3  # by whole names, parts of names and values
