"""What table queries leave to the engine: code that is compiled, and one pass over pages without tables written between."""

from __future__ import annotations

import os
import re

import pytest

from folioflow.operators import stages, tables
from folioflow.plans import exports, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


@pytest.fixture
def fixed_plans(spark):
    """Plans as they are run, whole from the start."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_words_are_made_by_methods_that_the_jvm_compiles(spark, fixed_plans):
    plan = exports.searchable_words(spark, SF)._jdf.queryExecution().executedPlan()
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_decisions_write_no_tables_and_shuffle_words_once(spark, fixed_plans):
    before = len(stages._TABLES)
    some = tables.Analysis(words.words(spark, SF)).decisions()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert len(stages._TABLES) == before and plan.count("Exchange hashpartitioning") == 1
