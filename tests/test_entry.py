"""Driver contract: entry() at sf0.001 and every registered query runs."""

import __spark_entry__ as E
from vigil.plans import load_all
from vigil.plans.registry import QUERIES
from paths import SF001


load_all()
BASE = list(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["day", "model", "requests", "input_tokens", "output_tokens", "cost"]
    assert df.count() > 0


def test_no_query_uses_fixed_input_only(spark):
    # every registered query's plan reads a parquet table, or a checkpoint
    # (LogicalRDD) that Spark derived from one
    for name in BASE:
        df = E.queries()[name](spark, SF001)
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        # a checkpoint's rows must still come from a table: none are left without its rows
        # files written as JSON or text on the way likewise hold what a table gave
        derived = any(x in plan for x in ("logicalrdd", "] json", "] text"))
        assert "parquet" in plan or (derived and df.limit(1).count() == 1), name
