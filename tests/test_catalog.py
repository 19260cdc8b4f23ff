"""How a job's views become one plan."""

import payguard.plans.registry  # noqa: F401  the views of all jobs
from payguard.plans.catalog import frame


def test_views_are_no_common_table_expressions(spark, sf):
    """Inlining nested ones failed with a union of two types, depending on the ids that the session had given out."""
    plan = frame(spark, sf, "au_basis_text")._jdf.queryExecution()
    assert "CTE" not in plan.analyzed().toString()
    assert plan.optimizedPlan().resolved()


def test_no_view_stays_in_the_session(spark, sf):
    before = {t.name for t in spark.catalog.listTables()}
    rows = frame(spark, sf, "mt_vendor_identity")
    assert not [t.name for t in spark.catalog.listTables() if t.name not in before and t.name.startswith("shared_")]
    assert rows.count() > 0
