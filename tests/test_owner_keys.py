"""Owner keys: each form of an address is computed once."""

from landloom.plans.owners import owner_keys, q9_owner_properties
from landloom.sources.tables import parcels
from tests.oracle import DATA


def test_forms_of_an_address_are_computed_once(spark):
    keys = owner_keys(parcels(spark, f"{DATA}/sf0.001")).select("group_key", "key_type", "addr")
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\b(\d+)\b") == 1


def test_no_table_of_parcels_is_sent_to_all_tasks(spark):
    plan = q9_owner_properties(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
