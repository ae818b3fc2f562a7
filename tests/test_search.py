"""Searches over many rows that are alike but for their id."""

from landloom.plans.search import FUZZY_TIMES, LIMIT, _alike, search_owner


def test_alike_rows_are_ranked_as_one(spark):
    rows = [(i, "ANN SMITH") for i in range(500, 0, -1)] + [(1000, "ANN SMYTH"), (1001, "ann smith")]
    held = spark.createDataFrame(rows, "id long, owner_name string")
    told = {r.owner_name: r for r in _alike(held, FUZZY_TIMES * LIMIT).collect()}
    assert len(told) == 3 and told["ANN SMITH"].ids == list(range(1, FUZZY_TIMES * LIMIT + 1)) and told["ANN SMITH"].id == 1
    asked = [(1, "ann s"), (2, "ANN  s"), (3, "anm smyth")]
    got = {}
    for r in sorted(search_owner(spark.createDataFrame(asked, "query_id long, q string"), held).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.stage))
    assert got[1] == got[2] == [(i, 0) for i in range(1, 11)]
    assert got[3] == [(1000, 1)] + [(i, 1) for i in range(1, 10)]
