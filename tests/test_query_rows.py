"""What queries with a lexical leg write and shuffle at sf0.01 follows the questions and chunks, not their pairs."""

import pytest

from docmill.plans import registry

FOLDER = "/root/testdata/sf0.01"


def moved(spark, name: str) -> int:
    """Rows that the query's stages wrote or shuffled."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() + found.apply(i).outputRecords() for i in range(found.size())}

    before = stages()
    registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize(
    "name, most",
    [
        ("harvested_rows", 80_000),
        ("harvest_counters", 80_000),
        ("multi_query_search", 40_000),
        ("lexical_documents", 2_000),
        ("lexical_routing", 2_000),
        ("routed_documents", 8_000),
        ("bootstrap_of_fusion", 110_000),
    ],
)
def test_rows_moved(spark, name, most):
    moved(spark, "lexical_documents")  # the index is written once a session
    assert moved(spark, name) <= most
