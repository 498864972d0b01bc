"""Every registered query against its SQL on the smallest tables.

Broadcast joins are off, so that the shuffle joins a cluster would choose are what is tested, and
the plan of each query is checked for shapes that cannot scale.
"""

import re

import plans
import pytest
import verify
from conftest import FOLDER

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return verify.connect(FOLDER)


@pytest.fixture(scope="module")
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(no_broadcast, duck, key):
    frame = QUERIES[key](no_broadcast, FOLDER)
    text = plans.plan_of(frame)
    for name in ("CartesianProduct", "NestedLoop", "Python"):
        assert not re.search(plans.FLAGS[name], text), name
    rows = [tuple(r) for r in frame.collect()]
    if key not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[key])
    columns = [d[0] for d in cursor.description]
    problem = verify.compare(frame.columns, rows, columns, cursor.fetchall())
    assert not problem or problem.startswith("APPROX"), problem


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["bucket_date", "kind", "avg_score", "record_count"]
    assert frame.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
