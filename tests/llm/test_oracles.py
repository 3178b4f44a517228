"""Every query with SQL against it, and every query over the smallest tables."""

import pytest

from sondage.llm.oracles import ORACLES
from sondage.llm.queries import QUERIES
from tests.compare import database, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    assert differences(QUERIES[name](spark, folder), database(folder), ORACLES[name]) is None


def test_each_operator_has_one_query():
    assert sorted(n.partition("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))
