import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from symbolith.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_the_oracle(spark, con, name):
    assert oracle.same(spark, con, SF, queries.QUERIES[name], queries.SQL[name]) > 0


def test_accessors_beside_their_property_go(spark):
    made = queries._with_accessors(queries.derived.defs(spark, SF))
    accessors = made.filter("kind in ('getter', 'setter')").count()
    kept = queries.QUERIES["accessor_dedup"](spark, SF).filter("kind in ('getter', 'setter')").count()
    assert 0 < kept < accessors
