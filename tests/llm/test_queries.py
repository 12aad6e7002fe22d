import pytest

from nearfield.llm.registry import ORACLE, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, ORACLE[name])
