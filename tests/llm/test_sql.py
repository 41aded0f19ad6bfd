import pytest

from compare import differences, duck
from tillroll.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name]) == []
