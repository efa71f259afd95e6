import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.queries import QUERIES, SQL
from oracle import connection, differs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differs(spark, connection(SF), SF, QUERIES[name], SQL[name]) is None
