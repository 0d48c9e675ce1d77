import pytest

from grainmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(Q.queries()[name], SQL[name])


def test_ten_operators_and_the_pipeline():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
