"""Every register query that has SQL gives the rows of the SQL."""

import pytest

from groupforge.plans import register_queries

SQL = register_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, same_rows, name):
    got = register_queries.queries()[name](spark, sf_dir).toPandas()
    assert same_rows(got) == same_rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(register_queries.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert register_queries.queries()[name](spark, sf_dir).count() >= 0


def test_no_person_leaves(spark, sf_dir):
    for name, f in register_queries.queries().items():
        if name.startswith(("rule_", "group_", "export_", "search_")):
            assert "person" not in f(spark, sf_dir).columns, name
