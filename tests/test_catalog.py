import __spark_entry__ as entry
from chainloom.plans import catalog


def test_every_sql_belongs_to_a_query_and_names_are_unique():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    parts = catalog._parts()
    assert len(catalog.queries()) == sum(len(p.QUERIES) for p in parts)
    assert len(catalog.queries()) > 250 and set(catalog.queries()) <= set(entry.queries())
