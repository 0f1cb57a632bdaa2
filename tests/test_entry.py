import __spark_entry__ as E
from brook.plans import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["source", "published_date", "n_articles", "title_chars", "n_categories"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) == set(q)
    assert not any(k.startswith("op") or "pipeline" in k for k in q)


def test_entry_registers_the_library_and_its_training_data_queries():
    """The training-data queries are added where their package is present."""
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.queries()) <= set(q) and set(o) <= set(q)
    added = set(q) - set(catalog.queries())
    assert all(k.startswith("op") or k == "pipeline" for k in added)
