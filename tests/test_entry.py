import __spark_entry__ as entry
from reconweave.plans import oracle, queries


def test_every_oracle_belongs_to_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(entry.queries())


def test_oracle_reads_only_what_it_needs():
    assert "truth AS" not in oracle.sql("SELECT * FROM rate")
    text = oracle.sql("SELECT * FROM settlement")
    assert text.index("truth AS") < text.index("settlement AS") and "bank AS" not in text
