"""Driver contract: entry, query registry and oracle registry line up."""

import __spark_entry__ as E
from searchrank import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["srch_id", "prop_id", "price_usd", "rank"]
    assert max(r["rank"] for r in rows) <= 5


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql())
    assert set(q) - set(o) == {"mf_scores", "mf_sgd_scores", "mf_epoch_error", "mf_tune", "ltr_rank", "xrank"}
