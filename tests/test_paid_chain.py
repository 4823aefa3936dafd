"""The whole chain of paid grants; the preview is its beginning."""

import __spark_entry__ as entry
from filigree.plans import filings

DATA = "/root/testdata/sf0.001"


def test_chain_is_whole(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 500
    assert rows[:500] == filings.grants_paid_chain(spark, DATA).collect()
