"""Streaming ingest equals the batch counts, also across several micro-batches."""

from conftest import SF_SMALL
from oracle_util import compare, duck


def test_stream_matches_batch(spark):
    from __spark_entry__ import queries
    s = queries()["stream_cell_counts"](spark, SF_SMALL)
    b = queries()["trips_cell_hour"](spark, SF_SMALL)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_matches_oracle(spark):
    assert compare(spark, "stream_cell_counts", SF_SMALL, duck(SF_SMALL), verbose=False)
