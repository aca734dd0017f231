"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from gridstream.plans.registry import ORACLES, QUERIES
from tests.oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_rows(df, ORACLES[name], SF)
    assert not df.isEmpty()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_streamed_preferred_frequency_equals_the_batch(spark):
    from gridstream.operators import lfr
    from gridstream.plans import aggregates

    sf = "/root/testdata/sf0.01"
    batch = {r.publication_id: round(r.double_value, 6) for r in lfr.publications(aggregates._preferred(spark, sf), "urn:lfr:preferred", aggregates.SETTINGS).collect()}
    stream = {r.publication_id: r.double_value for r in QUERIES["o74_stream_lfr"](spark, sf).collect()}
    second = lambda k: int(k.rsplit(":", 1)[1])
    assert stream.items() <= batch.items()
    assert set(batch) - set(stream) == {k for k in batch if second(k) > max(map(second, stream))}  # those still open
