"""Event types are all used or refused, never dropped."""

import pytest

from strandmill.sources import adapters


def test_too_many_states_are_an_error(spark, tmp_path):
    for n, folder in ((1000, "most"), (1001, "more")):
        spark.range(n).selectExpr("concat('e', id) AS event_type").write.parquet(f"{tmp_path}/{folder}/events.parquet")
    assert len(adapters.event_states(spark, f"{tmp_path}/most")) == 1000
    with pytest.raises(ValueError, match="1000"):
        adapters.event_states(spark, f"{tmp_path}/more")
