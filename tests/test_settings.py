"""Settings of a block."""

import pytest

from tidemark.session import settings


def test_settings_hold_within_the_block(spark):
    kept, new = "spark.sql.shuffle.partitions", "spark.tidemark.test"
    before = spark.conf.get(kept)
    with pytest.raises(ValueError), settings(spark, {kept: "3", new: "x"}):
        assert spark.conf.get(kept) == "3" and spark.conf.get(new) == "x"
        raise ValueError
    assert spark.conf.get(kept) == before and spark.conf.get(new, None) is None
