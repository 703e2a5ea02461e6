"""Scratch folders."""

import pytest

from cellcast.session import path_exists, scratch_dir, scratch_scope


def write(spark):
    path = scratch_dir(spark, "test")
    spark.range(3).write.parquet(path)
    return path


def test_scope_deletes_its_own_folders_only(spark):
    before = write(spark)
    with scratch_scope(spark):
        outer = write(spark)
        with scratch_scope(spark):
            inner = write(spark)
        assert path_exists(spark, outer) and not path_exists(spark, inner)
        scratch_dir(spark, "never-written")
    assert path_exists(spark, before) and not path_exists(spark, outer)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        lost = write(spark)
        1 / 0  # noqa: B018
    assert not path_exists(spark, lost)
    assert path_exists(spark, write(spark))  # outside of a scope a folder stays
