import os

import pytest

from webstrata.session import cut_lineage, shared_folder, temporary_tables


def _tables(spark):
    folder = shared_folder(spark).removeprefix("file:") + "/webstrata"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_of_a_block_go_when_it_ends(spark):
    kept = cut_lineage(spark.range(3))
    before = _tables(spark)
    with temporary_tables(spark):
        outer = cut_lineage(spark.range(5))
        with temporary_tables(spark):
            assert cut_lineage(outer).count() == 5
            later = cut_lineage(outer.where("id > 2"), outlive=True)
        assert outer.count() == 5 and later.count() == 2
        assert len(_tables(spark)) == len(before) + 2
    assert _tables(spark) == before and kept.count() == 3
    with pytest.raises(ValueError), temporary_tables(spark):
        cut_lineage(spark.range(2))
        raise ValueError
    assert _tables(spark) == before
