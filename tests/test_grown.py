"""The volume queries over a volume that grows with the table."""

import oracle
import pytest

from laminae.plans import catalog, graphs, reviews, solvers  # noqa: F401 (adds queries)
from laminae.plans.fixtures import GrownTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.GROWN_ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.difference(spark, con, catalog.GROWN[name], catalog.GROWN_ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(catalog.GROWN) - set(catalog.GROWN_ORACLES)))
def test_runs_over_all_voxels(spark, name):
    assert catalog.GROWN[name](spark, FOLDER).count() == GrownTables(spark, FOLDER).ct().count()


def test_voxels_and_masks_grow_with_the_table(spark):
    def sizes(folder):
        t = GrownTables(spark, f"/root/testdata/{folder}")
        masks = (t.ct(), t.fg(), t.gt().filter("v >= 35"), t.gt().filter("v >= 47"), t.ct().filter("v < 10"), t.ct().filter("v < 25"))
        return [m.count() for m in masks]

    few, many = sizes("sf0.01"), sizes("sf0.1")
    assert min(few) > 0 and all(9 < b / a < 11 for a, b in zip(few, many, strict=True))
