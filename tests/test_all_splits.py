"""Model queries fit and score every split; the boosted ones grow their own 300 trees."""

import os

import pytest

import __spark_entry__ as entry
from barline.modelling.boosting import Growth
from barline.plans import models

SF = "/root/testdata/sf0.001"
QUICK = ["linear_baselines", "multiclass_forest", "cluster_sweep", "consensus_k", "regime_states"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", [*QUICK, "feature_set_ablation"])
def test_every_split_is_in_the_result(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert set(got.split) == set(models.WALKS) == {"w1", "w2", "w3"}
    if name == "feature_set_ablation":
        assert len(got) == 9 and got.auc_all.between(0, 1).all()


def test_default_trees():
    assert Growth() == Growth(trees=300, depth=4, rate=0.03, subsample=0.8)
