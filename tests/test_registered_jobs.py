"""Registered queries ask the operators for the whole job: all test years, default trees and draws."""

import pytest

from loomspan.operators import forecast, walkforward
from loomspan.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, module, operator", [
    ("j5_tree_walk_forward", walkforward, "tree_predictions"),
    ("j6_feature_importance", walkforward, "feature_importance"),
    ("j8_recursive_forecast", forecast, "recursive_forecast"),
    ("j11_residual_bootstrap", forecast, "residual_bootstrap"),
])
def test_whole_job(spark, monkeypatch, name, module, operator):
    asked = []
    monkeypatch.setattr(module, operator, lambda *args, **named: asked.append((args, named)) or spark.range(1))
    plans.queries()[name](spark, SF)
    (args, named), = asked
    assert not {"trees", "draws"} & set(named)
    if name == "j5_tree_walk_forward":
        assert args[3] == plans.YEARS and len(plans.YEARS) == 4
