"""The queries of models run their protocols at full size."""

from types import SimpleNamespace

import pytest
from loomgraph.plans import protocols as PR
from loomgraph.plans import q_scores
from loomgraph.plans import tasks as TK


@pytest.mark.parametrize("query,task,protocol", [("link_prediction_rf", "link_prediction", PR.LinkPrediction()), ("dist_approx_rf", "dist_approx", PR.DistanceApproximation())])
def test_queries_take_the_defaults_of_their_protocol(spark, monkeypatch, query, task, protocol):
    seen = []
    monkeypatch.setattr(q_scores, "_z", lambda spark, sf: (None, None))
    monkeypatch.setattr(TK, task, lambda e, z, p, *rest: seen.append(p) or SimpleNamespace(scores={"x": 1.0}))
    getattr(q_scores, query)(spark, "")
    assert seen == [protocol]
