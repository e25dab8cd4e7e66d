"""Registered queries that do the whole job beside those whose SQL fixes less."""

import pytest

from tagloom import catalog
from tagloom.operators import resample

BOOTSTRAPS = ["bootstrap_cluster_ci", "bootstrap_paired_delta", "bootstrap_record_ci", "bootstrap_record_delta", "bootstrap_poisson_ci"]


@pytest.mark.parametrize("name", BOOTSTRAPS)
def test_bootstraps_are_registered_with_the_references_replicates(spark, small, name, monkeypatch):
    made = []
    inner = resample.replicate_f1
    monkeypatch.setattr(resample, "replicate_f1", lambda r, models: made.append(r) or inner(r, models))
    assert catalog.QUERIES[f"{name}_1000"](spark, small).count() == 1
    assert made[0].select("it").distinct().count() == 1000
