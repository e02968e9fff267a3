"""The registered model queries ask for the whole job: the library's defaults."""

import inspect

import pytest

import __spark_entry__ as contract
from catalog import modeling, workflows
from launchlens import operators as op
from launchlens.plans.settings import StoreSettings, TwoChannelSettings


class Asked(Exception):
    pass


def asked(monkeypatch, query, name):
    """Arguments of the first call of ``op.<name>`` by a query, with the defaults; the rows are stubs."""
    signature = inspect.signature(getattr(op, name))

    def stop(*args, **given):
        bound = signature.bind(*args, **given)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(op, name, stop)
    monkeypatch.setattr(op, "fit_linear", lambda *a, **k: None)
    if name != "fit_linear":
        monkeypatch.setattr(op, "importance", lambda *a, **k: None)
    monkeypatch.setattr(modeling, "scaled_profile", lambda *a: None)
    monkeypatch.setattr(modeling, "model_rows", lambda s, r, k=5: ((k, "rows"), "y", ["x"]))
    with pytest.raises(Asked) as found:
        contract.queries()[query](None, "")
    return found.value.args[0]


@pytest.mark.parametrize("query, name, want", [
    ("m2_kmeans_fit", "kmeans_fit", {"n_start": 20, "max_iter": 100}),
    ("m3_elbow_curve", "elbow_curve", {"ks": tuple(range(1, 16)), "n_start": 20, "max_iter": 100}),
    ("m6_assign_clusters", "kmeans_fit", {"n_start": 50, "max_iter": 100}),
    ("m17_fit_forest", "fit_forest", {"df": (5, "rows"), "trees": 500, "depth": 30, "candidates": None}),
    ("m18_fit_boosted", "fit_boosted", {"params": {"rounds": 450, "depth": 7, "step": 0.03, "gamma": 0.5, "columns": 0.5, "min_rows": 7, "row_share": 0.7, "penalty": 1.0}}),
    ("m19_fit_bagged", "fit_bagged", {"trees": 25, "depth": 30}),
    ("m23_importance", "fit_bagged", {"trees": 25, "depth": 30}),
])
def test_query_asks_for_the_defaults(monkeypatch, query, name, want):
    got = asked(monkeypatch, query, name)
    assert {k: got[k] for k in want} == want


def test_workflows_keep_the_effort(monkeypatch):
    for mine, whole in ((workflows.TWO, TwoChannelSettings()), (workflows.STORE, StoreSettings())):
        for field in ("starts", "max_iter", "folds", "clusters", "train_share"):
            assert getattr(mine, field) == getattr(whole, field), field
    assert workflows.TWO.forest_trees == TwoChannelSettings().forest_trees

    def run(*tables, **given):
        raise Asked(given)

    monkeypatch.setattr(workflows.two_channel, "run", run)
    for table in ("web", "pos", "master", "stores"):
        monkeypatch.setattr(workflows.v, table, lambda *a: None)
    with pytest.raises(Asked) as found:
        contract.queries()["c11_train_all"](None, "")
    assert found.value.args[0] == {}
