from panelwright.plans import all_queries, q_causal


def test_fitted_stability_needs_no_effects(spark, monkeypatch):
    def effects(*_):
        raise AssertionError("effects were asked for")

    monkeypatch.setattr(q_causal.v, "fitted_effects", effects)
    asked = []
    monkeypatch.setattr(q_causal.v, "fitted_links", lambda *_: asked.append("links"))
    monkeypatch.setattr(q_causal.v, "fitted_parents", lambda *_: spark.createDataFrame([(0.1, "pooled", "y")], "alpha double, stratum string, target string"))
    monkeypatch.setattr(q_causal.co, "target_links", lambda x: x)
    monkeypatch.setattr(q_causal.co, "stability", lambda links, parents: parents)
    assert all_queries()["fitted_stability"](spark, "none").count() == 0 and asked == ["links"]
