"""The registered models are the operators' own, not smaller ones, and are trained once."""

import pytest

from barloom.catalog import models
from barloom.operators import ml
from barloom.plans import registry, training


def test_forest_of_the_queries_is_whole(spark, sf_dir):
    forest = models.trained(spark, sf_dir).model
    assert forest.getNumTrees == ml.FOREST["numTrees"]
    for share in forest.shares:
        assert share.stages[-1].getOrDefault("maxDepth") == ml.FOREST["maxDepth"]
    assert models._fused(spark, sf_dir).model.getNumTrees == ml.FUSION_FOREST["numTrees"]


def test_a_known_run_is_loaded(spark, sf_dir, monkeypatch):
    models.trained(spark, sf_dir)

    def refuse(*_, **__):
        raise AssertionError("trained again")

    monkeypatch.setattr(models.training, "train_structured", refuse)
    run = models.trained(spark, sf_dir)
    assert run.importances.count() == 21 and run.folds is None and run.metrics.count() == 1
    monkeypatch.setattr(models, "ml", type("Other", (), {**vars(ml), "FOREST": {**ml.FOREST, "numTrees": 7}}))
    with pytest.raises(AssertionError):
        models.trained(spark, sf_dir)


def test_features_are_made_once_from_bars_that_are_grouped_once(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "registry_dir", lambda _: str(tmp_path))
    want = {tuple(r) for r in models.features.training_features(models.events_bars(spark, sf_dir)).collect()}
    seen = []

    def made(bars):
        seen.append(bars.inputFiles())
        return training_features(bars)

    training_features = models.features.training_features
    monkeypatch.setattr(models.features, "training_features", made)
    assert {tuple(r) for r in models._training(spark, sf_dir).collect()} == want == {tuple(r) for r in models._training(spark, sf_dir).collect()}
    assert len(seen) == 1 and not any("events.parquet" in f for f in seen[0])


def test_fingerprint_follows_files_and_parameters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = registry.fingerprint(spark, [path], trees=3)
    assert registry.fingerprint(spark, [path], trees=3) == first and registry.fingerprint(spark, [path], trees=4) != first
    spark.range(4).write.mode("overwrite").parquet(path)
    assert registry.fingerprint(spark, [path], trees=3) != first


def test_registry_makes_anew_what_was_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "registry_dir", lambda _: str(tmp_path))
    made = []

    def make(path):
        made.append(path)
        spark.range(len(made)).write.parquet(path)

    def load(path):
        return spark.read.parquet(path).count()

    assert registry.registered(spark, "x", "k", make, load) == 1 == registry.registered(spark, "x", "k", make, load)
    import shutil

    shutil.rmtree(made[0])
    assert registry.registered(spark, "x", "k", make, load) == 2 and len(made) == 2


def test_shares_give_one_forest(spark, sf_dir):
    rows = models._training(spark, sf_dir)
    model = ml.train_forest(rows, numTrees=19, maxDepth=4)
    assert len(model.shares) == 8 and model.getNumTrees == 19 and sorted(model.trees) == [2] * 5 + [3] * 3
    scored = ml.score(rows, model)
    assert scored.filter("abs(p_up + p_down - 1) > 1e-9").count() == 0 and abs(model.importances().sum() - 1) < 1e-9
    run = training.train_structured(rows, folds=2, numTrees=3, maxDepth=3)
    assert run.folds.count() == 2 and run.model.getNumTrees == 3
