"""Registered queries use all cells of an embedding, all folds and the study's grid."""

from cohortline.catalog import modelling, time_and_folds
from cohortline.operators import baseline, models


def test_class_rows_hold_every_cell(spark, sf):
    assert [c for c in modelling._class_rows(spark, sf).columns if c[1:].isdigit()] == [f"e{i}" for i in range(64)]


def test_nested_elastic_net_takes_the_whole_grid(spark, sf, monkeypatch):
    seen = {}

    def stop(*args, **named):
        seen.update(grid=args[7], inner_k=named["inner_k"])
        raise InterruptedError

    monkeypatch.setattr(models, "nested_cross_validate", stop)
    try:
        modelling.nested_elastic_net(spark, sf)
    except InterruptedError:
        pass
    assert len(seen["grid"]) == 18 and seen["inner_k"] == 5


def test_train_shuffle_is_checked_for_every_fold(spark, sf, monkeypatch):
    folds, real = [], baseline.shuffle_train_labels
    monkeypatch.setattr(baseline, "shuffle_train_labels", lambda *a: folds.append(a[4]) or real(*a))
    assert time_and_folds.train_shuffle(spark, sf).filter("total is null").count() == 0
    assert folds == [1, 2, 3]
