"""Bundles are published together or not at all."""

import pytest

from landshift.sources.publish import BrokenStore, BundleStore, PublishConflict


def tables(spark, results, cases):
    return (spark.createDataFrame(results, "bundle_id string, score int"), spark.createDataFrame(cases, "bundle_id string, status string"))


def seen(store):
    found = store.read("results")
    if found is None:
        return {}
    return {r["bundle_id"]: (r["score"], r["status"]) for r in found.join(store.read("cases"), "bundle_id").collect()}


def states(df):
    return {r["bundle_id"]: r["state"] for r in df.collect()}


def test_whole_bundles_are_published_once(spark, tmp_path):
    store = BundleStore(spark, str(tmp_path))
    first = store.publish(*tables(spark, [("a", 1), ("b", 2), (None, 3), ("d", 4), ("d", 5)], [("a", "x"), ("c", "y"), ("d", "z")]))
    assert states(first) == {"a": "NEW", "b": "CASE_MISSING", "c": "RESULT_MISSING", None: "CASE_MISSING", "d": "DUPLICATE"}
    assert seen(store) == {"a": (1, "x")}
    again = store.publish(*tables(spark, [("a", 9), ("b", 2)], [("a", "other"), ("b", "x")]))
    assert states(again) == {"a": "STORED", "b": "NEW"} and seen(store) == {"a": (1, "x"), "b": (2, "x")}
    store.publish(*tables(spark, [("a", 7)], [("a", "w")]))
    assert len(store.log()) == 2 and seen(store) == {"a": (1, "x"), "b": (2, "x")}
    store.check()


def test_a_publish_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = BundleStore(spark, str(tmp_path))
    store.publish(*tables(spark, [("a", 1)], [("a", "x")]))
    before = seen(store)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(BundleStore, "_commit", die)  # after both tables were written, before the entry
        with pytest.raises(KeyboardInterrupt):
            store.publish(*tables(spark, [("b", 2)], [("b", "y")]))
    assert seen(store) == before and len(store.unpublished()) == 1
    assert states(store.publish(*tables(spark, [("b", 3)], [("b", "y")]))) == {"b": "NEW"}
    assert seen(store) == {"a": (1, "x"), "b": (3, "y")}
    store.check()


def test_of_two_publishers_one_has_to_look_again(spark, tmp_path, monkeypatch):
    one, two = BundleStore(spark, str(tmp_path)), BundleStore(spark, str(tmp_path))
    commit = BundleStore._commit

    def late(self, number, entry):
        monkeypatch.setattr(BundleStore, "_commit", commit)
        two.publish(*tables(spark, [("b", 2)], [("b", "y")]))
        commit(self, number, entry)

    monkeypatch.setattr(BundleStore, "_commit", late)
    with pytest.raises(PublishConflict):
        one.publish(*tables(spark, [("b", 1)], [("b", "x")]))
    assert seen(one) == {"b": (2, "y")}


def test_a_half_version_is_refused(spark, tmp_path):
    store = BundleStore(spark, str(tmp_path))
    store.publish(*tables(spark, [("a", 1)], [("a", "x")]))
    entry = dict(store.log()[0], number=2, folder="00000002-missing")
    store._commit(2, entry)
    with pytest.raises(BrokenStore):
        store.check()
