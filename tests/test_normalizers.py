import re

import pytest

from quiverlog import Engine, GraphStore
from quiverlog.errors import EngineError, NormalizerError
from quiverlog.sources import layers, shared
from quiverlog.streaming import normalizer
from quiverlog.streaming.normalizer import Normalizers

#: Sightings of birds: a place, a kind of bird and a weather; place and kind make the compound.
ROLES = {"where": "place", "what": "bird"}
SCHEMA = "no long, place string, bird string, weather string"
QUERY = "Sighting@(where=p, what=b)?"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def setup(spark):
    engine = Engine(GraphStore(spark))
    engine.query("".join(f'DefCompound("Sighting", "{r}", "0", "liquid/string"). ' for r in ROLES))
    return engine, Normalizers(engine.store), lambda *r: spark.createDataFrame(list(r), SCHEMA)


@pytest.mark.parametrize("few", [0, 100_000], ids=["rewritten at once", "layered"])
def test_rows_come_change_and_go(setup, monkeypatch, few):
    monkeypatch.setattr(layers, "FEW_CHANGES", few)
    engine, normalizers, table = setup
    heron, again, wren = (1, "pond", "heron", "rain"), (2, "pond", "heron", "sun"), (3, "hedge", "wren", "sun")
    normalizers.create("sightings", table(heron, again), "seen", "Sighting", ROLES, ["no"])
    assert rows(engine.query(QUERY)) == [("pond", "heron")] and normalizers.ledger.count() == 4
    normalizers.apply_changes("sightings", None, table(wren))
    assert rows(engine.query(QUERY)) == [("hedge", "wren"), ("pond", "heron")]
    # one of two rows moves on: the compound stays with the other
    moved = (1, "weir", "heron", "rain")
    normalizers.apply_changes("sightings", table(heron), table(moved))
    assert rows(engine.query(QUERY)) == [("hedge", "wren"), ("pond", "heron"), ("weir", "heron")]
    normalizers.apply_changes("sightings", table(again), None)
    assert rows(engine.query(QUERY)) == [("hedge", "wren"), ("weir", "heron")]
    # a column that no role maps changes nothing, a null in a mapped one takes the compound away
    normalizers.apply_changes("sightings", table(wren), table((3, "hedge", "wren", "fog")))
    assert rows(engine.query(QUERY)) == [("hedge", "wren"), ("weir", "heron")]
    normalizers.apply_changes("sightings", table(moved), table((1, None, "heron", "rain")))
    assert rows(engine.query(QUERY)) == [("hedge", "wren")] and normalizers.ledger.count() == 2
    # and an insert and a delete in one batch
    normalizers.apply_changes("sightings", table((3, "hedge", "wren", "fog")), table((5, "barn", "owl", "dark")))
    assert rows(engine.query(QUERY)) == [("barn", "owl")]


def test_rebuild_brings_back_and_drop_takes_all(setup):
    engine, normalizers, table = setup
    owl, lark = (1, "barn", "owl", "dark"), (2, "field", "lark", "sun")
    normalizers.create("sightings", table(owl), "seen", "Sighting", ROLES, ["no"], backfill=False)
    assert engine.query(QUERY).count() == 0
    normalizers.rebuild("sightings", "seen", table(owl))
    engine.store.tombstone(engine.store.live().filter("object = 'owl'"))
    assert rows(engine.query(QUERY)) == []
    normalizers.rebuild("sightings", "seen", table(owl, lark))
    assert rows(engine.query(QUERY)) == [("barn", "owl"), ("field", "lark")]
    normalizers.drop("sightings", "seen")
    assert rows(engine.query(QUERY)) == [] and normalizers.ledger.count() == 0 and not normalizers.registrations


@pytest.mark.parametrize("purge", [True, False])
def test_drop_writes_its_rows_once_and_looks_up_no_keys(setup, monkeypatch, purge):
    engine, normalizers, table = setup
    normalizers.create("sightings", table(*((k, f"field {k}", "lark", "sun") for k in range(9))), "seen", "Sighting", ROLES, ["no"])
    written, real = [], normalizer.cut
    monkeypatch.setattr(normalizer, "cut", lambda df, tag: written.append((tag, df)) or real(df, tag))
    normalizers.drop("sightings", "seen", purge)
    assert [tag for tag, _ in written] == ["dropped"] and "Join" not in written[0][1]._jdf.queryExecution().optimizedPlan().toString()
    assert engine.query(QUERY).count() == (0 if purge else 9) and normalizers.ledger.count() == 0


def test_keys_of_many_changes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(layers, "FEW_CHANGES", 5)
    table = lambda *ids: shared.cut(spark.createDataFrame([(i, v) for i, v in ids], "id long, v string"), "test")
    kept = layers.Layers(table(*((i, "old") for i in range(200))), ["id"], "kept")
    for ids in (range(4), range(2, 8), range(7, 9)):
        kept.put(table(*((i, f"new {len(ids)}") for i in ids)))
        assert rows(kept.rows().filter("v <> 'old'").select("id"))[-1] == (ids[-1],)
        plan = kept.rows()._jdf.queryExecution().sparkPlan().toString()
        # the outermost join is that of the base with the keys of all changes
        assert re.search(r"\w+Join", plan)[0] == {4: "BroadcastHashJoin", 6: "SortMergeJoin", 2: "SortMergeJoin"}[len(ids)]
    assert rows(kept.rows().filter("v <> 'old'")) == [(0, "new 4"), (1, "new 4"), *((i, "new 6") for i in range(2, 7)), (7, "new 2"), (8, "new 2")]


def test_support_of_another_normalizer_and_unowned_edges(setup):
    engine, normalizers, table = setup
    for source in ("ringed", "heard"):
        normalizers.create(source, table((1, "reeds", "bittern", "fog")), "seen", "Sighting", ROLES, ["no"])
    normalizers.drop("ringed", "seen")
    assert engine.query(QUERY).count() == 1
    normalizers.drop("heard", "seen", purge=False)
    assert engine.query(QUERY).count() == 1 and normalizers.ledger.count() == 0


def test_a_restart(setup, spark, tmp_path):
    engine, normalizers, table = setup
    first, second = (1, "pond", "heron", "rain"), (2, "pond", "heron", "sun")
    normalizers.create("sightings", table(first, second), "seen", "Sighting", ROLES, ["no"])
    engine.store.save(str(tmp_path), normalizers)
    found = Normalizers.load(spark, str(tmp_path))
    assert found.registrations == normalizers.registrations and found.ledger.count() == 4
    found.apply_changes("sightings", table(first), None)
    assert rows(Engine(found.store).query(QUERY)) == [("pond", "heron")]
    found.apply_changes("sightings", table(second), None)
    assert rows(Engine(found.store).query(QUERY)) == []
    found.store.save(str(tmp_path), found)
    # a version that was not written to its end does not count
    (tmp_path / "v00000003" / "records").mkdir(parents=True)
    assert rows(Engine(Normalizers.load(spark, str(tmp_path)).store).query(QUERY)) == []
    with pytest.raises(EngineError):
        GraphStore.load(spark, str(tmp_path / "v00000003"))


def test_rejections(setup):
    _, normalizers, table = setup
    here = table((1, "pond", "heron", "rain"))
    normalizers.create("sightings", here, "seen", "Sighting", ROLES, ["no"], backfill=False)
    refused = {
        "no mapping": (here, "n", "Sighting", ["where"], ["no"]), "no table": ("sightings", "n", "Sighting", ROLES, ["no"]), "no key": (here, "n", "Sighting", ROLES, []), "no such type": (here, "n", "Nest", ROLES, ["no"]),
        "a role too few": (here, "n", "Sighting", {"what": "bird"}, ["no"]), "no such column": (here, "n", "Sighting", ROLES | {"what": "egg"}, ["no"]), "a name twice": (here, "seen", "Sighting", ROLES, ["no"]),
    }
    for args in refused.values():
        with pytest.raises(NormalizerError):
            normalizers.create("sightings", *args)
    for call in (lambda: normalizers.drop("sightings", "none"), lambda: normalizers.rebuild("sightings", "none", here)):
        with pytest.raises(NormalizerError):
            call()


def test_change_stream(setup, spark, tmp_path):
    engine, normalizers, table = setup
    normalizers.create("sightings", table((1, "pond", "heron", "rain")), "seen", "Sighting", ROLES, ["no"])
    struct = f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"
    changes = [((1, "pond", "heron", "rain"), (1, "weir", "heron", "rain")), (None, (2, "barn", "owl", "dark"))]
    spark.createDataFrame(changes, f"before {struct}, after {struct}").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"before {struct}, after {struct}").parquet(str(tmp_path / "in")).writeStream.foreachBatch(normalizers.change_sink("sightings"))
    stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows(engine.query(QUERY)) == [("barn", "owl"), ("weir", "heron")]
