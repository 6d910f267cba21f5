"""The live catalog's store: what a batch reads, compaction, restarts."""

from shapelog.plans import infer
from shapelog.streaming import catalog as live
from shapelog.streaming import store as tables
from shapelog.streaming import values as live_values
from shapelog.streaming.store import Table


def line(actor, message, raw):
    return f"[1]: D/JSIPCTypeSend JSIT Send ACTOR {actor} MESSAGE {message} KIND Message TYPE {raw}"


def slots(spark, store):
    return {(r.actor, r.message): r.slot0 for r in live.stored_catalog(spark, store).collect()}


def test_catalog_through_compactions_and_reruns(spark, lines, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FOLDERS", 2)
    read, of = [], Table.folders

    def recorded(self, buckets=None, before=None):
        found = of(self, buckets, before)
        if buckets is not None:
            read.append((self.path.rsplit("/", 1)[1], set(buckets), len(found)))
            assert {f[0] for f in found} <= set(buckets)
        return found

    monkeypatch.setattr(Table, "folders", recorded)
    store, counts = str(tmp_path / "store"), []
    # Many messages once; then the same one again and again.
    live.update_catalog(lines([line(f"A{i}", "m", "number") for i in range(40)]).drop("mid"), 0, store)
    for n in range(1, 8):
        read.clear()
        texts = [line("A1", "m", f"{{a{n}: number}}"), line("A1", "m", "string" if n == 3 else "number")]
        live.update_catalog(lines(texts).drop("mid"), n, store)
        if n == 5:  # run again, as after a failure
            live.update_catalog(lines(texts).drop("mid"), n, store)
        messages = [r for r in read if r[0] != "raw_types"]
        assert all(len(b) == 1 for _, b, _ in messages)
        counts.append(max(c for _, _, c in messages))
    # The folders read do not grow with the batches.
    assert max(counts) <= 4
    found = slots(spark, store)
    assert len(found) == 40 and found["A2", "m"] == "number"
    texts = ["number"] + [t for n in range(1, 8) for t in ([f"{{a{n}: number}}"] + (["string"] if n == 3 else []))]
    once = str(tmp_path / "once")
    live.update_catalog(lines([line("A1", "m", t) for t in texts]).drop("mid"), 0, once)
    assert slots(spark, once)["A1", "m"] == found["A1", "m"]


def test_covered_folders_are_not_read(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", "k string, n int", ["k"])
    assert table.read().count() == 0 and table.read([1]).count() == 0 and table.folders([]) == []
    for n in range(4):
        table.write(spark.createDataFrame([(f"k{i}", n) for i in range(20)], "k string, n int"), n)
    table.write(spark.createDataFrame([(f"k{i}", 3) for i in range(20)], "k string, n int"), 3)
    assert table.read().count() == 80 and table.read(before=2).count() == 40
    # A compaction that stopped before it deleted anything.
    table._lay(table.read(before=3, versions=True).drop("batch"), 0, 2)
    assert table.read().count() == 80 and {f[1:] for f in table.folders()} == {(0, 2), (3, 3)}


def value(actor, message, contents):
    return f"[1]: QQQ ACTOR {actor} MESSAGE {message} CONTENTS {contents}"


def test_values_through_batches_and_reruns(spark, lines, tmp_path, monkeypatch):
    """After each batch the report is that of the whole log so far."""
    monkeypatch.setattr(tables, "FOLDERS", 2)
    read = []
    typed = live_values.values.infer_value_types

    def recorded(payloads):
        read.append({r.skeleton for r in payloads.select("skeleton").distinct().collect()})
        return typed(payloads)

    batches = [
        [value("A", "m", '{"a": 1}'), value("A", "n", "[1, 2]"), value("B", "m", "new Foo(")],
        [value("A", "m", '{"a": 7}'), value("A", "m", '{"b": "x", "a": null}'), value("C", "m", "({q:1})")],
        [],
        [value("A", "n", '["s"]'), value("A", "m", "true"), value("C", "m", "({q:2})")],
        [value("A", "m", '{"a": 9}'), value("B", "m", "(void 0)"), value("C", "m", "({q:3})")],
        [value("A", "m", '{"c": [{"1": 2}]}'), value("C", "m", "({'q':null})")],
    ]
    store, log = str(tmp_path / "values"), []

    def shown(report):
        return [tuple(r) for r in report.select("actor", "message", "n_types", "type_text").collect()]

    for n, texts in enumerate(batches):
        monkeypatch.setattr(live_values.values, "infer_value_types", recorded)
        for _ in range(2 if n in (1, 4) else 1):  # run again, as after a failure
            live_values.update_values(lines(texts).drop("mid"), n, store)
        monkeypatch.setattr(live_values.values, "infer_value_types", typed)
        log += texts
        for strict in (False, True):
            whole = infer.infer_schemas(lines(log), strict, mode="PERMISSIVE")
            assert shown(live_values.stored_values(spark, store, strict)) == shown(whole)
    # No batch types what an earlier one did; only the batches run twice did so again.
    distinct = [s for i, s in enumerate(read) if s not in read[:i]]
    assert len({t for s in distinct for t in s}) == sum(map(len, distinct))
