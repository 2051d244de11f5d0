"""Watching: late and repeated changes, quiet files, restarts, increments."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inventra import catalogue_flow
from inventra.operators import extract
from inventra.streaming.watch import Inventory, read_changes, settled, watch

START = datetime(2024, 1, 1)


def put(folder, n, rows):
    """One file of the stream: (path, seconds, content)."""
    folder.mkdir(exist_ok=True)
    said = [{"root": "r" if p else None, "path": p, "mtime": (START + timedelta(seconds=t)).isoformat() + "Z", "content": c} for p, t, c in rows]
    (folder / f"{n}.json").write_text("\n".join(map(json.dumps, said)))


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches one by one, each with a new query on the same checkpoint, and gives what settled in each."""
    n = 0

    def feed(*rows, quiet=10, late=5):
        nonlocal n
        n += 1
        put(tmp_path / "in", n, rows)
        out = []
        q = settled(read_changes(spark, str(tmp_path / "in")), quiet, late).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path, int((r.mtime - START).total_seconds()), r.content) for r in out)

    return feed


def test_quiet_late_and_repeated(run):
    assert run(("a", 0, "1"), ("a", 4, "2"), ("b", 2, "x")) == []
    # Not yet quiet: the newest time less 5 is 9, and a was written at 4.
    assert run(("c", 14, "c")) == []
    # b is quiet since 12 and told; a was written again.
    assert run(("a", 13, "3"), (None, 19, None)) == [("b", 2, "x")]
    # An older change of a comes late, and is dropped.
    assert run(("a", 12, "old"), (None, 30, None)) == [("a", 13, "3"), ("c", 14, "c")]
    # Told again as it was, or back to that before it settled: nothing.
    assert run(("a", 31, "3"), ("c", 32, "d"), ("c", 33, "c"), (None, 60, None)) == []
    # A deletion is a change; so is what comes back.
    assert run(("a", 61, None), (None, 90, None)) == [("a", 61, None)]
    assert run(("a", 91, "3"), ("b", 91, ""), ("b", 91, "y"), (None, 120, None)) == [("a", 91, "3"), ("b", 91, "y")]


def test_restart_tells_nothing_twice(run):
    """Every call above and here is a query of its own that goes on from the checkpoint."""
    assert run(("a", 0, "1"), (None, 100, None)) == [("a", 0, "1")]
    assert run((None, 200, None)) == [] and run(("a", 201, "1"), (None, 300, None)) == []


def test_only_what_changed_is_scanned(spark, tmp_path):
    scanned, told = [], []

    def scan(files):
        scanned.append(sorted(r.path for r in files.collect()))
        return extract.SCANNERS["model"](files)

    def feed(n, *rows):
        put(tmp_path / "in", n, rows)
        q = watch(read_changes(spark, str(tmp_path / "in")), str(tmp_path / "state"), scan, lambda df, _: told.append(sorted((r.path, r.name, r.change) for r in df.collect())), str(tmp_path / "check"), quiet=1, late=1, every=2)
        q.awaitTermination()

    feed(0, ("a.py", 0, "model = 'gpt-4o'"), ("b.py", 0, "model = 'gpt-5x'"), (None, 10, None))
    feed(1, ("a.py", 11, "\nmodel = 'gpt-4o'"), (None, 20, None))
    feed(2, ("a.py", 21, "model = 'claude-3-opus'"), ("c.py", 21, "x = 1"), (None, 30, None))
    feed(3, ("b.py", 31, None), (None, 40, None))
    assert scanned == [["a.py", "b.py"], ["a.py"], ["a.py", "c.py"], []]
    assert told == [[("a.py", "gpt-4o", "added"), ("b.py", "gpt-5x", "added")], [], [("a.py", "claude-3-opus", "added"), ("a.py", "gpt-4o", "removed")], [("b.py", "gpt-5x", "removed")]]
    assert [(r.path, r.name) for r in Inventory(spark, str(tmp_path / "state/components")).current().collect()] == [("a.py", "claude-3-opus")]


def test_inventory(spark, tmp_path):
    """A batch that runs twice writes the same; parts are written together."""
    inventory = Inventory(spark, str(tmp_path / "i"))
    files = lambda *paths: spark.createDataFrame([("r", p) for p in paths], "root string, path string")
    comps = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "root string, path string, name string, component_type string, line int")
    tell = lambda *x: sorted((r.path, r.name, r.change) for r in inventory.add(*x).collect())
    assert inventory.current().collect() == []
    first = files("a", "b"), comps(("a", "m", "model", 1), ("b", "n", "model", 1)), 0
    assert tell(*first) == tell(*first) == [("a", "m", "added"), ("b", "n", "added")]
    second = files("a"), comps(("a", "o", "model", 2)), 3
    assert tell(*second) == [("a", "m", "removed"), ("a", "o", "added")]
    before = sorted(map(tuple, inventory.current().collect()))
    inventory.compact(3)
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["all-3"] and sorted(map(tuple, inventory.current().collect())) == before == [("r", "a", "o", "model", 2), ("r", "b", "n", "model", 1)]
    assert tell(files("b"), comps(), 4) == [("b", "n", "removed")] and inventory.current().agg(F.count("*")).first()[0] == 1


def test_equal_times_go_to_the_first_event(spark, tmp_path):
    """Events at one time: the one with the least id, not the longest content."""
    at = lambda day: datetime(2024, 1, day)
    rows = [(3, at(1), 7, "purchase"), (2, at(1), 7, "view"), (12, at(1), 7, "click"), (20, at(9), 8, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue_flow.settled_changes(spark, str(tmp_path)).collect()
    assert [(r.path, r.content) for r in got] == [("u7", "view:2")]
