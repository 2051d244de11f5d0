"""Documents joined from parts equal those rendered from rows in order."""

import json
import random

import pytest

from inventra.plans import assess
from inventra.sinks import reports
from inventra.sinks.documents import PIECES, DocumentWriter, write_document, write_pieces

SCHEMA = "source string, name string, component_type string, file_path string, line_number int, framework string, detection_source string, heuristic_confidence double, agentic_confidence double, model_name string, description string, instance_id string, ord long, test_only boolean, needs_agentic boolean"


@pytest.fixture(scope="module")
def inventory(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["a", "B|", "é", '"', "<x>", "&", ",", "\n", "=", "'", "\\"]) for _ in range(rng.randint(1, 5)))
    kinds = ["agent", "model", "secret", "dataset", "dependency", "mcp_server", "a_very_long_kind_of_component"]
    rows = [(rng.choice(["s1", "s2", 's"3']), word(), rng.choice(kinds), rng.choice([None, "", word()]), rng.choice([None, 0, 3, 12, 100]), rng.choice([None, "", "fw"]), "code", rng.choice([0.5, None]), rng.choice([None, 0.75]), rng.choice([None, word()]), rng.choice([None, "", word()]), f"i{i}", i, rng.random() < 0.2, False) for i in range(300)]
    c = spark.createDataFrame(rows, SCHEMA).repartition(5)
    flags = assess.weighted(spark.createDataFrame([("hardcoded_api_key", "b.py", 1, "i2"), ("no_auth", "b.py", 0, "i3")], "flag string, file_path string, line_number int, instance_id string"))
    edges = spark.createDataFrame([(f"i{i}", f"i{i + 1}", "uses", i) for i in range(20)], "source_instance_id string, target_instance_id string, relationship_type string, n int")
    return c, flags, edges


@pytest.mark.parametrize("kind", ["json", "csv", "cyclonedx", "sarif", "spdx", "markdown", "plaintext", "junit", "html"])
def test_equals_the_renderer(inventory, tmp_path, kind):
    c, flags, edges = inventory
    # Ties in what a renderer sorts by are in any order, so they are avoided.
    more = {"flags": flags, "edges": edges}
    if kind in ("csv", "html", "sarif", "plaintext", "markdown", "json"):
        c = c.dropDuplicates(["component_type", "name"] if kind != "html" else ["file_path", "name"])
    # The choice among duplicates is held fast by writing it down.
    c.write.parquet(str(tmp_path / "rows"))
    c = c.sparkSession.read.parquet(str(tmp_path / "rows"))
    want = reports.REPORTERS[kind](c, **more)
    place = tmp_path / "out" / "report"
    write_document(c, f"file://{place}", kind, **more)
    got = place.read_text(encoding="utf-8")
    if kind in ("json", "cyclonedx", "sarif", "spdx"):
        assert json.loads(got) == json.loads(want)
    else:
        assert got == want
    # Nothing but the document is left, and a second one takes its place.
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["report"]
    write_document(c.limit(0), f"file://{place}", kind, **more)
    assert len(place.read_text()) < len(got)


def test_glue_across_parts(spark, tmp_path):
    """Pieces of one list meet their glue wherever parts end; parts without any don't matter."""
    pieces = [([f"{i:03}"], str(i), ",", "x" if i < 50 else "y", "x" if i < 50 else "y") for i in range(100)]
    df = spark.createDataFrame(pieces, PIECES)
    write_pieces(df.repartition(7), f"file://{tmp_path}/d")
    assert (tmp_path / "d").read_text() == ",".join(map(str, range(50))) + ",".join(map(str, range(50, 100)))
    write_pieces(df.limit(0), f"file://{tmp_path}/d")
    assert (tmp_path / "d").read_text() == ""


def test_abort_leaves_nothing(tmp_path):
    writer = DocumentWriter(f"file://{tmp_path}/d")
    (tmp_path / writer.parts.rsplit("/", 1)[1]).mkdir()
    writer.abort([])
    assert list(tmp_path.iterdir()) == []


def test_a_report_is_read_item_by_item():
    """The rows of a whole decoding, also of odd reports, with far less than its objects in memory."""
    import json
    import tracemalloc

    import pytest

    from inventra.sources.files import _report

    big = json.dumps({"v": [1, {}], "sources": {"a": {"components": {"model": [{"name": f"n{i}", "line_number": i, "x": {"y": [i]}} for i in range(30_000)], "none": []}, "source_path": "p"}, "b": {"components": [{"component_type": "tool", "name": "é"}]}, "c": {"tool": [{}]}}}, indent=1)
    tracemalloc.start()
    try:
        n = sum(1 for _ in _report(big))
        assert n == 30_002 and tracemalloc.get_traced_memory()[1] < 200_000
    finally:
        tracemalloc.stop()
    rows = list(_report(big))
    assert rows[29_999] == ("p", "model", "n29999", "", 29_999, None) and rows[30_000:] == [("b", "tool", "é", "", 0, None), ("c", "tool", None, "", 0, None)]
    assert list(_report('{"sources": {"a": {"components": [{"name": 1}]}, "a": {}}}')) == [] and list(_report('{"sources": null}')) == [] == list(_report(" {} "))
    for odd in ("", "[]", "{", "{} x", '{"sources": [1]}', '{"sources": {"a": 1}}', '{"sources": {"a": {"components": [1]}}}', '{"sources": {"a": {"components": [{},]}}}', '{"sources": {"a": {"k": "x"}}}', '{"sources": {"a": {"k": null}}}', '{"a": 1,}', '{"sources": {"a": {"k": [{"line_number": "x"}]}}}'):
        with pytest.raises((ValueError, TypeError, AttributeError)):
            list(_report(odd))
