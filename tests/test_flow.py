"""Loop registrations followed through the code: one walk over many small repositories."""

import pytest

from inventra.operators import flow

DEF = "def search(q): return q\ndef lookup(k): return k\n"
LOOP = "for tool in {}:\n    server.add_tool(tool)\n"
#: name: (files, path and line of the registration, functions as path and name; None where no loop is)
CASES = {
    "listed": ({"s.py": DEF + LOOP.format("[search, *(lookup,)]")}, ("s.py", 4), {"search", "lookup"}),
    "in_function": ({"s.py": DEF + "def build(m):\n    for tool in {search}:\n        m.add_tool(tool)\n"}, ("s.py", 5), {"search"}),
    "grown": ({"s.py": DEF + "T = []\nT.append(search)\nT += [lookup] if x else []\n" + LOOP.format("sorted(T)[1:]")}, ("s.py", 7), {"search", "lookup"}),
    "comprehension": ({"s.py": DEF + LOOP.format("[t for t in (search,) if t] + list(a or [lookup])")}, ("s.py", 4), {"search", "lookup"}),
    "wrapped": ({"s.py": DEF + "import functools\n" + LOOP.format("[functools.partial(search, 1), Tool.from_function(lookup, 'n')]")}, ("s.py", 5), {"search", "lookup"}),
    "closure": ({"s.py": DEF + "def guard(fn):\n    def inner(): return fn()\n    return inner\n" + LOOP.format("[guard(search)]")}, ("s.py", 7), {"search"}),
    "returned": ({"s.py": DEF + "def all_tools():\n    if x:\n        return (search,)\n    return {lookup}\n" + LOOP.format("all_tools()")}, ("s.py", 8), {"search", "lookup"}),
    "parameter": ({"a.py": "def build(s, tools=()):\n    for tool in tools:\n        s.add_tool(tool)\n", "b.py": DEF + "build(x, [search])\nm.build(y, tools=[lookup])\nbuild(*rest)\n"}, ("a.py", 3), {"search", "lookup"}),
    "method": ({"a.py": DEF + "class B:\n    def build(self, tools):\n        for tool in tools:\n            self.s.add_tool(tool)\nb.build([search])\nb.build(*[lookup])\n"}, ("a.py", 6), {"search", "lookup"}),
    "behind_a_star": ({"a.py": DEF + "def build(x, tools):\n    for tool in tools:\n        s.add_tool(tool)\nbuild(*a, [search])\n"}, ("a.py", 5), set()),
    "field": ({"a.py": DEF + "class Box: pass\nb = Box(read=[search], write=[lookup])\n" + LOOP.format("b.read")}, ("a.py", 6), {"search"}),
    "field_without_name": ({"a.py": DEF + "class Box: pass\nb = Box([search], write=[lookup])\n" + LOOP.format("b.read")}, ("a.py", 6), {"search", "lookup"}),
    "replaced": ({"a.py": DEF + "class Box: pass\nb = replace(Box(read=[search]), write=[lookup])\n" + LOOP.format("b.read")}, ("a.py", 6), {"search"}),
    "container": ({"a.py": DEF + "class Box: pass\nb = Box(read=[search], write=[lookup])\n" + LOOP.format("b.tools_for(1)")}, ("a.py", 6), {"search", "lookup"}),
    "same": ({"a.py": DEF + "T = {1: 2}\nT.update([search])\n" + LOOP.format("T.values()")}, ("a.py", 6), {"search"}),
    "imported": ({"p/__init__.py": "from .inner import T as U\n", "p/inner.py": "from q.deep import search\nT = [search]\n", "p/q/deep.py": DEF, "p/s.py": "from . import U\n" + LOOP.format("U")}, ("p/s.py", 3), {"search"}),
    "in_tests": ({"tests/f.py": DEF, "s.py": "from tests.f import search\n" + LOOP.format("[search]")}, ("s.py", 3), set()),
    "called_in_tests": ({"a.py": DEF + "def build(tools):\n    for tool in tools:\n        s.add_tool(tool)\n", "test_a.py": "from a import search\nbuild([search])\n"}, ("a.py", 5), set()),
    "unknown": ({"s.py": "from plugins import discover\n" + LOOP.format("discover()")}, ("s.py", 3), set()),
    "no_loop": ({"s.py": DEF + "server.add_tool(search)\n"}, ("s.py", 3), None),
    "broken": ({"s.py": "def x(:\nfor tool in [a]:\n    add_tool(tool)\n"}, ("s.py", 3), None),
    "cycle": ({"a.py": DEF + "from b import U\nT = [search, *U]\n" + LOOP.format("T"), "b.py": "from a import T, lookup\nU = [lookup, *T, *U]\ndef again(n): return again(n)\nU.extend(again(1))\n"}, ("a.py", 6), {"search", "lookup"}),
    "inner_loop": ({"a.py": DEF + "for tool in [search]:\n    for tool in [lookup]:\n        s.add_tool(tool)\n"}, ("a.py", 5), {"lookup"}),
    "nested": ({"a.py": "def f():\n    def inner(): pass\n    for tool in [inner]:\n        s.add_tool(tool)\n"}, ("a.py", 4), set()),
    "shadowed": ({"a.py": DEF + "T = [lookup]\ndef f():\n    T = [search]\n    for tool in T:\n        s.add_tool(tool)\n"}, ("a.py", 7), {"search"}),
    "set_of_specs": ({
        "pkg/__init__.py": "", "pkg/tools/__init__.py": "from ..spec import Set\nfrom .kv import get, put\nTOOLS = Set(read=(get,), write=(put,))\n", "pkg/tools/kv.py": "def get(k): return k\ndef put(k, v): return v\n",
        "pkg/spec.py": "class Set:\n    def tools_for(self, ro): return list(self.read)\nclass Spec:\n    tools: Set\n", "pkg/server.py": "from .spec import Spec\nfrom .tools import TOOLS\nSPEC = Spec(name='kv', tools=TOOLS)\n",
        "pkg/gate.py": "def gate(spec, ro):\n    tools = spec.tools.tools_for(ro)\n    enabled = [t for t in tools if t]\n    final = []\n    for t in enabled:\n        final.append(t)\n    return final\n",
        "pkg/app.py": "def build(spec, tools):\n    for tool in tools:\n        m.add_tool(tool)\n", "pkg/main.py": "from .app import build\nfrom .gate import gate\ndef start(spec):\n    build(spec, tools=gate(spec, False))\ndef main():\n    from .server import SPEC\n    start(SPEC)\n",
    }, ("pkg/app.py", 3), {"get", "put"}),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(root, path, text) for root, (tree, *_) in CASES.items() for path, text in tree.items()]
    return spark.createDataFrame(rows, "root string, path string, content string").repartition(3)


def test_every_way(spark, files):
    sites = spark.createDataFrame([(root, root, *at, "tool") for root, (_, at, _) in CASES.items()], "id string, root string, path string, line int, name string")
    got = {}
    for r in flow.registered(sites, files).collect():
        got.setdefault(r.id, set()).update([r.name] if r.name else [])
    assert got == {root: want for root, (*_, want) in CASES.items() if want is not None}


def test_rows_are_put_in_place_of_the_variable(spark, files):
    tools = [(1, "listed", "s.py", 4, "tool", "add_tool(_pos_0)"), (2, "unknown", "s.py", 3, "tool", "from_function(x)"), (3, "no_loop", "s.py", 3, "search", "add_tool(_pos_0)"), (4, "unknown", "s.py", 3, "tool", "agent_tools_kwarg"), (5, "x", "a.ts", 1, "tool", "add_tool(x)"), (6, "listed", "s.py", 0, "tool", None)]
    got = flow.expanded(spark.createDataFrame(tools, "id int, root string, path string, line int, name string, via string"), files)
    assert sorted((r.id, r.path, r.line, r.name, r.reported_line) for r in got.collect() if r.id != 1) == [(3, "s.py", 3, "search", None), (4, "s.py", 3, "tool", None), (5, "a.ts", 1, "tool", None), (6, "s.py", 0, "tool", None)]
    assert sorted((r.line, r.name, r.reported_path, r.reported_line) for r in got.collect() if r.id == 1) == [(1, "search", "s.py", 4), (2, "lookup", "s.py", 4)]


def test_depth_ends_a_walk(spark):
    chain = {"a.py": DEF + "A = [search]\n" + "".join(f"A{i} = [*{'A' if i == 0 else f'A{i - 1}'}]\n" for i in range(12)) + LOOP.format("A11")}
    tree = spark.createDataFrame([("r", p, t) for p, t in chain.items()], "root string, path string, content string")
    sites = spark.createDataFrame([(1, "r", "a.py", 17, "tool")], "id int, root string, path string, line int, name string")
    # Each list is three steps: the list, the star, the name; then the list and its function.
    assert [r.name for r in flow.registered(sites, tree, depth=38).collect()] == ["search"]
    assert [r.name for r in flow.registered(sites, tree, depth=37).collect()] == [None]


def test_nothing_to_follow(spark):
    none = spark.createDataFrame([], "root string, path string, content string")
    assert flow.registered(spark.createDataFrame([], "id int, root string, path string, line int, name string"), none).collect() == []


def test_a_round_follows_several_edges(spark, monkeypatch):
    """Lists that take in another module's list: about a round for each module, not one for each edge."""
    tree = {"pkg/m0.py": "def f0(): pass\nT0 = [f0]\n"} | {f"pkg/m{i}.py": f"from .m{i - 1} import T{i - 1}\ndef f{i}(): pass\nT{i} = [f{i}, *T{i - 1}]\n" for i in range(1, 5)}
    tree["pkg/m4.py"] += LOOP.format("T4")
    rounds, keep = [], flow._Walk._keep
    monkeypatch.setattr(flow._Walk, "_keep", lambda self, rows: rounds.append(1) or keep(self, rows))
    sites = spark.createDataFrame([(1, "r", "pkg/m4.py", 5, "tool")], "id int, root string, path string, line int, name string")
    got = flow.registered(sites, spark.createDataFrame([("r", p, t) for p, t in tree.items()], "root string, path string, content string"))
    assert sorted(r.name for r in got.collect()) == ["f0", "f1", "f2", "f3", "f4"]
    assert len(rounds) <= 8


def test_what_many_loops_lead_to_is_walked_once(spark, monkeypatch):
    """A loop over each list of a chain: the walk has some rows for each module, not for each pair of them."""
    tree = {f"p/m{i}.py": (f"from .m{i - 1} import T{i - 1}\n" if i else "T0 = 1\n") + f"def f{i}(): pass\nT{i} = [f{i}{f', *T{i - 1}' if i else ''}]\n" + LOOP.format(f"T{i}") for i in range(6)}
    rows, remove = [], flow.removed

    def counted(spark, path):
        held = spark.read.parquet(path)
        if "mode" in held.columns:
            rows.append(held.count())
        remove(spark, path)

    monkeypatch.setattr(flow, "removed", counted)
    sites = spark.createDataFrame([(i, "r", f"p/m{i}.py", 5, "tool") for i in range(6)], "id int, root string, path string, line int, name string")
    got = flow.registered(sites, spark.createDataFrame([("r", p, t) for p, t in tree.items()], "root string, path string, content string"))
    assert sorted((r.id, r.name) for r in got.collect()) == [(i, f"f{j}") for i in range(6) for j in range(i + 1)]
    assert len(rows) == 1 and rows[0] <= 36


def test_facts_that_nothing_leads_to_go():
    """An argument stays, as a parameter may lead to it; the call around it and its object don't."""
    text = "T = [f, *(g, h)]\ndef f(): return 1\nserver.add_tool(T)\n"
    rows = list(flow._shortened(list(flow._facts("r", "a.py", text)), "a.py"))
    assert {r[0] for r in rows} == {"edge", "def", "arg", "return"}
    # The list is met from the name alone, so its elements are one step away.
    assert sorted((r[1], r[2], r[10]) for r in rows if r[0] == "edge" and r[1] == "a.py@T") == [("a.py@T", "a.py@f", 2)]
