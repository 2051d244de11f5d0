"""The bounded walk over callers against a plain breadth-first walk."""

import random

import pytest

from inventra.operators.graph import workflows

FUNCTIONS = "function_id string, qualname string, file_path string, start_line int, end_line int, parameters array<string>"
CALLS = "caller string, callee string, line int, arguments string, ord int"


def made(seed):
    rng = random.Random(seed)
    functions = []
    for file in "ab":
        for i in range(12):
            functions.append((f"{file}{i}", f"m.{file}{i}", file, 10 * i + 1, 10 * i + 8, ["x"]))
        functions.append((f"{file}_inner", "m.inner", file, 3, 5, []))
    names = [f[0] for f in functions]
    calls = [(rng.choice(names), rng.choice([*names, "outside"]), rng.randrange(200), f"args{i}", i) for i in range(90)]
    # All call one.
    calls += [(n, "a0", 7, "all", 1000 + i) for i, n in enumerate(names)]
    points = [(i, rng.choice("abc"), rng.randrange(1, 130)) for i in range(40)]
    return points, functions, calls


def plain(points, functions, calls, hops, most):
    by_id = {f[0]: f for f in functions}
    first = {}
    for caller, callee, line, arguments, _ in calls:
        if caller != callee:
            first.setdefault((caller, callee), (line, arguments))
    out = []
    for i, file, line in points:
        own = sorted((f for f in functions if f[2] == file and f[3] <= line <= f[4]), key=lambda f: (f[3], f[4], f[0]))
        if not own:
            continue
        rows, met, todo = [(own[0][0], 0, None, (None, None))], {own[0][0]}, [(own[0][0], 0)]
        while todo and len(rows) < most:
            now, depth = todo.pop(0)
            if depth >= hops:
                continue
            for caller in sorted((c for c, e in first if e == now and c not in met), key=lambda c: (by_id[c][2], by_id[c][3], c)):
                if len(rows) < most:
                    met.add(caller)
                    rows.append((caller, depth + 1, now, first[caller, now]))
                    todo.append((caller, depth + 1))
        out += [(i, n, d, f, by_id[f][1], by_id[f][2], by_id[f][3], child, *call) for n, (f, d, child, call) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "hops", "most"), [(1, 4, 10), (2, 2, 100), (3, 3, 4)])
def test_equals_a_plain_walk(spark, seed, hops, most):
    points, functions, calls = made(seed)
    got = workflows(spark.createDataFrame(points, "id int, file_path string, line int"), spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS), hops, most)
    rows = sorted((r.id, r.position, r.distance, r.function_id, r.qualname, r.file_path, r.line, r.child, r.call_line, r.call_arguments) for r in got.collect())
    want = plain(points, functions, calls, hops, most)
    assert [r[:8] for r in rows] == [w[:8] for w in want] and rows == want


def test_no_calls(spark):
    points, functions, _ = made(4)
    got = workflows(spark.createDataFrame(points, "id int, file_path string, line int"), spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame([], CALLS))
    assert {r.distance for r in got.collect()} == {0}
