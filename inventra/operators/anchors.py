"""Where a tool is defined, for tools that were seen where they are registered.

A file's scopes and what they bind are rows; which binding a name means at a line
is a join and two aggregates, and a name that is imported is followed from module
to module by one join for each step."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.sources.files import parsed
from inventra.tables import stored

_SCOPE = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_DEF = re.compile(r"\s*(async\s+)?def\s")
#: How often an import is followed.
STEPS = 3
# What a registration says of how its tool was found.
KWARG, CALLS = "agent_tools_kwarg", ("add_tool(", "register_tool(", "register_function(")


def _bound(scope: ast.AST) -> Iterator[tuple[str, int, str]]:
    """Names that a scope binds itself, with line and kind; parameters before all."""
    todo, calls = [scope], set()
    while todo:
        for node in ast.iter_child_nodes(todo.pop()):
            match node:
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    yield node.name, node.lineno, "def"
                    continue
                case ast.ClassDef():
                    yield node.name, node.lineno, "class"
                    continue
                case ast.Lambda():
                    continue
                case ast.Import() | ast.ImportFrom():
                    for a in node.names:
                        yield (a.asname or a.name).split(".")[0], node.lineno, "import"
                case ast.Assign(value=ast.Call()):
                    calls.update(map(id, node.targets))
                case ast.AnnAssign(value=ast.Call()):
                    calls.add(id(node.target))
                case ast.Name(ctx=ast.Store()):
                    yield node.id, node.lineno, "call" if id(node) in calls else "other"
                case ast.ExceptHandler() if node.name:
                    yield node.name, node.lineno, "other"
                case ast.arg():
                    yield node.arg, 0, "other"
            todo.append(node)


def bindings(files: DataFrame) -> DataFrame:
    """Rows (name, kind, line, begin, end, of_class, module, level, origin): each
    scope (kind scope), what it binds, each line of a decorator with the next
    ``def`` as its end, and what a module's own statements define (top) or import
    (from).  Of a file that doesn't parse only the decorators are known."""
    def parse(root, path, content):
        lines = content.splitlines()
        nxt = None
        for i in range(len(lines), 0, -1):
            if _DEF.match(lines[i - 1]):
                nxt = i
            if lines[i - 1].lstrip().startswith("@"):
                yield "", "decorator", i, 0, nxt, False, "", 0, ""
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if node is tree or isinstance(node, _SCOPE):
                span = (0, 10**9) if node is tree else (node.lineno, node.end_lineno)
                yield "", "scope", 0, *span, isinstance(node, ast.ClassDef), "", 0, ""
                for name, line, kind in _bound(node):
                    yield name, kind, line, *span, isinstance(node, ast.ClassDef), "", 0, ""
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield node.name, "top", node.lineno, 0, 0, False, "", 0, ""
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    yield a.asname or a.name, "from", node.lineno, 0, 0, False, node.module or "", node.level, a.name

    python = files.where(F.col("path").endswith(".py"))
    return parsed(python, parse, "name string, kind string, line int, begin int, end int, of_class boolean, module string, level int, origin string")


def meant(asks: DataFrame, b: DataFrame) -> DataFrame:
    """asks (id, which, root, path, at, asked) with what the name is bound to there
    (bound: line and kind; null for nothing): in the innermost scope the last
    binding before the line, else the last of the nearest scope around that has
    one; classes aren't seen from within their functions."""
    held = b.where("kind not in ('decorator', 'top', 'from')").withColumnRenamed("name", "asked").withColumnRenamed("line", "b_line")
    around = F.col("at").between(F.col("begin"), F.col("end"))
    inner = asks.select("id", "root", "path", "at").distinct().join(held.where("kind = 'scope'").drop("asked"), ["root", "path"]).where(around).groupBy("id").agg(F.max("begin").alias("inner"))
    own = F.col("begin") == F.col("inner")
    rows = asks.join(inner, "id").join(held.where("kind <> 'scope'"), ["root", "path", "asked"]).where(around & (own | ~F.col("of_class")))
    known = F.when(~own | (F.col("b_line") <= F.col("at")), F.struct("begin", F.struct(F.col("b_line").alias("line"), "kind").alias("b")))
    best = rows.groupBy("id", "which").agg(F.max("begin").alias("nearest"), F.max(known).alias("k"))
    return best.select("id", "which", F.when(F.col("k.begin") == F.col("nearest"), F.col("k.b")).alias("bound"))


def modules(path: Column, module: Column, level: Column) -> Column:
    """Files that a module may be, the likeliest first: relative ones from their
    package, others from each folder above."""
    folders = F.split(path, "/")
    depth = F.size(folders) - 1
    up = F.when(level == 0, F.sequence(depth, F.lit(0), F.lit(-1))).when(depth >= level - 1, F.array(depth - level + 1)).otherwise(F.array().cast("array<int>"))
    parts = F.filter(F.split(module, r"\."), lambda x: x != "")
    below = lambda n: F.concat(F.filter(folders, lambda _, i: i < n), parts)
    file = lambda n: F.when(module != "", F.concat(F.array_join(below(n), "/"), F.lit(".py")))
    package = lambda n: F.array_join(F.concat(below(n), F.array(F.lit("__init__.py"))), "/")
    return F.flatten(F.transform(up, lambda n: F.array_compact(F.array(file(n), package(n)))))


def imported(asks: DataFrame, b: DataFrame, files: DataFrame) -> DataFrame:
    """asks (id, root, path, name) with the file and line of the function that an
    imported name means, within the same root, over ``STEPS`` modules at most."""
    top = b.where("kind in ('top', 'from')").groupBy("root", "path", "name").agg(F.max_by(F.struct("kind", "line", "module", "level", "origin"), "ord").alias("t"))
    there = files.select("root", F.col("path").alias("to")).distinct().hint("merge")
    now, found = asks, None
    for step in range(STEPS + 1):
        met = now.join(top, ["root", "path", "name"])
        if step:
            done = met.where("t.kind = 'top'").select("id", "path", F.col("t.line").alias("line"))
            found = done if found is None else found.unionByName(done)
        if step < STEPS:
            way = met.where("t.kind = 'from'").select("id", "root", F.col("t.origin").alias("name"), F.posexplode(modules(F.col("path"), F.col("t.module"), F.col("t.level"))).alias("n", "to"))
            now = way.join(there, ["root", "to"]).groupBy("id", "root", "name").agg(F.min_by("to", "n").alias("path"))
    return found


def aligned(tools: DataFrame, files: DataFrame) -> DataFrame:
    """tools (id, root, path, line, name, via) at their definitions: id, path, line,
    anchor, and where they were reported if that is elsewhere.

    What stands at a decorator goes to the function below it; else to the ``def``
    that the name means there; a name in an agent's list of tools that is imported
    to that import (anchor import), and goes altogether unless a class or a call's
    result is meant; an imported function that a registration call is given to its
    ``def`` in the module it comes from.  Others stay."""
    b = stored(bindings(files))
    t = tools.where("line > 0 and path like '%.py'")
    below = b.where("kind = 'decorator'").select("root", "path", "line", F.lit(True).alias("decorator"), F.col("end").alias("below"))
    t = t.join(below, ["root", "path", "line"], "left")
    ways = {"name": F.col("name"), "head": F.split_part("name", F.lit("."), F.lit(1)), "star": F.lit("*")}
    names = F.array(*(F.struct(F.lit(which).alias("which"), asked.alias("asked")) for which, asked in ways.items()))
    asks = t.where("decorator is null").select("id", "root", "path", F.col("line").alias("at"), F.explode(names).alias("a")).select("id", "root", "path", "at", "a.*")
    bound = meant(asks, b).groupBy("id").agg(*(F.max(F.when(F.col("which") == w, F.col("bound"))).alias(w) for w in ("name", "head", "star")))
    bound = bound.select("id", F.when(F.col("name.kind") == "def", F.col("name.line")).alias("own"), F.coalesce("head", "star").alias("by"))
    parsed_files = b.where("kind = 'scope'").select("root", "path").distinct().withColumn("known", F.lit(True))
    t = t.join(bound, "id", "left").join(parsed_files, ["root", "path"], "left")
    listed = F.col("decorator").isNull() & F.col("own").isNull() & (F.col("via") == KWARG) & F.col("known")
    kind = F.coalesce(F.col("by.kind"), F.lit("none"))
    called = F.col("decorator").isNull() & F.col("own").isNull() & F.col("known") & F.col("via").rlike("^(" + "|".join(map(re.escape, CALLS)) + ")")
    far = imported(t.where(called).select("id", "root", "path", "name"), b, files).toDF("id", "far_path", "far_line")
    t = t.where(F.coalesce(~listed | kind.isin("import", "class", "call"), F.lit(True))).join(far, "id", "left")
    line = F.coalesce(F.when(F.col("decorator"), F.col("below")), "own", F.when(listed & (kind == "import"), F.col("by.line")), "far_line", "line")
    moved = (line != F.col("line")) | F.col("far_path").isNotNull()
    out = t.select("id", F.coalesce("far_path", "path").alias("path"), line.alias("line"), F.when(listed & (kind == "import"), "import").alias("anchor"), F.when(F.col("far_path").isNotNull(), F.col("path")).alias("reported_path"), F.when(moved, F.col("line")).alias("reported_line"))
    rest = tools.where("not coalesce(line > 0 and path like '%.py', false)")
    none = F.lit(None).cast("string")
    return out.unionByName(rest.select("id", "path", "line", none.alias("anchor"), none.alias("reported_path"), F.lit(None).cast("int").alias("reported_line")))
