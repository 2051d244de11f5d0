"""Functions that are registered as tools in a loop.

``for tool in spec.tools(): server.add_tool(tool)`` names no tool but a loop
variable.  What the loop runs over is followed backwards through the repository:
assignments, growing lists, parameters by their call sites, return values,
constructor arguments, fields and imports, to functions that modules define.

One pass over the files writes *facts*: which expression takes its value from
which other (edges), which one reads a field or calls a method, and calls with
their arguments, definitions, returns, imports.  Two fixpoints go over these tables;
each round joins only the rows that are new in it, and follows a few edges at once.
The first has a row for each node that any start leads to, as what a node leads to
is the same for all of them.  Fields and methods ask which objects stand before the
dot: such a question is a start of its own, asked once however many ask it, and each
object found is met with all that wait for it.  Where nothing is constructed before
a dot, a method call passes on its first argument; that is decided once the walk has
come to rest, and it goes on from there.  The second has rows (start, node) over the
steps that the first has found, led past nodes with one way on.  Cycles end by
themselves, as a row is new only once, or again at less depth.
"""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.text import in_skipped_dir
from inventra.operators.anchors import modules
from inventra.sources.files import parsed
from inventra.tables import dropped, removed, shared_dir, stored

#: How many steps away from a loop a walk goes, and how many edges one round follows.
DEPTH = 24
AT_ONCE = 3
# Calls that pass on what they are given; methods that grow a collection; methods that give what they stand on.
PASSING = ("list", "tuple", "set", "frozenset", "sorted", "reversed", "iter")
GROWING = ("append", "extend", "add", "update", "insert")
SAME = ("copy", "values")
# Folders and names of test files.
TEST_FOLDERS = ("tests", "test", "testing", "__tests__")

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_INNER = (*_FUNCTION, ast.ClassDef, ast.Lambda)
FACTS = "kind string, node string, other string, name string, pos int, flag boolean, first boolean, module string, level int, line int, cost int, words array<string>"


def _own(scope: ast.AST, below: dict[int, list]) -> Iterator[ast.AST]:
    """What stands in a scope itself, in the order of the source.  below: the nodes
    right below each, by its id."""
    ahead = below[id(scope)][::-1]
    while ahead:
        node = ahead.pop()
        yield node
        if not isinstance(node, _INNER):
            ahead += below[id(node)][::-1]


def _targets(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


class _Scope:
    """What names are bound to in a module or a function: (kind, payload)."""

    def __init__(self, node: ast.AST, below: dict[int, list]):
        self.node, self.bound = node, {}
        for n in _own(node, below):
            match n:
                case ast.Assign():
                    self._add({x for t in n.targets for x in _targets(t)}, "value", n.value)
                case ast.AnnAssign() | ast.AugAssign() if n.value is not None:
                    self._add(_targets(n.target), "value", n.value)
                case ast.For() | ast.AsyncFor() | ast.comprehension():
                    self._add(_targets(n.target), "value", n.iter)
                case ast.Call(func=ast.Attribute(attr=attr, value=ast.Name(id=name))) if attr in GROWING:
                    for a in n.args:
                        self._add([name], "value", a)
                case ast.ImportFrom():
                    for a in n.names:
                        self._add([a.asname or a.name], "import", (n, a.name))
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    self._add([n.name], "def", n)
                case ast.ClassDef():
                    self._add([n.name], "class", n)
        if isinstance(node, _FUNCTION):
            positional = [a.arg for a in (*node.args.posonlyargs, *node.args.args)]
            for name in (*positional, *(a.arg for a in node.args.kwonlyargs)):
                self._add([name], "param", positional.index(name) if name in positional else None)

    def _add(self, names, kind: str, payload) -> None:
        for name in names:
            self.bound.setdefault(name, []).append((kind, payload))


def _row(kind: str, node: str, other=None, name=None, pos=None, flag=None, first=None, module=None, level=None, line=None, cost=1, words=None):
    return kind, node, other, name, pos, flag, first, module, level, line, cost, words


def _facts(root: str, path: str, content: str) -> Iterator[tuple]:
    """Facts of one file.  A node is ``path#number``, what a module calls by a name
    ``path@name``."""
    tree = ast.parse(content)
    number, parent, below, nodes = {}, {}, {}, [tree]
    # One pass in the order of ast.walk, as going through fields takes most of the time.
    for i, n in enumerate(nodes):
        number[id(n)] = i
        below[id(n)] = kids = list(ast.iter_child_nodes(n))
        parent |= {id(c): n for c in kids}
        nodes += kids
    key = lambda n: f"{path}#{number[id(n)]}"
    scopes: dict[int, _Scope] = {}

    def scope_of(node: ast.AST) -> _Scope:
        at = parent.get(id(node))
        while at is not None and not isinstance(at, (*_FUNCTION, ast.Module)):
            at = parent.get(id(at))
        at = at or tree
        if id(at) not in scopes:
            scopes[id(at)] = _Scope(at, below)
        return scopes[id(at)]

    def told(node: str, scope: _Scope, name: str) -> Iterator[tuple]:
        """What a name has its value from, in its own scope."""
        held = scope.bound[name]
        defining = [i for i, (kind, _) in enumerate(held) if kind in ("def", "class", "import")]
        for i, (kind, what) in enumerate(held):
            # The last definition is the one that a call means.
            last = bool(defining) and i == defining[-1]
            if kind == "value":
                yield _row("edge", node, key(what), "b")
            elif kind == "import":
                yield _row("import", node, name=what[1], first=last, module=what[0].module or "", level=what[0].level)
            elif kind == "def":
                inner = {n.name for n in _own(what, below) if isinstance(n, _FUNCTION)}
                returns = [n.value for n in _own(what, below) if isinstance(n, ast.Return) and n.value is not None]
                closure = any(isinstance(r, ast.Name) and r.id in inner for r in returns)
                yield _row("def", node, key(what), what.name, int(isinstance(scope.node, ast.Module)), closure, last, line=what.lineno)
            elif kind == "class":
                yield _row("class", node, first=last)
            else:
                owner = scope.node
                method = isinstance(parent.get(id(owner)), ast.ClassDef) and [a.arg for a in (*owner.args.posonlyargs, *owner.args.args)][:1] in (["self"], ["cls"])
                yield _row("param", node, name=name, pos=-1 if what is None else what - method, module=owner.name)

    top = scope_of(next(ast.iter_child_nodes(tree), tree))
    for name in top.bound:
        yield from told(f"{path}@{name}", top, name)
    for node in nodes:
        at = key(node)
        match node:
            case ast.Name():
                scope = scope_of(node)
                if scope is not top and node.id in scope.bound:
                    yield from told(at, scope, node.id)
                elif node.id in top.bound:
                    yield _row("edge", at, f"{path}@{node.id}", "b", cost=0)
            case ast.Tuple() | ast.List() | ast.Set():
                for e in node.elts:
                    yield _row("edge", at, key(e), "f")
            case ast.Starred() | ast.Subscript():
                yield _row("edge", at, key(node.value), "f")
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp():
                for g in node.generators:
                    yield _row("edge", at, key(g.iter), "f")
            case ast.IfExp():
                yield _row("edge", at, key(node.body), "f")
                yield _row("edge", at, key(node.orelse), "f")
            case ast.BoolOp():
                for v in node.values:
                    yield _row("edge", at, key(v), "f")
            case ast.BinOp(op=ast.Add()):
                yield _row("edge", at, key(node.left), "f")
                yield _row("edge", at, key(node.right), "f")
            case ast.Attribute():
                yield _row("attr", at, key(node.value), node.attr)
            case ast.Call():
                yield from _call(node, at, key, scope_of, top, path)
            case ast.Return() if node.value is not None:
                owner = parent.get(id(node))
                while owner is not None and not isinstance(owner, _INNER):
                    owner = parent.get(id(owner))
                if isinstance(owner, _FUNCTION):
                    yield _row("return", key(owner), key(node.value))
            case ast.For() | ast.AsyncFor():
                for name in _targets(node.target):
                    yield _row("loop", key(node.iter), name=name, line=node.lineno, pos=node.end_lineno or node.lineno)


def _call(node: ast.Call, at: str, key, scope_of, top: _Scope, path: str) -> Iterator[tuple]:
    f, given = node.func, key(node.args[0]) if node.args else None
    named = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
    if isinstance(f, ast.Name):
        if f.id in PASSING:
            if given:
                yield _row("edge", at, given, "f")
        else:
            scope = scope_of(node)
            yield _row("call", at, key(f) if scope is not top and f.id in scope.bound else f"{path}@{f.id}", given, flag=f.id != "replace")
    elif isinstance(f, ast.Attribute):
        yield _row("method", at, key(f.value), key(f.value) if f.attr in SAME else given)
    elif given:
        yield _row("edge", at, given, "f")
    if named == "replace" and given:
        yield _row("edge", at, given, "o")
    words = [k.arg for k in node.keywords if k.arg]
    open_end = False
    for i, a in enumerate(node.args):
        star = isinstance(a, ast.Starred)
        # Behind a first star nobody knows which parameter an argument is for.
        yield _row("arg", at, key(a.value if star else a), None, i, star, not open_end, named, len(node.args), words=words)
        open_end |= star
    for k in node.keywords:
        yield _row("arg", at, key(k.value), k.arg or "**", None, False, True, named, len(node.args), words=words)


#: What kinds of facts say of a node, and where they refer to other nodes (columns of FACTS).
_SAYS = {"import": (), "def": (), "class": (), "param": (), "attr": (2,), "method": (2, 3), "call": (2, 3)}
_REFERS = {"loop": 1, "arg": 2, "return": 2}


def _shortened(rows: list[tuple], path: str) -> Iterator[tuple]:
    """The facts without what nothing can lead to, and with edges led past nodes
    that only hand on, where that makes no more of them."""
    says: dict[str, list[tuple]] = {}
    out: dict[str, dict[str, tuple]] = {}
    into: dict[str, set[str]] = {}

    def led(node: str, to: str, f: float, o: float) -> None:
        """An edge by its cost for functions and for objects."""
        if node != to and min(f, o) < inf:
            before = out.setdefault(node, {}).get(to, (inf, inf))
            out[node][to] = min(before[0], f), min(before[1], o)
            into.setdefault(to, set()).add(node)

    # Names of the module can be imported; arguments and returns are met from other files.
    kept = set()
    for r in rows:
        if r[0] == "edge":
            led(r[1], r[2], inf if r[3] == "o" else r[10], inf if r[3] == "f" else r[10])
        elif r[0] in _SAYS:
            says.setdefault(r[1], []).append(r)
        elif r[_REFERS[r[0]]] is not None:
            kept.add(r[_REFERS[r[0]]])
    kept |= {n for n in (*out, *says) if n.startswith(f"{path}@")}
    ahead, met = list(kept), set(kept)
    while ahead:
        node = ahead.pop()
        asked = {r[i] for r in says.get(node, ()) for i in _SAYS[r[0]] if r[i] is not None}
        kept |= asked
        new = (asked | out.get(node, {}).keys()) - met
        met |= new
        ahead += new
    kept |= says.keys()
    for node in {*out, *into} - met:
        for to in out.pop(node, ()):
            into[to].discard(node)
    for node in sorted(met - kept):
        before, then = into.get(node, set()), out.get(node, {})
        if len(before) * len(then) <= len(before) + len(then):
            for to, (f, o) in then.items():
                into[to].discard(node)
                for at in before:
                    led(at, to, out[at][node][0] + f, out[at][node][1] + o)
            for at in before:
                del out[at][node]
            out.pop(node, None)
            into.pop(node, None)
    for r in rows:
        if r[0] != "edge" and (r[0] not in _SAYS or r[1] in met):
            yield r
    for node, ways in out.items():
        for to, (f, o) in ways.items():
            if to in says or out.get(to):
                for mode, cost in (("b", f),) if f == o else (("f", f), ("o", o)):
                    if cost < inf:
                        yield _row("edge", node, to, mode, cost=cost)


def facts(files: DataFrame) -> DataFrame:
    return parsed(files.where(F.col("path").endswith(".py")), lambda root, path, content: _shortened(list(_facts(root, path, content)), path), FACTS)


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.lower(p).isin(*TEST_FOLDERS))
    return folder | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def _linked(f: DataFrame, files: DataFrame) -> DataFrame:
    """root, node, to, first: what an imported name is in the file it comes from."""
    there = files.select("root", F.col("path").alias("to")).distinct()
    way = f.where("kind = 'import'").select("root", "node", "name", "first", F.posexplode(modules(F.col("path"), F.col("module"), F.col("level"))).alias("n", "to"))
    own = way.join(there, ["root", "to"]).groupBy("root", "node", "name", "first").agg(F.min_by("to", "n").alias("to"))
    return own.select("root", "node", F.concat_ws("@", "to", "name").alias("to"), "first")


def _meant(f: DataFrame, linked: DataFrame, depth: int) -> DataFrame:
    """root, node (a call), kind (def or class), other (the definition), closure:
    what calls by a name mean, import by import."""
    own = f.where("first and kind in ('def', 'class')").select("root", F.col("node").alias("at"), "kind", "other", F.col("flag").alias("closure"))
    way = linked.where("first").select("root", F.col("node").alias("at"), "to")
    now, found = f.where("kind = 'call'").select("root", "node", F.col("other").alias("at")), []
    for _ in range(depth):
        found.append(now.join(own, ["root", "at"]).select("root", "node", "kind", "other", "closure"))
        now = stored(now.join(way, ["root", "at"]).select("root", "node", F.col("to").alias("at")))
        if now.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _edges(f: DataFrame, linked: DataFrame, meant: DataFrame) -> DataFrame:
    """root, node, to, mode (f: for functions, o: for objects, b: both), cost."""
    one = F.lit(1).alias("cost")
    plain = f.where("kind = 'edge'").select("root", "node", F.col("other").alias("to"), F.col("name").alias("mode"), "cost")
    over = linked.select("root", "node", "to", F.lit("b").alias("mode"), one)
    call = f.where("kind = 'call'").select("root", "node", F.col("name").alias("given"), F.col("flag").alias("plain")).join(meant, ["root", "node"], "left")
    args = f.where("kind = 'arg'").select("root", "node", F.col("other").alias("to"))
    made = call.where("kind = 'class'").select("root", "node").join(args, ["root", "node"]).select("root", "node", "to", F.lit("f").alias("mode"), one)
    passed = call.where("given is not null and (kind is null or closure)").select("root", "node", F.col("given").alias("to"), F.lit("f").alias("mode"), one)
    back = f.where("kind = 'return'").select("root", F.col("node").alias("other"), F.col("other").alias("to"))
    mode = F.when(~F.col("plain"), "f").when(F.col("closure"), "o").otherwise("b")
    given = call.where("kind = 'def' and (plain or not closure)").select("root", "node", "other", mode.alias("mode")).join(back, ["root", "other"]).select("root", "node", "to", "mode", one)
    return plain.unionByName(over).unionByName(made).unionByName(passed).unionByName(given)


def loops(sites: DataFrame, f: DataFrame) -> DataFrame:
    """id, root, start: for sites (id, root, path, line, name) whose name is a loop's
    variable there, what the innermost such loop runs over."""
    held = f.where("kind = 'loop'").select("root", "path", "name", F.col("node").alias("start"), F.col("line").alias("begin"), F.col("pos").alias("end"), "ord")
    met = sites.select("id", "root", "path", "line", "name").join(held, ["root", "path", "name"]).where(F.col("line").between(F.col("begin"), F.col("end")))
    return met.groupBy("id", "root").agg(F.max_by("start", F.struct("begin", -F.col("ord"))).alias("start"))


def _followed(rows: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    """Rows, and where one more edge leads from them.  ways: root, node, ways."""
    fits = lambda w: (F.col("depth") + w["cost"] <= depth) & w["mode"].isin("b", F.col("mode")) if "mode" in rows.columns else F.col("depth") + w["cost"] <= depth
    there = F.transform(F.filter("ways", fits), lambda w: F.struct(w["to"].alias("to"), w["cost"].alias("cost")))
    own = F.array(F.struct(F.col("node").alias("to"), F.lit(0).alias("cost")))
    met = rows.join(ways, ["root", "node"], "left").withColumn("way", F.explode(F.when(F.col("ways").isNull(), own).otherwise(F.concat(own, there))))
    key = [c for c in rows.columns if c not in ("node", "depth")]
    return met.select(*key, F.col("way.to").alias("node"), (F.col("depth") + F.col("way.cost")).alias("depth")).groupBy(*key, "node").agg(F.min("depth").alias("depth"))


class _Rounds:
    """The rows of a fixpoint, in one folder with a partition for each round."""

    KEY = ("root", "start", "node")
    ROWS = "root string, start string, node string, depth int"

    def __init__(self, spark, depth: int):
        self.spark, self.depth, self.step = spark, depth, -1
        self.path = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"

    def _rows(self, upto: int) -> DataFrame:
        rows = self.spark.read.schema(f"{self.ROWS}, step int").option("basePath", self.path).parquet(self.path)
        return rows.where(F.col("step") <= upto).hint("merge")

    def _told(self, rows: DataFrame) -> DataFrame:
        return rows

    def _keep(self, rows: DataFrame) -> bool:
        """Writes what is new, or new at its depth; whether there is any."""
        rows = rows.where(F.col("depth") <= self.depth).groupBy(*self.KEY).agg(F.min("depth").alias("depth"))
        if self.step >= 0:
            old = self._rows(self.step).groupBy(*self.KEY).agg(F.min("depth").alias("before"))
            rows = rows.join(old, list(self.KEY), "left").where("before is null or depth < before").drop("before")
        self.step += 1
        path = f"{self.path}/step={self.step}"
        self._told(rows).write.option("compression", "zstd").parquet(path)
        return not self.spark.read.schema(self.ROWS).parquet(path).isEmpty()

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """The rows of the last round, and those before."""
        return self._rows(self.step).where(F.col("step") == self.step).drop("step"), self._rows(self.step - 1).drop("step")


class _Walk(_Rounds):
    """What any start leads to, by node.  Rows carry what a node asks for: kind,
    base and field of a dot, and whether it constructs an object (made).  Questions
    for objects (mode o) know their start, the base; where functions are looked for
    (mode f) all starts of a root are one, as what a node leads to is the same for each."""

    KEY = ("root", "mode", "start", "node")
    ROWS = "root string, mode string, start string, node string, depth int, kind string, base string, field string, made boolean"

    def __init__(self, f: DataFrame, files: DataFrame, depth: int):
        super().__init__(f.sparkSession, depth)
        linked = stored(_linked(f, files))
        meant = stored(_meant(f, linked, depth))
        self.edges = stored(_edges(f, linked, meant).groupBy("root", "node").agg(F.collect_set(F.struct("to", "mode", "cost")).alias("ways")))
        waits = f.where("kind in ('attr', 'method')").select("root", "node", "kind", F.col("other").alias("base"), F.col("name").alias("field"))
        made = meant.where("kind = 'class'").select("root", "node", F.lit(True).alias("made")).distinct()
        self.nodes = stored(waits.join(made, ["root", "node"], "full").withColumn("made", F.coalesce("made", F.lit(False))))
        self.params = stored(f.where("kind = 'param'").select("root", "node", F.col("name").alias("param"), "pos", F.col("module").alias("callee")))
        args = f.where("kind = 'arg'")
        # Calls in test files and vendored folders pass nothing on.
        own = args.where(~is_test(F.col("path")) & ~in_skipped_dir(F.col("path")))
        self.given = stored(own.select("root", F.col("module").alias("callee"), F.col("other").alias("to"), "name", F.col("pos").alias("at"), "flag", "first", "words"))
        self.args = stored(args.select("root", F.col("node").alias("object"), F.col("other").alias("to"), "name", "level", "words"))
        self.tables = [linked, meant, self.edges, self.nodes, self.params, self.given, self.args]

    def _told(self, rows: DataFrame) -> DataFrame:
        made = F.coalesce("made", F.lit(False)).alias("made")
        return rows.join(self.nodes, ["root", "node"], "left").select(*self.KEY, "depth", "kind", "base", "field", made)

    @staticmethod
    def _asked(rows: DataFrame) -> DataFrame:
        return rows.where("kind = 'attr' or (kind = 'method' and mode = 'f')")

    @staticmethod
    def _objects(rows: DataFrame) -> DataFrame:
        return rows.where("mode = 'o' and made").select("root", F.col("start").alias("base"), F.col("node").alias("object")).distinct()

    def _called(self, rows: DataFrame) -> DataFrame:
        """What calls give for the parameters among the rows' nodes, as ``to``."""
        met = rows.join(self.params, ["root", "node"]).join(self.given, ["root", "callee"])
        placed = F.when(F.col("flag"), F.col("at") <= F.col("pos")).otherwise(F.col("at") == F.col("pos")) & F.col("first") & ~F.array_contains("words", F.col("param"))
        return met.where(F.when(F.col("name").isNotNull(), F.col("name") == F.col("param")).otherwise(placed)).select(*rows.columns, "to")

    def _held(self, asked: DataFrame, objects: DataFrame) -> DataFrame:
        """What an object holds, as ``to``: in a field its argument of that name,
        else, for functions and if some have no name, any; behind a method any."""
        met = asked.join(objects, ["root", "base"]).join(self.args, ["root", "object"])
        lost = (F.col("mode") == "f") & (F.col("level") > 0) & ~F.array_contains("words", F.col("field"))
        fits = (F.col("kind") == "method") | F.coalesce(F.col("name") == F.col("field"), F.lit(False)) | lost
        return met.where(fits).select(*asked.columns, "to")

    def _lone(self, upto: int) -> DataFrame:
        """Methods before whose dot no object stands, with their first argument as ``to``."""
        rows = self._rows(upto).drop("step")
        methods = rows.where("kind = 'method' and mode = 'f' and field is not null").withColumn("to", F.col("field"))
        return methods.join(self._objects(rows).select("root", "base").distinct(), ["root", "base"], "left_anti")

    @staticmethod
    def _next(rows: DataFrame, node: str = "to", start: str = "start", mode: Column | str = "mode") -> DataFrame:
        return rows.select("root", F.col(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), F.col(start).alias("start"), F.col(node).alias("node"), (F.col("depth") + 1).alias("depth"))

    def _onward(self) -> DataFrame:
        """What the rows of the last round lead to: calls, questions and answers, and
        from there several edges, as a round costs more than an edge."""
        new, old = self._split()
        asked = self._asked(new)
        questions = self._next(asked, "base", "base", F.lit("o"))
        fresh = self._held(asked, self._objects(old))
        again = self._held(self._asked(old).unionByName(asked), self._objects(new))
        now = new.select(*self.KEY, "depth").unionByName(questions)
        for more in (self._called(new), fresh, again):
            now = now.unionByName(self._next(more))
        for _ in range(AT_ONCE):
            now = _followed(now, self.edges, self.depth)
        return now

    def links(self, starts: DataFrame) -> DataFrame:
        """root, node, to, cost: all steps that a walk from these starts can take."""
        some, rests = self._keep(starts.select("root", F.lit("f").alias("mode"), F.lit("").alias("start"), F.col("start").alias("node"), F.lit(0).alias("depth"))), []
        while some:
            while some:
                some = self._keep(self._onward())
            # Where nothing is constructed before a dot is known once all is at rest.
            rests.append(self.step)
            some = self._keep(self._next(self._lone(self.step)))
        rows = self._rows(self.step).drop("step")
        met = rows.where("mode = 'f'").dropDuplicates(["root", "node"])
        edges = met.join(self.edges, ["root", "node"]).select("root", "node", F.inline("ways")).where("mode in ('b', 'f')").select("root", "node", "to", "cost")
        for more in (self._called(met), self._held(self._asked(met), self._objects(rows)), *map(self._lone, rests)):
            edges = edges.unionByName(more.select("root", "node", "to", F.lit(1).alias("cost")))
        return edges.where("node <> to").groupBy("root", "node", "to").agg(F.min("cost").alias("cost"))


def _direct(links: DataFrame, kept: DataFrame, depth: int) -> DataFrame:
    """links led past all nodes but those kept (root, node) that lead to one other alone."""
    one = links.groupBy("root", "node").agg(F.count("*").alias("n"), F.first("to").alias("to"), F.first("cost").alias("cost")).where("n = 1")
    way, moved = stored(one.join(kept, ["root", "node"], "left_anti").select("root", "node", "to", "cost")), True
    ahead = lambda t: t.select("root", F.col("node").alias("to"), F.col("to").alias("then"), F.col("cost").alias("more"))
    led = lambda t, by: t.join(ahead(by), ["root", "to"], "left").select("root", "node", F.coalesce("then", "to").alias("to"), (F.col("cost") + F.coalesce("more", F.lit(0))).alias("cost"), F.col("then").isNotNull().alias("moved")).where((F.col("cost") <= depth) & (F.col("node") != F.col("to")))
    tables = [way]
    # Each time a way reaches twice as far; a step without cost is followed by one that has some.
    for _ in range((2 * depth + 2).bit_length()):
        further = stored(led(way, way))
        tables.append(further)
        way, moved = further.drop("moved"), not further.where("moved").isEmpty()
        if not moved:
            break
    out = led(links.join(tables[0].select("root", "node"), ["root", "node"], "left_anti"), way).drop("moved")
    if moved:
        out = out.unionByName(links.join(tables[0].select("root", "node"), ["root", "node"], "left_semi"))
    done = stored(out.groupBy("root", "node", "to").agg(F.min("cost").alias("cost")))
    for table in tables:
        dropped(table)
    return done


class _Paths(_Rounds):
    """Which ends each start leads to."""

    def reached(self, links: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
        """root, start, node: the ends (root, node) that lie within the depth of starts (root, start)."""
        first = starts.select("root", "start", F.col("start").alias("node"), F.lit(0).alias("depth"))
        direct = _direct(links, first.select("root", "node").unionByName(ends).distinct(), self.depth)
        going = direct.select("root", F.col("node").alias("to")).distinct()
        # What leads nowhere else is met once, at the end.
        ways = stored(direct.join(going, ["root", "to"], "left_semi").groupBy("root", "node").agg(F.collect_list(F.struct("to", "cost")).alias("ways")))
        some = self._keep(first)
        while some:
            now, _ = self._split()
            for _ in range(AT_ONCE):
                now = _followed(now, ways, self.depth)
            some = self._keep(now)
        rows = self._rows(self.step).drop("step")
        last = direct.join(going, ["root", "to"], "left_anti").join(ends.withColumnRenamed("node", "to"), ["root", "to"], "left_semi")
        met = rows.join(last, ["root", "node"]).where(F.col("depth") + F.col("cost") <= self.depth).select("root", "start", F.col("to").alias("node"))
        done = stored(met.unionByName(rows.select(*self.KEY).join(ends, ["root", "node"], "left_semi").select("root", "start", "node")).distinct())
        for table in (direct, ways):
            dropped(table)
        removed(self.spark, self.path)
        return done


def registered(sites: DataFrame, files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, path, name, line: the functions that loops register, for sites (id, root,
    path, line, name); nulls for a loop that leads to none, and no row where the
    name is no loop's variable.  files: root, path, content.

    Defined results: a file that doesn't parse has no facts.  Functions in test
    files don't count, nor do calls there.  Expressions are read in their own scope;
    of several definitions of a name a call means the last."""
    f = stored(facts(files))
    at = stored(loops(sites, f))
    starts = at.select("root", "start").distinct()
    walk = _Walk(f, files, depth)
    links = stored(walk.links(starts))
    defined = f.where((F.col("kind") == "def") & (F.col("pos") == 1) & ~is_test(F.col("path"))).select("root", "node", "path", "name", "line")
    reached = _Paths(walk.spark, depth).reached(links, starts, defined.select("root", "node").distinct())
    found = at.join(reached, ["root", "start"]).join(defined, ["root", "node"]).select("id", "path", "name", "line").distinct()
    done = stored(at.select("id").join(found, "id", "left"))
    for table in (*walk.tables, links, reached, f, at):
        dropped(table)
    removed(walk.spark, walk.path)
    return done


# How a registration that may stand in a loop says it was found.
REGISTRATIONS = ("add_tool(", "register_tool(", "register_function(", "from_function(")


def expanded(tools: DataFrame, files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tools (id, root, path, line, name, via) with a row for each function that a
    loop registers in place of the loop variable's; reported_path and reported_line
    say where that was.  A loop that leads to no function goes; all others stay."""
    may = (F.col("line") > 0) & F.col("path").endswith(".py") & F.col("via").rlike("^(" + "|".join(p.replace("(", r"\(") for p in REGISTRATIONS) + ")")
    found = registered(tools.where(may), files, depth).toDF("id", "to", "called", "at").withColumn("loop", F.lit(True))
    met = tools.join(found, "id", "left").where("loop is null or to is not null")
    moved = lambda new, old: F.when(F.col("loop"), F.col(new)).otherwise(F.col(old)).alias(old)
    return met.select("id", "root", moved("to", "path"), moved("at", "line"), moved("called", "name"), "via", F.when(F.col("loop"), F.col("path")).alias("reported_path"), F.when(F.col("loop"), F.col("line")).alias("reported_line"))
