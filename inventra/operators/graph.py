"""Walks over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inventra.operators.spans import first_around
from inventra.tables import stored


def callers_within(calls: DataFrame, starts: DataFrame, hops: int = 4) -> DataFrame:
    """Functions from which a start is reached in at most ``hops`` calls, with
    the least distance: (start, caller, distance).  Calls of oneself are left
    out.  Hops are unrolled, each on pairs not met before, so a cycle ends."""
    edges = calls.where("caller <> callee").select("caller", "callee").distinct()
    frontier = starts.select(F.col("name").alias("start"), F.col("name").alias("at"), F.lit(0).alias("distance")).distinct()
    seen = frontier
    for d in range(1, hops + 1):
        step = frontier.join(edges, frontier["at"] == edges["callee"]).select("start", F.col("caller").alias("at"), F.lit(d).alias("distance")).distinct()
        frontier = step.join(seen.select("start", "at"), ["start", "at"], "left_anti").select("start", "at", "distance")
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0").select("start", F.col("at").alias("caller"), "distance")


def workflows(points: DataFrame, functions: DataFrame, calls: DataFrame, hops: int = 4, most: int = 10) -> DataFrame:
    """The function around each point (id, file_path, line) and those from which it
    is reached in at most ``hops`` calls, ``most`` in all: id, position, distance,
    function_id, qualname, file_path, line, parameters, child (whom it calls), and
    line and arguments of its first such call.

    functions: function_id, qualname, file_path, start_line, end_line, parameters;
    calls: caller, callee, line, arguments, ord.  Of functions around each other the
    outer one counts.  Callers come in order of whom they call, then by file, line
    and id; those beyond ``most`` aren't walked from.  Each round keeps so many rows
    for a point by rank, a rank that Spark limits before it deals out the rows."""
    first = calls.where("caller <> callee").groupBy("caller", "callee").agg(F.min_by(F.struct("line", "arguments"), "ord").alias("call"))
    known = functions.select(F.col("function_id").alias("caller"), F.struct("file_path", "start_line").alias("place"))
    edges = first.join(known, "caller")
    around = first_around(points.withColumnRenamed("line", "at"), functions, ["file_path"], "at", "start_line", "end_line", [F.col("start_line"), F.col("end_line"), F.col("function_id")], ["function_id"], ["id"])
    none = lambda c: F.lit(None).cast(dict(calls.dtypes)[c])
    frontier = stored(around.select("id", F.col("found.function_id").alias("function_id"), F.lit(0).alias("distance"), none("callee").alias("child"), F.struct(none("line").alias("line"), none("arguments").alias("arguments")).alias("call"), F.lit(1).alias("position")))
    seen = frontier
    for distance in range(1, hops + 1):
        step = frontier.select("id", F.col("function_id").alias("callee"), F.col("position").alias("from")).join(edges, "callee")
        fresh = step.join(seen.select("id", F.col("function_id").alias("caller")), ["id", "caller"], "left_anti")
        # A caller of several counts for the one that was met first.
        own = fresh.groupBy("id", "caller", "place").agg(F.min_by(F.struct("from", "callee", "call"), "from").alias("m"))
        counts = seen.groupBy("id").agg(F.count("*").cast("int").alias("n"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("m.from", "place", "caller"))
        ranked = own.withColumn("rank", rank).where(F.col("rank") <= most).join(counts, "id").withColumn("position", F.col("n") + F.col("rank")).where(F.col("position") <= most)
        # Written down, as each round reads the rounds before it twice.
        frontier = stored(ranked.select("id", F.col("caller").alias("function_id"), F.lit(distance).alias("distance"), F.col("m.callee").alias("child"), "m.call", "position"))
        seen = seen.unionByName(frontier)
    about = functions.select("function_id", "qualname", "file_path", F.col("start_line").alias("line"), "parameters")
    return seen.join(about, "function_id").select("id", "position", "distance", "function_id", "qualname", "file_path", "line", "parameters", "child", F.col("call.line").alias("call_line"), F.col("call.arguments").alias("call_arguments"))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The callee of each call: a function of the same file, a method of the
    same class, the last two segments, the whole name; the first that is known,
    else the first candidate."""
    parts = F.split("name", r"\.")
    last = F.element_at(parts, -1)
    candidates = F.array(F.concat_ws(".", "module", last), F.concat_ws(".", "module", "class", last), F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))), F.col("name"))
    each = calls.select("call_id", F.posexplode(candidates).alias("rank", "candidate"))
    known = each.join(functions.select(F.col("qualname").alias("candidate"), F.lit(0).alias("unknown")), "candidate", "left")
    return known.groupBy("call_id").agg(F.min_by("candidate", F.struct(F.coalesce("unknown", F.lit(1)), "rank")).alias("callee"))


def payload(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends present."""
    ids = components.select("instance_id")
    return edges.join(ids, edges.source_instance_id == ids.instance_id, "left_semi").join(ids, edges.target_instance_id == ids.instance_id, "left_semi")
