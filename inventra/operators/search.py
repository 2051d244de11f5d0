"""Ad-hoc queries over files: searches, definitions, snippets and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inventra.functions.text import canonical_source

MOST_BYTES, MOST_MATCHES, CONTEXT = 1_000_000, 100, 200


def search_lines(files: DataFrame, pattern: str, keys: list[str], literal: bool = False, content: str = "content") -> DataFrame:
    """Lines that a pattern matches, with their number from 1; context cut to
    ``CONTEXT``.  The filter on the whole text comes first, so files without a
    match are never split."""
    hit = (lambda c: F.lower(c).contains(pattern.lower())) if literal else (lambda c: c.rlike(pattern))
    whole = hit(F.col(content)) if literal else F.col(content).rlike(f"(?m){pattern}")
    lines = files.where(whole).select(*keys, F.posexplode(F.split(content, "\n")).alias("_i", "_l"))
    return lines.where(hit(F.col("_l"))).select(*keys, (F.col("_i") + 1).cast("long").alias("line"), F.substring("_l", 1, CONTEXT).alias("context"))


def search_codebase(files: DataFrame, pattern: str, literal: bool = False, most: int = MOST_MATCHES) -> DataFrame:
    """The first matches in order of path and line, of files that aren't too
    large or binary, and whether there are more."""
    own = files.where((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(r"(?i)\.(png|jpg|gif|zip|so|pyc)$"))
    found = search_lines(own, pattern if literal else f"(?i){pattern}", ["path"], literal).orderBy("path", "line").limit(most + 1)
    # A window over one row more than is asked for at most.
    place, whole = Window.orderBy("path", "line"), Window.partitionBy()
    numbered = found.select("path", "line", "context", F.row_number().over(place).alias("_n"), (F.count("*").over(whole) > most).alias("truncated"))
    return numbered.where(F.col("_n") <= most).drop("_n")


def definitions(files: DataFrame, var: str) -> DataFrame:
    """Where configuration defines a variable, the first and its alternates by place."""
    value = F.regexp_extract("context", r"^[^:=]*[:=]\s*(.*?)\s*$", 1)
    return search_lines(files, rf"^\s*(export\s+)?{var}\s*[:=]", ["path"]).select("path", "line", F.regexp_replace(value, "^[\"']|[\"']$", "").alias("value"))


def snippet(files: DataFrame, path: str, first: int) -> DataFrame:
    return files.where(F.col("path") == path).select("path", F.concat_ws("\n", F.slice(F.split("content", "\n"), 1, first)).alias("snippet"))


def directory_tree(files: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """Directories and files down to a depth, in order of path."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).alias("entry")).distinct().orderBy("entry").limit(most)


def by_prefix(entries: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """The entry of an id, else of a prefix that only one has; two or more are
    ambiguous and raise."""
    exact = entries.where(F.col(key) == prefix)
    if not exact.isEmpty():
        return exact
    found = entries.where(F.col(key).startswith(prefix))
    if found.limit(2).count() > 1:
        raise ValueError(f"{prefix} is ambiguous")
    return found


def across_roots(env: DataFrame, packages: DataFrame) -> DataFrame:
    """Names defined, and packages named, under more than one root."""
    e = env.groupBy("name").agg(F.countDistinct("root").alias("roots"), F.count("*").alias("n")).withColumn("kind", F.lit("env"))
    p = packages.groupBy("name").agg(F.countDistinct("root").alias("roots"), F.count("*").alias("n")).withColumn("kind", F.lit("package"))
    return e.unionByName(p).where("roots > 1")


def with_alternates(env: DataFrame, most: int = 7) -> DataFrame:
    """The first definition of each name with up to ``most`` others in order.
    Only so many rows a name are gathered, by rank before the shuffle's end."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    near = env.withColumn("_r", rank).where(F.col("_r") <= most + 1)
    held = near.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("_h"))
    return held.select("name", F.col("_h")[0]["value"].alias("value"), F.transform(F.slice("_h", 2, most), lambda x: x["value"]).alias("alternates"))


def model_info(registry_rows: DataFrame, model: str) -> DataFrame:
    """What the registry says of one model; no row for what it doesn't know."""
    return registry_rows.where((F.col("model") == model) & F.col("source").isNotNull())


def data_flow(files: DataFrame, path: str, symbol: str) -> DataFrame:
    """Right-hand sides of a symbol's assignments and arguments in a file, with
    their line, the string that one is, and the variable that one reads."""
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("_i", "_l"))
    side = F.regexp_extract("_l", rf"\b{symbol}\s*=\s*([^=].*?)\s*$", 1)
    text = F.regexp_extract(side, "^[\"']([^\"']*)[\"']", 1)
    env = F.regexp_extract(side, r"(?:getenv\(|environ\.get\(|environ\[)\s*[\"'](\w+)[\"']", 1)
    return lines.select((F.col("_i") + 1).alias("line"), side.alias("rhs"), F.nullif(text, F.lit("")).alias("literal"), F.nullif(env, F.lit("")).alias("env")).where("rhs <> ''")


def search_text(files: DataFrame, pattern: str, most: int = MOST_MATCHES) -> DataFrame:
    """As ``search_codebase`` for patterns over line ends: matches in whole texts,
    without case, by the line on which they begin."""
    import re

    import pyarrow as pa

    compiled = re.compile(pattern, re.I | re.M)
    own = files.where((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(r"(?i)\.(png|jpg|gif|zip|so|pyc)$"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                for m in compiled.finditer(text or ""):
                    begin = text.rfind("\n", 0, m.start()) + 1
                    rows.append((path, text.count("\n", 0, m.start()) + 1, m[0][:CONTEXT], text[begin : begin + CONTEXT].split("\n")[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "line", "match", "context"])

    return own.select("path", "content").mapInArrow(run, "path string, line long, match string, context string").orderBy("path", "line").limit(most)


def payloads(c: DataFrame, sources: DataFrame) -> DataFrame:
    """One report per source: how many assets of which types, and its canonical
    reference by kind."""
    sums = c.groupBy("source").agg(F.count("*").alias("assets"), F.array_sort(F.collect_set("component_type")).alias("kinds"))
    return sums.join(sources.select("source", canonical_source(F.col("ref"), F.col("kind")).alias("source_ref_canonical")), "source")


def package_info(asked: DataFrame, info: DataFrame) -> DataFrame:
    """What a table of packages says of those that are asked for."""
    return asked.join(info, ["ecosystem", "name"])


def verified(table: DataFrame, rows: int, digest: str) -> DataFrame:
    """One row: whether a table has as many rows as its manifest says, and the
    digest: the sum of its rows' checksums, whatever their order."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct(*table.columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = table.agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.sum(each), F.lit(0)).cast("string"), 256).alias("digest"))
    return sums.select((F.col("n_rows") == rows).alias("rows_match"), (F.col("digest") == digest).alias("hash_match"), "n_rows", "digest")
