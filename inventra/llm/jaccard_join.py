"""N-gram Jaccard join: documents linked by word shingles, and the components.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
of distinct ``k``-word shingles.  The result is exact (up to 64-bit hashes of
shingles), at every size of group.

1. Blocks ask how many of a document's shingles occur nowhere else.  A set of
   ``n`` shingles needs an overlap of ``T = ceil(percent * n / 100)`` with any
   partner, so a document with more than ``n - T`` shingles of its own has none
   and is done: most documents end here.
2. Equal sets collapse to their smallest id.
3. Shingles of the rest are counted; in order of rising count, a partner must
   hold one of a document's first ``n - T + 1``, its short lists.  Short lists
   are rows (shingle, document) from here on, an inverted index in one table.
4. Each document is compared with one leader, the smallest of those of about its
   size with which it shares most short lists.  What links makes clusters: a
   large group of near copies costs one comparison a document.
5. What meets in short lists of more than one cluster is searched in blocks of
   bounded size, all but the largest cluster's documents against all, by
   DivideSkip: of the inverted lists of a document's shingles the ``L`` longest
   are set aside, the others merged on a heap that skips ahead, and ids met at
   least ``T - L`` times are looked up in the long ones by bisection.  Partners
   already in the same cluster aren't looked up.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing.  A row without doc_id keeps its row, with component
null.  Rows that share a doc_id are one document with several texts: each links
on its own, and they share a component.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.llm import blocks as B
from inventra.llm.components import components
from inventra.llm.tables import stored
from inventra.llm.words import U, shingles

#: Documents that a block of the search has as index, and as queries, at most.
CELL = 1024
#: The weight of a long list's lookups against the merge, as published.
MU = 0.0085
#: Parts that the rows of a shingle, or a text's copies, are dealt into where they
#: are joined, as bits of a mask.
SALTS = 64
_LOW = U(0xFFFFFFFF)
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SHORT = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("short", pa.binary())])


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def _runs(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))


def _spread(block: int, token: np.ndarray, first: np.ndarray, n_buckets: int):
    """The block's tokens as rows for the buckets: low halves, and by document how many."""
    order, cuts = B.by_bucket((token >> U(32)) % U(n_buckets))
    low, owner = (token & _LOW).astype(np.uint32)[order], _runs(first)[order]
    for bucket, a, b in cuts:
        own = owner[a:b]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        yield bucket, block, 0, B.pack(low[a:b], own[at], np.diff(np.append(at, b - a)).astype(np.uint32))


def _counts(parts: list[tuple[int, bytes]]) -> tuple[list, np.ndarray]:
    """The unpacked rows of a bucket, and how often each of their tokens occurs in all."""
    got = [(block, *B.unpack(p)) for block, p in parts]
    low = np.concatenate([g[1] for g in got])
    order = np.argsort(low)
    held = low[order]
    cut = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    count = np.empty(len(low), np.uint32)
    count[order] = np.repeat(np.diff(np.append(cut, len(low))), np.diff(np.append(cut, len(low))))
    return got, count


def _first_ask(k: int, n_buckets: int):
    def ask(block: int, table: pa.Table):
        _, texts = B.docs_of(table)
        token, first = shingles(texts, k)
        sig = b"".join(hashlib.blake2b(token[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        yield block % n_buckets, block, 9, B.pack(np.diff(first), np.frombuffer(sig, np.uint8))
        yield from _spread(block, token, first, n_buckets)

    return ask


def _alone(parts):
    """Of each block's documents, how many of their tokens in this bucket occur nowhere else."""
    got, count = _counts(parts)
    at = 0
    for block, low, doc, many in got:
        own = np.add.reduceat((count[at : at + len(low)] == 1).astype(np.int64), np.cumsum(many, dtype=np.int64) - many)
        at += len(low)
        yield block, 1, B.pack(doc[own > 0], own[own > 0].astype(np.uint32))


def _first_finish(k: int, percent: int):
    def finish(table: pa.Table, parts):
        ids, texts = B.docs_of(table)
        size = sig = None
        alone = np.zeros(len(ids), np.int64)
        for _, kind, part in parts:
            a, b = B.unpack(part)
            if kind == 9:
                size, sig = a, b.tobytes()
            else:
                alone[a] += b.astype(np.int64)
        alive = np.flatnonzero((size > 0) & (size - needed(size, percent) + 1 > alone))
        tokens: list = [None] * len(ids)
        token, first = shingles([texts[i] for i in alive], k)
        for j, i in enumerate(alive.tolist()):
            if ids[i] is not None:
                tokens[i] = token[first[j] : first[j + 1]].tobytes()
        return ids, size.tolist(), [sig[16 * i : 16 * i + 16] for i in range(len(ids))], tokens

    return finish


def _sets(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids, tokens and bounds of a block of distinct sets, in order of id."""
    ids, raw = B.docs_of(table)
    first = np.cumsum([0, *(len(r) // 8 for r in raw)])
    return ids, np.frombuffer(b"".join(raw), U), first


def _second_ask(n_buckets: int):
    def ask(block: int, table: pa.Table):
        _, token, first = _sets(table)
        yield from _spread(block, token, first, n_buckets)

    return ask


def _frequency(parts):
    """The count of each token, as the block listed them."""
    got, count = _counts(parts)
    at = 0
    for block, low, _, _ in got:
        yield block, 1, B.pack(np.minimum(count[at : at + len(low)], 65535).astype(np.uint16))
        at += len(low)


def _short_lists(percent: int, n_buckets: int):
    """Each set's size and its first ``n - T + 1`` shingles in order of count,
    without those that no other set holds."""

    def finish(table: pa.Table, parts):
        ids, token, first = _sets(table)
        order, cuts = B.by_bucket((token >> U(32)) % U(n_buckets))
        answers = {bucket: part for bucket, _, part in parts}
        count = np.empty(len(token), np.uint16)
        for bucket, a, b in cuts:
            count[order[a:b]] = B.unpack(answers[bucket])[0]
        size = np.diff(first)
        short = size - needed(size, percent) + 1
        kept = []
        for i in range(len(ids)):
            a, b = first[i], first[i + 1]
            at = np.lexsort((token[a:b], count[a:b]))[: short[i]]
            kept.append(token[a:b][at[count[a:b][at] > 1]].tobytes())
        return ids, size.tolist(), kept

    return finish


def _postings(batches):
    """Rows (token, rep, n), one for each short list of a set."""
    for batch in batches:
        raw = batch["short"].to_pylist()
        many = [len(r) // 8 for r in raw]
        token = np.frombuffer(b"".join(raw), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch["rep"].to_numpy(), many)), pa.array(np.repeat(batch["n"].to_numpy(), many))], names=["token", "rep", "n"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many of ``a`` are in ``b``, by binary probes; both are in order."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _compared(percent: int):
    """Edges of the pairs (a, b, their tokens) that are linked."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch["tokens_a"], batch["tokens_b"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("a", "b")], schema=_EDGES)

    return run


class Union:
    """Disjoint sets of 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def merged(lists: list[list[int]], least: int):
    """(id, how often it occurs) of the ids in ``least`` or more of the sorted
    lists, in order, by a heap that skips: what stands below the place that could
    still reach ``least`` is passed over by bisection."""
    heap = [(held[0], k, 0) for k, held in enumerate(lists) if held]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            ahead = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            ahead = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], ahead, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


def divide_skip(query: list[int], index: dict[int, list[int]], sizes: list[int], percent: int, done=None):
    """Places in the index that are linked with a query's tokens; ``done`` says
    of a place that it needn't be known."""
    n, need = len(query), -(-percent * len(query) // 100)
    lists = sorted((held for held in map(index.get, query) if held), key=len)
    if len(lists) < need:
        return
    aside = min(need - 1, int(need / (MU * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for y, times in merged(short, need - aside):
        m = sizes[y]
        if 100 * n < percent * m or 100 * m < percent * n or (done and done(y)):
            continue
        least = -(-percent * (n + m) // (100 + percent))
        left = len(long)
        for held in reversed(long):
            if times + left < least:
                break
            at = bisect_left(held, y)
            times += at < len(held) and held[at] == y
            left -= 1
        if times >= least:
            yield y


def _search(percent: int):
    """Edges from the queries of a block to what its index has linked with them."""

    def block(rows) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        ids = sorted({r[0] for r in rows})
        place = {i: k for k, i in enumerate(ids)}
        union, first = Union(len(ids)), {}
        for i, _, _, cluster, _ in rows:
            union.join(place[i], first.setdefault(cluster, place[i]))
        held = [(place[i], np.frombuffer(t, U).tolist()) for i, indexed, _, _, t in rows if indexed]
        index: dict[int, list[int]] = {}
        for k, (_, tokens) in enumerate(held):
            for t in tokens:
                index.setdefault(t, []).append(k)
        sizes, out = [len(t) for _, t in held], []
        for i, _, query, _, raw in rows:
            if query:
                x = place[i]
                for y in divide_skip(np.frombuffer(raw, U).tolist(), index, sizes, percent, lambda y: union.find(held[y][0]) == union.find(x)):
                    if union.find(held[y][0]) != union.find(x):
                        union.join(x, held[y][0])
                        out.append((i, ids[held[y][0]]))
        return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], schema=_EDGES)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("label", "ci", "cj", "rep", "indexed", "query", "cluster", "tokens"))
            for label, ci, cj, *row in zip(*columns, strict=True):
                if (label, ci, cj) != key:
                    if rows:
                        yield block(rows)
                    key, rows = (label, ci, cj), []
                rows.append(row)
        if rows:
            yield block(rows)

    return run


def _told(rows: DataFrame, keys: list[str], found: dict[str, Column], where: str) -> DataFrame:
    """Rows with ``found`` (aggregates by ``keys``) of their keys, where ``where``
    holds of those.  A key's rows are never in one task: they are aggregated
    before they are shuffled, and joined by parts; only the parts that a key has
    are told."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("_mask")
    whole = salted.groupBy(*keys).agg(*(c.alias(name) for name, c in found.items()), mask).where(where)
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("_mask", i) == 1)
    return salted.join(whole.select(*keys, *found, F.explode(parts).alias("salt")), [*keys, "salt"]).drop("salt")


def _met(postings: DataFrame, sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """Edges of the documents that meet in ``postings`` (token, rep, cluster):
    neighbourhoods of lists that share documents, each searched in blocks of an
    index cell and a chunk of queries."""
    least = _told(postings, ["token"], {"b": F.min("rep")}, "true")
    hood = components(least.select(F.col("rep").alias("a"), "b").distinct())
    docs = postings.select("rep", "cluster").distinct().join(hood.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("root", "rep").alias("label"))
    clusters = docs.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    shape = clusters.groupBy("label").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("largest")).where("all > largest")
    docs = docs.join(shape, "label").withColumn("query", F.col("cluster") != F.col("top"))
    docs = docs.withColumn("cells", F.ceil(F.col("all") / cell).cast("int")).withColumn("chunks", F.ceil((F.col("all") - F.col("largest")) / cell).cast("int"))
    # In a neighbourhood of one block a document comes once, as both.
    whole = F.col("cells") == 1
    index = docs.select("rep", "cluster", "label", F.lit(True).alias("indexed"), (whole & F.col("query")).alias("query"), F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int").alias("ci"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("cj"))
    queries = docs.where(F.col("query") & ~whole).select("rep", "cluster", "label", F.lit(False).alias("indexed"), "query", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("ci"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int").alias("cj"))
    rows = index.unionByName(queries).join(sets.select("rep", "tokens"), "rep").select("label", "ci", "cj", "rep", "indexed", "query", "cluster", "tokens")
    return rows.repartition("label", "ci", "cj").sortWithinPartitions("label", "ci", "cj").mapInArrow(_search(percent), "a long, b long")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, block_bytes: int = B.BLOCK_BYTES, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``df``."""
    n = B.pieces(B.total_bytes(df, text), block_bytes)
    docs = B.dealt(df, doc_id, text, n)
    alone = B.answered(B.asked(docs, _first_ask(k, n), n), _alone, n)
    found = stored(B.met(docs, alone, _first_finish(k, percent), "doc_id long, n_shingles long, sig binary, tokens binary", _FOUND))

    alive = found.where("tokens is not null")
    sets = stored(alive.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")))
    m = B.pieces(B.total_bytes(sets, "tokens"), block_bytes)
    dealt = B.dealt(sets, "rep", "tokens", m)
    counted = B.answered(B.asked(dealt, _second_ask(m), m), _frequency, m)
    short = stored(B.met(dealt, counted, _short_lists(percent, m), "rep long, n long, short binary", _SHORT))
    postings = short.mapInArrow(_postings, "token long, rep long, n long")

    def compared(pairs: DataFrame) -> DataFrame:
        own = sets.select("rep", "tokens")
        both = pairs.join(own.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_compared(percent), "a long, b long")

    band = postings.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))) if percent < 100 else F.col("n"))
    lead = band.groupBy("token", "band").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b < other").drop("other")
    pairs = band.join(lead, ["token", "band"]).where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("many"))
    star = stored(compared(pairs.groupBy("a").agg(F.max_by("b", F.struct("many", F.bitwise_not("b"))).alias("b"))))

    cluster = components(star)
    postings = postings.join(cluster.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("root", "rep").alias("cluster"))
    mixed = postings.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high")
    mixed = stored(postings.join(mixed.select("token"), "token").select("token", "rep", "cluster"))
    edges = star.unionByName(_met(mixed, sets, percent, cell))

    own = found.where("n_shingles > 0 and doc_id is not null")
    copies = _told(own.select("sig", F.col("doc_id").alias("rep")), ["sig"], {"b": F.min("rep"), "other": F.max("rep")}, "b < other").where("rep <> b").select(F.col("rep").alias("a"), "b")
    root = components(edges.unionByName(copies))
    out = found.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
