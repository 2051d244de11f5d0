"""Benchmark decontamination by q-gram lemma filtering.

A benchmark text of m bytes that stands in a document with at most k edits
shares at least ``m - q + 1 - q * k`` of its q-grams with it, at diagonals
(place in the document less place in the item) that span at most ``2 * k``.  So
q-gram hits are counted by item and document first, then in overlapping bands
of diagonals, and what reaches the bound is verified by banded alignment.

Which documents an item is counted in is found by its rarest q-grams: k edits
spoil at most ``q * k`` of them, so of the ``q * k + s`` rarest different ones s are
shared.  The commonest (a template that all items begin with) are never looked
up, and a document that shares fewer than s (``SHARED``) isn't counted in.

Both sides are compared with A-Z lower-cased and white space runs as one space.
k is ``percent`` of the item's length, and q is ``q`` or what still leaves the
bound at one.  Items shorter than ``shortest`` bytes are searched word for word:
without edits, and not within longer words.

Benchmarks of at most ``broadcast_bytes`` go to all executors, and documents are
read once, in Arrow batches, without a shuffle.  Larger ones stay a table of
postings: documents are joined with it by rare q-grams, those in a filter of
fixed size, and only documents and items that meet are brought together.

Defined results: null and empty texts, and items of white space alone, match
nothing.  Items of equal text all match.  Repeated rows match each; an item
without item_id is left out.  A document without doc_id is matched with doc_id
null.  An empty table on either side gives none.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inventra.llm.tables import stored
from inventra.llm.words import _LOWER_BYTES, _SPACE, U, run_hash, slices

Q, PERCENT, SHORTEST = 10, 7, 30
SHARED = 6
BROADCAST_BYTES = 8_000_000
_FILTER = 22
#: Bits of the filter that stands before the join, whatever the benchmark's size.
_WIDE = 25
SCHEMA = "doc_id long, item_id long, begin long, end long, edits int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def plain(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Compared bytes of a text, and where each of them stands in it."""
    data = _LOWER_BYTES[np.frombuffer(text or b"", np.uint8)]
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(keep) and space[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    out = data[at]
    out[space[at]] = 0x20
    if len(out) and out[-1] == 0x20:
        out, at = out[:-1], at[:-1]
    return out, at


def aligned(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between ``item`` and any part of ``region``, and the part,
    over paths on diagonals ``low`` to ``high``; None beyond ``most``."""
    width = high - low + 1
    offset = np.arange(width)
    far = most + 1
    place = offset + low
    inside = (place >= 0) & (place <= len(region))
    cost = np.where(inside, 0, far)
    origin = place.copy()
    for i in range(1, len(item) + 1):
        place = place + 1
        inside = (place >= 0) & (place <= len(region))
        char = np.full(width, 256)
        ok = (place >= 1) & (place <= len(region))
        char[ok] = region[place[ok] - 1]
        new = cost + (char != item[i - 1])
        start = origin.copy()
        up = np.append(cost[1:] + 1, far)
        better = up < new
        new[better], start[better] = up[better], np.append(origin[1:], 0)[better]
        new[~inside] = far
        best = np.minimum.accumulate(new - offset)
        run = best + offset
        source = np.maximum.accumulate(np.where(new - offset == best, offset, 0))
        cost, origin = np.where(inside, np.minimum(run, far), far), start[source]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), int(place[end])


def bounds(size: int, q: int, percent: int, shortest: int) -> tuple[int, int, int]:
    """Edits, q and least number of shared q-grams of an item of ``size`` bytes."""
    edits = size * percent // 100 if size >= shortest else 0
    own = max(1, min(q, size // (edits + 1)))
    return edits, own, size - own + 1 - own * edits


def looked_up(different: int, q: int, edits: int) -> tuple[int, int]:
    """How many of an item's different q-grams are looked up, the rarest, and how
    many of these a document must share."""
    return min(different, q * edits + SHARED), max(1, min(SHARED, different - q * edits))


def _letters(data: np.ndarray, at: int) -> bool:
    """Whether a letter, a digit or a byte of a wider character stands there."""
    if not 0 <= at < len(data):
        return False
    c = int(data[at])
    return c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A


class _Grams:
    """The q-grams of items that have the same q, and their rare ones."""

    def __init__(self, which: list[int], texts: list[np.ndarray], edits: list[int], q: int):
        self.q, self.which = q, which
        grams = [run_hash(t, q) for t in texts]
        self.gram, spot, many = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        self.spots, self.places, rare_spot, rare_item, share = [], [], [], [], []
        begin = 0
        for i, (own, k) in enumerate(zip(grams, edits, strict=True)):
            mine = spot[begin : begin + len(own)]
            begin += len(own)
            order = np.argsort(mine, kind="stable")
            self.spots.append(mine[order])
            self.places.append(order)
            different = np.unique(mine)
            most, least = looked_up(len(different), q, k)
            rare_spot.append(different[np.lexsort((different, many[different]))[:most]])
            rare_item.append(np.full(most, i))
            share.append(least)
        self.share = np.array(share)
        rare_spot, rare_item = np.concatenate(rare_spot), np.concatenate(rare_item)
        order = np.argsort(rare_spot, kind="stable")
        self.item = rare_item[order]
        self.first = np.searchsorted(rare_spot[order], np.arange(len(self.gram) + 1))
        self.bits = np.zeros(1 << _FILTER, bool)
        self.bits[(self.gram >> U(64 - _FILTER)).astype(np.int64)] = True

    def rare(self) -> np.ndarray:
        return self.gram[np.diff(self.first) > 0]

    def candidates(self, data: np.ndarray, starts: np.ndarray):
        """(text, item, places in the item, places in all texts) where an item's rare
        q-grams stand in a text."""
        hashed = run_hash(data, self.q)
        at = np.flatnonzero(self.bits[(hashed >> U(64 - _FILTER)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.gram, hashed[at]), len(self.gram) - 1)
        hit = self.gram[spot] == hashed[at]
        at, spot = at[hit], spot[hit]
        text = np.searchsorted(starts, at, side="right") - 1
        # Each text's different q-grams are looked up once.
        pair = np.unique(text * len(self.gram) + spot)
        many = np.diff(self.first)[pair % len(self.gram)]
        posting = np.repeat(self.first[pair % len(self.gram)], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key, shared = np.unique(np.repeat(pair // len(self.gram), many) * len(self.which) + self.item[posting], return_counts=True)
        key = key[shared >= self.share[key % len(self.which)]]
        begins = np.searchsorted(text, np.arange(len(starts)))
        for k in key.tolist():
            t, i = divmod(k, len(self.which))
            own, where = spot[begins[t] : begins[t + 1]], at[begins[t] : begins[t + 1]]
            low, high = np.searchsorted(self.spots[i], own), np.searchsorted(self.spots[i], own, side="right")
            many = high - low
            places = self.places[i][np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            yield t, i, places, np.repeat(where, many)


class Items:
    """Q-grams of benchmark items, and the search of a batch of texts for them."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, percent: int, shortest: int):
        kept = [(i, own) for i, own in ((i, plain(t)[0]) for i, t in items) if len(own)]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.shortest = shortest
        limits = [bounds(len(t), q, percent, shortest) for t in self.texts]
        self.budget, self.need = [x[0] for x in limits], [x[2] for x in limits]
        self.groups = []
        for own in sorted({x[1] for x in limits}):
            which = [i for i, x in enumerate(limits) if x[1] == own]
            self.groups.append(_Grams(which, [self.texts[i] for i in which], [self.budget[i] for i in which], own))

    def found(self, texts: list[bytes | None]):
        """(text, item, begin, end, edits), the least begin of the fewest edits."""
        for a, b in slices(texts):
            parts = [plain(t) for t in texts[a:b]]
            gap = np.zeros(1, np.uint8)
            data = np.concatenate([x for p, _ in parts for x in (p, gap)])
            starts = np.cumsum([0, *(len(p) + 1 for p, _ in parts)])
            for group in self.groups:
                for t, own, place, at in group.candidates(data, starts):
                    i = group.which[own]
                    if len(place) < self.need[i]:
                        continue
                    best = self._region(parts[t][0], i, place, at - starts[t] - place)
                    if best:
                        edits, begin, end = best
                        where = parts[t][1]
                        yield a + t, i, int(where[begin]), int(where[end - 1]) + 1, edits

    def _region(self, data, i, place, diagonal):
        k, size = self.budget[i], len(self.texts[i])
        width = 2 * k + 1
        best = None
        for shift in (0, width):
            band = (diagonal + shift) // (2 * width)
            order = np.argsort(band, kind="stable")
            held = band[order]
            cut = np.append(np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))), len(held))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a < self.need[i] or len(np.unique(place[order[a:b]])) < self.need[i]:
                    continue
                low = int(held[a]) * 2 * width - shift - k
                begin = max(0, low)
                region = data[begin : low + 2 * width + 2 * k + size]
                exact = self._exact(data, region, i, begin)
                if exact >= 0:
                    got = (0, exact, exact + size)
                else:
                    got = aligned(self.texts[i], region, low - begin, low - begin + 2 * width + 2 * k, k) if k else None
                if got and (best is None or (got[0], got[1] + begin) < best[:2]):
                    best = (got[0], got[1] + begin, got[2] + begin)
                if best and not k:
                    return best
        return best

    def _exact(self, data, region, i, begin) -> int:
        """Where the item stands in the region as it is, or -1."""
        text = self.texts[i]
        raw, own, at = region.tobytes(), text.tobytes(), -1
        while (at := raw.find(own, at + 1)) >= 0:
            inside = (_letters(text, 0) and _letters(data, begin + at - 1)) or (_letters(text, len(text) - 1) and _letters(data, begin + at + len(text)))
            if len(text) >= self.shortest or not inside:
                return at
        return -1


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[j] for g in found], kind) for j, kind in enumerate(_ARROW.types)], schema=_ARROW)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, percent: int = PERCENT, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, begin, end (bytes of the text), edits: one row for each
    row of ``docs`` and item that stands in it."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    total, rows = items.agg(F.sum(F.length("t")), F.count("*")).first()
    if (total or 0) + 16 * rows > broadcast_bytes:
        return _joined(own, items, q, percent, shortest)
    held = sorted((r["i"], bytes(r["t"])) for r in items.collect())

    def run(batches):
        known = Items(held, q, percent, shortest)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            yield _batch([(ids[t], known.ids[i], begin, end, edits) for t, i, begin, end, edits in known.found(texts)])

    return own.mapInArrow(run, SCHEMA)


def _gram_rows(q_of: list[int], ids: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (q, gram, key), one for each hash."""
    many = [len(h) for h in hashes]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(q_of, np.int32), many)), pa.array(np.concatenate(hashes).astype(np.int64) if many else [], pa.int64()), pa.array(np.repeat(ids, many).astype(np.int64), pa.int64())], names=["q", "gram", "key"])


def _joined(docs: DataFrame, items: DataFrame, q: int, percent: int, shortest: int) -> DataFrame:
    """As ``leaks``, for a benchmark of any size: a row is known by the hash of
    its id and text, and meets the items with which it shares a rare q-gram."""
    key = lambda *c: F.xxhash64(*c)
    items = items.withColumn("key", key("i", "t"))

    def grams(batches):
        for batch in batches:
            keys, texts, qs, ids, hashes = batch["key"].to_pylist(), batch["t"].to_pylist(), [], [], []
            for k, t in zip(keys, texts, strict=True):
                own = plain(t)[0]
                if len(own):
                    _, n, _ = bounds(len(own), q, percent, shortest)
                    qs.append(n)
                    ids.append(k)
                    hashes.append(np.unique(run_hash(own, n)))
            yield _gram_rows(qs, np.array(ids, np.int64), hashes)

    postings = items.select("key", "t").mapInArrow(grams, "q int, gram long, key long")
    many = postings.groupBy("q", "gram").agg(F.count("*").alias("many"))
    need = items.select("key", "t").mapInArrow(lambda batches: _needs(batches, q, percent, shortest), "key long, most long, least long")
    ranked = postings.join(many, ["q", "gram"]).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("many", "gram")))
    rare = stored(ranked.join(need, "key").where("rank <= most").select("q", "gram", "key", "least"))
    qs = [r["q"] for r in rare.select("q").distinct().orderBy("q").collect()]
    shift = 64 - _WIDE
    words = rare.select(F.shiftrightunsigned("gram", shift + 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {shift}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marks = np.zeros(1 << (_WIDE - 6), np.int64)
    for r in words.collect():
        marks[r["word"]] = r["bits"]
    marks = docs.sparkSession.sparkContext.broadcast(marks.tobytes())

    def probes(batches):
        held = np.frombuffer(marks.value, np.uint64)
        for batch in batches:
            keys, texts = batch["key"].to_pylist(), batch["text"].to_pylist()
            for a, b in slices(texts):
                out_q, ids, hashes = [], [], []
                for k, t in zip(keys[a:b], texts[a:b], strict=True):
                    own = plain(t)[0]
                    for n in qs:
                        if len(own) >= n:
                            h = run_hash(own, n)
                            place = h >> U(shift)
                            h = h[(held[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1]
                            out_q.append(n)
                            ids.append(k)
                            hashes.append(np.unique(h))
                yield _gram_rows(out_q, np.array(ids, np.int64), hashes)

    docs = docs.withColumn("key", key("doc_id", "text"))
    asked = docs.where(F.length("text") > 0).select("key", "text").mapInArrow(probes, "q int, gram long, key long")
    pairs = asked.join(rare.withColumnRenamed("key", "item"), ["q", "gram"]).groupBy("key", "item", "least").agg(F.count("*").alias("shared")).where("shared >= least").select("key", "item")
    met = pairs.join(docs, "key").join(items.select(F.col("key").alias("item"), "i", "t"), "item")

    def verify(batches):
        for batch in batches:
            out = []
            for doc, text, i, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "i", "t")), strict=True):
                known = Items([(i, t)], q, percent, shortest)
                out += [(doc, i, begin, end, edits) for _, _, begin, end, edits in known.found([text])]
            yield _batch(out)

    return met.select("doc_id", "text", "i", "t").mapInArrow(verify, SCHEMA)


def _needs(batches, q: int, percent: int, shortest: int):
    """How many of an item's different q-grams are looked up, and must be shared."""
    for batch in batches:
        keys, most, least = [], [], []
        for k, t in zip(batch["key"].to_pylist(), batch["t"].to_pylist(), strict=True):
            own = plain(t)[0]
            if len(own):
                edits, n, _ = bounds(len(own), q, percent, shortest)
                up, shared = looked_up(len(np.unique(run_hash(own, n))), n, edits)
                keys.append(k)
                most.append(up)
                least.append(shared)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, most, least)], names=["key", "most", "least"])
