"""Blocks of documents that ask questions of buckets of hashes.

Many corpus operators need, for each of very many small items of a text (a
shingle, a distinct word, a pair of words, an anchor), something that is only
known from all documents.  One row per item is far too many rows.  Here
documents are dealt into blocks of about ``BLOCK_BYTES``; a block sends each
bucket of the hash space one packed row with the items that fall into it, a
bucket answers each block with one packed row, and the block meets its answers
beside its texts.  The texts are shuffled once (both uses of the dealt table
read the same exchange), and no key can gather more than a bucket's items, as a
block sends a repeated item once.

With ``n`` blocks there are about as many buckets, and each block has something
for nearly each bucket: ``n * n`` rows, ever smaller ones.  Beyond ``HOP`` blocks
rows therefore go by two hops: a block ties what goes to neighbouring buckets
into one row for their group, and a task that holds such rows of neighbouring
blocks ties them anew by bucket.  Groups are as wide as the root of ``n``, so
there are ``n ** 1.5`` rows a hop, each hop holds what a block holds, and results
are the same.

A block orders its documents by id and text before it numbers anything, so an
answer fits however often a lost executor makes Spark build a block anew.
"""

from __future__ import annotations

import ctypes
import os
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text a block holds on average.
BLOCK_BYTES = 10_000_000
#: Up to so many blocks rows go straight to their bucket.
HOP = 4096
ROW = "bucket int, block int, kind int, part binary"
_ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("part", pa.binary())])


def pieces(total: int | None, each: int) -> int:
    return max(1, -(-int(total or 0) // each))


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def dealt(df: DataFrame, doc_id: str, text: str, n: int, *more: Column) -> DataFrame:
    """Rows (block, docs): docs holds some of the block's rows as one compressed
    Arrow stream with the columns doc_id, text (as bytes) and what else is asked
    for.  Packed so, texts take about two thirds of what rows would in the
    shuffle."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    own = df.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SPREAD_BYTES:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)

    return own.mapInArrow(run, "block int, docs binary")


#: Bytes of rows a task gathers before it packs them by block.
SPREAD_BYTES = 16_000_000
_STREAM = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    order, cuts = by_bucket(table["block"].to_numpy())
    table = table.drop_columns("block")
    blocks, docs = [], []
    for block, a, b in cuts:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=_STREAM) as out:
            out.write_table(table.take(order[a:b]).combine_chunks())
        blocks.append(block)
        docs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(docs, pa.binary())], names=["block", "docs"])


def opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(d.as_buffer()).read_all() for d in table["docs"]])


def docs_of(table: pa.Table, *more: str) -> tuple:
    """Ids, texts and further columns of a block as lists, in the block's order."""
    ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
    lists = [ids, texts, *(table[c].to_pylist() for c in more)]
    return tuple([x[i] for i in order] for x in lists)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed part; bytes of a like place in their numbers
    stand together, so small numbers cost little whatever their type."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        planes = a if a.dtype.itemsize == 1 else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)
        out += [struct.pack("<3sQ", a.dtype.str[1:].encode(), len(a)), planes.tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(part: bytes) -> list[np.ndarray]:
    part = pa.decompress(memoryview(part)[8:], decompressed_size=struct.unpack_from("<Q", part)[0], codec="zstd", asbytes=True)
    (n,), at, out = struct.unpack_from("<H", part), 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<3sQ", part, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        at += 11
        if kind.itemsize == 1:
            out.append(np.frombuffer(part, kind, size, at))
        else:
            planes = np.frombuffer(part, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
            out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def steps(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising unsigned numbers as the first and what each adds to the one before."""
    a = a.astype(np.uint64)
    return a[:1], small(a[1:] - a[:-1])


def risen(first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What ``steps`` were made of."""
    return np.cumsum(np.concatenate((first, step.astype(np.uint64))), dtype=np.uint64)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, Iterable[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, begin, end) of each that has items."""
    if not len(bucket):
        return np.zeros(0, np.int64), ()
    small = bucket.astype(np.uint16 if bucket.max() < 65536 else np.int64)
    order = np.argsort(small, kind="stable")
    held = small[order]
    cuts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return order, zip(held[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(held)).tolist(), strict=True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def freed(made):
    """What was made; memory that its making left unused goes back to the
    system, as a worker lives on beside others on its executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return made


def rows(items: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*items, strict=True)) or [()] * 4
    return freed(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.types, strict=True)], schema=_ROW))


#: The kind of a row that holds further rows.
_TIED = -1


def width(n: int) -> int:
    """How many neighbouring buckets or blocks share a row."""
    return 1 if n <= HOP else int(np.ceil(np.sqrt(n)))


def _tied(table: pa.Table, wide: int, by: str) -> pa.Table:
    """One row for each group of ``wide`` buckets and of blocks; ``by`` names the
    column that stays as it is, ungrouped, or neither."""
    keys = {c: table[c].to_numpy() // (1 if c == by else wide) for c in ("bucket", "block")}
    order = np.lexsort((keys["block"], keys["bucket"]))
    bucket, block = keys["bucket"][order], keys["block"][order]
    cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))) if len(order) else np.zeros(0, int)
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True) if len(cut) else ():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROW) as stream:
            stream.write_table(table.take(order[a:b]).combine_chunks())
        out.append((int(bucket[a]), int(block[a]), _TIED, sink.getvalue().to_pybytes()))
    return rows(out)


def loose(table: pa.Table) -> pa.Table:
    """The rows themselves, where some hold further rows."""
    tied = table["kind"].to_numpy() == _TIED
    if not tied.any():
        return table
    held = table.filter(pa.array(tied))["part"]
    return pa.concat_tables([table.filter(pa.array(~tied)).cast(_ROW), *(pa.ipc.open_stream(p.as_buffer()).read_all() for p in held)])


def _routed(df: DataFrame, wide: int, by: str) -> DataFrame:
    """The second hop: rows of a group of buckets and of blocks, tied anew by
    what they go to."""
    if wide == 1:
        return df

    def run(table: pa.Table) -> pa.Table:
        return _tied(loose(table), wide, by)

    return df.groupBy("bucket", "block").applyInArrow(run, ROW)


def _sent(out: pa.Table, wide: int) -> pa.Table:
    return out if wide == 1 else _tied(out, wide, "")


def asked(blocks: DataFrame, ask: Callable[[int, pa.Table], Iterable[tuple[int, int, int, bytes]]], n: int) -> DataFrame:
    """``ask(block, its documents)`` gives (bucket, block, kind, part)."""
    wide = width(n)

    def run(table: pa.Table) -> pa.Table:
        return _sent(rows(ask(table["block"][0].as_py(), opened(table))), wide)

    return _routed(blocks.groupBy("block").applyInArrow(run, ROW), wide, "bucket")


def asked_again(blocks: DataFrame, answers: DataFrame, ask: Callable, n: int) -> DataFrame:
    """As ``asked``, with the answers to what was asked before."""
    wide = width(n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _sent(rows(ask(left["block"][0].as_py(), opened(left), parts_of(right)) if left.num_rows else ()), wide)

    return _routed(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ROW), wide, "bucket")


def parts_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, part) in order of kind and bucket."""
    table = loose(table)
    return sorted(zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["part"].to_pylist(), strict=True), key=lambda r: (r[1], r[0]))


def asks_of(table: pa.Table) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, bytes]]]:
    """What a bucket is asked, (block, part) in order, and what passes by it
    from a block to itself: rows of kind 9 as (block, kind, part)."""
    table = loose(table)
    held = list(zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["part"].to_pylist(), strict=True))
    return sorted((b, p) for b, k, p in held if k != 9), [h for h in held if h[1] == 9]


def _answers(table: pa.Table, answer: Callable, wide: int, *more) -> pa.Table:
    bucket = table["bucket"][0].as_py()
    own, passing = asks_of(table)
    out = [(bucket, b, k, p) for b, k, p in passing]
    out += [(bucket, b, k, p) for b, k, p in answer(own, *more)] if own else []
    return _sent(rows(out), wide)


def answered(asks: DataFrame, answer: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, int, bytes]]], n: int) -> DataFrame:
    """``answer(rows of one bucket: (block, part))`` gives (block, kind, part).
    Rows of kind 9 pass: they go from a block to itself."""
    wide = width(n)

    def run(table: pa.Table) -> pa.Table:
        return _answers(table, answer, wide)

    return _routed(asks.groupBy("bucket").applyInArrow(run, ROW), wide, "block")


def answered_told(asks: DataFrame, told: DataFrame, answer: Callable, heard: Callable[[pa.Table], object], n: int) -> DataFrame:
    """As ``answered``, with what is ``heard`` of the row that ``told`` has for each bucket."""
    wide = width(n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answers(left, answer, wide, heard(right)) if left.num_rows else rows(())

    return _routed(asks.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, ROW), wide, "block")


def met(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``finish(block's documents, answers)`` gives columns of ``arrow``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        return freed(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(finish(opened(left), parts_of(right)), arrow.types, strict=True)], schema=arrow))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
