"""Suffix-array dedup: bytes covered by windows that an earlier document holds.

A byte goes when some ``width``-byte window over it also starts in a document
with a smaller id.  Suffixes are ordered by a depth-limited radix sort, most
significant digit first and only to ``width`` bytes; two suffixes that agree so
far are in one group, and the groups are exactly the repeated windows.

* Not every suffix is sorted.  Each window has an anchor, the ``anchor``-byte
  gram with the least hash in it (the leftmost of several).  Equal windows have
  equal anchors, and neighbouring windows share them, so the suffixes that begin
  at anchors, one in about 14, speak for all.
* The first pass deals anchors to buckets by a hash of that first digit.  Those
  that stand only once leave the sort there: most of a corpus does.
* A block sends each distinct surrounding of a repeated anchor once, with the
  smallest id that has it.  Its bucket sorts the suffixes from the anchors in
  passes of eight bytes, each pass only within groups that are still equal, up to
  ``width`` bytes, and in the same way what stands before the anchors, read
  backwards.  The common lengths of neighbours in both orders say at every depth
  who is equal: a window that begins ``o`` bytes before its anchor equals another
  when the suffixes agree to ``width - o`` bytes and what is before to ``o``.
* An anchor that more than ``HOT`` blocks hold would fill a bucket with different
  surroundings.  Its windows go one by one, to buckets by 128 bits of hash of the
  whole window.

Exact copies of a whole text are settled by the text's hash: all but the
smallest id are covered wholly, and stay out of the sort.

Defined results: a null text is empty; a text shorter than ``width`` has no
window and keeps all its bytes.  Rows without doc_id are put before all others
(they lose nothing, and what they hold is lost by every other row).  Rows of
one doc_id never cover one another.  An empty table gives none.  Further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inventra.llm import blocks as B
from inventra.llm.words import U, mix, run_hash, slices

WIDTH, ANCHOR = 50, 24
_NONE = -(2**63)
_PLACE_BITS = U(24)
_PLACE_MASK = U((1 << 24) - 1)
_ROLL = U(0x9E3779B97F4A7C15)
#: Blocks that may hold an anchor before its windows go one by one.
HOT = 4096
#: Rows that are sorted at once, about.
STEP = 200_000


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of one text: its place, and the first and last window
    that has it.  Windows are named by where they start."""
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 3
    hashed = run_hash(data, gram)
    span = width - gram + 1
    out = []
    step = 1 << 22
    for base in range(0, len(data) - width + 1, step):
        part = hashed[base : base + step + span - 1]
        key = (part & ~_PLACE_MASK) | np.arange(len(part), dtype=U)
        reach = 1
        while reach * 2 <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        out.append((key & _PLACE_MASK).astype(np.int64) + base)
    place = np.concatenate(out)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[cut], cut, np.append(cut[1:], len(place)) - 1


class Anchored:
    """The anchors of a block's texts: hash, text, place in it, and windows."""

    def __init__(self, texts: list[bytes | None], use: np.ndarray, width: int, gram: int):
        got = []
        for a, b in slices(texts):
            for i in range(a, b):
                if use[i] and len(texts[i] or b"") >= width:
                    data = np.frombuffer(texts[i], np.uint8)
                    place, low, high = anchors(data, width, gram)
                    got.append((run_hash(data, gram)[place], np.full(len(place), i), place, low, high))
        kinds = (U, np.int64, np.int64, np.int64, np.int64)
        self.hash, self.text, self.place, self.low, self.high = (np.concatenate([g[j] for g in got]) if got else np.zeros(0, k) for j, k in enumerate(kinds))


def _short(h: np.ndarray) -> np.ndarray:
    return (h & U(0xFFFFFFFF)).astype(np.uint32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U(32)) % U(n)


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array([_NONE if i is None else i for i in ids], np.int64)


def _least(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of each entry's hash."""
    order = np.lexsort((doc, hashed))
    held = hashed[order]
    cut = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, int)
    out = np.empty(len(doc), np.int64)
    out[order] = np.repeat(doc[order[cut]], np.diff(np.append(cut, len(held))))
    return out


def _whole(texts: list[bytes | None]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest()) for t in texts], U)


def _digits(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as numbers of eight bytes each, in the bytes' order."""
    size = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), size), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(U)


def _agreed(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of two numbers are equal, from their difference by bits."""
    return sum((x >> U(8 * j) == 0).astype(np.int16) for j in range(8))


def radix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows of bytes, and how many bytes each row has in common with
    the one before it.  Most significant digit first: a pass orders the rows of
    each group by the next eight bytes, and what is alone in its group is done."""
    n, depth = rows.shape
    digits = _digits(rows)
    order = np.argsort(digits[:, 0], kind="stable")
    common = np.full(n, depth, np.int16)
    common[:1] = 0
    held = digits[order, 0]
    same = np.ones(n, bool)
    same[:1] = False
    same[1:] = held[1:] == held[:-1]
    split = np.flatnonzero(~same)[1:]
    common[split] = _agreed(held[split] ^ held[split - 1])
    for k in range(1, digits.shape[1]):
        member = same.copy()
        member[:-1] |= same[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        held = digits[order[at], k]
        sub = np.lexsort((held, group))
        order[at], held = order[at][sub], held[sub]
        # Groups keep their places, so only neighbours within one can part.
        apart = np.flatnonzero((held[1:] != held[:-1]) & (group[1:] == group[:-1])) + 1
        same[at[apart]] = False
        common[at[apart]] = 8 * k + _agreed(held[apart] ^ held[apart - 1])
    return order, np.minimum(common, depth)


class _Sort:
    def __init__(self, width: int, gram: int, buckets: int, hot: int = HOT):
        self.width, self.gram, self.buckets, self.hot = width, gram, buckets, hot
        self.side = width - gram
        self.offsets = self.side + 1
        self.box = 2 * self.side + gram

    @staticmethod
    def _texts(whole, doc):
        """The block's different texts by hash: the first row of each, its
        smallest id, and each row's place among them."""
        order = np.lexsort((doc, whole))
        held = whole[order]
        cut = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, int)
        at = np.empty(len(whole), np.int64)
        at[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(held))))
        return order[cut], at

    def first_ask(self, block, table):
        ids, texts = B.docs_of(table)
        whole, doc = _whole(texts), _ids(ids)
        # A copy within the block needs no anchors: its first one has them.
        pick, _ = self._texts(whole, doc)
        own = np.zeros(len(texts), bool)
        own[pick] = True
        found = Anchored(texts, own, self.width, self.gram)
        hashed = np.unique(found.hash)
        order, cuts = B.by_bucket(_bucket(hashed, self.buckets))
        for bucket, a, b in cuts:
            yield bucket, block, 0, B.pack(_short(hashed[order[a:b]]))
        order, cuts = B.by_bucket(_bucket(whole[pick], self.buckets))
        for bucket, a, b in cuts:
            yield bucket, block, 2, B.pack(whole[pick][order[a:b]], doc[pick][order[a:b]])

    def first_answer(self, parts):
        """Kind 1: which anchors another block has too, and which are hot.  Kind
        3: the smallest id of each text."""
        grams, whole = [], []
        for block, p in parts:
            got = B.unpack(p)
            (grams if len(got) == 1 else whole).append((block, *got))
        if grams:
            held = np.concatenate([g[1] for g in grams])
            order = np.argsort(held)
            ordered = held[order]
            cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            many = np.empty(len(held), np.int64)
            many[order] = np.repeat(np.diff(np.append(cut, len(held))), np.diff(np.append(cut, len(held))))
            at = 0
            for block, g in grams:
                own = many[at : at + len(g)]
                yield block, 1, B.pack(np.packbits(own > 1), np.packbits(own > self.hot))
                at += len(g)
        if whole:
            least = _least(np.concatenate([w[1] for w in whole]), np.concatenate([w[2] for w in whole]))
            at = 0
            for block, h, _ in whole:
                yield block, 3, B.pack(least[at : at + len(h)])
                at += len(h)

    def _boxes(self, texts, doc, parts):
        """The block's repeated anchors: the rows of ``Anchored`` that stay, which
        of these are hot, and the smallest id of each row's text."""
        whole = _whole(texts)
        pick, at = self._texts(whole, doc)
        least = np.empty(len(pick), np.int64)
        order, cuts = B.by_bucket(_bucket(whole[pick], self.buckets))
        told = {bucket: p for bucket, kind, p in parts if kind == 3}
        for bucket, a, b in cuts:
            least[order[a:b]] = B.unpack(told[bucket])[0]
        least = least[at]
        first = np.zeros(len(texts), bool)
        first[pick] = True
        found = Anchored(texts, first, self.width, self.gram)
        hashed, at, times = np.unique(found.hash, return_inverse=True, return_counts=True)
        shared, hot = times > 1, np.zeros(len(hashed), bool)
        order, cuts = B.by_bucket(_bucket(hashed, self.buckets))
        told = {bucket: p for bucket, kind, p in parts if kind == 1}
        for bucket, a, b in cuts:
            some, often = (np.unpackbits(x, count=b - a).astype(bool) for x in B.unpack(told[bucket]))
            shared[order[a:b]] |= some
            hot[order[a:b]] = often
        # Only a text's smallest id takes part; an earlier copy elsewhere speaks for it.
        keep = np.flatnonzero(shared[at] & (doc == least)[found.text])
        return found, keep, hot[at][keep], least

    def _surroundings(self, texts, found, keep):
        size = np.array([len(t or b"") for t in texts], np.int64)
        start = np.concatenate(([0], np.cumsum(size + 2 * self.side)))
        pad = b"\0" * self.side
        data = np.frombuffer(b"".join(pad + (t or b"") + pad for t in texts), np.uint8)
        left = start[found.text[keep]] + found.place[keep]
        box = np.lib.stride_tricks.sliding_window_view(data, self.box)[left] if len(keep) else np.zeros((0, self.box), np.uint8)
        # Window w with anchor a has offset a - w, from 0 to side.
        early, late = found.place[keep] - found.high[keep], found.place[keep] - found.low[keep]
        mask = ((U(2) << late.astype(U)) - U(1)) & ~((U(1) << early.astype(U)) - U(1))
        return box, mask

    def _unique(self, box, mask, hashed, doc):
        """Distinct (box, mask): one row of each with the smallest doc, and each entry's place in them."""
        key = mix(mask + U(1)) ^ hashed
        for j in range(0, self.box, 8):
            word = np.zeros((len(box), 8), np.uint8)
            word[:, : min(8, self.box - j)] = box[:, j : j + 8]
            key = mix(key * _ROLL + word.view(U)[:, 0])
        order = np.lexsort((doc, key))
        held = key[order]
        cut = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, int)
        at = np.empty(len(key), np.int64)
        at[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(held))))
        return order[cut], at

    def _single(self, box, mask, own):
        """The windows of boxes one by one: their box and offset, 128 bits of
        hash of each, and for each different one its first place."""
        row, offset = np.nonzero((mask[:, None] >> np.arange(self.offsets).astype(U)) & U(1))
        high, low = np.full(len(row), self.width, U), np.full(len(row), ~self.width & 0xFFFFFFFF, U)
        begin = self.side - offset
        for j in range(0, self.width, 8):
            word = np.zeros((len(row), 8), np.uint8)
            for i in range(min(8, self.width - j)):
                word[:, i] = box[row, begin + j + i]
            word = word.view(U)[:, 0]
            high, low = mix(high * _ROLL + word), mix((low ^ word) * _ROLL + U(j + 1))
        order = np.lexsort((own[row], low, high))
        h, l = high[order], low[order]
        cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])))) if len(row) else np.zeros(0, int)
        at = np.empty(len(row), np.int64)
        at[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(row))))
        return row, offset, high, low, order[cut], at

    def second_ask(self, block, table, parts):
        ids, texts = B.docs_of(table)
        doc = _ids(ids)
        found, keep, hot, _ = self._boxes(texts, doc, parts)
        box, mask = self._surroundings(texts, found, keep)
        own, hashed = doc[found.text[keep]], found.hash[keep]
        few = np.flatnonzero(~hot)
        pick, _ = self._unique(box[few], mask[few], hashed[few], own[few])
        pick = few[pick]
        order, cuts = B.by_bucket(_bucket(hashed[pick], self.buckets))
        for bucket, a, b in cuts:
            at = pick[order[a:b]]
            yield bucket, block, 0, B.pack(box[at].ravel(), mask[at].astype(np.uint32), own[at])
        if hot.any():
            row, _, high, low, first, _ = self._single(box[hot], mask[hot], own[hot])
            order, cuts = B.by_bucket(_bucket(high[first], self.buckets))
            for bucket, a, b in cuts:
                at = first[order[a:b]]
                yield bucket, block, 4, B.pack(high[at], low[at], own[hot][row[at]], np.zeros(0, np.uint8))
        for bucket, kind, part in parts:
            yield block % self.buckets, block, 9, B.pack(np.array([bucket, kind], np.int64), np.frombuffer(part, np.uint8))

    def second_answer(self, parts):
        """Kind 1: of each box, the windows that a smaller id holds too, as bits.
        Kind 5: likewise of each single window."""
        boxes, single = [], []
        for block, p in parts:
            got = B.unpack(p)
            (boxes if len(got) == 3 else single).append((block, *got))
        if boxes:
            box = np.concatenate([g[1] for g in boxes]).reshape(-1, self.box)
            early = self._early(box, np.concatenate([g[2] for g in boxes]), np.concatenate([g[3] for g in boxes]))
            at = 0
            for block, _, _, doc in boxes:
                yield block, 1, B.pack(early[at : at + len(doc)])
                at += len(doc)
        if single:
            high, low, doc = (np.concatenate([g[j] for g in single]) for j in (1, 2, 3))
            order = np.lexsort((doc, low, high))
            h, l, d = high[order], low[order], doc[order]
            cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (l[1:] != l[:-1]))))
            early = np.empty(len(doc), bool)
            early[order] = np.repeat(d[cut], np.diff(np.append(cut, len(d)))) < d
            at = 0
            for block, own, *_ in single:
                yield block, 5, B.pack(np.packbits(early[at : at + len(own)]))
                at += len(own)

    def _early(self, box, mask, doc):
        """Of each box, the windows that the box of a smaller id holds too."""
        early = np.zeros(len(doc), np.uint32)
        order, common = radix_order(box[:, self.side :])
        # Anchors that are alone are done; groups of equal ones are taken in steps.
        begin = np.flatnonzero(common < self.gram)
        size = np.diff(np.append(begin, len(order)))
        begin, size = begin[size > 1], size[size > 1]
        step = np.cumsum(size) // STEP
        for k in np.unique(step):
            own = np.flatnonzero(step == k)
            at = np.repeat(begin[own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            self._windows(box[:, self.side - 1 :: -1] if self.side else box[:, :0], mask, doc, early, order[at], common[at])
        return early

    def _windows(self, left, mask, doc, early, rows, common):
        """Windows of ``rows``, which are in order of their suffixes."""
        before, agreed = radix_order(left[rows])
        # By id, so that a stable order by class has each class's smallest id first.
        by_doc = np.argsort(doc[rows], kind="stable")
        rank = np.empty(len(rows), np.int64)
        own, own_mask = doc[rows], mask[rows]
        for offset in range(self.offsets):
            use = by_doc[(own_mask[by_doc] >> np.uint32(offset)) & np.uint32(1) == 1]
            if len(use) < 2:
                continue
            rank[before] = np.cumsum(agreed < offset) if offset else 0
            kind = np.cumsum(common < self.width - offset)[use] * (len(rows) + 1) + rank[use]
            order = np.argsort(kind, kind="stable")
            held, at = kind[order], use[order]
            cut = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
            least = np.repeat(own[at[cut]], np.diff(np.append(cut, len(at))))
            seen = at[least < own[at]]
            early[rows[seen]] |= np.uint32(1 << offset)

    def spans(self, table, parts):
        """Ids, texts and for each text the removed spans."""
        ids, texts = B.docs_of(table)
        doc = _ids(ids)
        first_parts, second = [], {}
        for bucket, kind, part in parts:
            if kind == 9:
                key, raw = B.unpack(part)
                first_parts.append((int(key[0]), int(key[1]), raw.tobytes()))
            else:
                second[bucket, kind] = part
        found, keep, hot, least = self._boxes(texts, doc, first_parts)
        box, mask = self._surroundings(texts, found, keep)
        own, hashed = doc[found.text[keep]], found.hash[keep]
        few, bits = np.flatnonzero(~hot), np.zeros(len(keep), np.uint32)
        pick, at = self._unique(box[few], mask[few], hashed[few], own[few])
        early = np.zeros(len(pick), np.uint32)
        order, cuts = B.by_bucket(_bucket(hashed[few][pick], self.buckets))
        for bucket, a, b in cuts:
            early[order[a:b]] = B.unpack(second[bucket, 1])[0]
        bits[few] = np.where(own[few] > own[few][pick][at], mask[few].astype(np.uint32), early[at])
        if hot.any():
            row, offset, high, _, first, at = self._single(box[hot], mask[hot], own[hot])
            seen = np.zeros(len(first), bool)
            order, cuts = B.by_bucket(_bucket(high[first], self.buckets))
            for bucket, a, b in cuts:
                seen[order[a:b]] = np.unpackbits(B.unpack(second[bucket, 5])[0], count=b - a)
            gone = np.flatnonzero(seen[at] | (own[hot][row] > own[hot][row[first]][at]))
            np.bitwise_or.at(bits, np.flatnonzero(hot)[row[gone]], np.uint32(1) << offset[gone].astype(np.uint32))
        hit = np.flatnonzero(bits)
        starts: dict[int, list[np.ndarray]] = {}
        for offset in range(self.offsets):
            row = hit[(bits[hit] >> np.uint32(offset)) & np.uint32(1) == 1]
            text, window = found.text[keep][row], found.place[keep][row] - offset
            if not len(row):
                continue
            cut = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            for a, b in zip(cut, [*cut[1:], len(row)], strict=True):
                starts.setdefault(int(text[a]), []).append(window[a:b])
        first_of = {}
        out = []
        for i, t in enumerate(texts):
            size = len(t or b"")
            if size >= self.width and doc[i] > least[i]:
                out.append(np.array([[0, size]]))
                continue
            source = i
            if size >= self.width:
                source = first_of.setdefault(t, i)
            windows = starts.get(source)
            if not windows:
                out.append(np.zeros((0, 2), np.int64))
                continue
            w = np.sort(np.concatenate(windows))
            gap = np.flatnonzero(w[1:] > w[:-1] + self.width)
            out.append(np.stack([w[np.concatenate(([0], gap + 1))], w[np.append(gap, len(w) - 1)] + self.width], axis=1))
        return ids, texts, out


def kept_bytes(text: bytes | None, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append((text or b"")[at:a])
        at = b
    return b"".join([*out, (text or b"")[at:]])


def _without_cut_points(kept: bytes) -> bytes:
    return kept.decode("utf-8", "ignore").encode()


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, block_bytes: int = B.BLOCK_BYTES, carry: list[str] | None = None, whole_points: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (bytes):
    one row for each row of ``df``; where asked for, ``carry``: a struct of
    further columns, and ``kept`` without bytes of code points that were cut."""
    if not 8 <= anchor < width or width - anchor > 31 or anchor % 8:
        raise ValueError("anchor must be a multiple of 8 and at most 31 below width")
    n = B.pieces(B.total_bytes(df, text), block_bytes)
    sort = _Sort(width, anchor, n, hot)
    more = [F.struct(*carry).alias("carry")] if carry else []
    docs = B.dealt(df, doc_id, text, n, *more)
    first = B.answered(B.asked(docs, sort.first_ask, n), sort.first_answer, n)
    second = B.answered(B.asked_again(docs, first, sort.second_ask, n), sort.second_answer, n)
    shown = _without_cut_points if whole_points else bytes

    def finish(table, parts):
        ids, texts, spans = sort.spans(table, parts)
        out = [ids, [len(t or b"") for t in texts], [int((s[:, 1] - s[:, 0]).sum()) for s in spans], [[{"begin": a, "end": b} for a, b in s.tolist()] for s in spans], [shown(kept_bytes(t, s)) for t, s in zip(texts, spans, strict=True)]]
        return [*out, B.docs_of(table, "carry")[2]] if carry else out

    schema, arrow = SCHEMA, _ARROW
    if carry:
        kind = df.select(*more).schema["carry"].dataType
        schema, arrow = f"{SCHEMA}, carry {kind.simpleString()}", _ARROW.append(pa.field("carry", to_arrow_type(kind)))
    return B.met(docs, second, finish, schema, arrow)
