"""Katz backoff language model over words, pairs and triples of words.

``P(w | u v)`` is the discounted relative frequency of the triple where training
text has it twice or more, else ``alpha(u v) * P(w | v)``; ``P(w | v)`` likewise,
of pairs that training text has at all, else ``alpha(v) * P(w)``; ``P(w)`` is the
discounted relative frequency of the word, or for a word that training text lacks
the mass that discounting left (all such words are one symbol).  Counts up to 5
are discounted by Good-Turing from the counts of counts of all words, of all
pairs, of all triples; triples seen once are left to the pairs, as Katz did.
``alpha`` is worked out from the very probabilities that are used, so each context
sums to one.  A context without anything discounted keeps ``1 / (count + 1)`` for
the rest.  A text's first word follows the end of a text, and has no triple.

Tables are kept in buckets by context.  Blocks ask for the counts of their words,
which a bucket numbers from the commonest, so that what follows names words by
small numbers; with these for the counts of their pairs; with these for those of
triples both of whose pairs stand twice or more.  A context with over one token
in ``SPLIT`` is spread over many buckets by its second word.  Buckets read what
they are asked twice: first for the counts of counts and the sums of split
contexts, which are added up over all buckets (one row, and one for each split
context, of which there are at most ``SPLIT``), then, told of these, to answer.
Nothing depends on how many blocks there are.

Defined results: a null or empty text is its end alone.  A row without doc_id
has no checksum: it is never trained on and counts as not held out.  Rows of
one doc_id count each.  Without any training text every word is unseen: the
model gives probability one to its single symbol.  An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.llm import blocks as B
from inventra.llm.words import U, mix, slices, word_hashes

CUT = 5
SPLIT = 2000
#: Blocks that share a bucket: fewer buckets than blocks, as each part has a
#: table of words of its own.
SHARED = 2
#: How often training text must have a pair, and a triple.
LEAST = {2: 1, 3: 2}
END = U(0x5EED0FE0D)
_GOLD = U(0x9E3779B97F4A7C15)
_BITS = U(32)
_STATS = pa.schema([("n", pa.int64()), ("v", pa.int64()), *((f"n{r}", pa.int64()) for r in range(1, CUT + 2))])
#: A bucket's counts of counts (context null), or a split context's in it: how
#: many entries have count 1..6, tokens of those with more than ``CUT``, the
#: entries' share of the lower order (in units of 1 / ONE, so that sums don't
#: depend on order), tokens in all.
_SUMS = pa.schema([("context", pa.int64()), *((f"n{r}", pa.int64()) for r in range(1, CUT + 2)), ("often", pa.int64()), ("share", pa.int64()), ("size", pa.int64())])
ONE = 2.0**52
SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, base_sum double, score double, train_tokens long, train_words long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64()), ("train_tokens", pa.int64()), ("train_words", pa.int64())])
# Kinds of rows: answers about words, pairs and triples; what all blocks are told.
WORD, PAIR, TRIPLE, STATS, PAIRS, TRIPLES = 1, 2, 3, 11, 12, 13


def discounts(n: np.ndarray, least: int = 1) -> np.ndarray:
    """Factors for counts 0..5 (0 stands for nothing) from how many items have
    count 1..6: Katz's, or where they aren't between 0 and 1, absolute ones.
    Where counts below ``least`` stand for nothing, Turing's estimate as it is."""
    n = np.asarray(n, np.float64)
    out = np.ones(CUT + 1)
    out[:least] = 0.0 if least > 1 else 1.0
    if n[least - 1] <= 0:
        return out
    far = (CUT + 1) * n[CUT] / n[0] if least == 1 else 0.0
    step = n[least - 1] / (n[least - 1] + 2 * n[least]) if n[least] else 0.5
    for r in range(least, CUT + 1):
        turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        d = (turing - far) / (1 - far) if far < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - min(step, 0.9)) / r
    return out


def used(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return count * np.where(count <= CUT, d[np.minimum(count, CUT)], 1.0)


class Words:
    """P(w) from training counts."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v = int(stats[0]), int(stats[1])
        counts = np.asarray(stats[2 : CUT + 3], np.float64)
        self.d = discounts(counts)
        lost = float(np.sum(counts[:CUT] * np.arange(1, CUT + 1) * (1 - self.d[1:])))
        self.total = self.n + (0 if lost > 0 else 1)
        self.unseen = ((lost if lost > 0 else 1) / self.total) if self.n else 1.0
        #: A context with more tokens is split.
        self.hot = max(self.n // SPLIT, 1000)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, used(count, self.d) / max(self.total, 1), self.unseen)


def given(count: np.ndarray, size: np.ndarray, none: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probability of what a context of ``size`` tokens has ``count`` times."""
    return used(count, d) / np.maximum(size, 1) * np.where(none, size / (size + 1.0), 1.0)


def backoff(mass: np.ndarray, share: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of alpha of a context whose entries have ``mass`` of discounted
    counts and ``share`` of the lower order; and whether nothing was discounted."""
    left = 1 - mass / np.maximum(size, 1)
    none = left < 1e-9
    left = np.where(none, 1 / (size + 1.0), left)
    # What no context has is left in the lower order, so 1 - share is above nought but for rounding.
    return (np.log10(left) - np.log10(np.maximum(1 - share, 1e-15))).astype(np.float32), none


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with an end after each text, and how many each text has."""
    tokens, sizes = [], []
    for a, b in slices(texts):
        word, first = word_hashes(texts[a:b])
        tokens.append(np.insert(word, first[1:], END))
        sizes.append(np.diff(first) + 1)
    return np.concatenate(tokens), np.concatenate(sizes)


def _cuts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)


def _sizes(cut: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(cut, n))


def _sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each entry's total over equal keys, and a place and total of each distinct
    one, in order of the keys."""
    order = np.argsort(key)
    held = key[order]
    cut = _cuts(held)
    total = np.add.reduceat(count[order].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
    each = np.empty(len(key), np.int64)
    each[order] = np.repeat(total, _sizes(cut, len(held)))
    return each, order[cut], total


def _name(context: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(context + mix(second * _GOLD + U(1)))


class Block:
    """A block's tokens, and step by step what the buckets answered."""

    def __init__(self, texts: list[bytes | None], train: list[bool]):
        token, self.size = _tokens(texts)
        self.trained = np.repeat(np.array(train, bool), self.size)
        self.word, self.token = np.unique(token, return_inverse=True)

    def word_rows(self, block: int, n: int):
        count = np.bincount(self.token[self.trained], minlength=len(self.word))
        order, cuts = B.by_bucket(self.word % U(n))
        for bucket, a, b in cuts:
            # Hashes of one remainder rise as their quotients do.
            yield bucket, block, 0, B.pack(*B.steps(self.word[order[a:b]] // U(n)), B.small(count[order[a:b]]))

    def know_words(self, told: dict[int, bytes], n: int) -> None:
        """Words' totals and numbers; from here on the commonest words come first."""
        total, number = np.empty(len(self.word), np.int64), np.empty(len(self.word), U)
        order, cuts = B.by_bucket(self.word % U(n))
        for bucket, a, b in cuts:
            count, first, step = B.unpack(told[bucket])
            total[order[a:b]] = count
            number[order[a:b][np.argsort(-count.astype(np.int64), kind="stable")]] = B.risen(first, step) | (U(bucket) << _BITS)
        end = int(np.searchsorted(self.word, END))
        # The commonest first: what follows names words by their place in tables in this order.
        order = np.lexsort((number, -total))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number, self.total, self.token, self.end = number[order], total[order], rank[self.token], int(rank[end])
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[0] = self.end
        pair, self.place = np.unique(before * len(self.number) + self.token, return_inverse=True)
        self.first, self.second = np.divmod(pair, len(self.number))

    def pair_cuts(self, words: Words, n: int):
        bucket = self.number[self.first] >> _BITS
        hot = self.total[self.first] > words.hot
        bucket[hot] = U(n) + _name(self.number[self.first[hot]], self.number[self.second[hot]]) % U(n)
        return B.by_bucket(bucket)

    def pair_rows(self, block: int, words: Words, n: int):
        count = np.bincount(self.place[self.trained], minlength=len(self.first))
        order, cuts = self.pair_cuts(words, n)
        for bucket, a, b in cuts:
            at = order[a:b]
            run = _cuts(self.first[at])
            context = self.first[at][run]
            held, place = np.unique(self.second[at], return_inverse=True)
            yield bucket, block, 0, B.pack(*B.steps(self.number[context]), B.small(_sizes(run, len(at))), B.small(self.total[context]), *B.steps(self.number[held]), B.small(self.total[held]), B.small(place), B.small(count[at]))

    def know_pairs(self, told: dict[int, bytes], words: Words, n: int) -> None:
        self.pair_total = np.empty(len(self.first), np.int64)
        self.alpha, self.none = np.zeros(len(self.number), np.float32), np.zeros(len(self.number), bool)
        order, cuts = self.pair_cuts(words, n)
        for bucket, a, b in cuts:
            at = order[a:b]
            total, alpha, none = B.unpack(told[bucket])
            self.pair_total[at] = total
            run = _cuts(self.first[at])
            context = self.first[at][run]
            self.none[context] |= np.unpackbits(none, count=len(run)).astype(bool)
            self.alpha[context[np.add.reduceat(total == 0, run) > 0]] = alpha

    def triples(self) -> None:
        """Contexts (pairs that stand twice or more) with the pairs that follow
        them, both as places among the block's pairs."""
        first = np.zeros(len(self.token), bool)
        first[np.cumsum(self.size) - self.size] = True
        self.at = np.flatnonzero(~first)
        before, here = self.place[self.at - 1], self.place[self.at]
        # In order of the middle word, the first and the last.
        words = len(self.number)
        middle = np.argsort(self.second * words + self.first)
        by_middle = np.empty(len(middle), np.int64)
        by_middle[middle] = np.arange(len(middle))
        code, self.triple = np.unique(by_middle[before] * len(self.first) + here, return_inverse=True)
        context, self.follow = np.divmod(code, len(self.first))
        self.context = middle[context]
        self.asked = self.pair_total[self.context] >= LEAST[3]
        # A triple can only stand so often when both its pairs do.
        self.entry = self.asked & (self.pair_total[self.follow] >= LEAST[3])

    def triple_cuts(self, words: Words, n: int):
        """Triples that are asked about, by bucket, in order of context; those
        that can't be entries ask for their context alone.  Contexts of a rarer
        middle word are in that word's bucket."""
        own = np.flatnonzero(self.asked)
        context = self.context[own]
        v = self.second[context]
        name = _name(self.number[self.first[context]], self.number[v])
        bucket = np.where(self.total[v] > words.hot, name % U(n), self.number[v] >> _BITS)
        hot = self.pair_total[context] > words.hot
        bucket[hot] = U(n) + _name(name[hot], np.where(self.entry[own[hot]], self.number[self.second[self.follow[own[hot]]]], U(0))) % U(n)
        order, cuts = B.by_bucket(bucket)
        return own[order], cuts

    def triple_rows(self, block: int, words: Words, n: int):
        count = np.bincount(self.triple[self.trained[self.at]], minlength=len(self.context))
        order, cuts = self.triple_cuts(words, n)
        for bucket, a, b in cuts:
            at = order[a:b]
            run = _cuts(self.context[at])
            entry = self.entry[at]
            many = np.add.reduceat(entry.astype(np.int64), run)
            pair, own = self.context[at][run], at[entry]
            u, v, w = self.first[pair], self.second[pair], self.second[self.follow[own]]
            held, place = np.unique(np.concatenate((u, w)), return_inverse=True)
            cut = _cuts(v)
            middle = v[cut]
            rest = many < _sizes(run, len(at))
            yield bucket, block, 0, B.pack(*B.steps(self.number[held]), *B.steps(self.number[middle]), B.small(self.total[middle]), np.packbits(self.none[middle]), B.small(_sizes(cut, len(v))), B.small(place[: len(u)]), B.small(many), B.small(self.pair_total[pair]), np.packbits(rest), B.small(place[len(u) :]), B.small(self.pair_total[self.follow[own]]), B.small(count[own]))

    def log_p(self, told: dict[int, bytes], words: Words, d2: np.ndarray, d3: np.ndarray, n: int, highest: int) -> np.ndarray:
        """log10 of the probability of each token, order by order."""
        with np.errstate(divide="ignore"):
            word = np.log10(words.p(self.total))
            seen = np.log10(given(self.pair_total, self.total[self.first], self.none[self.first], d2))
            pair = np.where(self.pair_total >= LEAST[2], seen, self.alpha[self.first] + word[self.second])
            if highest == 2:
                return pair[self.place]
            self.triples()
            triple = pair[self.follow]
            order, cuts = self.triple_cuts(words, n)
            for bucket, a, b in cuts:
                at = order[a:b]
                total, alpha, none = B.unpack(told[bucket])
                run = _cuts(self.context[at])
                many = _sizes(run, len(at))
                count = np.zeros(len(at), np.int64)
                count[self.entry[at]] = total
                wants = np.add.reduceat((count == 0).astype(np.int64), run) > 0
                each = np.zeros(len(run), np.float32)
                each[wants] = alpha
                none = np.unpackbits(none, count=len(run)).astype(bool)
                own = np.log10(given(count, self.pair_total[self.context[at]], np.repeat(none, many), d3))
                triple[at] = np.where(count > 0, own, np.repeat(each, many) + triple[at])
        out = pair[self.place]
        out[self.at] = triple[self.triple]
        return out


# --- buckets ---------------------------------------------------------------


def _word_parts(parts):
    got = [(block, B.risen(first, step), count) for block, (first, step, count) in ((block, B.unpack(p)) for block, p in parts)]
    return got, *_sums(np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))


def _word_answer(parts):
    """Counts, and words' numbers in the bucket, from the commonest; numbers are
    listed in order of the counts, in which they rise."""
    got, each, pick, total = _word_parts(parts)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    held = np.concatenate([g[1] for g in got])
    number = rank[np.searchsorted(held[pick], held)]
    at = 0
    for block, q, _ in got:
        count = each[at : at + len(q)]
        yield block, WORD, B.pack(B.small(count), *B.steps(number[at : at + len(q)][np.argsort(-count, kind="stable")]))
        at += len(q)


def _word_stats(table: pa.Table) -> pa.Table:
    parts, _ = B.asks_of(table)
    if not parts:
        return _STATS.empty_table()
    _, _, _, total = _word_parts(parts)
    found = [int(total.sum()), int((total > 0).sum()), *(int((total == r).sum()) for r in range(1, CUT + 2))]
    return pa.Table.from_arrays([pa.array([x], pa.int64()) for x in found], schema=_STATS)


@dataclass
class Asked:
    """What a block asks a bucket: contexts, how many entries each has, tokens
    and whether alpha is wanted in any case; the entries' second words, lower
    probabilities and counts in the block."""

    context: np.ndarray
    many: np.ndarray
    size: np.ndarray
    wants: np.ndarray
    second: np.ndarray
    lower: np.ndarray
    count: np.ndarray


def _pairs_of(part: bytes, told: list[np.ndarray]) -> Asked:
    words = Words(told[0])
    c1, c2, many, size, w1, w2, total, place, count = B.unpack(part)
    return Asked(B.risen(c1, c2), many.astype(np.int64), size.astype(np.int64), np.zeros(len(many), bool), B.risen(w1, w2)[place], words.p(total.astype(np.int64))[place], count)


def _triples_of(part: bytes, told: list[np.ndarray]) -> Asked:
    w1, w2, v1, v2, total, none, each, u, many, size, rest, w, pair, count = B.unpack(part)
    number, many = B.risen(w1, w2), many.astype(np.int64)
    middle = np.repeat(np.arange(len(each)), each)
    context = _name(number[u], B.risen(v1, v2)[middle])
    middle = np.repeat(middle, many)
    none = np.unpackbits(none, count=len(each)).astype(bool)
    lower = given(pair.astype(np.int64), total.astype(np.int64)[middle], none[middle], told[1])
    return Asked(context, many, size.astype(np.int64), np.unpackbits(rest, count=len(many)).astype(bool), number[w], lower, count)


class Level:
    """Pairs or triples of words in the buckets of their contexts."""

    def __init__(self, order: int, n: int):
        self.order, self.least, self.n = order, LEAST[order], n
        self.read = _pairs_of if order == 2 else _triples_of

    def _merged(self, parts, told):
        """What a bucket is asked; each entry's total; and of each distinct entry
        that training text has often enough the context, total and lower probability."""
        got = [self.read(p, told) for _, p in parts]
        context = np.concatenate([np.repeat(g.context, g.many) for g in got])
        each, pick, total = _sums(_name(context, np.concatenate([g.second for g in got])), np.concatenate([g.count for g in got]))
        pick, total = pick[total >= self.least], total[total >= self.least]
        return got, each, context[pick], total, np.concatenate([g.lower for g in got])[pick]

    def sums(self, asks: pa.Table, told: list[np.ndarray]) -> pa.Table:
        """Rows of _SUMS for a bucket, and for each split context in it."""
        parts, _ = B.asks_of(asks)
        if not parts:
            return _SUMS.empty_table()
        got, _, context, total, lower = self._merged(parts, told)
        out = [(None, *(int((total == r).sum()) for r in range(1, CUT + 2)), 0, 0, 0)]
        if asks["bucket"][0].as_py() >= self.n:
            names, at = np.unique(context, return_inverse=True)
            many = [np.bincount(at[total == r], minlength=len(names)) for r in range(1, CUT + 2)]
            often = np.bincount(at, np.where(total > CUT, total, 0), len(names))
            share = np.bincount(at, lower, len(names))
            size = dict(zip(np.concatenate([g.context for g in got]).tolist(), np.concatenate([g.size for g in got]).tolist(), strict=True))
            out += [(int(h.astype(np.int64)), *(int(m[i]) for m in many), int(often[i]), int(np.rint(share[i] * ONE)), size[int(h)]) for i, h in enumerate(names)]
        return B.freed(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SUMS))

    def told(self, sums: pa.Table) -> bytes:
        """The discounts, and the split contexts with log10 of alpha and whether
        nothing of them was discounted."""
        rows = sorted(zip(*(c.to_pylist() for c in sums.columns), strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
        whole = [r for r in rows if r[0] is None]
        split = np.array([r for r in rows if r[0] is not None], np.int64).reshape(-1, len(_SUMS))
        d = discounts(np.array(whole[0][1 : CUT + 2] if whole else [0] * (CUT + 1)), self.least)
        mass = split[:, 1 : CUT + 1] @ (np.arange(1, CUT + 1) * d[1:]) + split[:, CUT + 2]
        alpha, none = backoff(mass, split[:, CUT + 3] / ONE, split[:, CUT + 4])
        names = split[:, 0].astype(U)
        order = np.argsort(names)
        return B.pack(d, names[order], alpha[order], none[order].astype(np.uint8))

    def answer(self, parts, told: list[np.ndarray], own: list[np.ndarray]):
        """For the block: the counts of its entries (0 where training text hasn't
        them often enough), alpha of contexts that have such, or ask for it, and
        whether nothing of a context was discounted."""
        d, split, split_alpha, split_none = own
        hot = Words(told[0]).hot
        got, each, context, total, lower = self._merged(parts, told)
        names, at = np.unique(context, return_inverse=True)
        mass, share = np.bincount(at, used(total, d), len(names)), np.bincount(at, lower, len(names))
        begin = 0
        for (block, _), g in zip(parts, got, strict=True):
            count = each[begin : begin + len(g.second)]
            begin += len(g.second)
            count = np.where(count >= self.least, count, 0)
            alpha, none = np.zeros(len(g.context), np.float32), np.zeros(len(g.context), bool)
            known, value, flag = np.zeros(len(g.context), bool), None, None
            for names_of, use in ((split, g.size > hot), (names, g.size <= hot)):
                spot = np.searchsorted(names_of, g.context)
                known = use & (spot < len(names_of))
                known[known] = names_of[spot[known]] == g.context[known]
                spot = spot[known]
                if names_of is split:
                    value, flag = split_alpha[spot], split_none[spot].astype(bool)
                else:
                    value, flag = backoff(mass[spot], share[spot], g.size[known])
                alpha[known], none[known] = value, flag
            run = np.repeat(np.arange(len(g.context)), g.many)
            wants = g.wants | (np.bincount(run[count == 0], minlength=len(g.context)) > 0)
            yield block, PAIR if self.order == 2 else TRIPLE, B.pack(B.small(count), alpha[wants], np.packbits(none))


def _arrays(part: bytes) -> list[np.ndarray]:
    return B.unpack(part)


def _kinds(parts) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {k: {} for k in (WORD, PAIR, TRIPLE, STATS, PAIRS, TRIPLES)}
    for bucket, kind, part in parts:
        out[kind][bucket] = part
    return out


def _factors(told: dict[int, bytes], least: int) -> np.ndarray:
    """The discounts that all blocks are told; nothing is told where no bucket was asked."""
    return _arrays(told[0])[0] if told else discounts(np.zeros(CUT + 1), least)


def _known(table: pa.Table, parts, n: int, known: int):
    """A block that knows its words (1) or its pairs as well (2), and what it was told."""
    _, texts, train = B.docs_of(table, "train")
    held, kinds = Block(texts, train), _kinds(parts)
    words = Words(_arrays(kinds[STATS][0])[0])
    held.know_words(kinds[WORD], n)
    if known > 1:
        held.know_pairs(kinds[PAIR], words, n)
    return held, words, kinds


def katz_scores(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_sum (of log10(count + 0.5)), score,
    and of all training texts train_tokens and train_words (different ones), for
    each row of ``df``.  ``train`` marks the rows to learn from; null is false.
    ``order`` 2 leaves triples out."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    train = F.coalesce(train, F.lit(False))
    n = B.pieces(B.total_bytes(df, text), block_bytes)
    docs = B.dealt(df, doc_id, text, n, train.alias("train"))
    m = -(-n // SHARED)
    pairs, triples = Level(2, m), Level(3, m)

    def everyone(part: DataFrame, kind: int) -> DataFrame:
        """A row that all blocks are told."""
        return part.select(F.lit(0).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(kind).alias("kind"), "part")

    def buckets(*parts: DataFrame) -> DataFrame:
        """Rows that all buckets are told, one for each of ``parts``."""
        out = [p.select(F.explode(F.sequence(F.lit(0), F.lit(2 * m - 1))).alias("bucket"), F.lit(i).alias("which"), "part") for i, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, out)

    def heard(table: pa.Table) -> list[list[np.ndarray]]:
        return [_arrays(p) for _, p in sorted(zip(table["which"].to_pylist(), table["part"].to_pylist(), strict=True))]

    def one(sums: DataFrame, make) -> DataFrame:
        """All rows of small sums as one part."""
        return sums.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: pa.table({"part": pa.array([make(t.drop_columns("all"))], pa.binary())}), "part binary")

    def added(level: Level, asks: DataFrame, told: DataFrame, lower) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return level.sums(left, lower(heard(right))) if left.num_rows else _SUMS.empty_table()

        rows = asks.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, ", ".join(f"{f.name} long" for f in _SUMS))
        sums = rows.groupBy("context").agg(*(F.sum(f.name).alias(f.name) for f in _SUMS if f.name not in ("context", "size")), F.max("size").alias("size"))
        return one(sums, level.told)

    # Words.  All uses of what is asked read the same exchange.
    asks = B.asked(docs, lambda block, table: Block(*B.docs_of(table, "train")[1:]).word_rows(block, m), n)
    word = B.answered(asks, _word_answer, n)
    stats = asks.groupBy("bucket").applyInArrow(_word_stats, ", ".join(f"{f.name} long" for f in _STATS))
    stats = one(stats.agg(*(F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in _STATS)), lambda t: B.pack(np.array([c[0].as_py() for c in t.columns], np.int64)))
    heard_first = word.unionByName(everyone(stats, STATS))

    # Pairs.
    def ask_pairs(block, table, parts):
        held, words, _ = _known(table, parts, m, 1)
        yield from held.pair_rows(block, words, m)

    asks = B.asked_again(docs, heard_first, ask_pairs, n)
    own = added(pairs, asks, buckets(stats), lambda told: [told[0][0]])
    pair = B.answered_told(asks, buckets(stats, own), lambda parts, told: pairs.answer(parts, [told[0][0]], told[1]), heard, n)
    heard_second = heard_first.unionByName(pair).unionByName(everyone(own, PAIRS))

    def finish(table, parts):
        held, words, kinds = _known(table, parts, m, 2)
        log_p = held.log_p(kinds[TRIPLE], words, _factors(kinds[PAIRS], LEAST[2]), _factors(kinds[TRIPLES], LEAST[3]), m, order)
        ids, _, marked = B.docs_of(table, "train")
        begin = np.cumsum(held.size) - held.size
        known = np.add.reduceat((held.total[held.token] > 0).astype(np.int64), begin)
        base = np.add.reduceat(np.log10(held.total + 0.5)[held.token], begin)
        return ids, marked, held.size.tolist(), known.tolist(), base.tolist(), np.add.reduceat(log_p, begin).tolist(), [words.n] * len(ids), [words.v] * len(ids)

    if order == 2:
        return B.met(docs, heard_second, finish, SCHEMA, _ARROW)

    # Triples.
    def ask_triples(block, table, parts):
        held, words, _ = _known(table, parts, m, 2)
        held.triples()
        yield from held.triple_rows(block, words, m)

    asks = B.asked_again(docs, heard_second, ask_triples, n)
    last = added(triples, asks, buckets(stats, own), lambda told: [told[0][0], told[1][0]])
    triple = B.answered_told(asks, buckets(stats, own, last), lambda parts, told: triples.answer(parts, [told[0][0], told[1][0]], told[2]), heard, n)
    return B.met(docs, heard_second.unionByName(triple).unionByName(everyone(last, TRIPLES)), finish, SCHEMA, _ARROW)
