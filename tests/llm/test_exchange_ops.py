"""The operators on blocks and buckets, against brute force."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, corpus
from pyspark.sql import functions as F

from inventra.llm.bpe import checked, encode_decode
from inventra.llm.jaccard_join import divide_skip, jaccard_components, merged, overlap
from inventra.llm.katz import Words, discounts, katz_scores
from inventra.llm.queries import remainder, tokenizer_json
from inventra.llm.repeats import radix_order, repeated_spans

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def low(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = low(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(params=[4096, 2], ids=["one_hop", "two_hops"])
def hops(request, monkeypatch):
    """Whether rows go straight to their bucket or by groups."""
    monkeypatch.setattr("inventra.llm.blocks.HOP", request.param)


@pytest.mark.parametrize(("k", "percent", "cell", "block"), [(4, 85, 4096, 10**7), (4, 85, 3, 4000), (2, 50, 5, 4000), (1, 30, 7, 4000), (4, 100, 9, 4000)])
def test_jaccard(docs, hops, k, percent, cell, block):
    sets = [(i, shingle_set(t, k)) for i, t, *_ in ROWS]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    expected = Counter((i, len(s), None if i is None else find(i)) for i, s in sets)
    got = jaccard_components(docs, k=k, percent=percent, cell=cell, block_bytes=block).collect()
    assert Counter(tuple(r) for r in got) == expected


@pytest.mark.parametrize("seed", range(8))
def test_divide_skip(seed):
    rng = np.random.default_rng(seed)
    sets = [sorted(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(60)]
    index: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            index.setdefault(t, []).append(i)
    for percent in (20, 50, 80, 100):
        for q in [*sets[:20], list(range(0, 40, 2)), [99]]:
            want = [i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= percent * len(set(q) | set(s))]
            assert list(divide_skip(q, index, [len(s) for s in sets], percent)) == want
    lists = [sorted(rng.choice(50, rng.integers(0, 20), replace=False).tolist()) for _ in range(9)]
    for least in range(1, 10):
        many = Counter(x for one in lists for x in one)
        assert list(merged(lists, least)) == sorted((x, n) for x, n in many.items() if n >= least)
    a, b = (np.unique(rng.integers(0, 90, 40)).astype(np.uint64) for _ in range(2))
    assert overlap(a, b) == overlap(b, a) == len(np.intersect1d(a, b)) and overlap(a, b[:0]) == 0


@pytest.mark.parametrize("seed", range(6))
def test_radix_order(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 3, (200, [3, 8, 9, 26, 50, 17][seed])).astype(np.uint8)
    rows[100:] = rows[rng.integers(0, 100, 100)]
    order, common = radix_order(rows)
    held = [bytes(rows[i]) for i in order]
    assert held == sorted(held)
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
    assert common.tolist() == [0, *(same(a, b) for a, b in zip(held, held[1:], strict=False))]
    assert len(radix_order(rows[:0])[0]) == 0


@pytest.mark.parametrize(("block", "hot"), [(10**7, 4096), (3000, 4096), (3000, 0), (3000, 2)])
def test_repeats(docs, hops, block, hot):
    width = 50
    raw = [(i if i is not None else -math.inf, (t or "").encode()) for i, t, *_ in ROWS]
    least = {}
    for i, t in raw:
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            least[w] = min(least.get(w, math.inf), i)
    expected = Counter()
    for i, t in raw:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if least[t[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        expected[(i if i != -math.inf else None, len(t), sum(gone), runs, kept)] += 1
    got = repeated_spans(docs, block_bytes=block, hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == expected


@pytest.mark.parametrize("block", [10**7, 3000])
def test_bpe(docs, hops, block):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json())
    expected = Counter()
    for i, t, *_ in ROWS:
        ids = made.encode(t or "", add_special_tokens=False).ids
        expected[(i, b"".join(x.to_bytes(4, "little") for x in ids), len(ids), made.decode(ids, skip_special_tokens=False))] += 1
    got = encode_decode(docs, tokenizer_json(), block_bytes=block).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in got) == expected


def test_bpe_refuses_what_it_cannot_encode(docs):
    good = json.loads(tokenizer_json())
    assert checked(json.dumps(good))
    bad = [{"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": " "}},
           {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[a-z]+ ?"}, "behavior": "Removed", "invert": True}}, {"added_tokens": [{**good["added_tokens"][0], "lstrip": True}]}]
    for change in bad:
        with pytest.raises(ValueError):
            checked(json.dumps(good | change))
    with pytest.raises(ValueError):
        encode_decode(docs, tokenizer_json("byte_bpe_50k.json"))


class BruteKatz:
    """The model over texts, from counters."""

    def __init__(self, train, order=3):
        self.order = order
        self.words, self.pairs, self.triples = Counter(), Counter(), Counter()
        for t in train:
            own = ["", *low(t), ""]
            self.words.update(own[1:])
            self.pairs.update(zip(own, own[1:], strict=False))
            self.triples.update(zip(own, own[1:], own[2:], strict=False))
        self.n = sum(self.words.values())
        many = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, 7)])
        self.model = Words(np.array([self.n, len(self.words), *many(self.words)]))
        self.d2, self.d3 = discounts(many(self.pairs)), discounts(many(self.triples), 2)
        self.size, self.after, self.after2 = Counter(), {}, {}
        for (v, w), c in self.pairs.items():
            self.size[v] += c
            self.after.setdefault(v, {})[w] = c
        for (u, v, w), c in self.triples.items():
            if c >= 2 and order == 3:
                self.after2.setdefault((u, v), {})[w] = c

    def p1(self, w):
        return float(self.model.p(np.array([self.words[w]]))[0])

    @staticmethod
    def backed(count, held, d, size, lower, w):
        use = lambda c: c * (d[c] if c <= 5 else 1)
        left = 1 - sum(map(use, held.values())) / size
        scale, left = (1, left) if left > 1e-9 else (size / (size + 1), 1 / (size + 1))
        return scale * use(count) / size if count else left / (1 - sum(map(lower, held))) * lower(w)

    def p2(self, v, w):
        if not self.size[v]:
            return self.p1(w)
        return self.backed(self.pairs[(v, w)], self.after[v], self.d2, self.size[v], self.p1, w)

    def p3(self, u, v, w):
        held = self.after2.get((u, v))
        if not held:
            return self.p2(v, w)
        return self.backed(held.get(w, 0), held, self.d3, self.pairs[(u, v)], lambda x: self.p2(v, x), w)

    def score(self, text):
        own = ["", *low(text), ""]
        out = math.log10(self.p2(own[0], own[1]))
        return out + sum(math.log10(self.p3(*x)) for x in zip(own, own[1:], own[2:], strict=False))


@pytest.mark.parametrize(("order", "block"), [(3, 10**7), (3, 3000), (3, 800), (2, 10**7), (2, 800)])
def test_katz(docs, hops, order, block):
    """All columns against brute force, whatever the size of blocks."""
    got = katz_scores(docs, remainder(5) != 1, order=order, block_bytes=block).collect()
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    brute = BruteKatz([t for i, t, *_ in ROWS if trained(i)], order)
    assert {(r.train_tokens, r.train_words) for r in got} == {(brute.n, len(brute.words))}
    want = []
    for i, t, *_ in ROWS:
        own = low(t) + [""]
        want.append((i, trained(i), len(own), sum(w in brute.words for w in own), round(sum(math.log10(brute.words[w] + 0.5) for w in own), 6), brute.score(t)))
    key = lambda r: (str(r[:5]), r[5])
    found = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, round(r.base_sum, 6), r.score) for r in got), key=key)
    want.sort(key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for x, y in zip(found, want, strict=True):
        assert abs(x[5] - y[5]) < 1e-5 * x[2] + 1e-6


def test_katz_contexts_sum_to_one(spark):
    """Every context's probabilities over all words and the unseen symbol sum to one."""
    train = ["a b a b a c", "b b a", "a a d e", "c a b", "x y", "a b a d", "c a b", *["q r"] * 9]
    brute = BruteKatz(train)
    vocabulary = sorted({w for t in train for w in t.split()})
    every = ["", *vocabulary, "zz"]
    assert abs(sum(map(brute.p1, every)) - 1) < 1e-12
    for v in every:
        assert abs(sum(brute.p2(v, w) for w in every) - 1) < 1e-9
        for u in every:
            assert abs(sum(brute.p3(u, v, w) for w in every) - 1) < 1e-9
    probes = [f"{u} {v} {w}" for u in ("a", "c", "q", "zz") for v in [*vocabulary, "zz"] for w in [*vocabulary, "zz"]]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(1000 + i, t, False) for i, t in enumerate(probes)]
    one = {r.doc_id: r.score for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train")).collect()}
    for i, t in enumerate(probes):
        assert abs(one[1000 + i] - brute.score(t)) < 1e-5


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(none).count() == 0
    assert repeated_spans(none).count() == 0
    assert encode_decode(none, tokenizer_json()).count() == 0
    assert katz_scores(none, remainder(5) != 1).count() == 0


def test_all_null(spark):
    none = spark.createDataFrame([(None, None, 1, "p", None)] * 2, SCHEMA)
    assert [tuple(r) for r in jaccard_components(none).collect()] == [(None, 0, None)] * 2
    assert [r.n_removed for r in repeated_spans(none).collect()] == [0, 0]
    assert [r.n_tokens for r in encode_decode(none, tokenizer_json()).collect()] == [0, 0]
    assert [(r.n_tokens, r.score) for r in katz_scores(none, remainder(5) != 1).collect()] == [(1, 0.0)] * 2


def test_repeats_without_cut_code_points(spark):
    # The repeat ends within the two bytes of the last letter: é and è share the first.
    shared = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUV"
    docs = spark.createDataFrame([(1, shared + "é"), (2, shared + "è tail"), (3, None), (4, "")], "doc_id long, text string")
    plain = {r.doc_id: bytes(r.kept) for r in repeated_spans(docs).collect()}
    whole = {r.doc_id: bytes(r.kept) for r in repeated_spans(docs, whole_points=True).collect()}
    assert plain[2] == b"\xa8 tail" and whole[2] == b" tail"
    assert whole[1] == plain[1] == (shared + "é").encode()
    assert whole[3] == whole[4] == b""


@pytest.mark.parametrize("block", [10**7, 2500])
def test_katz_split_contexts(spark, block):
    """Also where contexts lie in many buckets: the end and "a" have over 1000
    tokens each, and so has the pair of both; no block gives other scores."""
    train = [f"a b{i % 300} c{i % 170} d{i % 97}" for i in range(1300)] + [f"e{i} f{i % 9} g{i % 40}" for i in range(200)] + [f"a h{i % 3}" for i in range(30)]
    held = ["a b5 c5 d5", "a c9 x", "e3 f3 g3", "c7 d7 a", "b1 b2", "", "a a", "a h1", "a h2 b5", "x a b7", "a zz"]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(5000 + i, t, False) for i, t in enumerate(held)]
    one = {r.doc_id: r.score for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3), F.col("train"), block_bytes=block).collect()}
    brute = BruteKatz(train)
    assert brute.size["a"] > 1000 and brute.pairs[("", "a")] > 1000
    for i, t in enumerate(held):
        assert abs(one[5000 + i] - brute.score(t)) < 1e-5
