"""Each stage of the pipeline on its own input, against brute force."""

import re

import numpy as np
import pytest
from corpus import corpus
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402
from inventra.llm.queries import tokenizer_json  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t, *_ in corpus(5, 48)]
    junk = [(5000 + i, " ".join(["junk***!!"] * 40), "en", "s", 0) for i in range(12)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, t, *_ in rows if i is not None and t] + [(r[0], 0, 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leak = next(t for _, t, *_ in rows if t and len(t) > 300 and "\n" in t)
    spark.createDataFrame([(1, leak[:120])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def edits(item, text):
    """Fewest edits between the item and any part of the text."""
    item, data = item.encode(), np.frombuffer(text.encode(), np.uint8)
    step = np.arange(len(data) + 1)
    row = np.zeros(len(data) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (data != c))))
        row = np.minimum.accumulate(new - step) + step
    return row.min()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]
    one = P.quality(spark, docs, folder)
    assert one.columns == docs.columns
    kept = rows(one)
    assert not any(i is not None and i >= 5000 for i, _ in kept) and len(kept) > 30

    two = P.near_duplicates(spark, one, folder)
    assert two.columns == docs.columns
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [(i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := low(t)) else set(), t) for i, t in kept]
    up = {i: i for i, _, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a, _ in sets:
        for j, b, _ in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    # All different texts of the smallest id of a group stay; rows without id stay as they are.
    want = {(i, t) for i, _, t in sets if i is not None and find(i) == i}
    want = sorted([*want, *((None, t) for i, _, t in sets if i is None)], key=str)
    assert rows(two) == want

    three = P.repeats(spark, two, folder)
    raw = [(i, (t or "").encode()) for i, t in rows(two)]
    order = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in raw:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], 2**63), order(i))
    want = []
    for i, t in raw:
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < order(i):
                gone.update(range(p, p + 50))
        left = bytes(b for p, b in enumerate(t) if p not in gone).decode("utf-8", "ignore")
        if left:
            want.append((i, left))
    assert rows(three) == sorted(want, key=str) and three.columns == docs.columns
    assert three.where("n_chars <> length(text)").count() == 0

    four = P.decontaminate(spark, three, folder)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    plain = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[\x20\x09-\x0D]+", " ", t)).strip()
    clean = lambda t: edits(plain(item), plain(t)) > len(plain(item).encode()) * 7 // 100
    assert rows(four) == [r for r in rows(three) if clean(r[1])]
    assert len(rows(four)) < len(rows(three))
    # A leaking row without id goes, another row without id and a clean text of the same id stay.
    more = spark.createDataFrame([(None, item, "en", "s", 1), (None, "clean enough", "en", "s", 1), (7, item, "en", "s", 1), (7, "clean as well", "en", "s", 1)], docs.schema)
    assert rows(P.decontaminate(spark, more, folder)) == sorted([(None, "clean enough"), (7, "clean as well")], key=str)

    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json())
    got = {(r["doc_id"], r["n_tokens"]) for r in P.encode(spark, four, folder).collect()}
    assert got == {(i, len(made.encode(t, add_special_tokens=False).ids)) for i, t in rows(four)}


def test_empty_tables(spark, folder, tmp_path):
    """Each stage, and the whole, on a table without rows."""
    d = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, d)
        assert got.count() == 0 and (k == len(P.STAGES) - 1 or got.columns == docs.columns)
    assert P.run(spark, d).count() == 0


def test_run(spark, folder):
    got = P.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 5
    assert got.where(F.length("ids_sha256") != 64).count() == 0
