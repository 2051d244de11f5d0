"""Each registered query over whole tables: its contract's columns and values
against plain Python or its DuckDB twin."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from corpus import corpus
from pyspark.sql import functions as F

from inventra.llm import queries as Q
from inventra.llm.main_text import main_text

LONG = "bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t, *_ in corpus(9, 42) if i is not None]
    # One row per id, as in the tables.
    rows = list({r[0]: r for r in rows}.values())
    toxic = [(9000 + i, f"you idiot and moron number {i} are pathetic", "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(bool(r[1]) and len(r[1]) > 40), 0) for r in rows] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leak = next(t for _, t, *_ in rows if t and len(t) > 300 and "\n" in t)
    spark.createDataFrame([(1, leak[:120]), (2, "never there at all, not in any document of these")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "u1", "<article><h1>T</h1><p>One, two.</p></article><footer>f</footer>"), (2, "u2", None), (3, "u3", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def table(spark, folder, name):
    return {r[0]: r for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()}


def run(spark, folder, name, kinds):
    """The rows by their first column; it must be a key, and the columns be as given."""
    got = Q.queries()[name](spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][: len(kinds)] == kinds
    return got.collect()


def low(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op5_shards", "op9_repeats", "op10_rules", "op12_exact_dedup"])
def test_twins(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = Q.queries()[name](spark, folder)
    want = con.execute(f"select {', '.join(got.columns)} from ({Q.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


@pytest.mark.parametrize(("name", "mod", "held", "cutoff"), [("op2_quality", 5, 0, 0.3), ("op6_toxicity", 3, 1, 0.7)])
def test_scores(spark, folder, name, mod, held, cutoff):
    got = run(spark, folder, name, [("doc_id", LONG), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    docs = table(spark, folder, "documents")
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    for r in got:
        assert r.held_out == (check(r.doc_id) % mod == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff)


def test_labels_of_held_out_rows_are_never_read(spark, folder, tmp_path):
    """Other labels, sources and languages of held-out rows change no score."""
    d = str(tmp_path)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).write.parquet(f"{d}/documents.parquet")
    turned = lambda c, mod, held: F.when(Q.remainder(mod) == held, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    labels.select("doc_id", turned("quality", 5, 0), turned("toxic", 3, 1)).write.parquet(f"{d}/labels.parquet")
    for name in ("op2_quality", "op6_toxicity"):
        one, two = ({r.doc_id: round(r.score, 9) for r in Q.queries()[name](spark, x).collect()} for x in (folder, d))
        assert one == two


def test_bpe(spark, folder):
    from tokenizers import Tokenizer

    got = run(spark, folder, "op3_bpe", [("doc_id", LONG), ("n_tokens", LONG), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    made = Tokenizer.from_str(Q.tokenizer_json())
    want = {}
    for i, r in table(spark, folder, "documents").items():
        ids = made.encode(r.text or "", add_special_tokens=False).ids
        said = made.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_decontaminate(spark, folder):
    got = run(spark, folder, "op4_decontaminate", [("doc_id", LONG), ("item_id", LONG)])
    item = " ".join(low(table(spark, folder, "benchmark")[1].text))
    want = {i for i, r in table(spark, folder, "documents").items() if item in " ".join(low(r.text))}
    assert want and want <= {r.doc_id for r in got} and {r.item_id for r in got} == {1}


def test_katz(spark, folder):
    got = run(spark, folder, "op7_katz", [("doc_id", LONG), ("held_out", "boolean"), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", "double"), ("score", "double")])
    docs = table(spark, folder, "documents")
    count = Counter(w for i, r in docs.items() if check(i) % 5 != 1 for w in [*low(r.text), None])
    n, v = sum(count.values()), len(count)
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    for r in got:
        own = [*low(docs[r.doc_id].text), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (check(r.doc_id) % 5 == 1, len(own), sum(w in count for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * len(own) + 1e-9 and r.score <= 0


def test_main_text(spark, folder):
    got = run(spark, folder, "op8_main_text", [("page_id", LONG), ("url", "string"), ("text", "string"), ("n_chars", LONG)])
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {(1, "u1", "T\n\nOne, two.", 12), (2, "u2", "", 0), (3, "u3", "", 0)}
    assert main_text(None) == ""


def test_every_query_is_registered():
    found = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and set(Q.oracle_sql()) <= set(found)
