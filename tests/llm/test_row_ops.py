"""The operators that work row by row, against brute force and plants."""

import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from corpus import SCHEMA, corpus
from pyspark.sql import functions as F

from inventra.llm import queries as Q
from inventra.llm.decontaminate import aligned, leaks, plain
from inventra.llm.linear import dual_descent, features, log_count_ratios
from inventra.llm.main_text import main_text, main_texts
from inventra.llm.quality import quality_scores
from inventra.llm.rules import LENGTHS, judged, least, log_tail, pooled
from inventra.llm.shards import sharded
from inventra.llm.toxicity import LabelModel, Voters, _words, distinct_votes, summed, toxicity_scores

ROWS = corpus()
DATA = Path("/root/testdata/sf0.01")
have_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("part_rows", [9, 200_000])
def test_shards(docs, part_rows):
    got = sharded(docs, 8, part_rows=part_rows).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(-1 if i is None else i, 8), jump(-1 if i is None else i, 9)) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
        held = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert held == sorted(held)


def test_shards_keys(spark):
    # The last ones are chosen for a first draw beside a multiple of the shift.
    back = pow(2862933555777941757, -1, 2**64)
    draws = [(x - 1) * back % 2**64 for x in (2**33 - 1, 2**64 - 1, (5 << 33) - 1, 5 << 33, (5 << 33) + 1)]
    keys = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, 12345678901234567, *(d - 2**64 if d >= 2**63 else d for d in draws)]
    got = sharded(spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string"), 40).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {k: (jump(k, 40), jump(k, 41)) for k in keys}
    assert sharded(spark.createDataFrame([], SCHEMA)).count() == 0


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_counts(spark):
    extra = [(9000 + i, t, 7, "p", None) for i, t in enumerate(["a b c d e " * 5, "a|b\n\na|b\n \na|b", "x\x0by\x0cz\r\n" * 9, "ÄÖ é # ** <b>", " lead", "a b c d e f g a b c d e"])]
    rows = ROWS + extra
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i is not None], "doc_id long, quality int")
    got = judged(df, labels).collect()
    want = Counter()
    for i, t, *_ in rows:
        c = counts(t)
        want[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    # Every labelled document is good, so nothing is known to be worth rejecting.
    assert all(r.kept == (not r.base_failed) for r in got)


def test_binomial_tail():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert abs(math.exp(log_tail(3, 50, 0.1)) - exact) < 1e-12 and log_tail(5, 5, 0.1) == 0


def test_rules_learn_and_keep(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "iota"], 60)) + f" {i}", "en") for i in range(3000)]
    bad = [(10000 + i, " ".join(f"w{i}x{j}***" for j in range(60)), "en") for i in range(300)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = judged(df, labels).where("not base_failed").collect()
    assert all(not r.kept for r in got if r.doc_id >= 10000)
    assert all(r.kept for r in got if r.doc_id < 10000)


def test_rules_pool_thin_strata(spark):
    # Twelve strata of 100 good documents each: none has enough of its own, all together have.
    rng = np.random.default_rng(2)
    words = [a + b for a in "abcdefg" for b in "hijklm"]
    good = [(i, " ".join(rng.choice(words, [60, 150, 1010][i % 3])) + f" {i}", ["en", "de", "es", None][i // 3 % 4]) for i in range(1200)]
    bad = [(10000 + i, " ".join(f"w{i}x{j}***" for j in range([60, 150, 1010][i % 3])), ["en", "de", "xx"][i // 3 % 3]) for i in range(90)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = judged(df, labels).where("not base_failed").collect()
    assert all(not r.kept for r in got if r.doc_id >= 10000)
    assert all(r.kept for r in got if r.doc_id < 10000)


def test_rules_of_many_strata(spark):
    # Bad documents in strata without any good one, behind 1200 with one each.
    rng = np.random.default_rng(3)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "iota"], 60)) + f" {i}", f"g{i}") for i in range(1200)]
    bad = [(10000 + i, " ".join(f"w{i}x{j}***" for j in range(60)), f"z{i}") for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = judged(df, labels).where("not base_failed").collect()
    assert all(r.kept == (r.doc_id < 10000) for r in got) and sum(r.doc_id >= 10000 for r in got) == 60


def test_rules_pools():
    none = {(None, length): 0 for length in LENGTHS}
    own = lambda lang, *n: {(f"{lang}/{length}", length): x for length, x in zip(LENGTHS, n, strict=True)}
    pools = lambda good: sorted((sorted(str(k[0]) for k in p if k[0]), sum(good[k] for k in p)) for p in pooled(good, 0.005, 0.05))
    # Well covered by itself; the rest of all lengths together.
    got = pools(none | own("en", 252, 1615, 172) | own("de", 57, 392, 44) | own("fr", 55, 409, 34) | own("es", 51, 243, 22))
    assert [n for _, n in got] == [1731, 1615] and (["en/middle"], 1615) in got
    # The rest of one length has enough by itself.
    assert (["de/middle", "fr/middle"], 1800) in pools(none | own("en", 3000, 3000, 3000) | own("de", 9, 900, 9) | own("fr", 700, 900, 700))
    # Too thin a rest takes in the thinnest stratum.
    assert pools(none | own("en", 5000, 1500, 20)) == [(["en/long", "en/middle"], 1520), (["en/short"], 5000)]
    assert len(pooled(none, 0.005, 0.05)) == 1
    for strata in (1, 5):
        bound = math.log(0.05 / (6 * strata))
        n = least(strata, 0.005, 0.05)
        assert log_tail(0, n, 0.005) <= bound < log_tail(0, n - 1, 0.005)


def test_leaks(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "é"], rng.integers(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(30).capitalize()) for i in range(6)] + [(6, "short"), (7, None), (None, say(30))]
    edited = items[1][1].replace("k", "K", 3)[:40] + "x" + items[1][1][41:]
    texts = [say(50) + "\n" + items[0][1] + " " + say(50), say(9) + edited + say(9), re.sub("[a-z]", lambda m: m[0].upper(), items[2][1]).replace(" ", "\n  "), say(400), None, "", items[3][1][: len(items[3][1]) // 2], say(3000) + items[4][1] + items[5][1], "short"]
    df = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)] + [(None, items[0][1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    # Sent to all executors, and joined as a table; the short item stands as a word in the last text only.
    for most in (8_000_000, 0):
        got = leaks(df, bench, broadcast_bytes=most).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 0), (100, 0), (101, 1), (102, 2), (107, 4), (107, 5), (108, 6)]
        for r in got:
            if r.edits == 0 and r.doc_id is not None:
                cut = texts[r.doc_id - 100].encode()[r.begin : r.end]
                assert plain(cut)[0].tobytes() == plain(dict(items[:7])[r.item_id].encode())[0].tobytes()
        assert leaks(df.limit(0), bench, broadcast_bytes=most).count() == 0 and leaks(df, bench.limit(0), broadcast_bytes=most).count() == 0


def fewest_edits(item, text):
    """Fewest edits between the item and any part of the text."""
    data, step = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (data != c))))
        row = np.minimum.accumulate(new - step) + step
    return row.min()


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_leaks_against_brute_force(spark, most):
    """Items of all lengths, with and without edits at the budget's bound, in
    texts of few words, with a beginning that all items share; rows repeat."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdé "), rng.integers(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, "Question: which of these " * (i % 2) + say(int(rng.integers(1, 60)))) for i in range(60)] + [(60, "ab"), (61, "é"), (62, " \n"), (63, "x1"), (64, "x1")]
    texts = []
    for i, (_, t) in enumerate(items):
        own = list(t)
        for _ in range(int(rng.integers(0, 2 + len(t) * 7 // 100))):
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = rng.choice(["", "z", "zz"])
        texts.append(say(5) + " " + "".join(own) + " " + say(5) if i % 3 else "".join(own))
    texts += [say(200), "ab", "AB\tcab x12", "(x1)", None, "", "é", "éé"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    want = Counter()
    for i, t in rows:
        own = plain((t or "").encode())[0].tobytes()
        for j, x in items:
            item = plain(x.encode())[0].tobytes()
            if len(item) >= 30:
                hit = fewest_edits(item, own) <= len(item) * 7 // 100
            else:
                letter = rb"[0-9a-z\x80-\xff]"
                edge = lambda c: bool(re.match(letter, c))  # noqa: E731, B023
                before, after = (rb"(?<!" + letter + rb")" if edge(item[:1]) else b""), (rb"(?!" + letter + rb")" if edge(item[-1:]) else b"")
                hit = bool(item) and re.search(before + re.escape(item) + after, own) is not None
            if hit:
                want[(i, j)] += 1
    got = leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=most).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(97, 100, 30).astype(np.uint8)
    region = np.concatenate([rng.integers(97, 100, 7), np.delete(item, 11), rng.integers(97, 100, 9)]).astype(np.uint8)
    region[15] = 101
    table = [[0] * (len(region) + 1)]
    for i in range(1, len(item) + 1):
        row = [i]
        for j in range(1, len(region) + 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (item[i - 1] != region[j - 1])))
        table.append(row)
    got = aligned(item, region, -10, len(region), 8)
    assert got and got[0] == min(table[-1])
    begin, end = got[1:]
    piece = region[begin:end]
    again = aligned(item, piece, -10, len(piece), 8)
    assert again and again[0] == got[0]
    assert aligned(item, np.full(40, 122, np.uint8), 0, 20, 5) is None


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"), ("<script>x</script><style>y</style>", ""),
    ("<body><nav><a href=/>Home, here, there, now</a></nav><article><h1>T</h1><p><b>One,\n two<br>x<br><p>Three &lt;i&gt;</article><footer>F</footer>", "T\n\nOne, two x\n\nThree <i>"),
    ("<div class='ad banner'>Buy, now, please, do, it</div><div id=content><p>First, long, enough.</p><p>Second, one.</p></div><div class=comments><p>Reader, says, a, lot, here</p></div>", "First, long, enough.\n\nSecond, one."),
    ("<main><form>f<input></form><p>A, b, c.</p><aside>s</aside><ul><li>x<li>y</ul></main>", "A, b, c.\n\nx\n\ny"),
    ("<article><p>kept<!-- gone --> text<script>if (a < b) {}</script></p></article", "kept text"),
    ("<article><div class='article-header'><h1>Title</h1></div><p>Prose, here.</p></article>", "Title\n\nProse, here."),
    ("<body><p class=legal>The one paragraph.</p></body>", "The one paragraph."),
    ("<article><p>First, one.</p><section class='social policy'><p>On social policy, much.</p></section></article>", "First, one.\n\nOn social policy, much."),
    ("<article><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is, here.</p></article>", "The sum x+y is, here."),
    ("<article><p title='hidden ad'>Shown <span class=ad>Buy</span> text, <label>no <p>x</label> more.</p><noscript><p>Enable JS</p></noscript><button><div>Go</div></button></article>", "Shown text, more."),
    ("<form><div><p>All, of it, is in a form.</p><p>Second, too.</p></div></form>", "All, of it, is in a form.\n\nSecond, too."),
    ("<nav><a href=/>only</a> menu</nav><footer>x</footer>", ""),
    ("<div class=ad>Buy</div>", ""),
    ("<article><p>Art, icle.</p><ol class='comment-list'><li><article><p>A comment, long, with, many, commas, and more, and more, of it.</p></article></ol></article>", "Art, icle."),
    ("<nav><ul><li>x<article><p>In an unclosed nav, prose.</p></article>", "In an unclosed nav, prose."),
    ("<h1>T</h1><div id=c><p>One, two, three, four and some more text.</p><p>Two.</p></div><ul><li>a</ul>", "T\n\nOne, two, three, four and some more text.\n\nTwo."),
    ("<p>a < b and 1<2 &amp; x", "a < b and 1<2 & x"),
    ("<a href=x><div>Teaser one</div></a><div><p>Some prose, in here, that is longer than teasers.</p></div>", "Some prose, in here, that is longer than teasers."),
    ("<article><header><h1>In</h1></header><p>P, q.</p><footer>tags</footer></article>", "In\n\nP, q."),
    ("<table><tr><td>a<td>b<tr><td>c, d</table>", "a b\n\nc, d"),
])
def test_main_text(page, want):
    assert main_text(page) == want


def test_main_text_bears_anything(spark):
    deep = "<div>" * 5000 + "deep, text" + "</div>" * 5000
    assert main_text(deep) == "deep, text"
    pages = spark.createDataFrame([(1, None, "t"), (2, "<p>a</p>" * 2, "t"), (2, "<p>a</p>" * 2, "t")], "page_id long, html string, text string")
    assert Counter((r.page_id, r.text) for r in main_texts(pages).collect()) == Counter({(1, ""): 1, (2, "a\n\na"): 2})
    assert main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a " * 3_000_000, "<div>" * 300_000 + "x", "<" + "a" * 3_000_000 + "<", "<a x=\"y' " * 500_000, "<label>" * 500_000, "<span class=ad>x" * 300_000, "</div>" * 500_000, "<!-- " * 1_000_000, "<a b" + " " * 3_000_000 + "c>x", "<script>" * 500_000])
def test_main_text_in_linear_time(page):
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 20


@have_data
@pytest.mark.parametrize(("score", "label", "mod", "held", "cutoff"), [(quality_scores, "quality", 5, 0, 0.3), (toxicity_scores, "toxic", 3, 1, 0.7)])
def test_held_out_accuracy(spark, score, label, mod, held, cutoff):
    docs, labels = Q.table(spark, str(DATA), "documents"), Q.table(spark, str(DATA), "labels")
    out = score(docs.select("doc_id", "text"), labels, Q.remainder(mod) != held)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where(Q.remainder(mod) == held).collect()
    right = sum((r["score"] >= cutoff) == r[label] for r in rows) / len(rows)
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_scores_of_odd_tables(spark, docs, score):
    label = "quality" if score is quality_scores else "toxic"
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in score(docs, none, Q.remainder(5) != 0).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (13, 0), (23, 1), (33, 0), (33, 9), (None, 1)], f"doc_id long, {label} int")
    got = score(docs, some, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), some, F.lit(True)).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(3)
    truth = rng.random(2000) < 0.2
    noisy = lambda p: np.where(rng.random(2000) < p, truth, ~truth)
    twin = noisy(0.7)
    says = np.stack([noisy(0.9), noisy(0.85), twin, twin, twin], axis=1)
    up = np.concatenate([says, truth[:, None]], axis=1).astype(float)
    down = np.concatenate([~says, np.zeros((2000, 1))], axis=1).astype(float)
    model = LabelModel(lambda f: f(up, down, np.ones(2000)), 6, 0.2)
    assert model.share[2] < 0.6 and model.share[0] > 0.8 and model.accuracy[0] > 0.8
    assert ((model.posterior(up, down) > 0.5) == truth).mean() > 0.95


def test_votes_are_summed_over_all_rows(spark):
    """The label model sees every document: sums over distinct votes equal sums over rows."""
    rng = np.random.default_rng(6)
    say = lambda *more: " ".join([*rng.choice(["red", "blue", "green", "stone"], 30), *more])
    docs = [say("idiot", f"grobmalion{i % 7}", f"grobmalian{i % 5}") if i % 5 == 0 else say() for i in range(200)]
    label = np.array([float(i % 5 == 0) for i in range(200)])
    voters = Voters([_words(t.encode()) for t in docs], label)
    assert voters.any_start[5] == {"grobm"} and voters.known >= {"idiot"}
    each = [voters.votes(_words(t.encode())) for t in docs]
    votes = distinct_votes(spark.createDataFrame([(t,) for t in docs], "text string").selectExpr("cast(text as binary) as text").repartition(5), voters)
    assert Counter({(r.up, r.down): r.n for r in votes.collect()}) == Counter(each)
    f = lambda up, down, n: np.concatenate([[n.sum()], n @ up, n @ down])
    want = f(*(np.array([[x >> k & 1 for k in range(voters.count)] for x in side], float) for side in zip(*each, strict=True)), np.ones(200))
    assert np.allclose(summed(votes, voters.count)(f), want)
    assert len(summed(votes.limit(0), voters.count)(f)) == 2 * voters.count + 1


@have_data
def test_weak_supervision_gains(spark):
    """On held-out rows: no fewer toxic documents found than by the plain
    classifier with the words alone, and hardly a clean one lost."""
    docs, labels = Q.table(spark, str(DATA), "documents").select("doc_id", "text"), Q.table(spark, str(DATA), "labels")
    weak = toxicity_scores(docs, labels, Q.remainder(3) != 1)
    plain_ = quality_scores(docs, labels, Q.remainder(3) != 1, label="toxic", score="plain")
    rows = weak.join(plain_.select("doc_id", "plain"), "doc_id").join(labels, "doc_id").where(Q.remainder(3) == 1).collect()
    found = lambda c: sum(r[c] >= 0.7 for r in rows if r.toxic)
    assert found("score") >= found("plain") and found("score") >= 0.7 * sum(r.toxic for r in rows)
    assert sum(r["score"] >= 0.7 for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_features_against_brute_force():
    """Two texts share a place exactly where they share an n-gram or a count."""
    rng = np.random.default_rng(8)
    words = ["alpha", "Alphabet", "beta", "b", "gamma-x", "ß", "alphaville"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 9)))).encode() for _ in range(40)] + [None, b""]

    def grams(t, often):
        w = (t or b"").split()
        low = [x.lower() for x in w]
        out = {("w", x) for x in low} | {("p", *x) for x in zip(low, low[1:], strict=False)} | {("b", x[:5]) for x in low} | {("e", x[-2:]) for x in w}
        same = sum(a == b for a, b in zip(low, low[1:], strict=False))
        out |= {("same", min(12, same.bit_length())), ("distinct", 8 * len(set(low)) // len(low) if low else 9), ("n", min(20, len(low).bit_length()))}
        if often:
            for cut in (5, 7):
                out |= {("o", cut, b, k) for b, n in Counter(x[:cut] for x in low).items() for k in (2, 3, 5) if n >= k}
        return out

    for often in (False, True):
        place, first = features(texts, often)
        held = [set(place[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
        want = [grams(t, often) for t in texts]
        assert [len(h) for h in held] == [len(w) for w in want]
        assert [[len(a & b) for b in held] for a in held] == [[len(a & b) for b in want] for a in want]


def test_ratios_and_descent_against_brute_force():
    """Log-count ratios from counts, and a solution of the dual that fits its conditions."""
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    label = np.array([float((r < 9).sum() + rng.integers(0, 2) > 2) for r in rows])
    place, first = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    ratio = log_count_ratios(place, first, label)
    for p in range(30):
        up, down = (1 + sum(p in r for r, y in zip(rows, label, strict=True) if y == side) for side in (1, 0))
        assert abs(ratio[p] - (math.log(up / (label.sum() + 2)) - math.log(down / ((1 - label).sum() + 2)))) < 1e-12
    sign, cost = 2 * label - 1, np.ones(60)
    weight, bias = dual_descent(place, first, sign, cost, ratio, epochs=400)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / math.sqrt(len(r))
        x[i, 30] = 1
    w = np.append(weight[:30], bias)
    # The primal objective can't be lowered along any direction that is tried.
    value = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()
    best = value(w)
    assert all(value(w + step * rng.normal(size=31)) > best - 1e-3 for step in (1e-3, 1e-2, 0.1) for _ in range(40))
    assert abs(value(np.zeros(31)) - 60) < 1e-9 and best < 60
