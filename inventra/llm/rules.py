"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose measure lies beyond a cutoff.  Cutoffs come from
labelled holdouts: for each rule, stratum and candidate cutoff, the good
documents that it would reject are counted, and a cutoff is safe when the exact
binomial tail shows a false rejection rate over ``risk`` to be unlikely:
P(Bin(n, risk) <= k) at most ``level`` divided by the number of rules and strata
(Bonferroni).  The cutoffs of one rule in one stratum are tested in a fixed
sequence, from the one that rejects least, until one fails, so they share that
error.  Per rule and stratum the safe cutoff that rejects most of the labelled
bad documents is taken, and only if it rejects any.

A stratum is a language and length class where these have enough good documents
for a cutoff without any false rejection to be safe.  The other languages of a
length class are one stratum; what is still too thin is one stratum for all
lengths, and takes in the thinnest others until it is well covered.  Pools
depend on how many good documents there are, never on their measures.  Only a
label table with too few good documents in all gives no rule.  All rules together
falsely reject at most ``rules * risk`` of a stratum, which is what ``risk`` is
set for; in a pooled stratum that holds for the pool, not for each language in it.

Defined results: a null or empty text has no words, fails the base rules and is
not kept.  A row without doc_id has no label and is judged like any other.
Several labels of one id count as good only if all do.  Further columns are
ignored.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISK, LEVEL = 0.005, 0.05
# What the contract counts.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Measures of the rules; a text is rejected at or beyond a cutoff.
CUTOFFS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]
LENGTHS = ("short", "middle", "long")
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "few_distinct", "mark_share")


def counted(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` and the counts of each text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, and the measures of the rules."""
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(raw, SPACES), "")
    # Java reads the class's \\x09-\\x0D as written; lines of white space alone hold no word.
    lines = F.filter(F.split(raw, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    step = df.select(*keep, raw.alias("t"), words.alias("w"), lines.alias("l"))
    n = F.size("w")
    # Words are hashed once; a window's hash is that of five words' hashes.
    step = step.withColumn("x", F.transform("w", lambda word: F.xxhash64(word)))
    window = F.when(n >= 5, F.transform(F.slice("x", 1, n - 4), lambda first, i: F.xxhash64(first, *(F.get("x", i + k) for k in range(1, 5))))).otherwise(F.array().cast("array<bigint>"))
    bare = F.length(F.translate("t", WHITE, ""))
    step = step.select(
        *(c for c in step.columns if c not in ("t", "w", "l", "x")),
        F.size("w").cast("long").alias("n_words"), bare.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (bare - F.length(F.regexp_replace(F.translate("t", WHITE, ""), "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (bare - F.length(F.translate("t", WHITE + "!?.,;:|*#$%&<>+=_", ""))).cast("long").alias("n_marks"),
        window.alias("h"),
    )
    step = step.withColumn("n_repeat_words", F.when(F.size("h") > F.size(F.array_distinct("h")), _covered(F.col("h"))).otherwise(F.lit(0)).cast("long"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return step.select(
        *(c for c in step.columns if c != "h"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"),
        F.when(F.col("n_words") > 0, 1 - F.col("n_distinct") / F.col("n_words")).otherwise(F.lit(0.0)).alias("few_distinct"),
        share("n_marks", "word_chars").alias("mark_share"),
    )


def _covered(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        # 1 where the neighbour before or after in hash order has the same hash.
        twice = F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        before = F.concat(F.array(F.lit(False)), F.slice(twice, 1, F.size(s) - 1))
        both = F.zip_with(F.zip_with(twice, before, lambda a, b: a | b), s, lambda t, x: F.when(t, x["i"]))
        return F.array_sort(F.filter(both, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    # A one-element array binds a value once for the lambdas that read it often.
    held = F.transform(F.array(pairs), places)
    return F.element_at(F.transform(held, total), 1)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum(lang: Column) -> Column:
    length = F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")
    return F.concat_ws("/", F.coalesce(lang, F.lit("?")), length)


def log_tail(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exactly summed."""
    if k >= n:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def least(strata: int, risk: float, level: float) -> int:
    """Good documents with which a cutoff that rejects none of them is safe."""
    return ceil(log(level / (strata * len(RULES))) / log1p(-risk))


def length_of(stratum: Column) -> Column:
    return F.substring_index(stratum, "/", -1)


#: A stratum's name and length class; name None for those of that length that aren't named.
Key = tuple[str | None, str]


def pooled(good: dict[Key, int], risk: float, level: float) -> list[list[Key]]:
    """The final strata, as keys that are judged together, from the good
    documents of each; the fewest strata that are well covered at their own
    number of tests."""
    held = lambda group: sum(good[k] for k in group)
    for most in range(1, len(good) + 1):
        need = least(most, risk, level)
        out = [[k] for k in good if k[0] is not None and good[k] >= need]
        rest = [[k for k in good if k[1] == length and not (k[0] is not None and good[k] >= need)] for length in LENGTHS]
        out += [group for group in rest if held(group) >= need]
        thin = [k for group in rest if held(group) < need for k in group]
        while thin and out and held(thin) < need:
            thin += out.pop(out.index(min(out, key=held)))
        out += [thin] if thin else []
        if len(out) <= most:
            return out
    return []


def learnt(measured: DataFrame, labels: DataFrame, label: str = "quality", risk: float = RISK, level: float = LEVEL) -> list[tuple[list[Key], dict[str, float]]]:
    """The final strata with the safe cutoffs of their rules.  What comes to the
    driver is one row for each stratum that is well covered by itself, and one
    for the others of each length class."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("good"))
    own = measured.where(~F.col("base_failed")).join(known, "doc_id")
    sums = [F.sum((F.col("good") == g).cast("long")).alias(f"n{g}") for g in (0, 1)]
    for rule in RULES:
        sums += [F.sum(((F.col("good") == g) & (F.col(rule) >= c)).cast("long")).alias(f"{rule}_{g}_{j}") for g in (0, 1) for j, c in enumerate(CUTOFFS)]
    by_name = own.groupBy("stratum").agg(*sums)
    # A stratum too thin even as the only one never stands for itself: those are added up here.
    stands = F.when(F.col("n1") >= least(1, risk, level), F.col("stratum")).alias("name")
    rows = by_name.groupBy(stands, length_of(F.col("stratum")).alias("length")).agg(*(F.sum(c).alias(c) for c in by_name.columns if c != "stratum")).orderBy("name", "length").collect()
    found = {(row["name"], row["length"]): row for row in rows}
    pools = pooled({(None, length): 0 for length in LENGTHS} | {k: row["n1"] for k, row in found.items()}, risk, level)
    bound = log(level / max(1, len(pools) * len(RULES)))
    out = []
    for keys in pools:
        held = [found[k] for k in keys if k in found]
        n = sum(row["n1"] for row in held)
        cutoffs: dict[str, float] = {}
        for rule in RULES:
            safe = []
            for j, c in reversed(list(enumerate(CUTOFFS))):
                if not n or log_tail(sum(row[f"{rule}_1_{j}"] for row in held), n, risk) > bound:
                    break
                safe.append((sum(row[f"{rule}_0_{j}"] for row in held), c))
            if safe and max(safe)[0] > 0:
                cutoffs[rule] = max(safe)[1]
        out.append((keys, cutoffs))
    return out


def rejected(strata: list[tuple[list[Key], dict[str, float]]]) -> Column:
    named = [k[0] for keys, _ in strata for k in keys if k[0] is not None]
    out = F.lit(False)
    for keys, cutoffs in strata:
        own = F.lit(False)
        for rule, cutoff in sorted(cutoffs.items()):
            own = own | (F.col(rule) >= cutoff)
        names, lengths = [k[0] for k in keys if k[0] is not None], [k[1] for k in keys if k[0] is None]
        here = F.col("stratum").isin(names) | (~F.col("stratum").isin(named) & length_of(F.col("stratum")).isin(lengths))
        out = out | (here & own)
    return out


def judged(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the counts, base_failed, stratum and kept of each row of ``df``.
    The counts are stored once: thresholds are learnt from them, then applied."""
    from inventra.llm.tables import stored

    rows = counted(df, text, F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"))
    rows = stored(rows.withColumn("base_failed", base_failed()).withColumn("stratum", stratum(F.col("lang"))))
    strata = learnt(rows, labels, label, risk, level)
    return rows.withColumn("kept", ~F.col("base_failed") & ~rejected(strata))
