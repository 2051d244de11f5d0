"""Toxicity by weak supervision.

Many voters each say toxic, clean or nothing of a document: a lexicon of insults
in four languages, lexicons of words and of word beginnings that one part of the
label sample each shows to be one-sided, and patterns (several different hits,
hits near one another, many hits for the length, none at all).  A generative
label model estimates, without labels and from the votes on *all* documents,
each voter's accuracy by expectation maximisation and how strongly voters agree
beyond what the hidden label explains; a voter's say is divided by the size of
its clique.  What the steps need is summed over a table of distinct votes, so
each is one small job and only its sums come to the driver.

A linear classifier on n-gram indicators learns the posterior labels of the
label sample and of as many unlabelled documents, so it also scores what no
voter sees.  In the posterior of a labelled document its label is one more vote,
as accurate as it agrees with the other votes.

Both samples are bounded (``most`` rows, ``most_bytes``): the documents with the
least hash of their id for which ``learn`` holds.  Labels are used to mine
lexicons, as that vote, for the first guess of how many documents are toxic and
to fit the logistic curve of the score.  Votes and scores cover every row and
whole texts, in Arrow batches and without a shuffle of texts.

Defined results: a null or empty text draws the votes of a text without hits.
Without labels, or with labels of one class only, every score is that class's
smoothed share.  Repeated rows are scored each and vote each; an id that several
rows share is learnt from once.  An empty table gives none.  Further columns
stay; one that has the name of the score gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.llm.linear import features, fitted, held_margins, logistic
from inventra.llm.quality import MOST, MOST_BYTES, Linear, constant, labelled_sample, plain_sample
from inventra.llm.tables import stored

#: Parts of the label sample that lexicons are mined from, each on its own.
PARTS = 3
#: Letters of the word beginnings that are mined.
BEGINNINGS = (5, 7)
ROUNDS = 24
SEEN, SIDED = 5, 20
# Insults by language.
INSULTS = {
    "en": "idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb garbage imbecile jerk hate",
    "de": "idiot dumm dummkopf abschaum trottel arschloch ekelhaft wertlos versager hass",
    "fr": "idiot stupide imbécile ordure racaille minable nul dégoûtant crétin haine",
    "es": "idiota estúpido imbécil basura escoria patético inútil asqueroso payaso odio",
}
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode("utf-8", "replace").lower())


def _beginnings(words: list[str], cut: int) -> Counter[str]:
    """How many words have each beginning that is shorter than they are."""
    return Counter(w[:cut] for w in words if len(w) > cut)


def mined(docs: list[Counter[str]], label: np.ndarray, least: int) -> set[str]:
    """What stands ``least`` times or more in far more toxic than clean texts:
    in ``SEEN`` toxic ones at least, and ``SIDED`` times as often."""
    up, down = Counter(), Counter()
    for held, toxic in zip(docs, label, strict=True):
        (up if toxic else down).update([w for w, n in held.items() if n >= least])
    n1, n0 = label.sum() + 1, (1 - label).sum() + 1
    return {w for w in up if up[w] >= SEEN and (up[w] + 0.1) / n1 > SIDED * (down[w] + 0.1) / n0}


class Voters:
    """Votes of a text as two sets of bits: who says toxic, who says clean."""

    def __init__(self, docs: list[list[str]], label: np.ndarray):
        self.known = {w for v in INSULTS.values() for w in v.split()}
        self.words, self.starts = [], []
        for part in range(PARTS):
            own = [i for i in range(len(docs)) if i % PARTS == part]
            self.words.append(mined([Counter(docs[i]) for i in own], label[own], 1))
            self.starts += [(cut, mined([_beginnings(docs[i], cut) for i in own], label[own], 2)) for cut in BEGINNINGS]
        self.any = self.known.union(*self.words)
        self.any_start = {cut: set().union(*(v for c, v in self.starts if c == cut)) for cut in BEGINNINGS}
        self.count = 1 + len(self.words) + len(self.starts) + 7

    def votes(self, words: list[str]) -> tuple[int, int]:
        own = set(words)
        begin = {cut: _beginnings(words, cut) for cut in BEGINNINGS}
        # Places of words that some lexicon has, or whose beginning often recurs and is in one.
        often = {cut: {b for b in self.any_start[cut] if begin[cut][b] > 1} for cut in BEGINNINGS}
        hit = [i for i, w in enumerate(words) if w in self.any or any(w[:cut] in often[cut] and len(w) > cut for cut in BEGINNINGS)]
        different = len({words[i] for i in hit})
        toxic = [not own.isdisjoint(self.known), *(not own.isdisjoint(v) for v in self.words)]
        toxic += [any(begin[cut][b] > 1 for b in v) for cut, v in self.starts]
        toxic += [different > 1, different > 3, any(b - a < 40 for a, b in zip(hit, hit[1:], strict=False)), 100 * len(hit) > len(words)]
        clean = [not hit, not own & self.any, not any(often.values())]
        up = sum(1 << i for i, v in enumerate(toxic) if v)
        return up, sum(1 << (len(toxic) + i) for i, v in enumerate(clean) if v)


def _spread(packed: np.ndarray, voters: int) -> np.ndarray:
    """Bits as a matrix of 0 and 1."""
    return ((packed[:, None] >> np.arange(voters)) & 1).astype(float)


class LabelModel:
    """Votes of a hidden binary label: accuracies and correlations.

    ``over(f)`` sums ``f(up, down, n)`` over all distinct votes: who says toxic
    and who says clean, as matrices, and how many documents vote so."""

    def __init__(self, over: Callable, voters: int, prior: float = 0.1, rounds: int = ROUNDS):
        self.voters, self.prior, self.table = voters, min(max(prior, 0.005), 0.9), None
        self.least = np.ones(voters)
        n, mean, both = self._cut(over(self._moments), 1, voters, (voters, voters))
        n = max(n[0], 1.0)
        centred = both / n - np.outer(mean / n, mean / n)
        spread = np.sqrt(np.maximum(np.diag(centred), 1e-12))
        # Voters that all but repeat one another are one clique from the start:
        # left whole, they would become what the label is taken for.
        close = (np.abs(centred / np.outer(spread, spread)) > 0.95) & (np.diag(centred) > 1e-9)
        self.least = 1 / np.maximum(1, close.sum(1))
        self.share = self.least.copy()
        for step in range(rounds):
            got = self._cut(over(self._expected), 2, voters, voters, voters, voters)
            (p, n), up1, up0, down1, down0 = got
            self.prior = float(np.clip((p + 1) / (n + 1 / max(prior, 0.005)), 0.005, 0.9))
            self.table = np.stack([np.stack([(a + 0.05) / (p + 2), (b + 0.05) / (n - p + 2)]) for a, b in ((up1, up0), (down1, down0))])
            self.table = np.minimum(self.table, 0.999)
            self.accuracy = (up1 + down0) / np.maximum(1e-9, up1 + up0 + down1 + down0)
            if step % 8 == 7:
                self.means = ((up1 - down1) / (p + 1e-9), (up0 - down0) / (n - p + 1e-9))
                rest = over(self._rest).reshape(voters, voters)
                spread = np.sqrt(np.diag(rest)) + 1e-9
                self.correlation = np.abs(rest / np.outer(spread, spread))
                np.fill_diagonal(self.correlation, 0)
                self.share = np.minimum(self.least, 1 / (1 + np.where(self.correlation > 0.3, self.correlation, 0).sum(1)))

    @staticmethod
    def _cut(flat: np.ndarray, *shapes) -> list[np.ndarray]:
        out, at = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    @staticmethod
    def _moments(up, down, n):
        signed = up - down
        return np.concatenate([[n.sum()], n @ signed, ((signed * n[:, None]).T @ signed).ravel()])

    def _expected(self, up, down, n):
        p = self.posterior(up, down) * n
        q = n - p
        return np.concatenate([[p.sum(), n.sum()], p @ up, q @ up, p @ down, q @ down])

    def _rest(self, up, down, n):
        """What voters say beyond their mean under the posterior."""
        p = self.posterior(up, down)[:, None]
        rest = up - down - p * self.means[0] - (1 - p) * self.means[1]
        return ((rest * n[:, None]).T @ rest).ravel()

    def posterior(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.clip(0.5 + 0.5 * np.tanh((up - down) @ self.share), 0.02, 0.98)
        ratio = np.log(self.table[:, 0]) - np.log(self.table[:, 1])
        none = np.log(np.clip(1 - self.table[:, 0].sum(0), 1e-3, 1)) - np.log(np.clip(1 - self.table[:, 1].sum(0), 1e-3, 1))
        said = up * ratio[0] + down * ratio[1] + (1 - up - down) * none
        score = np.log(self.prior / (1 - self.prior)) + said @ self.share
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def distinct_votes(texts: DataFrame, voters: Voters) -> DataFrame:
    """up, down, n: the different votes on the texts (a column ``text`` of
    bytes), and how many documents draw each."""

    def run(batches):
        held: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            held.update(voters.votes(_words(t)) for t in batch["text"].to_pylist())
        rows = sorted(held.items())
        yield pa.RecordBatch.from_pydict({"up": pa.array([k[0] for k, _ in rows], pa.int64()), "down": pa.array([k[1] for k, _ in rows], pa.int64()), "n": pa.array([n for _, n in rows], pa.int64())})

    return texts.mapInArrow(run, "up long, down long, n long").groupBy("up", "down").agg(F.sum("n").alias("n"))


def summed(votes: DataFrame, voters: int) -> Callable:
    """``over`` of a label model for a table of distinct votes: a partition
    gives one row of sums, which are added in order."""

    def over(f):
        def run(batches):
            from pyspark import TaskContext

            out = None
            for batch in batches:
                up, down, n = (batch[c].to_numpy() for c in ("up", "down", "n"))
                got = f(_spread(up, voters), _spread(down, voters), n.astype(float))
                out = got if out is None else out + got
            if out is not None:
                yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "sums": [out.tobytes()]})

        rows = sorted(votes.mapInArrow(run, "at long, sums binary").collect(), key=lambda r: r["at"])
        return sum((np.frombuffer(r["sums"]) for r in rows[1:]), np.frombuffer(rows[0]["sums"]).copy()) if rows else f(np.zeros((0, voters)), np.zeros((0, voters)), np.zeros(0))

    return over


def with_label(posterior: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Posteriors with the label as one more vote, as accurate as it agrees."""
    agreed = np.where(label > 0.5, posterior, 1 - posterior).sum()
    accuracy = np.clip((agreed + 1) / (len(label) + 2), 0.6, 0.98)
    odds = np.log(posterior / (1 - posterior)) + np.where(label > 0.5, 1, -1) * np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-odds))


def fit(texts: list[bytes | None], label: np.ndarray, more: list[bytes | None], voters: Voters, model: LabelModel) -> Linear:
    """The classifier from labelled texts and further ones without labels."""

    def posterior(own):
        votes = np.array([voters.votes(_words(t)) for t in own], np.int64).reshape(-1, 2)
        return model.posterior(_spread(votes[:, 0], voters.count), _spread(votes[:, 1], voters.count))

    soft = np.concatenate([with_label(posterior(texts), label), posterior(more)])
    place, first = features([*texts, *more], often=True)
    margin = held_margins(place, first, soft)
    slope, offset = logistic(margin[: len(texts)], label)
    weight, bias = fitted(place, first, soft)
    return Linear(weight, bias, slope, offset, often=True)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", most: int = MOST, most_bytes: int = MOST_BYTES, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``: how likely the text is toxic."""
    texts, known = labelled_sample(docs, labels, label, learn, most, most_bytes, doc_id, text)
    if len(known) < 2 or known.min() == known.max():
        return docs.withColumn(score, constant(known).column(text))
    voters = Voters([_words(t) for t in texts], known)
    votes = stored(distinct_votes(docs.select(F.col(text).cast("binary").alias("text")), voters))
    model = LabelModel(summed(votes, voters.count), voters.count, float(known.mean()))
    more = plain_sample(docs, labels, label, learn, most, most_bytes, doc_id, text)
    return docs.withColumn(score, fit(texts, known, more, voters, model).column(text))
