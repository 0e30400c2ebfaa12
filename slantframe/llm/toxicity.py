"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the distinct words of a text.  Labelled texts that
mention an identity term are also taken with the term swapped for the other
terms of its group, and those that mention none of a group with each of its
terms put in; the squared change of the logit is penalised (logit pairing), so
that a neutral mention of a group does not move the score.  Groups have terms
of the corpus's four languages.

The model is fitted on the driver on a bounded, documented sample of labelled
rows and a bounded number of words; alike rows are one, and DENSE rows at a time
are a dense matrix.  Every document is then scored in its own partition with the
broadcast weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.labelled import labelled_sample, remainder
from slantframe.llm.scratch import Scratch, free_names

#: Terms of one group are swapped for each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "transgender"),
    ("immigrants", "citizens"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("noirs", "blancs", "asiatiques"),
    ("immigrés", "citoyens"),
    ("homosexuels", "hétérosexuels", "transgenres"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("schwarze", "weiße", "asiaten"),
    ("einwanderer", "bürger"),
    ("schwule", "lesben", "heterosexuelle"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("negros", "blancos", "asiáticos"),
    ("inmigrantes", "ciudadanos"),
    ("homosexuales", "heterosexuales", "transexuales"),
)

SEPARATORS = kernels.not_alphanumeric()
#: Rows of the sample that the fit holds as a dense matrix at a time.
DENSE = 512


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(kernels.words(data, np.array([0, len(data)]), SEPARATORS)[0][0])


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted word hashes, their weights, the intercept, and how many counterfactual pairs the fit was held to."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float
    pairs: int = 0

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; null and empty texts get the intercept's."""
        data, offsets = kernels.utf8(column)
        out = np.full(len(column), self.intercept)
        n = len(self.hashes)
        if n:
            for a, b in kernels.chunks(offsets):
                found, bounds, _, _ = kernels.words(data[offsets[a] : offsets[b]], offsets[a : b + 1], SEPARATORS)
                at = np.minimum(np.searchsorted(self.hashes, found), n - 1)
                hit = np.flatnonzero(self.hashes[at] == found)
                text = np.searchsorted(bounds, hit, side="right") - 1
                pairs = np.unique(text * n + at[hit])
                out[a:b] += np.bincount(pairs // n, self.weights[pairs % n], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


@dataclass(frozen=True)
class WordRows:
    """Rows of a sample: each one's label, how many alike there are, and the numbers of its words, which end at bounds."""

    labels: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    bounds: np.ndarray

    def blocks(self, d: int) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, dense matrix) of DENSE rows at a time: d words and a column of ones."""
        for a in range(0, len(self.labels), DENSE):
            b = min(a + DENSE, len(self.labels))
            x = np.zeros((b - a, d + 1))
            x[np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1])), self.words[self.bounds[a] : self.bounds[b]]] = 1
            x[:, d] = 1
            yield slice(a, b), x


def fit_logits(sample: WordRows, changes: np.ndarray, pairing: float, ridge: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on mean log loss + pairing * mean squared change of the pairs' logits + ridge.

    changes is the mean outer product of the pairs' differences, a square of the words.
    """
    n, d = sample.counts.sum(), len(changes)
    w = np.zeros(d + 1)
    penalty = np.zeros((d + 1, d + 1))
    penalty[:d, :d] = 2 * pairing * changes + 2 * ridge * np.eye(d)
    penalty[d, d] = 1e-9
    for _ in range(rounds):
        grad, hess = penalty @ w, penalty.copy()
        for own, x in sample.blocks(d):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            grad += x.T @ (sample.counts[own] * (p - sample.labels[own])) / n
            hess += (x * (sample.counts[own] * (p * (1 - p) + 1e-9) / n)[:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:d], float(w[d])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    label: str = "toxic",
    groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    rows: int = 20_000,
    words: int = 512,
    least: int = 3,
    strength: float = 4.0,
    pairing: float = 1.0,
    ridge: float = 1e-6,
) -> ToxicityModel:
    """Fits the classifier on at most ``rows`` labelled rows (those with the least id hashes).

    Words that occur in ``least`` sampled texts and differ between the labels
    by ``strength`` standard errors take part, at most ``words`` of them, and
    with them the identity terms.  Without labelled rows, or with one label
    only, the model is a constant: the share of label 1 (0 without rows).
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else learn
    scratch = Scratch(spark, "toxicity")

    @kernels.tidied
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in kernels.shingle_sets(batch.column(2), 1, SEPARATORS)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["label", "words"])

    sample = scratch.save(labelled_sample(docs, labels, label, learn, rows).mapInArrow(distinct, "label int, words binary"))
    n_all, n_one = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0)
    if not n_all or n_one in (0, n_all):
        scratch.drop(sample)
        share = n_one / n_all if n_all else 0.0
        return ToxicityModel(none.astype(np.uint64), none, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    @kernels.tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = batch.column(0).to_numpy().astype(bool)
            sets = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            if sets:
                found, at = np.unique(np.concatenate(sets), return_inverse=True)
                one = np.repeat(ones, [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, minlength=len(found))), pa.array(np.bincount(at[one], minlength=len(found)))], ["word", "n", "ones"])

    p = n_one / n_all
    z = F.abs(F.col("ones") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    chosen = (
        sample.mapInArrow(counted, "word long, n long, ones long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
        .where(F.col("n") >= least)
        .withColumn("z", z)
        .where(F.col("z") >= strength)
        .orderBy(F.desc("z"), "word")
        .limit(words)
        .select("word")
        .collect()
    )
    terms = [[np.uint64(word_hash(t)) for t in group] for group in groups]
    hashes = np.unique(np.array([np.int64(r[0]).astype(np.uint64) for r in chosen] + [h for g in terms for h in g], dtype=np.uint64))
    shared = spark.sparkContext.broadcast(hashes)

    @kernels.tidied
    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of = [np.flatnonzero(np.isin(shared.value, np.frombuffer(x, dtype=np.uint64))).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_of, pa.list_(pa.int32()))], ["label", "at"])

    got = sample.mapInArrow(selected, "label int, at array<int>").groupBy("label", "at").agg(F.count("*").alias("n")).orderBy("label", "at").toArrow()
    scratch.drop(sample)
    at = got.column("at").combine_chunks()
    bounds = np.r_[0, np.cumsum(at.value_lengths().to_numpy())]
    alike = WordRows(got.column("label").to_numpy(), got.column("n").to_numpy(), at.flatten().to_numpy(), bounds)
    place = {int(h): i for i, h in enumerate(hashes)}
    # Differences have one or two entries, so their outer products are summed entry by entry.
    changes, pairs = np.zeros((len(hashes), len(hashes))), 0
    for i, n in enumerate(alike.counts.tolist()):
        found = alike.words[bounds[i] : bounds[i + 1]].tolist()
        for group in terms:
            own = [place[int(h)] for h in group]
            held = [i for i in own if i in found]
            for a in held:
                for b in own:
                    if b != a:
                        moved = [a] if b in found else [a, b]
                        changes[np.ix_(moved, moved)] += n * np.array([[1.0, -1.0], [-1.0, 1.0]])[: len(moved), : len(moved)]
                        pairs += n
            for b in own if not held else []:
                changes[b, b] += n
                pairs += n
    weights, intercept = fit_logits(alike, changes / max(1, pairs), pairing, ridge)
    return ToxicityModel(hashes, weights, intercept, pairs)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of every whole text.

    With keep, the columns of docs and, behind them, toxic_score and
    toxic_predicted, with underscores behind a name that docs has.  Null texts are empty texts; repeated rows and null ids
    give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if keep else docs.select("doc_id", "text")
    said = free_names(docs.columns, "toxic_score", "toxic_predicted")
    text = docs.columns.index("text")

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(text))
            predicted = (score >= threshold).astype(np.int32)
            columns = batch.columns if keep else [batch.column(0)]
            names = batch.schema.names if keep else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(predicted)], [*names, *said])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] if keep else [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"]
    out = docs.mapInArrow(run, ", ".join([*fields, f"`{said[0]}` double, `{said[1]}` int"]))
    return out if keep else out.select("doc_id", F.col(said[0]).alias("score"), F.col(said[1]).alias("predicted"))


def held_out(folds: int, fold: int) -> tuple[Column, Column]:
    """(learn, held_out): conditions on a sample's id and on doc_id."""
    return remainder(F.col("id"), folds) != fold, remainder(F.col("doc_id"), folds) == fold
