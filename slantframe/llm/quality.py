"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words (hashed, A-Z as a-z), runs of four character
classes (neighbouring bytes of one class count once) and, for every word,
whether it repeats one of the words just before it.  Term counts are damped, weighted by inverse document
frequency and projected by a truncated singular value decomposition.  The
labelled vectors are few and bounded, so they are broadcast; every document is
multiplied with all of them in blocks, and its nearest ones vote with their
cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.labelled import labelled_sample

#: Terms: hashed runs of classes, then words that repeat the last, the one before it, or neither, then hashed words.
RUNS, WORDS = 1021, 4093
TERMS = RUNS + 3 + WORDS
#: Texts whose counts are in memory at a time.
BLOCK = 256
SPACES = kernels.white_space()


def _classes() -> np.ndarray:
    out = np.full(256, 9, dtype=np.int64)
    out[128:] = 1
    for chars, k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t", 4), (b"\r\n", 5), (b".,;:", 6), (b"!?", 7), (b"|", 8), (b"#$%&*", 10), (b"<>{}[]()/\\", 11), (b"'\"-", 12)):
        out[list(chars)] = k
    return out


CLASSES = _classes()


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of blocks of texts; a row of TERMS counts for each text."""
    data, offsets = kernels.utf8(column)
    for a, b in ((x, min(x + BLOCK, end)) for start, end in kernels.chunks(offsets) for x in range(start, end, BLOCK)):
        own, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        counts = np.zeros(n * TERMS)
        kinds = CLASSES[own]
        first = np.empty(len(kinds), dtype=bool)
        if len(kinds):
            first[0] = True
            np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
            first[local[:-1][local[:-1] < len(kinds)]] = True
        at = np.flatnonzero(first)
        runs, text = kinds[at], np.searchsorted(local, at, side="right") - 1
        if len(runs) > 3:
            code = (runs[:-3] << 12 | runs[1:-2] << 8 | runs[2:-1] << 4 | runs[3:]) % RUNS
            same = text[:-3] == text[3:]
            counts += np.bincount(text[:-3][same] * TERMS + code[same], minlength=n * TERMS)
        hashes, bounds, _, _ = kernels.words(own, offsets[a : b + 1], SPACES)
        if len(hashes):
            of = np.searchsorted(bounds, np.arange(len(hashes)), side="right") - 1
            kind = np.full(len(hashes), RUNS + 2)
            for back in (2, 1):
                again = (hashes[back:] == hashes[:-back]) & (of[back:] == of[:-back])
                kind[back:][again] = RUNS + back - 1
            counts += np.bincount(of * TERMS + kind, minlength=n * TERMS)
            word = (hashes % np.uint64(WORDS)).astype(np.int64) + RUNS + 3
            counts += np.bincount(of * TERMS + word, minlength=n * TERMS)
        yield a, counts.reshape(n, TERMS)


@dataclass(frozen=True)
class QualityModel:
    """Term weights, projection, and the labelled unit vectors with their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        latent = (np.log1p(counts) * self.idf).astype(np.float32) @ self.axes
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 0)

    def scores(self, column: pa.Array, block: int = 256) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the prior where nothing is near."""
        out = np.full(len(column), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for first, counts in term_counts(column):
            latent = self.embed(counts)
            for x in range(0, len(latent), block):
                # Cosines that agree to six digits are ties, which go to the least id: vectors are in the order of ids.
                cosines = np.round(latent[x : x + block] @ self.vectors.T, 6)
                least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
                near, even = cosines > least, cosines == least
                near |= even & (np.cumsum(even, axis=1) <= k - near.sum(axis=1, keepdims=True))
                weight = np.where(near, np.maximum(cosines, 0), 0).astype(np.float64)
                total = weight.sum(axis=1)
                vote = weight @ self.labels
                out[first + x : first + x + len(cosines)] = np.where(total > 0, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def _leading(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(1).standard_normal((x.shape[1], min(2 * rank, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    return (axes @ turn[:rank].T).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", rows: int = 4096, rank: int = 48, neighbours: int = 15) -> QualityModel:
    """Fits the space and keeps the vectors of at most ``rows`` labelled rows (least id hashes).

    The driver gets ``rows`` x ``TERMS`` counts at most.  Without labelled
    rows every score is 0.5.
    """
    learn = F.lit(True) if learn is None else learn

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row.astype(np.float32).tobytes() for _, counts in term_counts(batch.column(2)) for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "label", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted((str(r[0]), r[1], bytes(r[2])) for r in labelled_sample(docs, labels, label, learn, rows).mapInArrow(counted, f"id {kind}, label int, counts binary").collect())
    y = np.array([r[1] for r in got], dtype=float)
    x = np.frombuffer(b"".join(r[2] for r in got), dtype=np.float32).reshape(-1, TERMS)
    if not len(y):
        return QualityModel(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours, 0.5)
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))) + 1
    energy = ((np.log1p(x) * idf) ** 2).sum(axis=0, dtype=np.float64)
    # Words and layout carry the same weight over the labelled rows.
    idf[RUNS + 3 :] *= np.sqrt(energy[: RUNS + 3].sum() / max(energy[RUNS + 3 :].sum(), 1e-12))
    model = QualityModel(idf, _leading((np.log1p(x) * idf).astype(np.float32), rank), np.zeros((0, rank), np.float32), y, neighbours, float(y.mean()))
    return QualityModel(idf, model.axes, model.embed(x), y, neighbours, float(y.mean()))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of every whole text.

    Null texts are empty texts, which have no near neighbour and get the share
    of label 1; repeated rows and null ids give a row each; other columns are
    not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
