"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and pairs of neighbouring words (hashed, A-Z as a-z), runs of three character classes
(hashed), and how often a word stands again 1 to REPEATS words later. Counts are damped and weighted by inverse
document frequency; words and pairs make one unit vector, classes and repeats another, LEXICAL and 1 are their
weights. Both together are projected on the leading singular vectors of a labelled sample. The labelled vectors, at
most 2 * SAMPLE of DIMENSIONS numbers, are broadcast. Every document's vector is multiplied with all of them, a block
of rows at a time, and its NEIGHBOURS nearest vote with their labels, weighted by cosine similarity. The score is the
weighted share of label 1.

The sample: of each label the SAMPLE rows with the least hash of doc_id, so it does not depend on the order or
partitioning of rows and its size is bounded. Labels, language, source and id are no part of a score.

Cases: a null or empty text, or one that shares no term with the sample, scores the sample's mean label, as do
all where the sample lacks a label; without labelled rows every score is 0.5; cosines count to six places, and of
neighbours with equal ones the earlier in hash order goes first, so that a score depends on the text alone; a text
longer than PIECE bytes is counted piece by piece, terms that lie across a cut by their parts; repeated rows score
alike; an empty table gives an empty result; extra columns pass through unless they carry an output name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import encoded, hash48, parts, released
from .shingles import mixed, word_hashes

#: Most labelled rows of each label that the model is fitted on.
SAMPLE = 2000
DIMENSIONS = 32
NEIGHBOURS = 15
#: Similarities count to this power, so that near neighbours outweigh the rest.
SHARPNESS = 8
THRESHOLD = 0.7
#: Columns of character classes, words and pairs of words; distances of repeats; weight of words and pairs.
HASHED, WORDS, PAIRS, REPEATS = 1024, 2048, 1024, 8
LEXICAL = 0.5
COLUMNS = HASHED + REPEATS + WORDS + PAIRS
#: Bytes of one text and rows handled at once, and places of a cosine that count.
PIECE = 128 << 10
BLOCK_ROWS = 256
PLACES = 1e6
#: Passes of the subspace iteration that finds the singular vectors, and vectors that it carries beside those kept.
PASSES, SPARE = 8, 16

_CLASSES = 26


def _byte_classes() -> np.ndarray:
    """0: outside; small and accented letters 1, capitals 2, digits 3, space 4, line end 5, other marks their own."""
    out = np.full(256, 1, dtype=np.uint16)
    out[:128] = 6
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[[32, 9, 11, 12, 13]], out[10] = 4, 5
    for i, c in enumerate(".,!?'\"&#*$%|<>@/-:;"):
        out[ord(c)] = 7 + i
    return out


CLASS = _byte_classes()
_numbers = (np.arange(_CLASSES**3, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
TERM = ((_numbers ^ (_numbers >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(54)).astype(np.int32)


def _add(out: np.ndarray, first: int, width: int, owner: np.ndarray, column: np.ndarray) -> None:
    """Counts (owner, column) pairs into width columns of out from first on."""
    out[:, first : first + width] += np.bincount(owner * width + column, minlength=len(out) * width).reshape(len(out), width)


def _piece_counts(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros((len(pieces), COLUMNS), dtype=np.float32)
    data = np.frombuffer(b"\n".join(pieces) + b"\n", dtype=np.uint8)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(t) + 1 for t in pieces])
    c = CLASS[data]
    term = TERM[(c[:-2] * np.uint16(_CLASSES) + c[1:-1]) * np.uint16(_CLASSES) + c[2:]]
    inside = owner[2:] == owner[:-2]
    _add(out, 0, HASHED, owner[2:][inside], term[inside])
    words, firsts = word_hashes(pieces)
    of = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(firsts))
    for k in range(1, REPEATS + 1):
        same = (words[k:] == words[:-k]) & (of[k:] == of[:-k])
        _add(out, HASHED + k - 1, 1, of[k:][same], np.zeros(int(same.sum()), dtype=np.int32))
    _add(out, HASHED + REPEATS, WORDS, of, (words % np.uint64(WORDS)).astype(np.int32))
    together = of[1:] == of[:-1]
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])[together]
    _add(out, HASHED + REPEATS + WORDS, PAIRS, of[1:][together], (pairs % np.uint64(PAIRS)).astype(np.int32))
    return out


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(len(texts), COLUMNS): classes, repeats, words and pairs of each text."""
    out = np.zeros((len(texts), COLUMNS), dtype=np.float32)
    rows, held, size = [], [], 0

    def count():
        if rows:
            np.add.at(out, rows, _piece_counts(held))

    for row, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            rows.append(row)
            held.append(text[at : at + PIECE])
            size += len(held[-1])
            if size >= PIECE:
                count()
                rows, held, size = [], [], 0
    count()
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts by inverse document frequency; a row without terms stays 0."""
    x = np.log1p(counts) * idf
    style = HASHED + REPEATS
    return np.hstack((_unit(x[:, :style]), LEXICAL * _unit(x[:, style:])))


def sparse(counts: np.ndarray) -> bytes:
    """A row of counts as the numbers of its columns and their counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


class Rows:
    """The sample's counts, held sparsely and made dense a block at a time."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    def blocks(self):
        for lo in range(0, len(self.rows), BLOCK_ROWS):
            out = np.zeros((min(BLOCK_ROWS, len(self.rows) - lo), COLUMNS), dtype=np.float32)
            for i, raw in enumerate(self.rows[lo : lo + BLOCK_ROWS]):
                n = len(raw) // 6
                out[i, np.frombuffer(raw, dtype="<u2", count=n)] = np.frombuffer(raw, dtype="<f4", offset=2 * n)
            yield out


class Model:
    """Projection, labelled vectors and labels."""

    def __init__(self, rows: Rows, labels: np.ndarray) -> None:
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.votes = len(set(labels.tolist())) > 1
        seen = sum(((x > 0).sum(axis=0) for x in rows.blocks()), np.zeros(COLUMNS))
        self.idf = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
        if self.votes:
            q = np.linalg.qr(np.random.default_rng(7).standard_normal((COLUMNS, DIMENSIONS + SPARE)))[0]
            for _ in range(PASSES):
                y = np.zeros_like(q)
                for counts in rows.blocks():
                    x = _weighted(counts, self.idf)
                    y += x.T @ (x @ q.astype(np.float32))
                q, _ = np.linalg.qr(y)
            self.axes = np.ascontiguousarray(q[:, :DIMENSIONS])
            self.vectors, self.labels = np.concatenate([self.project(x) for x in rows.blocks()]), labels.astype(np.float64)

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf).astype(np.float64) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not self.votes or not len(counts):
            return np.full(len(counts), self.mean)
        n = len(self.labels)
        cosine = np.rint((self.project(counts) @ self.vectors.T) * PLACES).astype(np.int64)
        # one number for cosine and place in hash order: no two are equal, so the nearest are well defined
        key = cosine * n + np.arange(n - 1, -1, -1)
        k = min(NEIGHBOURS, n)
        nearest = np.sort(np.partition(key, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
        weight = np.maximum(nearest // n / PLACES, 0) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[n - 1 - nearest % n]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(share, 0, 1), self.mean)


def _blocks(batch: pa.RecordBatch, column: int):
    """A batch in runs of few rows and bytes, each with the counts of its texts."""
    for part in parts(batch, column, PIECE):
        for lo in range(0, part.num_rows, BLOCK_ROWS):
            some = part.slice(lo, BLOCK_ROWS)
            texts = encoded(some.column(column))
            yield some, texts, term_counts(texts)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from at most sample rows of each label, the least in hash order."""
    order = hash48(F.col("doc_id"), "fit")
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull())
    of = lambda value: known.filter(F.col("_label") == value).orderBy(order, "doc_id").limit(sample)
    chosen = of(0).unionByName(of(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def counted(batches):
        for batch in batches:
            for some, texts, counts in _blocks(batch, 1):
                digests = [hashlib.md5(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(digests), pa.array([sparse(r) for r in counts], pa.binary())], names=["doc_id", "label", "digest", "counts"])

    # repeated rows could exceed the bound: the limit of both labels' rows holds for what is collected
    rows = texts.select("doc_id", "text", "_label").mapInArrow(released(counted), "doc_id long, label int, digest string, counts binary")
    rows = rows.orderBy(order, "doc_id", "digest", "label").limit(2 * sample).collect()
    return Model(Rows([bytes(r["counts"]) for r in rows]), np.array([r["label"] for r in rows], dtype=np.int64))


def scored(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("score", "predicted")
    kept = [f for f in docs.schema.fields if f.name not in added]
    at = [f.name for f in kept].index(text)

    def run(batches):
        for batch in batches:
            for some, _, counts in _blocks(batch, at):
                score = shared.value.scores(counts)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*(f.name for f in kept), *added])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(released(run), StructType(list(kept)).add("score", DoubleType()).add("predicted", IntegerType()))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels the model never sees: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a model fitted on labels that are not held out."""
    model = fit(docs, labels.filter(~held_out()))
    return scored(docs, model).withColumn("held_out", held_out())


