"""Language of a text in two steps: its family, then the language within the family.

A text's features are the runs of one to four bytes (UTF-8, small letters) in which no two neighbours are outside of
words, hashed into COLUMNS counts, damped and made a unit vector; everything but letters counts as one blank. Families
are told apart by linear support vector machines, one against the rest; within a family there is one for every pair of
languages, and the language that wins most of its pairs is taken (ties: the larger sum of margins, then the name). All
are fitted on at most SAMPLE texts of each language, the least in hash order, by dual coordinate descent on the squared
hinge loss. What is broadcast is a weight a column for each machine.

The score is the family's share of the families' softened margins times the mean, over the language's pairs, of their
logistic margins: 1 is certain. Language, source and id are no part of a prediction.

Cases: a null text or one without a letter (Unicode L) is `und` with score 0, as is every text where nothing was
learned; one learned language is always taken; a language without a known family is a family of its own; texts without
features of the sample go where the biases point; a text longer than PIECE bytes is counted piece by piece; equal texts
get equal results; an empty table gives an empty result; extra columns pass through unless they carry an output name.
More than MAX_LANGUAGES learned values raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import encoded, hash48, parts, released
from .quality_classifier import held_out, sparse
from .shingles import mixed

#: Most labelled texts of each language that the model is fitted on; most languages.
SAMPLE, MAX_LANGUAGES = 300, 64
COLUMNS, LONGEST = 2048, 4
#: Bytes of one text and rows handled at once.
PIECE, BLOCK_ROWS = 128 << 10, 256
#: Passes over the sample, cost of a margin below 1, and how a margin turns into confidence.
PASSES, COST, STEEPNESS = 20, 4.0, 3.0
UNKNOWN = "und"

#: Languages by family (fixed values).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc rm la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz tk ky".split(),
    "indic": "hi bn ur pa gu mr ne".split(),
}


def _letters() -> np.ndarray:
    """Bytes of words as they are, A-Z as a-z, all others as blanks; bytes above 127 belong to words."""
    out = np.full(256, 32, dtype=np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = out[65:91] = np.arange(97, 123)
    return out


LETTERS = _letters()


def _folded(pieces: list[bytes]) -> np.ndarray:
    """The bytes of all pieces, each with a blank before and after it; capitals of Latin-1 as small letters."""
    raw = np.frombuffer(b"\n" + b"\n\n".join(pieces) + b"\n", dtype=np.uint8)
    data = LETTERS[raw]
    capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    data[capital] += 0x20
    return data


def _piece_counts(pieces: list[bytes]) -> np.ndarray:
    data = _folded(pieces)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int64), [len(p) + 2 for p in pieces])
    blank = data == 32
    # a run may not hold two blanks in a row, so none begins in one text and ends in the next
    apart = np.concatenate((blank[1:] & blank[:-1], [True]))
    rolling = np.zeros(len(data), dtype=np.uint64)
    alive = np.ones(len(data), dtype=bool)
    out = np.zeros(len(pieces) * COLUMNS, dtype=np.int64)
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        if n > 1:
            alive = alive[:m] & ~apart[n - 2 : n - 2 + m]
        rolling = rolling[:m] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        use = alive & ~blank if n == 1 else alive
        column = mixed(rolling[use] * np.uint64(LONGEST) + np.uint64(n - 1)) % np.uint64(COLUMNS)
        out += np.bincount(owner[:m][use] * COLUMNS + column.astype(np.int64), minlength=len(out))
    return out.reshape(len(pieces), COLUMNS)


def feature_counts(texts: list[bytes]) -> np.ndarray:
    """(len(texts), COLUMNS) counts."""
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


def vectors(counts: np.ndarray) -> np.ndarray:
    """Damped counts as unit vectors; a row without features stays 0."""
    x = np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def dense(rows: list[bytes]) -> np.ndarray:
    """Rows of counts from their columns and counts."""
    out = np.zeros((len(rows), COLUMNS), dtype=np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        out[i, np.frombuffer(raw, dtype="<u2", count=n)] = np.frombuffer(raw, dtype="<f4", offset=2 * n)
    return out


def machine(x: np.ndarray, positive: np.ndarray, passes: int = PASSES, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge loss) by dual coordinate descent. Both sides
    weigh alike, however many rows they have."""
    rows = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    ease = share / cost  # 1 / (2 C) with C = cost / (2 share)
    norm = np.square(rows).sum(axis=1) + ease
    w, alpha = np.zeros(rows.shape[1]), np.zeros(len(rows))
    draw = np.random.default_rng(3)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            slack = y[i] * (rows[i] @ w) - 1 + ease[i] * alpha[i]
            new = max(alpha[i] - slack / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * rows[i]
                alpha[i] = new
    return w


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(STEEPNESS * margin, -50, 50)))


class Model:
    """Machines between families and between the pairs of languages in each."""

    def __init__(self, counts: list[bytes], languages: list[str], families: dict[str, list[str]]) -> None:
        of = {code: name for name, codes in families.items() for code in codes}
        self.languages = sorted(set(languages))
        self.families: dict[str, list[int]] = {}
        for i, code in enumerate(self.languages):
            self.families.setdefault(of.get(code, f"only {code}"), []).append(i)
        self.names = sorted(self.families)
        if not self.languages:
            return
        label = np.array([self.languages.index(code) for code in languages])
        x = vectors(dense(counts))
        family = np.array([next(k for k, name in enumerate(self.names) if i in self.families[name]) for i in range(len(self.languages))])[label]
        self.between = np.array([machine(x, family == k) for k in range(len(self.names))]) if len(self.names) > 1 else None
        self.within: dict[tuple[int, int], np.ndarray] = {}
        for members in self.families.values():
            for n, a in enumerate(members):
                for b in members[n + 1 :]:
                    two = (label == a) | (label == b)
                    self.within[a, b] = machine(x[two], label[two] == a)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of rows of counts."""
        rows = vectors(counts).astype(np.float64)
        rows = np.hstack((rows, np.ones((len(rows), 1))))
        if self.between is None:
            family, sure = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows))
        else:
            margins = np.round(rows @ self.between.T, 9)
            family = margins.argmax(axis=1)
            soft = np.exp(STEEPNESS * (margins - margins.max(axis=1, keepdims=True)))
            sure = 1 / soft.sum(axis=1)
        out = np.zeros(len(rows), dtype=np.int64)
        for k, name in enumerate(self.names):
            mine, members = np.flatnonzero(family == k), self.families[name]
            if not len(mine):
                continue
            won, total, trust = (np.zeros((len(mine), len(members))) for _ in range(3))
            for a, i in enumerate(members):
                for b in range(a + 1, len(members)):
                    margin = np.round(rows[mine] @ self.within[i, members[b]], 9)
                    for side, value in ((a, margin), (b, -margin)):
                        won[:, side] += (value > 0) | (value == 0) & (side == a)
                        total[:, side] += value
                        trust[:, side] += _logistic(value)
            best = np.lexsort((-np.broadcast_to(np.arange(len(members)), won.shape), total, won), axis=1)[:, -1]
            out[mine] = np.array(members)[best]
            if len(members) > 1:
                sure[mine] *= trust[np.arange(len(mine)), best] / (len(members) - 1)
        return out, np.round(np.clip(sure, 0, 1), 6)


def _blocks(batch: pa.RecordBatch, column: int):
    for part in parts(batch, column, PIECE):
        for lo in range(0, part.num_rows, BLOCK_ROWS):
            some = part.slice(lo, BLOCK_ROWS)
            texts = encoded(some.column(column))
            yield some, texts, feature_counts(texts)


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter of any script."""
    if any(65 <= c <= 122 and c not in b"[\\]^_`" for c in text[:64]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(docs: DataFrame, *, language: str = "lang", sample: int = SAMPLE, families: dict[str, list[str]] | None = None) -> Model:
    """The model from at most sample texts of each language, the least in hash order."""
    order = hash48(F.col("doc_id"), "language")
    known = docs.select("doc_id", F.col(language).alias("_language")).filter("_language IS NOT NULL AND doc_id IS NOT NULL")
    codes = [r[0] for r in known.select("_language").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(codes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # each task keeps its least rows of a language before any is shuffled
    ranked = Window.partitionBy("_language").orderBy(order, "doc_id")
    chosen = known.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= sample).drop("_rank").distinct()
    texts = docs.select("doc_id", "text", F.col(language).alias("_language")).join(F.broadcast(chosen), ["doc_id", "_language"])

    def counted(batches):
        for batch in batches:
            for some, texts, counts in _blocks(batch, 2):
                digests = [hashlib.md5(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(digests), pa.array([sparse(r) for r in counts], pa.binary())], names=["doc_id", "language", "digest", "counts"])

    rows = texts.select("doc_id", "_language", "text").mapInArrow(released(counted), "doc_id long, language string, digest string, counts binary")
    # repeated rows could exceed the bound: it holds for what is collected
    rows = rows.orderBy(order, "doc_id", "digest", "language").limit(sample * max(1, len(codes))).collect()
    return Model([bytes(r["counts"]) for r in rows], [r["language"] for r in rows], FAMILIES if families is None else families)


def predicted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name not in added]
    at = [f.name for f in kept].index(text)

    def run(batches):
        for batch in batches:
            for some, texts, counts in _blocks(batch, at):
                found = shared.value
                told = np.array([bool(found.languages) and has_letter(t) for t in texts], dtype=bool)
                language, score = found.predict(counts) if found.languages else (np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)))
                names = [found.languages[i] if ok else UNKNOWN for i, ok in zip(language, told, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(names, pa.string()), pa.array(np.where(told, score, 0.0))], names=[*(f.name for f in kept), *added])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(released(run), StructType(list(kept)).add("lang_pred", StringType()).add("score", DoubleType()))


def languages(docs: DataFrame) -> DataFrame:
    """The language of every document by a model fitted on those that are not held out."""
    return predicted(docs.drop("held_out"), fit(docs.filter(~held_out()))).withColumn("held_out", held_out())
