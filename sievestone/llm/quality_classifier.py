"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded, documented sample of labelled texts (`per_label` of each label, the first by a hash of the id) gives the space:
log-scaled counts of hashed byte trigrams, and of words that repeat the word before them, inverse document frequency, and a truncated singular value decomposition of
the sample. The sample's vectors, their labels and the projection are broadcast; their size is fixed by the parameters.
Every text of the corpus is projected, its cosines with all labelled vectors are computed exactly in blocks, and the
labels of the `neighbours` nearest vote with weight exp(similarity / temperature).

Defined results: null and empty texts have the zero vector, so all cosines are 0 and all labelled vectors vote alike.
Equal similarities go to the earlier labelled row. Rows that repeat a labelled id count once. Without labelled rows every score is 0.5. Whole texts count, whatever
their length. Rows repeat as they come; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, likely_first, mix, span_hashes, text_buffer, text_slices, word_spans

FEATURES = 4096
RANK = 64
PER_LABEL = 1000
NEIGHBOURS = 15
TEMPERATURE = 0.1
#: Weight of the term for repeated words, one against thousands of trigrams.
REPEATS = 8.0
THRESHOLD = 0.3
#: Texts are counted in parts of so many bytes and rows, which bounds a worker's memory.
PART_BYTES, PART_ROWS = 1 << 18, 128


class Model(NamedTuple):
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def counts(texts: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Counts of hashed byte trigrams, a row for each text; the first column counts words equal to the word before,
    beyond the first two, which occur in ordinary prose."""
    data, offs = text_buffer(texts)
    out = np.zeros(len(texts) * features, np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint64)
        grams = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
        rows = np.repeat(np.arange(len(texts)), np.diff(offs))[:-2]
        inside = np.arange(len(grams)) + 3 <= offs[rows + 1]
        keys = rows[inside] * features + 1 + (mix(grams[inside]) % np.uint64(features - 1)).astype(np.int64)
        out = np.bincount(keys, minlength=len(out)).astype(np.float32)
    out = out.reshape(len(texts), features)
    starts, ends, rows = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    again = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out[:, 0] = np.maximum(0, np.bincount(rows[1:][again], minlength=len(texts)) - 2)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _weigh(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    scaled = np.log1p(raw) * idf
    scaled[:, 0] *= REPEATS
    return _unit(scaled)


def project(texts: pa.Array, model: Model) -> np.ndarray:
    return _unit(_weigh(counts(texts, len(model.idf)), model.idf) @ model.projection)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, features: int = FEATURES, rank: int = RANK) -> Model | None:
    """From documents (doc_id, text) and labels (doc_id, quality) with quality 0 or 1; other labels are ignored."""
    labels = labels.where(F.col("quality").isin(0, 1)).select(F.xxhash64("doc_id").alias("h"), "doc_id", F.col("quality").cast("int").alias("quality"))
    totals = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    parts = [labels.where((F.col("quality") == q) & likely_first(F.col("h"), per_label, totals.get(q, 0))).orderBy("h", "doc_id").limit(per_label) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).distinct()  # at most 2 * per_label rows
    rows = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "text", "quality")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch):
                raw = counts(part.column("text"), features).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("quality"), pa.array([r.tobytes() for r in raw], pa.binary())], ["h", "quality", "raw"])

    counted = rows.mapInArrow(frugal(count), T.StructType.fromDDL("h long, quality int, raw binary"))
    # An id that many rows repeat is one labelled row, so that what is collected keeps its bound.
    got = counted.groupBy("h", "quality").agg(F.min("raw").alias("raw")).collect()  # at most 2 * per_label rows of 4 * features bytes
    if not got:
        return None
    got.sort(key=lambda r: (r["h"], bytes(r["raw"])))
    raw = np.stack([np.frombuffer(r["raw"], "<u4") for r in got]).astype(np.float32)
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weigh(raw, idf)
    # Leading eigenvectors of x x' give the decomposition; the sample bounds its size.
    values, vectors = np.linalg.eigh(x @ x.T)
    best = np.argsort(-values)[: min(rank, len(values))]
    best = best[values[best] > 1e-6]
    projection = (x.T @ vectors[:, best]) / np.sqrt(values[best])
    # The sign of a singular vector is arbitrary: fixed here, so that runs agree.
    projection *= np.sign(projection[np.abs(projection).argmax(axis=0), np.arange(projection.shape[1])])
    return Model(idf, projection.astype(np.float32), _unit((x @ projection).astype(np.float32)), np.array([r["quality"] for r in got], np.float32))


def vote(vectors: np.ndarray, model: Model, neighbours: int = NEIGHBOURS, temperature: float = TEMPERATURE, block: int = 1024) -> np.ndarray:
    """Scores of unit vectors: exact cosines with all labelled vectors, a block of rows at a time."""
    out = []
    for a in range(0, len(vectors), block):
        cosines = vectors[a : a + block] @ model.vectors.T
        k = min(neighbours, cosines.shape[1])
        # The k-th largest value first; ties at it go to the earlier labelled row.
        bound = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k][:, None]
        above = cosines > bound
        tied = cosines == bound
        room = k - above.sum(axis=1, keepdims=True)
        near = above | (tied & (np.cumsum(tied, axis=1) <= room))
        weights = np.where(near, np.exp((cosines - cosines.max(axis=1, keepdims=True)) / temperature), 0.0)
        zero = ~vectors[a : a + block].any(axis=1)
        weights[zero] = 1.0
        out.append((weights @ model.labels.astype(np.float64)) / weights.sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def _scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return np.clip(vote(project(texts, model), model), 0.0, 1.0)


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batch, limit=PART_BYTES):
        for at in range(0, part.num_rows, PART_ROWS):
            yield part.slice(at, PART_ROWS)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by features, rank and per_label

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in (x for batch in batches for x in _few(batch)):
            s = _scores(few.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(judge), T.StructType.fromDDL("doc_id long, score double, predicted int"))


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns; nothing is joined or shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in (x for batch in batches for x in _few(batch)):
            yield few.filter(pa.array(_scores(few.column("text"), sent.value) >= threshold))

    return docs.mapInArrow(frugal(keep), docs.schema)
