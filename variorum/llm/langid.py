"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the set of its byte n-grams (lengths `GRAMS`, over lower-cased text in which every run of other bytes than
letters is one space); each n-gram is hashed to a row of an embedding table, the rows are averaged, and a linear
softmax gives the classes. Both layers are trained by stochastic gradient descent in numpy in one task, over at
most `SAMPLE` labelled documents of at most `SAMPLE_BYTES` in all (whole texts, in the order of a hash of doc_id), cut into
passages so that short texts are learned as well; only the model comes to the driver. Since averaging and the last layer are linear, the trained model ships as one table of
a logit per bucket and class, and scoring is a gather and a sum.

Calibration: on a tenth of the passages kept from training, a temperature is fitted by likelihood, and the rejection
threshold is set to the calibrated confidence below which passages are wrong more often than `RISK`.

The result has lang_pred (the best class, or `und` where the text is null or has no letter, with score 0), score
(its calibrated probability) and rejected (score under the threshold, or `und`). Documents with a null lang are
scored but teach nothing. Of equally likely classes the first by name counts. Repeated rows keep their multiplicity
(and teach once), extra columns are kept, and the result's names win over clashing ones. Without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from variorum.llm import bytesops as B
from variorum.llm.training import in_one_task, training_rows

#: The most labelled documents that a fit reads.
SAMPLE = 3000
#: The most bytes of their texts.
SAMPLE_BYTES = 64 << 20
BITS = 15
DIM = 16
GRAMS = (1, 2, 3, 4)
PASSAGE = 200  # bytes; learning also sees halves, quarters ... of passages
EPOCHS = 5
RATE = 4.0
BATCH = 64
RISK = 0.05
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # float32, (buckets, classes): an n-gram's share of the logits, over the temperature
    bias: np.ndarray
    threshold: float


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _letters(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals of Latin-1 (C3 80 to C3 9E); other bytes than letters become spaces."""
    low = B.LOWER[raw]
    if len(low) > 1:
        capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[capital] += 0x20
    return np.where(_LETTER[low], low, np.uint8(32))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each length, their rows, and the number of bytes that rows keep.

    Runs of spaces are one space, every row gets one before and one behind, so no n-gram leaves its row.
    """
    text = _letters(raw)
    letter = text != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter and the space that ends a word
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    text = text[keep]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    ends = np.cumsum(counts)
    # A space stands before each row's first byte; what ends the row before does that for all but the first.
    at = ends - counts
    text = np.insert(text, at[counts > 0], 32)
    row = np.insert(row, at[counts > 0], np.flatnonzero(counts > 0))
    x = text.astype(np.uint32)
    out = []
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        # Rolling from the right: the hash of the n bytes that end here.
        shifted = np.zeros(len(x), np.uint32)
        shifted[n - 1 :] = x[: len(x) - n + 1] if n > 1 else x
        h = h * np.uint32(0x01000193) ^ (shifted + np.uint32(0x9E37 * n))
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = mixed >> np.uint32(32 - BITS)
            good = np.zeros(len(x), bool)
            good[n - 1 :] = row[n - 1 :] == row[: len(row) - n + 1]
            out.append(np.where(good, bucket, np.uint32(1 << BITS)))  # the last bucket is for nothing
    return out, row, counts


def _logits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    grams, row, counts = _grams(raw, offsets)
    n = len(offsets) - 1
    total, used = np.zeros((n, len(model.classes))), np.zeros(n)
    if not len(row):
        return total + model.bias
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    for bucket in grams:
        got = np.add.reduceat(model.table[bucket], begins, axis=0)
        total[row[begins]] += got
        used[row[begins]] += np.add.reduceat((bucket < (1 << BITS)).astype(np.int64), begins)
    return total / np.maximum(used, 1)[:, None] + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _passages(texts: list[bytes], langs: list[str], rng: np.random.Generator) -> tuple[list[bytes], list[str]]:
    """All passages of all texts, of lengths from PASSAGE down to a sixteenth of it, cut at spaces where there are some."""
    cut, of = [], []
    for text, lang in zip(texts, langs, strict=True):
        at = 0
        while at < len(text):
            size = PASSAGE >> int(rng.integers(0, 5))
            to = min(len(text), at + size)
            space = text.find(b" ", to, to + 40)
            to = len(text) if to == len(text) else (space if space >= 0 else to)
            cut.append(text[at:to])
            of.append(lang)
            at = to
    return cut, of


def train(texts: list[bytes], langs: list[str], seed: int = 11, limit: int = 30_000) -> Model:
    """Fits on whole texts; limit bounds the passages of an epoch (drawn anew each time)."""
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    cut, of = _passages(texts, langs, rng)
    order = rng.permutation(len(cut))
    number = {c: i for i, c in enumerate(classes)}
    y_all = np.array([number[x] for x in of])
    aside, learn = order[: len(order) // 10 + 1], order[len(order) // 10 + 1 :]
    if not len(learn):
        learn = aside
    k = len(classes)
    embedding = rng.normal(0, 1 / DIM, ((1 << BITS) + 1, DIM))
    embedding[-1] = 0
    head, bias = np.zeros((DIM, k)), np.zeros(k)
    share = np.bincount(y_all[learn], minlength=k) / len(learn)
    weight = 1 / np.maximum(share * k, 0.05)
    steps = EPOCHS * (min(limit, len(learn)) // BATCH + 1)
    done = 0
    for _ in range(EPOCHS):
        for lo in range(0, min(limit, len(learn)), BATCH):
            pick = rng.choice(learn, BATCH)
            raw, offsets = B.column_bytes(pa.array([cut[i] for i in pick], pa.large_binary()))
            grams, row, _ = _grams(raw, offsets)
            bucket = np.concatenate(grams).astype(np.int64)
            rows = np.concatenate([row] * len(grams))
            good = bucket < (1 << BITS)
            bucket, rows = bucket[good], rows[good]
            count = np.maximum(np.bincount(rows, minlength=BATCH), 1)
            mean = np.zeros((BATCH, DIM))
            for d in range(DIM):
                mean[:, d] = np.bincount(rows, weights=embedding[bucket, d], minlength=BATCH)
            mean /= count[:, None]
            p = _softmax(mean @ head + bias)
            p[np.arange(BATCH), y_all[pick]] -= 1
            p *= weight[y_all[pick]][:, None]
            rate = RATE * (1 - done / steps)
            done += 1
            back = (p @ head.T) / count[:, None]
            head -= rate / BATCH * mean.T @ p
            bias -= rate / BATCH * p.sum(axis=0)
            np.subtract.at(embedding, bucket, rate * back[rows] / BATCH * 8)
    model = Model(classes, (embedding @ head).astype(np.float32), bias, 0.0)
    # Calibration on passages that took no part.
    raw, offsets = B.column_bytes(pa.array([cut[i] for i in aside], pa.large_binary()))
    z, y = _logits(model, raw, offsets), y_all[aside]
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(np.geomspace(0.02, 10, 60), key=loss)
    model.table, model.bias = (model.table / temperature).astype(np.float32), model.bias / temperature
    p = _softmax(z / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    rank = np.argsort(best)
    wrong = np.cumsum(~right[rank]) / np.arange(1, len(rank) + 1)  # among those up to each confidence
    over = np.flatnonzero(wrong > RISK)
    model.threshold = float(best[rank[over[-1]]]) if len(over) and len(over) < len(rank) else 1 / k
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the documents that are not held out and have a lang, at most `sample` of them."""
    open_ = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = training_rows(open_, ["lang"], sample, sample_bytes)
    return in_one_task(rows, lambda table: train(table["text"].cast(pa.large_binary()).to_pylist(), table["lang"].to_pylist()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    names = ("lang_pred", "score", "rejected")
    kept = docs.drop(*names).withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    at = kept.columns.index("text")
    schema = StructType([*kept.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets times classes, whatever the corpus's size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        classes = np.array([*model.classes, UNDETERMINED], dtype=object)
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(at), B.PIECE >> 1):
                letters = batch.column(batch.num_columns - 1)[lo:hi].to_numpy(zero_copy_only=False).astype(bool)
                if model.classes:
                    p = _softmax(_logits(model, raw, offsets))
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    best, score, letters = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                best = np.where(letters, best, len(classes) - 1)
                score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(classes[best], pa.string()), pa.array(score), pa.array(score < model.threshold)], names=[*batch.schema.names[:-1], *names])

    return kept.mapInArrow(B.task(read), schema)
