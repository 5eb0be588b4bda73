"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A document is a bag of sentences and is toxic if some sentence is. A sentence's score is the logistic of a prior (less, the
more sentences there are) and a sum of hashed feature weights (each word, and its prefixes of 4 to 6 bytes, counted once a
sentence); a document's is 1 - prod(1 - sentence score), in training as in scoring.
Only documents are labelled; the gradient of the noisy-or hands the blame to the sentences that best explain a
label, so the fitted model also locates the offending sentences.

The fit is by proximal AdaGrad (an L1 penalty keeps the weights of words that mean nothing at exactly zero) over all
labelled documents that are not held out. A hash of doc_id deals them to groups of about `GROUP_BYTES` of texts. In each of
`ROUNDS` rounds every group goes on in a task from the common weights, and the next common weight is the mean of the groups',
each counted by its evidence: the sum of the squared gradients that the group had for it (to a quarter of a power of two), so
groups without a word don't dilute what others learned of it. It is zero where it is so by more than half of the evidence, else
every group would add its own chance words to the model. Groups are added in order, hence the model is the same however
the tables are laid out; only the sums come to the driver (`BUCKETS` at most). With one group, rounds are epochs of one fit.
A doc_id that is labelled twice is toxic if one label says so, and a document that comes twice teaches once.
Scoring covers every document's whole text. Words are runs of ASCII letters, digits and bytes beyond ASCII, in
lower case; sentences end with . ! ? or a line feed.

A null text counts as empty. An empty text gets the noisy-or of no sentence, 0, which is not toxic. Repeated rows
keep their multiplicity, extra columns are kept. With no labelled row of either class the model scores all 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from variorum.llm import bytesops as B
from variorum.llm import storage
from variorum.llm.training import distinct

#: Bytes of the texts of a group, about.
GROUP_BYTES = 16 << 20
#: Bytes of the texts of a step of the descent, about.
STEP_BYTES = 1 << 18
#: The buckets go in so many slices where groups are added.
SLICES = 16
BITS = 18
BUCKETS = 1 << BITS
PREFIXES = (4, 5, 6)
#: Rounds of the groups, and epochs of a group in each.
ROUNDS, EPOCHS = 4, 6
#: How much more than a clean document a toxic one counts, at most.
LEAN = 1.0
RATE = 1.0
#: What the squared gradients of AdaGrad start at.
FLOOR = 1e-2
PENALTY = 2e-4
OFFENDING = 0.5
#: Log-odds of the only sentence of a document, without telling words. In a document of n sentences they are less by log n:
#: a document is as likely to be toxic whatever its length, and faint sentences of a book don't add up.
PRIOR = -7.0

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each bucket
    bias: float


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For _bucket: sums, and where words start and end; the sentence of each word, and where sentences start and end."""
    low = B.LOWER[raw]
    starts, ends = B.spans(B.WORD[low], offsets[:-1])
    s_from, s_to = B.spans(~_BREAK[low], offsets[:-1])
    return B.running(low), starts, ends, np.searchsorted(s_from, starts, side="right") - 1, s_from, s_to


def _bucket(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each word (n = 0), or of its first n bytes."""
    to = np.minimum(starts + n, ends) if n else ends
    return ((B.span_hash(sums, starts, to) + np.uint64(n * 0x9E3779B9)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(raw: np.ndarray, offsets: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of sentences (useful buckets, and the sentence of each), and sentences' rows, starts and ends."""
    sums, starts, ends, of, s_from, s_to = _words(raw, offsets)
    parts = []
    for n in (0, *PREFIXES):
        bucket = _bucket(sums, starts, ends, n)
        keep = useful[bucket]
        parts.append(of[keep] * BUCKETS + bucket[keep])
    distinct = np.unique(np.concatenate(parts))
    return distinct & (BUCKETS - 1), distinct >> BITS, B.row_of(s_from, offsets), s_from, s_to


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(B.sums_by_row(np.log1p(-np.minimum(p, 1 - 1e-12)), rows, n))


def _prior(bias: float, rows: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of every sentence before its words are looked at."""
    return bias - np.log(np.maximum(np.bincount(rows, minlength=n), 1))[rows]


def coded(texts: pa.Array, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """What a fit needs of whole texts and their 0/1 labels.

    units: distinct words by what they add to their sentence, a bucket for each kind of feature, or BUCKETS where it is there
    already. unit: of every word that adds something. words: how many of these each sentence has. sentences: how many each
    text has. texts: how many each step of the descent takes.
    """
    keys, rows, units, words, sentences, sizes = [], [], [], [], [], []
    for lo, hi, raw, offsets in B.pieces(texts, STEP_BYTES):
        sums, starts, ends, of, s_from, _ = _words(raw, offsets)
        buckets = np.stack([_bucket(sums, starts, ends, n) for n in (0, *PREFIXES)])
        new = np.zeros(buckets.size, bool)
        new[np.unique(of * BUCKETS + buckets, return_index=True)[1]] = True
        buckets = np.where(new.reshape(buckets.shape), buckets, BUCKETS)
        adds = (buckets < BUCKETS).any(axis=0)
        key = np.zeros(int(adds.sum()), np.uint64)
        for kind in buckets[:, adds].astype(np.uint64):
            key = B.mix(key + kind + np.uint64(1))
        key, at, unit = np.unique(key, return_index=True, return_inverse=True)
        keys.append(key)
        rows.append(buckets[:, adds][:, at].T)
        units.append(unit)
        words.append(np.bincount(of[adds], minlength=len(s_from)))
        sentences.append(np.bincount(B.row_of(s_from, offsets), minlength=hi - lo))
        sizes.append(hi - lo)
    none = [np.zeros(0, np.int32)]
    every, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_index=True)
    unit = np.concatenate([*none, *(np.searchsorted(every, k)[u] for k, u in zip(keys, units, strict=True))]).astype(np.int64)
    # Frequent ones first, which is shorter.
    order = np.argsort(-np.bincount(unit, minlength=len(every)), kind="stable")
    place = np.empty(len(every), np.int32)
    place[order] = np.arange(len(every))
    return {
        "units": np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int64), *rows])[at[order]].astype(np.int32),
        "unit": place[unit],
        "words": np.concatenate(none + words).astype(np.int32),
        "sentences": np.concatenate(none + sentences).astype(np.int32),
        "texts": np.array(sizes, np.int32),
        "toxic": np.asarray(toxic, np.int32),
    }


def _packed(x: np.ndarray) -> bytes:
    """int32 numbers; their first bytes, their second ones and so on."""
    return zlib.compress(np.ascontiguousarray(x.ravel().view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _steps(c: dict[str, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """For each step: labels, the row of each sentence, sentence and local unit of each word, buckets, and the places of units' in them."""
    out = []
    text = sentence = word = 0
    for n in c["texts"].tolist():
        per_text = c["sentences"][text : text + n]
        per_sentence = c["words"][sentence : sentence + per_text.sum()]
        unit = c["unit"][word : word + per_sentence.sum()]
        local, unit = np.unique(unit, return_inverse=True)
        at, places = np.unique(c["units"][local], return_inverse=True)
        out.append((c["toxic"][text : text + n].astype(np.float64), np.repeat(np.arange(n), per_text), np.repeat(np.arange(len(per_sentence)), per_sentence), unit, at, places.reshape(len(local), -1)))
        text, sentence, word = text + n, sentence + len(per_sentence), word + len(unit)
    return out


def descend(c: dict[str, np.ndarray], weights: np.ndarray, energy: np.ndarray, share: float, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and energy after some epochs from those given. share: of all labels, those that are 1."""
    weights, energy = np.append(weights, 0.0), np.append(energy, 1.0)  # the last is of no bucket
    steps, rng = _steps(c), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(steps)):
            y, rows, of, unit, at, places = steps[k]
            n, now = len(y), weights[at]
            p = _logistic(_prior(PRIOR, rows, n) + B.sums_by_row(now[places].sum(axis=1)[unit], of, len(rows)))
            doc = np.clip(_noisy_or(p, rows, n), 1e-9, 1 - 1e-9)
            # d loss / d z of a sentence: p if the document is clean, else -(1 - P) / P * p.
            dz = np.where(y == 1, -(1 - doc) / doc * min(0.5 / share, LEAN), 1.0)[rows] * p
            of_unit = np.bincount(unit, weights=dz[of], minlength=len(places))
            grad = np.bincount(places.ravel(), weights=np.repeat(of_unit, places.shape[1]), minlength=len(at)) / n
            grad[at == BUCKETS] = 0
            some = grad != 0
            at, grad = at[some], grad[some]
            energy[at] += grad**2
            step = RATE / np.sqrt(energy[at])
            moved = weights[at] - step * grad
            weights[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
    return weights[:-1], energy[:-1]


def fit(docs: DataFrame, labels: DataFrame, group_bytes: int = GROUP_BYTES) -> Model:
    """A model from all labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(known, "doc_id")
    n, bad, size = sizes.agg(F.count("*"), F.sum("toxic"), F.sum("size")).head()
    if not n or bad in (0, n):
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    share = bad / n
    dealt = lambda df: df.groupBy(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(size // group_bytes + 1)).alias("part"))

    def code(key: tuple[pa.Scalar], own: pa.Table, said: pa.Table) -> pa.Table:
        at = pc.index_in(own["doc_id"].combine_chunks(), value_set=said["doc_id"].combine_chunks())
        own = own.select(["doc_id", "text"]).append_column("toxic", pc.take(said["toxic"].combine_chunks(), at))
        own = distinct(own.filter(pc.is_valid(at)))
        c = coded(own["text"].combine_chunks(), own["toxic"].to_numpy())
        B.release()
        return pa.table({"part": [key[0].as_py()], **{k: [_packed(x)] for k, x in c.items()}})

    names = ("units", "unit", "words", "sentences", "texts", "toxic")
    groups = storage.kept(dealt(texts).cogroup(dealt(known)).applyInArrow(code, f"part long, {', '.join(f'{k} binary' for k in names)}"), "toxicity-groups")
    weights, energy = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, FLOOR, np.float32)
    for k in range(ROUNDS):
        weights, energy = _round(groups, weights, energy, share, k)
    return Model(weights, PRIOR)


def _round(groups: DataFrame, weights: np.ndarray, energy: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The common weights and energy after every group went on from those given."""
    shipped = groups.sparkSession.sparkContext.broadcast((weights, energy))  # BUCKETS floats each
    n = BUCKETS // SLICES

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, energy = (x.astype(np.float64) for x in shipped.value)
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                c = {name: _unpacked(batch.column(name)[i].as_py()) for name in batch.schema.names[1:]}
                c["units"] = c["units"].reshape(-1, 1 + len(PREFIXES))
                new, gained = descend(c, weights, energy, share, k)
                gained -= energy
                # 1 to 255 for 2^-50 to 2^13.5, 0 for nothing.
                evidence = np.where(gained > 0, np.clip(np.rint(4 * np.log2(np.maximum(gained, 1e-300))) + 201, 1, 255), 0).astype(np.uint8)
                held = [np.flatnonzero(evidence[s : s + n] * (new[s : s + n] != 0)).astype(np.int32) for s in range(0, BUCKETS, n)]
                yield pa.RecordBatch.from_pydict({
                    "slice": np.arange(SLICES, dtype=np.int32),
                    "part": np.full(SLICES, part),
                    "evidence": [evidence[s : s + n].tobytes() for s in range(0, BUCKETS, n)],
                    "at": [x.tobytes() for x in held],
                    "weight": [new[s : s + n][x].astype(np.float32).tobytes() for s, x in zip(range(0, BUCKETS, n), held, strict=True)],
                })

    def add(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        total, moved, having, held = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for row in rows.sort_by("part").to_pylist():
            level, at = np.frombuffer(row["evidence"], np.uint8), np.frombuffer(row["at"], np.int32)
            evidence = np.where(level > 0, 2.0 ** ((level - 201.0) / 4), 0)
            total += evidence
            having += level > 0
            moved[at] += evidence[at] * np.frombuffer(row["weight"], np.float32)
            held[at] += evidence[at]
        moved[2 * held < total] = 0
        some = np.flatnonzero(having).astype(np.int32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "at": [some.tobytes()], "weight": [(moved[some] / total[some]).astype(np.float32).tobytes()], "gained": [(total[some] / having[some]).astype(np.float32).tobytes()]})

    rows = groups.mapInArrow(B.task(go_on), "slice int, part long, evidence binary, at binary, weight binary")
    weights, energy = weights.copy(), energy.copy()
    for row in rows.groupBy("slice").applyInArrow(add, "slice int, at binary, weight binary, gained binary").toArrow().to_pylist():
        at = np.frombuffer(row["at"], np.int32) + row["slice"] * n
        weights[at] = np.frombuffer(row["weight"], np.float32)
        energy[at] += np.frombuffer(row["gained"], np.float32)
    shipped.unpersist()
    return weights, energy


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted and offending: the byte spans and scores of sentences scored OFFENDING or more."""
    names = ("score", "predicted", "offending")
    kept = docs.drop(*names)
    at = kept.columns.index("text")
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("offending", ArrayType(span))])
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS floats, whatever the corpus's size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value
        useful = weights != 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(at)):
                n = hi - lo
                buckets, of, rows, s_from, s_to = _features(raw, offsets, useful)
                p = _logistic(_prior(bias, rows, n) + B.sums_by_row(weights[buckets], of, len(rows)))
                total = np.clip(_noisy_or(p, rows, n), 0.0, 1.0)
                bad = np.flatnonzero(p >= OFFENDING)
                spans: list[list[dict]] = [[] for _ in range(n)]
                for i in bad.tolist():
                    row = int(rows[i])
                    spans[row].append({"start": int(s_from[i] - offsets[row]), "end": int(s_to[i] - offsets[row]), "score": float(p[i])})
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(B.task(read), schema)
