"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most `PASSAGE` words, which overlap by half. Their words, hashed to at most
   2^`BITS` columns, are the terms; document frequencies of all terms are counted over the whole corpus and give the TF-IDF
   weights. Function words weigh nothing.
2. The latent space is the leading `RANK` right singular directions of the TF-IDF matrix of all benchmark passages, which are
   what is searched for, by a randomised SVD: a Gaussian sketch and subspace iterations. Windows of the corpus are folded in
   (they have no terms besides the passages'). Passes over the matrix are distributed, and their shares are added and
   orthogonalised in one task; all have columns times RANK numbers, however large benchmark and corpus are.
3. Every document is cut into windows that begin at every `STRIDE` words; a window's latent vector is the sum of its
   words'. A passage is held against windows that are just long enough to contain it wherever it stands (`WINDOWS`), and
   whose surroundings have `RARE` of its rarest words: a leak has `PARAPHRASE` of a passage's words, so whichever others it
   has, it has three of the rarest (1 - PARAPHRASE of them and three more). That index loses nothing and spares most vectors.
   Windows whose cosine reaches `COSINE` are candidates. A scan of the corpus takes `GROUP` passages, so a corpus is scanned
   once for every so many.
4. A candidate's surroundings are compared with the passage by the longest common subsequence of words, as a share of the
   passage's words. It is a leak if the share is `VERBATIM` or more, or if it is `PARAPHRASE` or more and the passage's
   answer, its last `ANSWER` words, is there at that place too (half of them or more are in the common subsequence).

Items under `SHORTEST` words are too short for a paraphrase to be told from chance; they are searched exactly, as sequences
of words (cosine and share are 1 then). An item without words is in nothing. Of several places of an item in a document the
best is told, of equally good ones the last. Null texts, empty texts and rows with null ids give nothing, an item or a
document that comes twice counts once, texts are taken whole however long, and other columns take no part. An empty
benchmark or corpus gives an empty result. The result has a row per document and item found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

PASSAGE, SHORTEST = 96, 8
STRIDE, WINDOWS = 8, (16, 24, 32, 48, 64, 112)
BITS = 16
RANK = 160
GROUP = 8192
COSINE = 0.4
#: How many of a passage's rarest words have to stand around a window.
RARE = 3
#: The share of all words of the corpus from which a word counts as a function word (so there are 400 at most).
STOP = 0.0025
VERBATIM, PARAPHRASE = 0.8, 0.65
ANSWER = 8
PIECE = 1 << 17
#: Pairs of windows and passages whose vectors are multiplied at once.
_PAIRS = 1 << 14
RESULT = "doc_id long, item_id long, lcs double, cosine double, answer_found boolean, first_word long"
_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _longest(window: int) -> int:
    """The longest passage that stands whole in some window of this size, wherever it stands."""
    return window - STRIDE + 1


@dataclass
class Space:
    """The latent space: at most 2^BITS columns."""

    column: np.ndarray  # int32, of each bucket; the number of columns for words of no passage
    latent: np.ndarray  # float32 (columns + 1, rank): weighted latent vectors, the last zero
    stands: np.ndarray  # int64, of each column: how many words of the corpus it has


@dataclass
class Group:
    """At most GROUP passages, with the latent vectors of each class of lengths."""

    items: np.ndarray
    words: list[np.ndarray]
    classes: list[tuple[int, np.ndarray, np.ndarray]]  # blocks of a window, passages of this class, their unit vectors (passages, rank)
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]  # ascending words, where each one's passages begin, passages
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: ascending hashes of short items, and the passage of each


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[raw]
    starts, ends = B.spans(B.WORD[low], offsets[:-1])
    return B.span_hash(B.running(low), starts, ends), np.searchsorted(starts, offsets)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id and words (hashes) of every passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begins = _words(*B.column_bytes(batch.column(1)))
            out = []
            for item, a, b in zip(batch.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                starts = [a] if b - a <= PASSAGE else range(a, b - PASSAGE // 2, PASSAGE // 2)
                out += [(item, words[at : min(at + PASSAGE, b)].view(np.int64)) for at in starts if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in out], pa.list_(pa.int64()))], names=["item_id", "words"])

    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return named.distinct().mapInArrow(B.task(cut), "item_id long, words array<long>")


def frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many documents each known bucket has a word, and how many words; how many documents and words there are."""
    n = len(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, stands, seen, read = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(0), 1 << 19):
                words, begins = _words(raw, offsets)
                bucket = _bucket(words)
                some = known[bucket]
                rows = np.repeat(np.arange(hi - lo), np.diff(begins))[some]
                stands += np.bincount(bucket[some], minlength=n)
                there += np.bincount(np.unique(rows * n + bucket[some]) % n, minlength=n)
                seen, read = seen + hi - lo, read + len(words)
        at = np.flatnonzero(stands)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, n).astype(np.int32), "docs": np.append(there[at], seen), "stands": np.append(stands[at], read)})

    out = np.zeros((n + 1, 2), np.int64)
    got = docs.select("text").mapInArrow(B.task(count), "bucket int, docs long, stands long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("stands").alias("stands")).toArrow()
    out[got["bucket"].to_numpy()] = np.stack([got["docs"].to_numpy(), got["stands"].to_numpy()], axis=1)
    return out[:n, 0], out[:n, 1], int(out[n, 0]), int(out[n, 1])


def randomised_svd(rows: DataFrame, width: int, rank: int, passes: int = 3, seed: int = 3) -> np.ndarray:
    """An orthonormal basis (width, rank) of the leading right singular space of a distributed sparse matrix.

    rows: at array<int>, value array<double>. Each pass sends the present basis out; tasks give their shares of A^T (A Q), and
    one task adds them up and orthogonalises. All of these are of width times rank numbers.
    """
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0].astype(np.float32)
    for _ in range(passes):
        shipped = rows.sparkSession.sparkContext.broadcast(basis)

        def share(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            q, total = shipped.value, None
            for batch in batches:
                at, value = batch.column("at"), batch.column("value")
                ends, flat, v = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
                total = np.zeros((width, rank)) if total is None else total
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    total[flat[a:b]] += v[a:b, None] * (v[a:b] @ q[flat[a:b]])
            if total is not None:
                yield pa.RecordBatch.from_pydict({"share": [total.tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, rank))
            for batch in batches:
                for one in batch.column(0):
                    total += np.frombuffer(one.as_buffer()).reshape(width, rank)
            yield pa.RecordBatch.from_pydict({"basis": [np.linalg.qr(total)[0].astype(np.float32).tobytes()]})

        summed = rows.mapInArrow(B.task(share), "share binary").repartition(1).mapInArrow(B.task(add), "basis binary").head()
        basis = np.frombuffer(summed["basis"], np.float32).reshape(width, rank)
        shipped.unpersist()
    return basis


def _terms(words: np.ndarray, column: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and TF-IDF values (of length 1) of one passage."""
    number, tf = np.unique(column[_bucket(words)], return_counts=True)
    value = tf * weight[number]
    number, value = number[value > 0], value[value > 0]
    return number, value / max(np.linalg.norm(value), 1e-12)


def space(docs: DataFrame, cut: DataFrame) -> Space | None:
    """The latent space for the passages cut (a written table), over docs; None if there are no passages to be searched by it."""
    spark = docs.sparkSession
    long = cut.where(F.size("words") >= SHORTEST)
    held = long.select(F.explode("words").alias("w")).select(F.shiftrightunsigned("w", 64 - BITS).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()
    if not len(held):
        return None
    known = np.zeros(1 << BITS, bool)
    known[held] = True
    counts, stands, n, n_words = frequencies(docs, known)
    column = np.full(1 << BITS, len(held), np.int32)
    column[np.sort(held)] = np.arange(len(held))
    held = np.sort(held)
    stop = np.append((stands > STOP * n_words)[held], False)

    def mostly_stopped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [column[_bucket(w)] for w in _lists(batch.column(0))]
            found = [x for x in numbers if stop[x].mean() > 0.5]
            yield pa.RecordBatch.from_pydict({"c": np.unique(np.concatenate([np.zeros(0, np.int32), *found]))})

    # Function words weigh nothing, but where they are most of a passage (as in a corpus of nothing but that passage).
    stop[long.select("words").mapInArrow(B.task(mostly_stopped), "c int").distinct().toArrow()["c"].to_numpy()] = False
    weight = np.where(stop, 0, np.append(np.log((n + 1) / (counts[held] + 1)) + 1, 0))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [x for x in (_terms(w, column, weight) for w in _lists(batch.column(0))) if len(x[0])]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.list_(pa.int32())), pa.array([v for _, v in done], pa.list_(pa.float64()))], names=["at", "value"])

    matrix = storage.kept(long.select("words").mapInArrow(B.task(rows_of), "at array<int>, value array<double>"), "decontam-rows")
    rank = min(RANK, len(held), max(matrix.count(), 1))
    basis = randomised_svd(matrix.repartition(8), len(held), rank)
    return Space(column, np.concatenate([weight[:-1, None] * basis, np.zeros((1, rank))]).astype(np.float32), stands[held])


def _sequence_hash(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length` words in a row."""
    n = max(len(words) - length + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h += words[j : j + n] * _C[j]
    return B.mix(h)


def _rarest(words: np.ndarray, known: Space) -> np.ndarray:
    """Words of which any leak of the passage has RARE: a subsequence of PARAPHRASE of its places misses all others at most."""
    missed = len(words) - int(np.ceil(PARAPHRASE * len(words) - 1e-9))
    return np.unique(words[np.argsort(known.stands[known.column[_bucket(words)]], kind="stable")[: missed + RARE]])


def _group(rows: pa.Table, known: Space | None) -> Group:
    items, words = rows["item_id"].to_numpy(), _lists(rows["words"].combine_chunks())
    sizes = np.array([len(w) for w in words])
    classes, short = [], {}
    low = 0
    for window in WINDOWS:
        own = np.flatnonzero((sizes >= max(SHORTEST, low)) & (sizes <= _longest(window)))
        low = _longest(window) + 1
        if len(own):
            vectors = np.stack([known.latent[known.column[_bucket(words[p])]].sum(axis=0) for p in own])
            classes.append((window // STRIDE, own, vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]))
    for length in np.unique(sizes[sizes < SHORTEST]).tolist():
        own = np.flatnonzero(sizes == length)
        h = np.array([_sequence_hash(words[p], length)[0] for p in own])
        short[length] = (np.sort(h), own[np.argsort(h)])
    found = [(w, p) for p in np.flatnonzero(sizes >= SHORTEST).tolist() for w in _rarest(words[p], known).tolist()]
    rare = np.array([w for w, _ in found], np.uint64)
    order = np.argsort(rare, kind="stable")
    rare, begins = np.unique(rare[order], return_index=True)
    return Group(items, words, classes, (rare, np.append(begins, len(found)), np.array([p for _, p in found], np.int64)[order]), short)


def common(passage: np.ndarray, text: np.ndarray) -> tuple[int, np.ndarray]:
    """The length of the longest common subsequence, and which of the passage's words one such subsequence takes."""
    masks: dict[int, int] = {}
    for i, w in enumerate(passage.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    v = full
    steps = [v]
    for w in text.tolist():
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    # length of the subsequence of passage[:i] and text[:j]: zeros among the lowest i bits of steps[j].
    taken = np.zeros(len(passage), bool)
    i, j = len(passage), len(text)
    while i and j:
        if steps[j] >> (i - 1) & 1:
            i -= 1
        elif not steps[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i -= 1
            j -= 1
            taken[i] = True
    return int(full.bit_count() - v.bit_count()), taken


def _runs(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from begins to before ends, and which of the runs each is of."""
    sizes = np.maximum(ends - begins, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[of], of


def _windows(words: np.ndarray, begins: np.ndarray, rows: np.ndarray, g: Group, known: Space) -> Iterator[tuple[int, int, int, int, float]]:
    """Candidates: passage, first word, words of the window, row, cosine."""
    rare, first, of_rare = g.rare
    at = np.minimum(np.searchsorted(rare, words), len(rare) - 1)
    there = np.flatnonzero(rare[at] == words)
    entry, of = _runs(first[at[there]], first[at[there] + 1])
    place, passage = there[of], of_rare[entry]
    if not len(place):
        return
    # Blocks of STRIDE words, by row.
    sizes = np.diff(begins)
    n_blocks = -(-sizes // STRIDE)
    block_first = np.cumsum(n_blocks) - n_blocks
    block_row = np.repeat(np.arange(len(sizes)), n_blocks)
    block_at = begins[block_row] + (np.arange(len(block_row)) - block_first[block_row]) * STRIDE
    length = np.array([len(w) for w in g.words])
    sums, known_block = np.zeros((len(block_at), known.latent.shape[1]), np.float32), np.zeros(len(block_at), bool)

    def add(wanted: np.ndarray) -> None:
        """Latent vectors of blocks that aren't known yet."""
        new = np.unique(wanted)
        new = new[~known_block[new]]
        known_block[new] = True
        left = np.minimum(begins[block_row[new] + 1] - block_at[new], STRIDE)
        for k in range(STRIDE):
            some = new[left > k]
            sums[some] += known.latent[known.column[_bucket(words[block_at[some] + k])]]

    for blocks, own, vectors in g.classes:
        size, number = blocks * STRIDE, np.full(len(g.words), -1)
        number[own] = np.arange(len(own))
        mine = number[passage] >= 0
        where, which = place[mine], passage[mine]
        # Places with so many others of their passage near that some surroundings can have them all.
        order = np.lexsort((where, which))
        where, which = where[order], which[order]
        if len(where) < RARE:
            continue
        span = where[RARE - 1 :] - where[: 1 - RARE] < size + 2 * (length[which[RARE - 1 :]] // 2) + 1
        together = span & (which[RARE - 1 :] == which[: 1 - RARE]) & (rows[where[RARE - 1 :]] == rows[where[: 1 - RARE]])
        dense = np.zeros(len(where), bool)
        for k in range(RARE):
            dense[k : k + len(together)] |= together
        where, which = where[dense], which[dense]
        row, half = rows[where], length[which] // 2
        # Windows whose surroundings, as they are compared below, have the place.
        low = np.maximum(-(-(where - size - half + 1 - begins[row]) // STRIDE), 0)
        high = np.minimum((where + half - begins[row]) // STRIDE, n_blocks[row] - 1)
        start, of = _runs(block_first[row] + low, block_first[row] + high + 1)
        pairs, stand = np.unique(start * len(own) + number[which[of]], return_counts=True)
        pairs = pairs[stand >= RARE]
        start, which = pairs // len(own), pairs % len(own)
        some, window_of = np.unique(start, return_inverse=True)
        last = block_first[block_row[some]] + n_blocks[block_row[some]]
        inside, _ = _runs(some, np.minimum(some + blocks, last))
        add(inside)
        window = np.zeros((len(some), sums.shape[1]), np.float32)
        for k in range(blocks):
            more = some + k < last
            window[more] += sums[some[more] + k]
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-6)
        for at in range(0, len(pairs), _PAIRS):
            w, p = window_of[at : at + _PAIRS], which[at : at + _PAIRS]
            cosine = np.einsum("ij,ij->i", window[w], vectors[p]) / norm[w]
            for i in np.flatnonzero(cosine >= COSINE).tolist():
                b = int(some[w[i]])
                yield int(own[p[i]]), int(block_at[b]), size, int(block_row[b]), float(cosine[i])


def _scan(docs: DataFrame, group: Group, known: Space | None) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((group, known))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, latent = shipped.value
        vocabularies: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in B.pieces(batch.column(1), PIECE):
                words, begins = _words(raw, offsets)
                if not len(words):
                    continue
                rows = np.repeat(np.arange(hi - lo), np.diff(begins))
                best: dict[tuple[int, int], tuple] = {}
                for length, (hashes, own) in g.short.items():
                    h = _sequence_hash(words, length)
                    first = np.searchsorted(hashes, h, side="left")
                    hit = np.flatnonzero((np.searchsorted(hashes, h, side="right") > first) & (rows[: len(h)] == rows[length - 1 :]))
                    for i in hit.tolist():
                        for p in own[first[i] : np.searchsorted(hashes, h[i], side="right")].tolist():
                            if (g.words[p] == words[i : i + length]).all():
                                best[int(rows[i]), int(g.items[p])] = (1.0, 1.0, True, i - int(begins[rows[i]]))
                for p, start, size, row, cosine in _windows(words, begins, rows, g, latent) if g.classes else ():
                    passage, key = g.words[p], (row, int(g.items[p]))
                    if key in best and best[key][0] == 1.0:
                        continue
                    a = max(start - len(passage) // 2, int(begins[row]))
                    b = min(start + size + len(passage) // 2, int(begins[row + 1]))
                    # No subsequence is longer than the number of the passage's words that stand here.
                    if p not in vocabularies:
                        vocabularies[p] = np.unique(passage)
                    mine = vocabularies[p]
                    there = mine[np.minimum(np.searchsorted(mine, words[a:b]), len(mine) - 1)] == words[a:b]
                    least = int(np.ceil(PARAPHRASE * len(passage) - 1e-9))
                    if there.sum() < least or np.isin(passage, words[a:b][there]).sum() < least:
                        continue
                    length, taken = common(passage, words[a:b])
                    share, answer = length / len(passage), bool(taken[-ANSWER:].mean() >= 0.5)
                    if (share >= VERBATIM or share >= PARAPHRASE and answer) and (key not in best or share > best[key][0]):
                        best[key] = (share, cosine, answer, start - int(begins[row]))
                out += [(ids[lo + row], item, *found) for (row, item), found in best.items()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "lcs", "cosine", "answer_found", "first_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(B.task(read), RESULT)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs, cosine, answer_found and first_word of every benchmark item found in a document."""
    cut = storage.kept(passages(benchmark), "decontam-passages")
    found = docs.sparkSession.createDataFrame([], RESULT)
    n = cut.count()
    known = space(docs, cut) if n else None
    parts = -(-n // GROUP)
    number = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(parts, 1)))
    for k in range(parts):
        found = found.unionByName(_scan(docs, _group(cut.where(number == k).orderBy("item_id", "words").toArrow(), known), known))
    best = F.max(F.struct("lcs", "cosine", "answer_found", F.col("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
