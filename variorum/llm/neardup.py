"""Near duplicates by ProbMinHash sketches of weighted word shingles, banding and exact verification.

A document is its multiset of `SHINGLE`-word shingles (words as in bytesops, lower-cased; a shorter text is one shingle),
weighted by their counts. Its sketch has `REGISTERS` registers: every shingle runs a Poisson process whose rate is its
weight, each arrival strikes a random register, and a register keeps the shingle that struck it first. Two sketches
agree in a register with the probability Jaccard similarity. A shingle whose next arrival comes after the last register's
first one can't change anything, and stops; arrivals are drawn in blocks that double until all have stopped.

`BANDS` bands of the sketch are hashed to buckets. Texts of equal word sequences are one class from the start and only
their smallest id goes into buckets. In a bucket everyone is compared with its leader (the member that shares most places
with others), so a group of copies costs a comparison for each and not for each pair, and no group is gathered in one task.
The links found so far join documents to components. Of buckets that still hold several components, those documents that
aren't in the leader's are compared with all others by their sketches, in blocks of about `BLOCK` documents, in memory and
only across components; pairs whose sketches agree in `PROMISING` of the registers or more are verified too (a pair at the
threshold falls short of that once in 20,000 times).

Where a shingle is repeated, a second sketch counts every shingle once and so agrees with the set Jaccard similarity; its
bands go to the same buckets (without repeats both sketches are the same), and a pair is promising if either agrees.

Documents are linked if the Jaccard similarity of their shingle sets or the probability Jaccard similarity of their
weighted shingles is `LEAST` or more, both computed exactly from the shingles. Classes are the connected components.

Texts without words that aren't empty are linked if they are equal. Empty and null texts are classes of their own. Rows
with one doc_id are one document. Rows with a null doc_id get a null class. A pair at exactly `LEAST` is linked. Texts are
taken whole; a very long one is a piece of work of its own. Columns but doc_id and text take no part. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage
from variorum.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 56, 9
REGISTERS = BANDS * ROWS
#: The share of registers in which two sketches agree to be verified, and the size of blocks.
PROMISING, BLOCK = 0.73, 1024
#: Pairs of one leader that are verified together.
SHARE = 256
#: Rows of at most 24 bytes that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000

_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _near(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (a written table, or of a known number of rows), marked for broadcast if its size allows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and where each row's begin (one more at the end)."""
    low = B.LOWER[raw]
    starts, ends = B.spans(B.WORD[low], offsets[:-1])
    return B.span_hash(B.running(low), starts, ends), np.searchsorted(starts, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all rows: row, hash and count, ordered by row and hash."""
    words, begins = _words(raw, offsets)
    counts = np.diff(begins)
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none.astype(np.uint64), none
    row = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):
        h[: len(words) - j] += words[j:] * _C[j]
    inside = np.arange(len(words)) + SHINGLE <= begins[row + 1]
    h, of = h[inside], row[inside]
    for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        own = words[begins[k] : begins[k + 1]]
        at = int(np.searchsorted(of, k))
        h = np.insert(h, at, (own * _C[: len(own)]).sum() + np.uint64(len(own)))
        of = np.insert(of, at, k)
    h = B.mix(h)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


def sketches(of: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers of n rows: the hash of the shingle that came first (0 in rows without shingles)."""
    m = REGISTERS
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    time, active = np.zeros(len(h)), np.arange(len(h))
    last = np.full(n, np.inf)
    k, block = 0, 1
    while len(active):
        point = np.arange(k + 1, k + 1 + block, dtype=np.uint64)
        u = B.mix(h[active, None] + point[None, :] * _C[6])
        gap = -np.log(((u >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight[active, None]
        t = time[active, None] + np.cumsum(gap, axis=1)
        register = ((u & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        inside = t <= last[of[active], None]
        flat = (of[active, None] * m + register)[inside]
        struck, by = t[inside], np.broadcast_to(h[active, None], t.shape)[inside]
        np.minimum.at(first, flat, struck)
        won = first[flat] == struck
        who[flat[won]] = by[won]
        last = first.reshape(n, m).max(axis=1)
        time[active] = t[:, -1]
        active = active[time[active] <= last[of[active]]]
        k += block
        block = min(block * 2, 64)
    return who.reshape(n, m)


def both_sketches(of: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of n rows by counts and with every shingle once, and which rows have repeats (elsewhere both are the same)."""
    repeats = np.zeros(n, bool)
    repeats[of[count > 1]] = True
    weighted = sketches(of, h, count.astype(np.float64), n)
    unit = weighted.copy()
    some = repeats[of]
    if some.any():
        rank = np.cumsum(repeats) - 1
        unit[repeats] = sketches(rank[of[some]], h[some], np.ones(int(some.sum())), int(repeats.sum()))
    return weighted, unit, repeats


def _bands(registers: np.ndarray) -> np.ndarray:
    n = len(registers)
    factors = B.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    keys = (registers.reshape(n, BANDS, ROWS) * factors).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _C[7]
    return B.mix(keys).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, two fingerprints of the word sequence (of the text without words; null if empty), and the band keys of both
    sketches (null without words)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(1)):
                n = hi - lo
                words, begins = _words(raw, offsets)
                counts = np.diff(begins)
                row = np.repeat(np.arange(n), counts)
                place = (np.arange(len(words)) - np.repeat(begins[:-1], counts)).astype(np.uint64)
                prints = []
                for c in (_C[5], _C[6]):
                    part = B.mix(words + B.mix(place + c))
                    behind = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
                    prints.append(B.mix(behind[begins[1:]] - behind[begins[:-1]] + counts.astype(np.uint64)).view(np.int64))
                of, h, count = shingles(raw, offsets)
                weighted, unit, repeats = both_sketches(of, h, count, n)
                bands, once = _bands(weighted), _bands(unit)
                empty = counts == 0
                at = np.where(empty, 0, BANDS) + np.where(repeats, BANDS, 0)
                ends = np.concatenate([[0], np.cumsum(at)]).astype(np.int32)
                flat = np.concatenate([bands, once], axis=1)[np.concatenate([np.repeat(~empty[:, None], BANDS, 1), np.repeat(repeats[:, None], BANDS, 1)], axis=1)]
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(empty))
                # Texts without words: fingerprints of all bytes.
                for k in np.flatnonzero(empty & (np.diff(offsets) > 0)).tolist():
                    digest = hashlib.blake2b(raw[offsets[k] : offsets[k + 1]].tobytes(), digest_size=16).digest()
                    prints[0][k], prints[1][k] = np.frombuffer(digest, np.int64)
                nothing = np.diff(offsets) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(p, mask=nothing) for p in prints), column], names=["doc_id", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(B.task(read), "doc_id long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """doc, its distinct shingles (ascending) with counts, and a byte of each register of its two sketches (one, if they are the same)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(1)):
                of, h, count = shingles(raw, offsets)
                ends = pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32))
                weighted, unit, repeats = both_sketches(of, h, count, hi - lo)
                short, once = ((B.mix(s) & np.uint64(255)).astype(np.uint8) for s in (weighted, unit))
                sketch = [s.tobytes() + (o.tobytes() if again else b"") for s, o, again in zip(short, once, repeats.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))), pa.array(sketch, pa.binary())], names=["doc", "shingles", "counts", "sketch"])

    return docs.mapInArrow(B.task(read), "doc long, shingles array<long>, counts array<int>, sketch binary")


def promising(table: pa.Table) -> pa.Table:
    """Pairs (a, b) across two blocks (or within one) of a bucket, of different roots, whose sketches agree enough.

    A pair comes from the smallest key of the mixed buckets that both are in, so only once.
    """
    doc, root, block = (table[c].to_numpy() for c in ("doc", "root", "block"))
    stored = table["sketch"].to_pylist()
    sketch = np.frombuffer(b"".join(s[:REGISTERS] for s in stored), np.uint8).reshape(len(doc), REGISTERS)
    repeats = np.array([len(s) > REGISTERS for s in stored], bool)
    once = np.frombuffer(b"".join(s[-REGISTERS:] for s in stored), np.uint8).reshape(len(doc), REGISTERS) if repeats.any() else sketch
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    key, own = table["key"][0].as_py(), table["keys"].combine_chunks()
    counts = np.diff(own.offsets.to_numpy())
    keys = np.full((len(doc), int(counts.max())), np.iinfo(np.int64).max)
    keys[np.repeat(np.arange(len(doc)), counts), np.concatenate([np.arange(c) for c in counts])] = own.flatten().to_numpy()
    a, b = [], []
    for x in left.tolist():
        others = right[(root[right] != root[x]) & ((doc[right] > doc[x]) | (i != j))]
        agree = (sketch[others] == sketch[x]).sum(axis=1)
        again = np.flatnonzero(repeats[others] | repeats[x])
        if len(again):
            agree[again] = np.maximum(agree[again], (once[others[again]] == once[x]).sum(axis=1))
        hit = others[agree >= PROMISING * REGISTERS]
        before = keys[x][keys[x] < key]
        if len(before) and len(hit):
            hit = hit[~np.isin(keys[hit], before).any(axis=1)]
        a.append(np.full(len(hit), doc[x]))
        b.append(doc[hit])
    a, b = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (a, b))
    return pa.table({"lead": np.minimum(a, b), "doc": np.maximum(a, b)})


def similarities(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """Jaccard and probability Jaccard similarity of two weighted sets (distinct elements, positive weights)."""
    both = np.union1d(a, b)
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a)], y[np.searchsorted(both, b)] = p / p.sum(), q / q.sum()
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0, 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    r, below, above = ratio[order], np.concatenate([[0], np.cumsum(y[order])]), np.concatenate([[0], np.cumsum(x[order])])
    t = ratio[shared]
    at = np.searchsorted(r, t, side="left")
    total = above[-1] - above[at] + t * below[at]  # sum over i of max(x_i, t * y_i)
    return float(shared.sum() / len(both)), float(np.minimum((x[shared] / total).sum(), 1.0))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (lead, doc) with both similarities.

    A lead of many pairs is a hot key; its pairs are dealt to groups of about `SHARE`, each with a copy of the lead's set.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {}
            for name in ("sa", "ca", "sb", "cb"):
                column = batch.column(name)
                lists[name] = (column.offsets.to_numpy(), column.values.to_numpy())
            out = np.zeros((batch.num_rows, 2))
            for i in range(batch.num_rows):
                own = [v[o[i] : o[i + 1]] for o, v in lists.values()]
                out[i] = similarities(*own)
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("doc"), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["lead", "doc", "set_j", "prob_j"])

    shares = _near(storage.kept(pairs.groupBy("lead").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("n")), "near-shares"))
    dealt = pairs.join(shares, "lead").select("lead", "doc", F.pmod(F.xxhash64("doc"), "n").cast("int").alias("share"))
    own = sets.select("doc", "shingles", "counts")
    right = own.join(_near(dealt, pairs.count()), "doc").select("lead", "share", "doc", F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    left = own.join(shares.withColumnRenamed("lead", "doc"), "doc").select(F.col("doc").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("share"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    joined = right.join(left, ["lead", "share"])
    return joined.select("lead", "doc", "sa", "ca", "sb", "cb").mapInArrow(B.task(read), "lead long, doc long, set_j double, prob_j double")


def _linked() -> Column:
    return (F.col("set_j") >= LEAST) | (F.col("prob_j") >= LEAST)


def links(docs: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership of equal texts (doc_id, rep), and links (u, v) between representatives."""
    reps = sketch.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    member = storage.kept(sketch.where("f1 is not null").select("doc_id", "f1", "f2").join(reps, ["f1", "f2"]).select("doc_id", "rep").distinct(), "near-members")
    # A document that has several rows is represented where any of its texts is.
    own = sketch.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "f1", "f2"], "left_semi")
    banded = own.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key"))
    shared = storage.kept(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("key", "n"), "near-keys")
    rest = storage.kept(banded.join(_near(shared), "key").distinct(), "near-buckets")

    wanted = storage.kept(rest.select("doc").distinct(), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(_near(wanted), "doc", "left_semi")
    sets = storage.kept(_sets(texts), "near-sets")
    # The leader of a bucket is its member with the most company in all of its buckets: the original among edited copies.
    company = rest.groupBy("doc").agg(F.sum("n").alias("company"))
    leaders = storage.kept(rest.join(company, "doc").groupBy("key").agg(F.max(F.struct("company", (-F.col("doc")).alias("d"))).alias("m")).select("key", (-F.col("m.d")).alias("lead")), "near-leaders")
    pairs = storage.kept(rest.join(_near(leaders), "key").where("doc <> lead").select("lead", "doc").distinct(), "near-pairs")
    done = storage.kept(_verified(pairs, sets), "near-verified")
    edges = done.where(_linked()).select(F.col("lead").alias("u"), F.col("doc").alias("v"))
    roots = storage.kept(components(edges, "near-components"), "near-roots")

    # Buckets with several components: blocks 0 ... hold what isn't in the leader's, the next ones what is.
    rooted = rest.join(_near(roots.withColumnRenamed("node", "doc")), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    rooted = storage.kept(rooted, "near-rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    lead = leaders.join(several, "key").join(_near(roots.withColumnRenamed("node", "lead")), "lead", "left").select("key", F.coalesce("root", "lead").alias("home"))
    mixed = storage.kept(rooted.join(_near(storage.kept(lead, "near-homes")), "key").withColumn("other", F.col("root") != F.col("home")).drop("home"), "near-mixed")
    sizes = storage.kept(mixed.groupBy("key").agg(F.ceil(F.count_if("other") / BLOCK).cast("int").alias("n_other"), F.ceil(F.count_if(~F.col("other")) / BLOCK).cast("int").alias("n_lead")), "near-sizes")
    spread = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    block = F.when(F.col("other"), spread(F.col("n_other"))).otherwise(F.col("n_other") + spread(F.col("n_lead")))
    blocks = mixed.join(_near(sizes), "key").withColumn("block", block)
    with_others = F.transform(F.sequence(F.lit(0), F.col("n_other") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    with_lead = F.transform(F.sequence(F.col("n_other"), F.col("n_other") + F.col("n_lead") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    tasks = blocks.withColumn("t", F.explode(F.when(F.col("other"), F.concat(with_others, with_lead)).otherwise(with_others)))
    tasks = tasks.select("key", "t.i", "t.j", "doc", "root", "block")
    tasks = tasks.join(sets.select("doc", "sketch").join(mixed.groupBy("doc").agg(F.sort_array(F.collect_set("key")).alias("keys")), "doc"), "doc")
    found = tasks.groupBy("key", "i", "j").applyInArrow(promising, "lead long, doc long").distinct()
    tried = done.select(F.least("lead", "doc").alias("lead"), F.greatest("lead", "doc").alias("doc"))
    more = storage.kept(_verified(storage.kept(found.join(tried, ["lead", "doc"], "left_anti"), "near-promising"), sets), "near-more")
    return member, roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more.where(_linked()).select(F.col("lead").alias("u"), F.col("doc").alias("v")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row."""
    sketch = storage.kept(sketched(docs), "near-sketch")
    member, edges = links(docs, sketch)
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(edges.unionByName(same), "near-classes")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(roots, ids["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
