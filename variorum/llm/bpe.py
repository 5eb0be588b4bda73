"""Byte-level BPE with the ranks of a public vocabulary: encoding and decoding by DuckDB queries in each partition.

A text is cut into words by the tokenizer's pattern. Words that a worker meets for the first time go, as rows of
(word, position, token), through a recursive query: each round joins neighbours with the merge table, contracts every
word's leftmost pair of minimum rank, and drops words at their fixpoint. Their ids are kept by the word's hash, so a
worker runs the recursion once per distinct word and texts are assembled by numpy gathers. Ids are decoded by an
ordered aggregation over their rows joined with the vocabulary; the decoded bytes are held against the text, and a
text that differs (two words of one hash) is encoded again without the cache.

Words over `LONG` bytes, for which one contraction a round would take thousands of rounds, go through a heap instead,
with the same rule. Caches are emptied at `CACHED` words; pieces of texts bound all else. A null text counts as empty
(no ids, digests of the empty string). Repeated rows keep their multiplicity; the ids of an empty table are empty.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from variorum.llm import bytesops as B

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 256
CACHED = 1_500_000
#: Words for one recursive query, which bounds its rows.
ROUND = 30_000
PIECE = 1 << 20
#: Pieces whose new words go through the recursion together.
GROUP = 8

_ENCODE = """
WITH RECURSIVE t(w, pos, id, active) AS (
  SELECT w, pos, id, true FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN pos = best & 4294967295 THEN (best >> 32)::INT ELSE id END, best IS NOT NULL
  FROM (
    SELECT w, pos, id, behind, min((m.rank::UBIGINT << 32) | pos::UBIGINT) OVER (PARTITION BY w) AS best
    FROM (SELECT w, pos, id, lead(id) OVER r AS neighbour, coalesce(lag(pos) OVER r, -1) AS behind FROM t WHERE active WINDOW r AS (PARTITION BY w ORDER BY pos)) a
    LEFT JOIN merges m ON a.id = m.l AND a.neighbour = m.r
  )
  WHERE best IS NULL OR behind <> (best & 4294967295)::BIGINT
)
SELECT w, pos, id FROM t WHERE NOT active ORDER BY w, pos
"""
_DECODE = "SELECT row, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocabulary USING (id) GROUP BY row"

# Byte classes of texts whose characters are ASCII, or letters of U+00AA to U+027F.
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[9:14] = _CLASS[32] = _SPACE


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ranks, from a rank file on the driver."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _plain_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows all of whose characters the byte classes describe."""
    ok = np.ones(len(offsets) - 1, bool)
    high = np.flatnonzero(raw >= 0xC2)
    if len(high):
        lead, after = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
        odd = (lead > 0xC9) | ((lead == 0xC2) & ~np.isin(after, (0xAA, 0xB5, 0xBA))) | ((lead == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        ok[B.row_of(high[odd], offsets)] = False
    return ok


def word_starts(raw: np.ndarray, offsets: np.ndarray, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """Where the pattern's matches begin (they cover each text)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    rows_from = offsets[:-1][offsets[:-1] < offsets[1:]]
    if pattern != public_tokenizers.PATTERN:
        return _slow_starts(raw, offsets, np.arange(len(offsets) - 1), pattern)
    kind = _CLASS[raw]
    fresh = np.ones(n, bool)  # a run of one class begins
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[rows_from] = True
    first = np.zeros(n, bool)
    first[rows_from] = True
    space = kind == _SPACE
    blank = raw == 32
    behind = np.zeros(n, bool)  # the byte before is a space of the same text
    behind[1:] = blank[:-1]
    behind[rows_from] = False
    starts = fresh & (space | ~behind)
    # The last character of white space before something else stands alone, or leads that if it is a space.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    starts |= last
    # Contractions: an apostrophe alone, no space before it.
    quote = np.flatnonzero((raw == 39) & fresh & ~behind)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    for i in quote.tolist():
        tail = raw[i + 1 : i + 3].tobytes()
        size = 1 if tail[:1] in b"stmd" else 2 if tail in (b"re", b"ve", b"ll") and not first[i + 2] else 0
        if size:
            starts[i + 1] = False
            after = i + 1 + size
            if after < n and not first[after] and kind[after] == _LETTER:
                starts[after] = True
    odd = np.flatnonzero(~_plain_rows(raw, offsets))
    for row in odd.tolist():
        starts[offsets[row] : offsets[row + 1]] = False
    found = np.flatnonzero(starts)
    return np.sort(np.concatenate([found, _slow_starts(raw, offsets, odd, pattern)])) if len(odd) else found


def _slow_starts(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, pattern: str) -> np.ndarray:
    import regex

    matcher, out = regex.compile(pattern), []
    for row in rows.tolist():
        at = int(offsets[row])
        for word in matcher.findall(raw[at : offsets[row + 1]].tobytes().decode("utf-8", "surrogateescape")):
            out.append(at)
            at += len(word.encode("utf-8", "surrogateescape"))
    return np.array(out, np.int64)


class Coder:
    """One worker's DuckDB connection, merge table and cache of words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.tables = {
            "merges": {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(merged, pa.int32())},
            "vocabulary": {"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks])},
        }
        self.open = None
        self.forget()

    @property
    def db(self):  # noqa: ANN201
        """The connection, opened by a task's first query; a worker at rest keeps none, only the cache of words."""
        if self.open is None:
            import duckdb

            self.open = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
            self.open.execute("SET temp_directory = ''")
            for name, columns in self.tables.items():
                self.open.register("loaded", pa.table(columns))
                self.open.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
                self.open.unregister("loaded")
        return self.open

    def rest(self) -> None:
        if self.open is not None:
            self.open.close()
            self.open = None

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def merge(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that lie end to end in text, and how many each has."""
        lengths = np.diff(ends, prepend=0)
        sizes, parts = np.zeros(len(ends), np.int64), []
        for lo in range(0, len(ends), ROUND):
            hi = min(lo + ROUND, len(ends))
            begin = ends[lo] - lengths[lo]
            word = np.repeat(np.arange(lo, hi), lengths[lo:hi])
            pos = np.arange(len(word)) - np.repeat(ends[lo:hi] - lengths[lo:hi] - begin, lengths[lo:hi])
            ids = self.single[text[begin : ends[hi - 1]]]
            short = lengths[word] <= LONG
            self.db.register("start", pa.table({"w": pa.array(word[short].astype(np.int32)), "pos": pa.array(pos[short].astype(np.int32)), "id": pa.array(ids[short])}))
            done = self.db.sql(_ENCODE).to_arrow_table()
            self.db.unregister("start")
            w, got = done["w"].to_numpy(), done["id"].to_numpy()
            for k in (lo + np.flatnonzero(lengths[lo:hi] > LONG)).tolist():
                long_ids = self.merge_long(text[ends[k] - lengths[k] : ends[k]].tobytes())
                at = int(np.searchsorted(w, k))
                w, got = np.insert(w, at, np.full(len(long_ids), k)), np.insert(got, at, long_ids)
            sizes[lo:hi] = np.bincount(w - lo, minlength=hi - lo)
            parts.append(got.astype(np.int32))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes

    def merge_long(self, word: bytes) -> list[int]:
        """The same contractions by a heap of (rank, position)."""
        n = len(word)
        after, before, upto, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (rank := self.ranks.get(word[i : upto[j]])) is not None:
                heapq.heappush(heap, (rank, i, upto[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or upto[after[i]] != end:
                continue
            j = after[i]
            alive[j], after[i], upto[i] = False, after[j], end
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[word[i : upto[i]]] for i in range(n) if alive[i]]

    def learn(self, hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words, end to end in text, of distinct new hashes (ascending) to the cache."""
        ends = np.cumsum(sizes)
        words = text.tobytes()
        whole = np.array([self.ranks.get(words[e - n : e], -1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int32)
        rest = whole < 0  # a word that is a token is that token
        ids, counts = self.merge(_gather(text, (ends - sizes)[rest], sizes[rest]), np.cumsum(sizes[rest]))
        all_counts = np.ones(len(hashes), np.int64)
        all_counts[rest] = counts
        of_rest = np.repeat(rest, all_counts)
        flat = np.empty(len(of_rest), np.int32)
        flat[of_rest], flat[~of_rest] = ids, whole[~rest]
        into = np.searchsorted(self.keys, hashes)
        self.at = np.insert(self.at, into, len(self.ids) + np.cumsum(all_counts) - all_counts)
        self.size = np.insert(self.size, into, all_counts.astype(np.int32))
        self.keys = np.insert(self.keys, into, hashes)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, parts: list[tuple[np.ndarray, np.ndarray]], pattern: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each (bytes, starts of texts): ids of the texts, end to end, and where each text's begin (one more at the end).

        The new words of all parts go through one recursive query, as each round of it has a fixed cost.
        """
        cut, unknown = [], []
        for raw, offsets in parts:
            starts = word_starts(raw, offsets, pattern)
            ends = np.append(starts[1:], len(raw)) if len(starts) else starts
            hashes, first, which = np.unique(B.span_hash(B.running(raw), starts, ends), return_index=True, return_inverse=True)
            cut.append((hashes, which.astype(np.int32), np.searchsorted(starts, offsets)))
            unknown.append((hashes, raw, starts[first], ends[first]))
        total = sum(len(u[0]) for u in unknown)
        if len(self.keys) + total > CACHED:
            self.forget()
        fresh_hash, fresh_text, fresh_size = [], [], []
        for hashes, raw, begin, end in unknown:
            at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
            new = self.keys[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
            fresh_hash.append(hashes[new])
            fresh_text.append(_gather(raw, begin[new], (end - begin)[new]))
            fresh_size.append((end - begin)[new])
        if sum(map(len, fresh_hash)):
            size, text = np.concatenate(fresh_size), np.concatenate(fresh_text)
            hashes, first = np.unique(np.concatenate(fresh_hash), return_index=True)
            begin = np.cumsum(size) - size
            self.learn(hashes, _gather(text, begin[first], size[first]), size[first])
        for hashes, which, rows_at in cut:
            if not len(which):
                yield np.zeros(0, np.int32), np.zeros(len(rows_at), np.int64)
                continue
            at = np.searchsorted(self.keys, hashes)[which]
            sizes = self.size[at].astype(np.int64)
            behind = np.concatenate([[0], np.cumsum(sizes)])
            yield _gather(self.ids, self.at[at], sizes), behind[rows_at]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        counts = np.diff(begins)
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        pos = (np.arange(len(ids)) - np.repeat(begins[:-1], counts)).astype(np.int32)
        self.db.register("ids", pa.table({"row": pa.array(row), "pos": pa.array(pos), "id": pa.array(ids)}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(counts)
        for k, text in zip(got["row"].to_pylist(), got["text"].to_pylist(), strict=True):
            out[k] = text.encode("latin-1")
        return out

    def both(self, column: pa.Array, pattern: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
        """(first row, row after the last, ids, where each row's begin, decoded texts) of consecutive rows of a column.

        Texts that don't come back are encoded anew, each word by its bytes.
        """
        waiting = list(B.pieces(column, PIECE))
        for at in range(0, len(waiting), GROUP):
            group = waiting[at : at + GROUP]
            coded = self.encode([(raw, offsets) for _, _, raw, offsets in group], pattern)
            for (lo, hi, raw, offsets), (ids, begins) in zip(group, coded, strict=True):
                texts = self.decode(ids, begins)
                wrong = [k for k, text in enumerate(texts) if text != raw[offsets[k] : offsets[k + 1]].tobytes()]
                if wrong:
                    rows = [ids[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                    for k in wrong:
                        rows[k] = self.plainly(raw[offsets[k] : offsets[k + 1]], pattern)
                        texts[k] = self.decode(rows[k], np.array([0, len(rows[k])]))[0]
                    begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                    ids = np.concatenate(rows)
                yield lo, hi, ids, begins, texts

    def plainly(self, text: np.ndarray, pattern: str) -> np.ndarray:
        """Ids of one text without the cache."""
        if not len(text):
            return np.zeros(0, np.int32)
        starts = word_starts(text, np.array([0, len(text)]), pattern)
        ids, out, at = *self.merge(text, np.append(starts[1:], len(text))), 0
        kept = []
        for a, b, n in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], out.tolist(), strict=True):
            whole = self.ranks.get(text[a:b].tobytes())
            kept.append(ids[at : at + n] if whole is None else np.array([whole], np.int32))
            at += n
        return np.concatenate(kept)


def _gather(source: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """source[at[0]:at[0]+sizes[0]], source[at[1]:...] ... end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return source[:0]
    return source[np.arange(ends[-1]) + np.repeat(at - (ends - sizes), sizes)]


_coders: dict[int, Coder] = {}


def _coder(ranks: dict[bytes, int]) -> Coder:
    """The worker's coder; it outlives tasks, and one of another vocabulary takes its place."""
    key = hash(frozenset(ranks.items()))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks)
    return _coders[key]


def _rest() -> None:
    for coder in _coders.values():
        coder.rest()


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ids (array of int)."""
    kept = docs.drop("ids")
    at = kept.columns.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # one vocabulary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value)
        for batch in batches:
            for lo, hi, ids, begins, _ in coder.both(batch.column(at), pattern):
                column = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), column], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(B.task(read, _rest), StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded (binary), from its column ids; null ids count as none."""
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")
    shipped = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [x or [] for x in part.column(at).to_pylist()]
                begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
                texts = coder.decode(np.array([i for r in rows for i in r], np.int32), begins)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(B.task(read, _rest), StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (over little-endian 32-bit ids) and decoded_sha256, without moving ids or texts back."""
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value)
        for batch in batches:
            for lo, hi, ids, begins, texts in coder.both(batch.column(1), pattern):
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(np.diff(begins).astype(np.int64)),
                        pa.array([hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.task(read, _rest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
