"""Byte-level BPE as relational queries (operator 5).

Inside each Spark task DuckDB merges the distinct pieces of the task's texts.  A piece
is a set of token-position rows; a recursive query joins neighbouring rows with the
merge table, contracts each piece's leftmost pair of minimum rank and goes on until no
pair of any piece is in the table.  Decoding is the ordered aggregation of the tokens'
bytes.  Pieces and runs of ids met before come from the worker's memory.

Pieces of ``LONG_BYTES`` and more do not go through the query, whose steps rewrite all
rows of a piece: its work grows with the square of their length, and a piece may be a
whole text.  They are lists of linked positions instead.  While many pairs have the
minimum rank these are contracted at once, from the left; after that a heap gives the
leftmost pair of minimum rank, one at a time.  (In a table made by merging, a pair's merge
never makes a pair of lower or equal rank, so both orders come to the same.)

Cases: a null text is empty; an empty text has no ids and decodes to nothing; null ids
decode to nothing; repeated rows are rows of their own; other columns stay as they are;
an id that the vocabulary lacks raises an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import by_batch, give_back, kept
from .pretokens import CACHED_WORDS, Encoder, Segments, mixed

LONG_BYTES = 128
NO_RANK = np.iinfo(np.int32).max
FEW = 64  # pairs of minimum rank are few where they are fewer than one in so many
STATE_ROWS = 1_000_000  # rows that one recursive query may make
SLICE_BYTES = 512 << 10  # texts that are worked on at once; what a worker needs beside its caches grows with it
RUN_IDS = 64

MERGE = """
WITH RECURSIVE state(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM given
  UNION ALL
  (WITH neighbours AS (
     SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM state),
   least AS (
     SELECT n.word, min(m.rank::BIGINT << 32 | n.pos) AS ranked
     FROM neighbours n JOIN merges m ON n.id = m.a AND n.next_id = m.b GROUP BY n.word),
   chosen AS (SELECT word, ranked & 4294967295 AS at, (ranked >> 32)::INTEGER AS merged FROM least)
   SELECT s.step + 1, s.word, CASE WHEN s.pos > c.at THEN s.pos - 1 ELSE s.pos END,
     CASE WHEN s.pos = c.at THEN c.merged ELSE s.id END
   FROM state s JOIN chosen c USING (word) WHERE s.pos <> c.at + 1)
)
SELECT s.word, s.id FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l USING (word, step)
ORDER BY s.word, s.pos
"""

DECODE = """
SELECT run, string_agg(token, '' ORDER BY pos) AS text FROM given JOIN vocabulary USING (id) GROUP BY run ORDER BY run
"""

_coders: dict[str, Coder] = kept({})


def _ranks(ids: np.ndarray, pairs: np.ndarray, rank_of: np.ndarray) -> np.ndarray:
    """The rank of each pair of neighbours, NO_RANK where they do not merge."""
    keys = ids[:-1].astype(np.int64) << 32 | ids[1:]
    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    return np.where(pairs[at] == keys, rank_of[at], NO_RANK)


def _linked(ids: np.ndarray, ranks: np.ndarray, rank_of: dict[int, int]) -> list[int]:
    """The leftmost pair of minimum rank contracted again and again, over linked positions."""
    n = len(ids)
    own, after, before = array("q", ids.tolist()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    at = np.flatnonzero(ranks != NO_RANK)
    heap = (ranks[at].astype(np.int64) << 32 | at).tolist()
    heapify(heap)

    def meet(left: int) -> None:
        right = after[left]
        if right < n:
            rank = rank_of.get(own[left] << 32 | own[right])
            if rank is not None:
                heappush(heap, rank << 32 | left)

    while heap:
        top = heappop(heap)
        rank, left = top >> 32, top & 0xFFFFFFFF
        right = after[left]
        # a pair that a merge beside it has changed is in the heap no more than by its old rank
        if own[left] < 0 or right >= n or rank_of.get(own[left] << 32 | own[right]) != rank:
            continue
        own[left], own[right] = rank, -1
        after[left] = following = after[right]
        if following < n:
            before[following] = left
        meet(left)
        if before[left] >= 0:
            meet(before[left])
    return [x for x in own if x >= 0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """A worker's DuckDB with the merge table and the vocabulary, and what it has coded so far."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        pairs = array("i")
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    pairs.extend((ranks[t[:i]], ranks[t[i:]], r))
        a, b, rank = np.frombuffer(pairs, np.int32).reshape(-1, 3).T
        self._table("merges", pa.table({"a": a.copy(), "b": b.copy(), "rank": rank.copy()}))
        # bytes travel as the characters of the same numbers
        ids, tokens = pa.array(ranks.values(), pa.int32()), [t.decode("latin-1") for t in ranks]
        self._table("vocabulary", pa.table({"id": ids, "token": tokens}))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.word_start = np.zeros(size, bool)
        self.word_start[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.id_hash = mixed(np.arange(size))
        self.place_factor = mixed(np.arange(RUN_IDS) + size) | np.uint64(1)
        self.pairs = None  # for long pieces only
        self.encoder = Encoder(self.encode_pieces)
        self.runs = Segments(np.uint8)
        give_back()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming").fetchall()
        self.db.unregister("incoming")

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        raw = [p.encode() for p in pieces]
        pending: list[int] = []
        rows = 0
        for i, word in enumerate(raw):
            whole = self.ranks.get(word)
            out.append([] if whole is None else [whole])
            if whole is None and len(word) >= LONG_BYTES:
                out[i] = self._merge_long(word)
            elif whole is None:
                pending.append(i)
                rows += len(word) * (len(word) + 1) // 2
                if rows >= STATE_ROWS:
                    self._merge([raw[k] for k in pending], [out[k] for k in pending])
                    pending, rows = [], 0
        if pending:
            self._merge([raw[k] for k in pending], [out[k] for k in pending])
        return out

    def _positions(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32),
            "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)],
        })

    def _merge(self, words: list[bytes], into: list[list[int]]) -> None:
        self._table("given", self._positions(words))
        rows = self.db.sql(MERGE).to_arrow_table()
        ids = rows["id"].to_numpy().tolist()
        ends = np.cumsum(np.bincount(rows["word"].to_numpy(), minlength=len(words))).tolist()
        at = 0
        for ids_of, end in zip(into, ends, strict=True):
            ids_of.extend(ids[at:end])
            at = end

    def _merge_long(self, word: bytes) -> list[int]:
        if self.pairs is None:
            rows = self.db.sql("SELECT a::BIGINT << 32 | b AS pair, rank FROM merges ORDER BY pair").to_arrow_table()
            self.pairs = rows["pair"].to_numpy(), rows["rank"].to_numpy()
        pairs, rank_of = self.pairs
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        while True:
            ranks = _ranks(ids, pairs, rank_of)
            least = np.flatnonzero(ranks == ranks.min(initial=NO_RANK)) if len(ranks) else ranks
            if not len(least) or ranks[least[0]] == NO_RANK:
                return ids.tolist()
            if len(least) * FEW < len(ids):
                return _linked(ids, ranks, dict(zip(pairs.tolist(), rank_of.tolist(), strict=True)))
            # of pairs that overlap, every other one from the left
            opens = np.append(True, np.diff(least) > 1)
            start = np.maximum.accumulate(np.where(opens, np.arange(len(least)), 0))
            taken = least[(np.arange(len(least)) - start) % 2 == 0]
            ids = ids.copy()
            ids[taken] = ranks[taken]
            ids = np.delete(ids, taken + 1)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids, laid end to end; ``ends`` says where each list ends.

        Lists are cut into runs, before each token that starts with a blank and after
        ``RUN_IDS`` ids at the latest; every distinct run is aggregated once.
        """
        if len(self.runs.keys) > CACHED_WORDS:
            self.runs = Segments(np.uint8)
        if not len(ids):
            return [b""] * len(ends)
        if ids.min() < 0 or ids.max() >= len(self.word_start):
            raise ValueError("an id that the vocabulary lacks")
        cut = self.word_start[ids]
        cut[0] = True
        cut[ends[ends < len(ids)]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(ids)))
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        cut[place % RUN_IDS == 0] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(ids)))
        hashes = np.add.reduceat(self.id_hash[ids] * self.place_factor[place % RUN_IDS], starts)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.runs.missing(distinct))
        if len(new):
            new_sizes = sizes[at[new]]
            pos = np.arange(new_sizes.sum()) - np.repeat(np.cumsum(new_sizes) - new_sizes, new_sizes)
            where = np.repeat(starts[at[new]], new_sizes) + pos
            self._table("given", pa.table({
                "run": np.repeat(np.arange(len(new), dtype=np.int32), new_sizes), "pos": pos.astype(np.int32),
                "id": ids[where].astype(np.int32),
            }))
            texts = [t.encode("latin-1") for t in self.db.sql(DECODE).to_arrow_table()["text"].to_pylist()]
            if len(texts) != len(new):
                raise ValueError("an id that the vocabulary lacks")
            counts = np.fromiter(map(len, texts), np.int32, len(texts))
            self.runs.add(distinct[new], np.frombuffer(b"".join(texts), np.uint8), counts)
        places = self.runs.places(distinct)[back]
        bounds = np.searchsorted(starts, np.append(0, ends)).tolist()
        return [self.runs.gathered(places[b:e])[0].tobytes() for b, e in zip(bounds[:-1], bounds[1:], strict=True)]


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES, one row at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
        yield at, end
        at = end


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of its text column; a column of the name ``ids`` is replaced.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name:
    a second pass would keep a second worker with all its tables beside each first one.
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.BinaryType()))
    kept = docs.drop(*[f.name for f in added if f.name != text])
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path)
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end in _slices(sizes):
            part = batch.slice(at, end - at)
            got = own.encoder.encode([t or "" for t in column.slice(at, end - at).to_pylist()])
            columns = [*part.columns, _lists(got)]
            if decoded:
                ends = np.cumsum([len(g) for g in got])
                columns.append(pa.array(own.decode(np.concatenate(got), ends), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            del part, got, columns
            give_back()

    return kept.mapInArrow(by_batch(run), schema)


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that its ids stand for; a column of the name ``decoded`` is replaced."""
    kept = docs.drop(decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path)
        lists = batch.column(batch.schema.get_field_index(ids))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end in _slices(4 * sizes):
            part = batch.slice(at, end - at)
            flat = lists.slice(at, end - at).flatten().to_numpy(zero_copy_only=False)
            got = own.decode(flat, np.cumsum(sizes[at:end]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], schema.names)

    return kept.mapInArrow(by_batch(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded bytes."""
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
