"""Token ids as Arrow files of fixed-size lists (operator 10).

Documents are put into the order of their id by range partitioning, encoded, closed
with an end id and laid end to end.  The stream of a file is cut into sequences of
equal length; a record batch holds a fixed number of them as a fixed-size list of ids
and a fixed-size list of mask bits (false: padding, only in a file's last sequence).
Batches are uncompressed, so sequence ``i`` of a memory-mapped file is found by one
division and read without a copy.

Cases: a null text is empty (the end id alone); a null doc_id sorts first; repeated
doc_ids follow each other in the order of a hash of their text; an empty table gives
no file and no row; other columns are not read.  The tokenizer's added tokens (such as
``<|endoftext|>``) in a text are ordinary text, or with ``added_tokens`` their ids, as the
library has it by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .files import new_folder, opened, own_name
from .memory import give_back, kept
from .pretokens import Encoder

_encoders: dict[tuple[str, bool], Encoder | AddedTokens] = kept({})
MANIFEST = "part int, seq int, file string, n_ids long, doc_id array<long>, n_tokens array<long>"


@dataclass(frozen=True)
class Layout:
    """``sequence`` ids make a row, ``rows`` rows a record batch; a file ends with the document
    that brings it to ``file_ids`` ids.  ``wide`` stores 32-bit ids, else 16-bit;
    an id that does not fit is an error."""

    sequence: int = 2048
    rows: int = 128
    file_ids: int = 32_000_000
    wide: bool = False


class AddedTokens:
    """Texts to ids where added tokens in a text become their ids; what lies between them is encoded by itself."""

    def __init__(self, encoder: Encoder, tokenizer):
        self.encoder, self.tokenizer = encoder, tokenizer
        added = tokenizer.get_added_tokens_decoder()
        self.ids = {t.content: i for i, t in added.items() if t.content}
        # at one place the library takes the longest
        longest = sorted(self.ids, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        # tokens that look at what is beside them, and texts that are changed first, are left to the library
        self.plain = tokenizer.normalizer is None and not any(
            t.single_word or t.lstrip or t.rstrip for t in added.values()
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is None:
            return self.encoder.encode(texts)
        if not self.plain:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
        split = [self.cut.split(t) for t in texts]
        # parts at even places are text, those at odd places added tokens
        between = iter(self.encoder.encode([p for parts in split for p in parts[::2]]))
        out = []
        for parts in split:
            ids = [np.array([self.ids[p]], np.int32) if i % 2 else next(between) for i, p in enumerate(parts)]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out


def hf_encoder(path: str, added_tokens: bool = False) -> Encoder | AddedTokens:
    """The worker's encoder for a tokenizers file; see ``added_tokens`` above."""
    if (path, added_tokens) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added_tokens
        encoder = Encoder(
            lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        )
        _encoders[path, added_tokens] = AddedTokens(encoder, tokenizer) if added_tokens else encoder
    return _encoders[path, added_tokens]


class TokenWriter:
    """Writes one file; ids come in any portions."""

    def __init__(self, place: str, layout: Layout):
        self.layout, self.dtype = layout, np.uint32 if layout.wide else np.uint16
        n = layout.sequence
        kind = pa.uint32() if layout.wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(kind, n)), ("mask", pa.list_(pa.bool_(), n))])
        fs, path = opened(place)
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit {self.dtype.__name__}: write with wide=True")
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.layout.sequence * self.layout.rows:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        n, size = self.layout.sequence, self.layout.sequence * self.layout.rows
        full = len(ids) // size * size
        parts = [ids[i : i + size] for i in range(0, full, size)] + ([ids[full:]] if last and len(ids) > full else [])
        for part in parts:
            mask = np.ones(-(-len(part) // n) * n, bool)
            mask[len(part) :] = False
            values = np.zeros(len(mask), self.dtype)
            values[: len(part)] = part
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(values), n),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), n),
            ]
            self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held = [ids[full:]]
        self.n_held = len(ids) - full

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


class TokenFile:
    """Random access to a file; memory-mapped where the file system is local."""

    def __init__(self, place: str):
        fs, path = opened(place)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.at, self.batch = -1, None

    def _column(self, batch: int, name: str) -> pa.Array:
        if batch != self.at:
            self.at, self.batch = batch, self.reader.get_batch(batch)
        return self.batch.column(name).flatten()

    def ids(self, i: int) -> np.ndarray:
        """Sequence ``i``, a view of the file."""
        n = self.sequence
        return self._column(i // self.rows, "ids").to_numpy()[(i % self.rows) * n : (i % self.rows + 1) * n]

    def mask(self, i: int) -> np.ndarray:
        n = self.sequence
        return self._column(i // self.rows, "mask").slice((i % self.rows) * n, n).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the file's stream; a view if one batch holds them."""
        size, parts = self.sequence * self.rows, []
        while count > 0:
            batch, offset = divmod(start, size)
            values = self._column(batch, "ids").to_numpy()[offset : offset + count]
            if not len(values):
                raise ValueError("the file ends before the ids that its index names")
            parts.append(values)
            start, count = start + len(values), count - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.batch = None
        self.source.close()


def write(
    docs: DataFrame, tokenizer: str, end_id: int, layout: Layout = Layout(), folder: str | None = None,
    added_tokens: bool = False,
) -> DataFrame:
    """Write all documents; returns the manifest, a row per file with its documents in order.

    Only files that the manifest names count: a task that is run again writes others.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = hf_encoder(tokenizer, added_tokens), TaskContext.get().partitionId(), 0
        writer, doc_ids, counts = None, [], []

        def finished() -> pa.RecordBatch:
            writer.close()
            row = {"part": part, "seq": seq, "file": place, "n_ids": writer.n_ids, "doc_id": doc_ids, "n_tokens": counts}
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    place = own_name(folder, f"part-{part:06d}-{seq:04d}") + ".arrow"
                    writer = TokenWriter(place, layout)
                writer.add(np.append(ids, end_id))
                doc_ids.append(doc_id)
                counts.append(len(ids) + 1)
                if writer.n_ids >= layout.file_ids:
                    yield finished()
                    writer, doc_ids, counts, seq = None, [], [], seq + 1
            give_back()
        if writer is not None:
            yield finished()

    return staged(ordered.mapInArrow(encode, MANIFEST))


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the number of ids in all files before; one narrow row per file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return manifest.join(starts, ["part", "seq"])


def read_documents(spark: SparkSession, manifest: DataFrame, digest, fields: str) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens and what ``digest`` makes of its ids.

    ``digest`` maps an array of ids to a value of the type that ``fields`` (``name type``) names.
    """
    name, kind = fields.split()
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source, at, values = TokenFile(row["file"]), 0, []
                starts = []
                for count in row["n_tokens"]:
                    values.append(digest(source.tokens(at, count)))
                    starts.append(row["start"] + at)
                    at += count
                source.close()
                yield pa.record_batch(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(starts, pa.int64()),
                        pa.array(row["n_tokens"], pa.int64()), pa.array(values, arrow),
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )

    # a count of its own, since adaptive execution would put the small manifest into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = located(manifest).select("file", "start", "doc_id", "n_tokens").repartition(tasks, "file")
    return files.mapInArrow(read, f"doc_id long, start long, n_tokens long, {fields}")
