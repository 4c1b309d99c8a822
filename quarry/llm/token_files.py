"""Token ids as Arrow files of equal-length sequences with masks.

All ids of the corpus, in ascending document order, are cut into sequences of one length. A file has
record batches of two fixed-size-list columns: `ids` and `mask` (false behind the last id). Memory-mapped,
sequence i of any batch is a slice of one buffer, without a copy. Beside each file lies a second one, its
index: each document's id, where its ids start in the file, and how many there are.

Documents are range-partitioned by id; each partition writes its own files whole, or again if its
executor is lost. A manifest of one row a file gives every file's place in the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keyed, make_dirs, mapped, writing
from .tokens import encoded, vocabulary_path

END = 2


@dataclass(frozen=True)
class TokenFile:
    path: str
    start: int
    tokens: int
    rows: int


def _schema(length: int, width: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids; writes a record batch for every `per_batch` sequences."""

    def __init__(self, sink, length: int, width: pa.DataType, per_batch: int = 256):
        self.schema = _schema(length, width)
        self.length, self.per_batch, self.width = length, per_batch, width
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * self.per_batch:
            whole = np.concatenate(self.held)
            step = self.length * self.per_batch
            for at in range(0, len(whole) - step + 1, step):
                self._batch(whole[at : at + step], step)
            rest = whole[len(whole) // step * step :]
            self.held, self.size = [rest], len(rest)

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        columns = [pa.array(ids, self.width), pa.array(np.arange(len(ids)) < valid)]
        lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            rest = np.concatenate(self.held)
            padded = np.zeros(-(-len(rest) // self.length) * self.length, rest.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        self.out.close()


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end: int = END,
    vocabulary: str | None = None,
    row_key: list[Column] | None = None,
) -> list[TokenFile]:
    """Write the corpus below `path`; the files in ascending document order.

    A null text is empty and has the end id alone; a null id comes first; rows of equal ids follow one
    another in the order of `row_key` (see common.keyed), so that many of one id spread too; bytes that are no UTF-8
    are read as replacement characters; texts of any length are written whole; an empty table writes nothing. Ids are
    stored in 16 bits where the vocabulary and the end id allow it. Only the id and the text are read, whatever
    other columns are called.
    """
    vocabulary = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    make_dirs(spark, path)
    keyed_rows, row = keyed(docs, row_key)
    source = keyed_rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *row)

    def run(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        number = TaskContext.get().partitionId()
        small = max(encoder(vocabulary).tokenizer.get_vocab_size() - 1, end) < 1 << 16
        width, dtype = (pa.uint16(), np.uint16) if small else (pa.uint32(), np.uint32)
        name = f"{path}/part-{number:09d}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        total = rows = 0
        with writing(f"{name}.arrow") as sink, writing(f"{name}.index.arrow") as index_sink:
            sequences = SequenceWriter(sink, length, width)
            schema = pa.schema([("doc_id", first.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
            index = pa.ipc.new_file(index_sink, schema)
            batch = first
            while batch is not None:
                lengths = np.zeros(batch.num_rows, np.int64)
                for row, ids, at in encoded(batch.column(1), vocabulary, end):
                    lengths[row : row + len(at) - 1] = np.diff(at)
                    sequences.append(ids.astype(dtype))
                starts = total + np.cumsum(lengths) - lengths
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(lengths)], schema=schema))
                total += int(lengths.sum())
                rows += batch.num_rows
                batch = next(batches, None)
            sequences.close()
            index.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([total]), pa.array([rows])], ["name", "tokens", "rows"]
        )

    parts = source.repartitionByRange("doc_id", *row).sortWithinPartitions("doc_id", *row).mapInArrow(run, "name string, tokens long, rows long").collect()
    parts.sort(key=lambda r: r["name"])  # numbered as the ranges are
    out, start = [], 0
    for r in parts:
        out.append(TokenFile(r["name"], start, r["tokens"], r["rows"]))
        start += r["tokens"]
    return out


class SequenceReader:
    """Random access to the sequences and to any run of ids of one file, over its memory map."""

    def __init__(self, name: str):
        self.file = pa.ipc.open_file(mapped(f"{name}.arrow"))
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.length = self.file.schema.field("ids").type.list_size
        flat = [b.column(0).flatten() for b in self.batches]
        self.ids = [x.to_numpy(zero_copy_only=True) for x in flat]
        self.starts = np.cumsum([0] + [len(x) for x in self.ids])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i."""
        b = int(np.searchsorted(self.starts, i * self.length, "right")) - 1
        at = i - int(self.starts[b]) // self.length
        mask = self.batches[b].column(1).flatten()[at * self.length : (at + 1) * self.length]
        return self.ids[b][at * self.length : (at + 1) * self.length], mask.to_numpy(zero_copy_only=False)

    def runs(self, start: int, n: int):
        """Views on the ids start to start + n, one for each batch that they lie in."""
        while n > 0:
            b = int(np.searchsorted(self.starts, start, "right")) - 1
            at = start - int(self.starts[b])
            part = self.ids[b][at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def read_digests(spark: SparkSession, files: list[TokenFile], id_type: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                f = files[number]
                reader = SequenceReader(f.path)
                index = pa.ipc.open_file(mapped(f"{f.path}.index.arrow"))
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    starts, lengths = part.column(1).to_numpy(), part.column(2).to_numpy()
                    sums = np.zeros(len(starts), np.int64)
                    for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                        crc = 0
                        for view in reader.runs(s, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        sums[k] = crc
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(starts + f.start), part.column(2), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the corpus to the shared folder and return what its files hold of each document."""
    spark = docs.sparkSession
    files = write(docs, fresh(spark, "tokens"), id_col, **options)
    return read_digests(spark, files, docs.schema[id_col].dataType.simpleString())
