"""Token ids of a corpus in compact binary files, in ascending order of the documents' ids, and back.

Pass 1 encodes every document once (ids and end id, staged) and counts every id over the whole corpus; the counts give
one frequency table for all files. Pass 2 orders the documents over ranges of their ids and writes one file for each range;
pass 3 is any later read. Files are a Python data source (`token_ids`), so both passes are ordinary Spark reads and
writes, and what a task writes counts only once it is committed.

A folder holds
  table.bin      shape of the blocks and the shared frequency table, with its CRC-32
  part-*.ids     blocks (see `token_coding`), then a footer: documents (id, number of ids) and blocks (place, number of
                 ids, words, CRC-32 of the ids, checkpoints) as two Arrow streams, then its place, lengths and CRC-32
  manifest.json  the files in order, with the number of ids before each; written last, by the commit

A read splits files at blocks: a task decodes the blocks in which its documents lie, all their checkpoint stretches
side by side, and checks every block. Offsets of files are prefix sums over the files, one number for each.

Defined cases: null and empty texts are the end id alone; null ids come first; repeated ids are ordered by their token
ids' hash, repeated rows as they come; an empty table gives a folder without files and no rows; other columns are not read.
A folder is written once. Paths may be of any file system that `pyarrow.fs` reaches.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import tokens
from . import words as W
from .staging import _delete_at_exit, arrow_rows, recorded, release, shared_folder, staged
from .token_coding import Block, Coder, CorruptTokens, Shape, shared_frequencies

FORMAT = "token_ids"
_MAGIC = b"TOKIDS01"
_TABLE = "<8sIIIIII"      # magic, precision, lanes, steps, checkpoint, ids, CRC-32 of the table
_TRAILER = "<QQQI8s"     # footer's place, lengths of its two parts, CRC-32, magic
GROUP_BLOCKS = 128                       # blocks coded at once
READ_BLOCKS = 256                        # blocks of one read task


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _read_file(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, place = file_system(path)
    with system.open_input_file(place) as file:
        return file.read_at(file.size() - start if length is None else length, start)


def _write_file(path: str, content: bytes) -> None:
    system, place = file_system(path)
    with system.open_output_stream(place) as out:
        out.write(content)


def write_table(path: str, frequencies: np.ndarray, shape: Shape) -> None:
    table = frequencies.astype("<u4").tobytes()
    _write_file(f"{path}/table.bin", struct.pack(_TABLE, _MAGIC, shape.precision, shape.lanes, shape.steps, shape.checkpoint, len(frequencies), zlib.crc32(table)) + table)


def read_coder(path: str) -> Coder:
    content = _read_file(f"{path}/table.bin")
    magic, precision, lanes, steps, checkpoint, ids, crc = struct.unpack_from(_TABLE, content)
    table = content[struct.calcsize(_TABLE):]
    if magic != _MAGIC or len(table) != 4 * ids or zlib.crc32(table) != crc:
        raise CorruptTokens(f"{path}: the frequency table is damaged")
    return Coder(np.frombuffer(table, "<u4"), Shape(precision, lanes, steps, checkpoint))


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


@dataclass
class _Committed(WriterCommitMessage):
    part: int
    file: str
    documents: int
    ids: int
    blocks: int


class TokenWriter(DataSourceArrowWriter):
    """Writes the rows of each partition (doc_id, ids), as they come, into one file."""

    def __init__(self, path: str, width: str):
        self.path, self.width = path, np.dtype(width)

    def write(self, iterator):
        from pyspark import TaskContext
        coder, part = read_coder(self.path), TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}.ids"
        system, place = file_system(f"{self.path}/{name}")
        docs, about, waiting, held, total = [], [], [], 0, 0
        group = GROUP_BLOCKS * coder.shape.block
        at = 0
        with system.open_output_stream(place) as out:
            def flush(everything: bool) -> None:
                nonlocal waiting, held, at
                ids = np.concatenate([*waiting, np.zeros(0, np.uint32)])
                to = len(ids) if everything else len(ids) // group * group
                for low in range(0, to, group):
                    for block in coder.encode(ids[low:min(to, low + group)]):
                        out.write(block.words)
                        about.append((at, block.ids, len(block.words) // 4, block.crc32, block.places.tobytes(), block.states.astype("<u8").tobytes()))
                        at += len(block.words)
                waiting, held = [ids[to:].copy()], len(ids) - to

            for batch in iterator:
                binary = batch.column("ids").cast(pa.large_binary())
                data, offsets = W.raw(binary)
                docs.append(pa.table([batch.column("doc_id"), pa.array(np.diff(offsets) // self.width.itemsize)], ["doc_id", "ids"]))
                ids = np.frombuffer(data.tobytes(), self.width).astype(np.uint32)
                waiting.append(ids)
                held, total = held + len(ids), total + len(ids)
                if held >= group:
                    flush(False)
            flush(True)
            documents = pa.concat_tables(docs) if docs else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.int64())})
            kinds = {"at": pa.int64(), "ids": pa.int64(), "words": pa.int64(), "crc32": pa.int64(), "places": pa.binary(), "states": pa.binary()}
            blocks = pa.table([pa.array([b[k] for b in about], t) for k, t in enumerate(kinds.values())], list(kinds))
            parts = [_stream(documents), _stream(blocks)]
            out.write(b"".join(parts))
            out.write(struct.pack(_TRAILER, at, *map(len, parts), zlib.crc32(b"".join(parts)), _MAGIC))
        return _Committed(part, name, documents.num_rows, total, len(about))

    def commit(self, messages):
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.part):
            files.append({"file": m.file, "documents": m.documents, "ids": m.ids, "blocks": m.blocks, "before": before})
            before += m.ids
        _write_file(f"{self.path}/manifest.json", json.dumps({"ids": before, "files": files}).encode())

    def abort(self, messages):
        for m in messages:
            if m is not None:
                system, place = file_system(f"{self.path}/{m.file}")
                system.delete_file(place)


class _Blocks(InputPartition):
    """value: file, number of ids before it, and low, high: the documents that begin in blocks low to high - 1."""


class TokenReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        files = json.loads(_read_file(f"{self.path}/manifest.json"))["files"]
        return [_Blocks((f["file"], f["before"], low, min(low + READ_BLOCKS, f["blocks"]))) for f in files for low in range(0, f["blocks"], READ_BLOCKS)]

    def read(self, partition):
        if partition is None or partition.value is None:  # a folder without files
            return
        name, before, low_block, high_block = partition.value
        coder = read_coder(self.path)
        shape = coder.shape
        system, place = file_system(f"{self.path}/{name}")
        with system.open_input_file(place) as file:
            documents, blocks = _footer(file, name)
            size = documents["ids"].to_numpy()
            start = np.cumsum(size) - size
            first, last = np.searchsorted(start, [low_block * shape.block, high_block * shape.block])
            at = int(first)
            while at < last:  # documents whose ids fill about a group of blocks
                to = max(at + 1, min(int(last), int(np.searchsorted(start + size, int(start[at]) + GROUP_BLOCKS * shape.block, "right"))))
                low, high = int(start[at]) // shape.block, -(-int(start[to - 1] + size[to - 1]) // shape.block)
                ids = [self._decoded(coder, file, blocks, b, min(b + GROUP_BLOCKS, high)) for b in range(low, high, GROUP_BLOCKS)]
                ids = np.concatenate(ids)[int(start[at]) - low * shape.block:].astype("<u4")
                ends = np.concatenate(([0], np.cumsum(size[at:to])))
                binary = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), pa.py_buffer(ids[:ends[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([documents["doc_id"].slice(at, to - at).combine_chunks(), pa.array(before + start[at:to]), pa.array(size[at:to]),
                                                  binary.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                at = to

    @staticmethod
    def _decoded(coder: Coder, file, blocks: pa.Table, low: int, high: int) -> np.ndarray:
        about = blocks.slice(low, high - low).to_pylist()
        content = file.read_at(sum(4 * b["words"] for b in about), about[0]["at"])
        base, shape, out = about[0]["at"], coder.shape, []
        for b in about:
            states = np.frombuffer(b["states"], "<u8").reshape(shape.checkpoints, shape.lanes)
            out.append(Block(b["ids"], b["crc32"], content[b["at"] - base:b["at"] - base + 4 * b["words"]], np.frombuffer(b["places"], "<u4"), states))
        return coder.decode(out)


def _footer(file, name: str) -> tuple[pa.Table, pa.Table]:
    end, size = file.size(), struct.calcsize(_TRAILER)
    place, first, second, crc, magic = struct.unpack(_TRAILER, file.read_at(size, end - size)) if end >= size else (0, 0, 0, 0, b"")
    content = file.read_at(first + second, place) if magic == _MAGIC else b""
    if magic != _MAGIC or len(content) != first + second or zlib.crc32(content) != crc:
        raise CorruptTokens(f"{name}: the footer is damaged")
    return tuple(pa.ipc.open_stream(part).read_all() for part in (content[:first], content[first:]))


class TokenIds(DataSource):
    """spark.read.format("token_ids").load(folder): doc_id, start, n_tokens, ids (little-endian unsigned 32 bits)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return f"doc_id {self.options.get('id', 'long')}, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return TokenReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"], self.options.get("width", "<u4"))


def _width(vocabulary: str, end_id: int) -> str:
    """Ids pass between the passes as little-endian unsigned numbers of 16 bits where all of them fit, else of 32."""
    return "<u2" if max(tokens.encoder(vocabulary).ids, end_id + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, *, doc_id: str, text: str, end_id: int, vocabulary: str, width: str) -> DataFrame:
    """doc_id, ids (end id last), tie (hash of the ids) and row (by position); staged."""
    def encode(batches):
        encoder, size = tokens.encoder(vocabulary), np.dtype(width).itemsize
        for batch in batches:
            for done, part in tokens.slices(batch.column("text")):
                ids, offsets = encoder.encode(part)
                ids = np.insert(ids, offsets[1:], end_id).astype(width)
                offsets = offsets + np.arange(len(offsets))
                binary = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((size * offsets).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(part)), binary.cast(pa.binary())], ["doc_id", "ids"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    with arrow_rows(docs.sparkSession, 2000):
        found = rows.mapInArrow(encode, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.BinaryType())]))
        return staged(found.select("doc_id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row")), "token-ids", "zstd")


def id_counts(stream: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs in all rows: counted in tasks, summed by id; as many rows as different ids reach the driver."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = W.raw(batch.column("ids").cast(pa.large_binary()))
            own = np.bincount(np.frombuffer(data.tobytes(), width))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[:len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    with arrow_rows(stream.sparkSession, 2000):
        rows = stream.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max(rows["id"].to_pylist(), default=-1) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_token_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, vocabulary: str | None = None,
                      shape: Shape = Shape(), file_ids: int = 1 << 24) -> None:
    """The token ids of all documents in ascending order of doc_id, in files of about file_ids ids (fewer where that leaves cores idle)."""
    spark = docs.sparkSession
    system, place = file_system(path)
    if system.get_file_info(f"{place}/manifest.json").type != pafs.FileType.NotFound:
        raise ValueError(f"{path} holds token files")
    system.create_dir(place, recursive=True)
    vocabulary = vocabulary or tokens.vocabulary_path()
    width = _width(vocabulary, end_id)
    with recorded() as made:
        stream = encoded(docs, doc_id=doc_id, text=text, end_id=end_id, vocabulary=vocabulary, width=width)
    counts = id_counts(stream, width)
    write_table(path, shared_frequencies(counts, shape.precision), shape)
    total = int(counts.sum())
    files = max(1, -(-total // file_ids), min(spark.sparkContext.defaultParallelism, -(-total // (GROUP_BLOCKS * shape.block))))
    order = ("doc_id", "tie", "row")
    spark.dataSource.register(TokenIds)
    with arrow_rows(spark, 2000):
        ranged = stream.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
        ranged.write.format(FORMAT).option("path", path).option("width", width).mode("append").save()
    release(spark, made)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of a folder."""
    spark.dataSource.register(TokenIds)
    return spark.read.format(FORMAT).option("id", id_type).load(path)


def token_files_report(docs: DataFrame) -> DataFrame:
    """Writes the files of all documents into the shared folder, reads them back, and gives each document's place, length and CRC-32."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    _delete_at_exit(spark, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
