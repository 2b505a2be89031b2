"""Token-ID files: independent zstandard frames, a trailing seek table, and a checksum for each frame.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and writes one or more files to the
shared folder, so a file holds consecutive documents. A file is

    data frames        each a zstandard frame of its own, with content checksum
    index              a skippable frame: for each data frame its first doc_id, documents and ids
    seek table         a skippable frame in the public seekable format: for each frame its compressed size, its size and
                       the low 32 bits of XXH64 of its content, then the number of frames

A data frame holds a count n, n flags (1: doc_id is null), n doc_ids, n id counts, and all ids. A reader fetches the tail
of a file, finds the frame in the index, and decompresses that frame only. A file appears under its name when complete, and a
task run again writes the same bytes, so a lost executor costs only its own tasks.

Defined results: a null text is an empty text and holds the end id only; null doc_ids come first; equal doc_ids are ordered
by text; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common, word_tokens

END_ID = 2
#: Fixed values of the seekable format.
SKIPPABLE, INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_IDS = 1 << 19
FILE_IDS = 1 << 25
MANIFEST = "path string, part int, number int, n_docs bigint, n_ids bigint, n_bytes bigint"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class FileWriter:
    def __init__(self, uri: str, level: int = 3):
        import zstandard

        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.unfinished = f"{self.path}.{context.taskAttemptId() if context else 0}"
        self.out = self.fs.open_output_stream(self.unfinished)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.n_docs = self.n_ids = self.n_bytes = 0
        self._start()

    def _start(self) -> None:
        self.doc_ids: list[int | None] = []
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 16-bit integers."""
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.held += len(ids) // 2
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.doc_ids:
            return
        n = len(self.doc_ids)
        flags = np.array([d is None for d in self.doc_ids], dtype="u1")
        numbers = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        data = b"".join([struct.pack("<I", n), flags.tobytes(), numbers.tobytes(), np.array([len(x) // 2 for x in self.ids], dtype="<u4").tobytes(), *self.ids])
        frame = self.zstd.compress(data)
        self.out.write(frame)
        self.entries.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        first = self.doc_ids[0]  # nulls come before all numbers
        self.index.append((-(1 << 63) if first is None else int(first), n, self.held))
        self.n_docs, self.n_ids, self.n_bytes = self.n_docs + n, self.n_ids + self.held, self.n_bytes + len(frame)
        self._start()

    def close(self) -> tuple[int, int, int]:
        self.flush()
        index = b"".join(struct.pack("<qII", *x) for x in self.index)
        table = b"".join(struct.pack("<III", *x) for x in self.entries)
        table += struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        tail = struct.pack("<II", INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE, len(table)) + table
        self.out.write(tail)
        self.out.close()
        self.fs.move(self.unfinished, self.path)
        return self.n_docs, self.n_ids, self.n_bytes + len(tail)


class FileReader:
    def __init__(self, uri: str):
        import zstandard

        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{uri} has no seek table")
        table = size - 9 - 12 * frames
        entries = np.frombuffer(self.file.read_at(12 * frames, table), dtype="<u4").reshape(-1, 3)
        index = self.file.read_at(16 * frames, table - 8 - 16 * frames)
        self.index = np.frombuffer(index, dtype=[("doc_id", "<i8"), ("n_docs", "<u4"), ("n_ids", "<u4")])
        self.sizes, self.checks = entries[:, 0], entries[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents of frame k."""
        import xxhash

        data = self.zstd.decompress(self.file.read_at(int(self.sizes[k]), int(self.starts[k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        (n,) = struct.unpack_from("<I", data)
        flags = np.frombuffer(data, "u1", n, 4)
        numbers = np.frombuffer(data, "<i8", n, 4 + n)
        counts = np.frombuffer(data, "<u4", n, 4 + 9 * n)
        ids = np.frombuffer(data, "<u2", offset=4 + 13 * n)
        ends = np.cumsum(counts, dtype=np.int64)
        return [(None if f else int(d), ids[e - c : e]) for f, d, c, e in zip(flags.tolist(), numbers.tolist(), counts.tolist(), ends.tolist(), strict=True)]

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of that doc_id; only frames that can hold it are read."""
        first = self.index["doc_id"]
        last = int(np.searchsorted(first, doc_id, "right"))
        return [ids for k in range(max(0, int(np.searchsorted(first, doc_id, "left")) - 1), last) for d, ids in self.frame(k) if d == doc_id]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Writes the files and returns their manifest (path, part, number, n_docs, n_ids, n_bytes), ordered by (part, number)."""
    end = b"" if end_id is None else struct.pack("<H", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens.load(path or word_tokens.vocabulary_path())
        part, number, writer, rows = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            encoded = words.encode_stream(text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0), encoded, strict=True):
                if writer is None:
                    target = f"{folder}/part-{part:06d}-{number:04d}.zst"
                    writer = FileWriter(target)
                writer.add(doc_id.as_py(), ids + end)
                if writer.n_ids >= FILE_IDS:
                    rows.append((target, part, number, *writer.close()))
                    writer, number = None, number + 1
        if writer is not None:
            rows.append((target, part, number, *writer.close()))
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["path", "part", "number", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(common.partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FileReader(uri)
                for k in range(len(reader)):
                    rows = reader.frame(k)
                    counts = np.array([len(ids) for _, ids in rows], dtype=np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file: a file holds millions of ids.
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    files = files.repartition(common.partitions_for(manifest.sparkSession))
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    manifest = write_token_files(docs, common.new_folder(spark, "tokens"))
    common.release(spark)
    return read_token_files(manifest)
