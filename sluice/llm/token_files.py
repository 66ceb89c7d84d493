"""Token-id output: independent zstandard frames with a trailing seek table.

A token file is a sequence of independent zstandard frames that hold little-endian unsigned
32-bit ids, documents one after another in ascending key order; a skippable frame with the
document table (keys and token counts); and, last, a seek table as the public zstandard seekable
format lays it down: compressed size, decompressed size and checksum (low 32 bits of XXH64 of the
decompressed bytes) of every frame. Plain zstandard tools read the ids; a reader that wants some
documents reads the tail of the file and decompresses only the frames that hold them.

Scale: one range shuffle on the key deals documents into files of about ``docs_per_file``; the task
of a range encodes and writes in one stream, a frame at a time. A file appears under its name only when complete, so a repeated
task replaces it by the same bytes. Files go through Arrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values of the zstandard seekable format
SKIPPABLE_SEEK, SKIPPABLE_TABLE = 0x184D2A5E, 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
TABLE = "file string, key long, file_start long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes one file; ids arrive document by document."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting, self.size = [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.keys, self.counts = [], []

    def add(self, keys: list[int], ids: np.ndarray, at: np.ndarray) -> None:
        """Documents ``keys`` with the ids between their offsets ``at``."""
        self.keys += keys
        self.counts += np.diff(at).tolist()
        data = ids.astype("<u4", copy=False).tobytes()
        for begin, end in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True):
            if self.size and self.size + end - begin > FRAME_BYTES:
                self._frame()
            while end - begin > FRAME_BYTES:  # only a document larger than a frame is cut
                self.waiting.append(data[begin:begin + FRAME_BYTES])
                begin += FRAME_BYTES
                self._frame()
            self.waiting.append(data[begin:end])
            self.size += end - begin

    def _frame(self) -> None:
        plain = b"".join(self.waiting)
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), _checksum(plain)))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._frame()
        table = self.compressor.compress(struct.pack("<Q", len(self.keys)) + np.array(self.keys, "<i8").tobytes()
                                         + np.array(self.counts, "<i8").tobytes())
        table = struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table
        self.out.write(table)
        self.entries.append((len(table), 0, _checksum(b"")))
        body = b"".join(struct.pack("<III", *e) for e in self.entries)
        body += struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


class TokenFile:
    """Reads a token file: the document table at once, ids a frame at a time."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.fs, root = _filesystem(folder)
        self.file = self.fs.open_input_file(f"{root}/{name}")
        self.plain = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{name}: no seek table")
        entries = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        table = self.plain.decompress(self._bytes(int(at[-2]) + 8, int(entries[-1, 0]) - 8))
        n = struct.unpack("<Q", table[:8])[0]
        self.keys = np.frombuffer(table, "<i8", n, 8)
        self.counts = np.frombuffer(table, "<i8", n, 8 + 8 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.entries, self.at = entries[:-1], at[:-1]
        self.token_at = np.concatenate([[0], np.cumsum(self.entries[:, 1])]) // 4
        self.frames_read = 0
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            data = self.plain.decompress(self._bytes(int(self.at[k]), int(self.entries[k, 0])),
                                         max_output_size=int(self.entries[k, 1]))
            if len(data) != self.entries[k, 1] or _checksum(data) != self.entries[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._last = (k, np.frombuffer(data, "<u4"))
        return self._last[1]

    def pieces(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the document in ``row`` of the table, frame by frame."""
        begin, end = int(self.starts[row]), int(self.starts[row + 1])
        k = int(np.searchsorted(self.token_at, begin, "right")) - 1
        while begin < end:
            upto = min(end, int(self.token_at[k + 1]))
            if upto > begin:
                yield self.frame(k)[begin - int(self.token_at[k]):upto - int(self.token_at[k])]
            begin, k = max(begin, upto), k + 1

    def ids(self, row: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.pieces(row)])

    def rows(self, keys: Iterable[int]) -> list[int]:
        """Table rows of the wanted keys."""
        return np.flatnonzero(np.isin(self.keys, np.array(list(keys), np.int64))).tolist()

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, encoder: Callable, end_id: int):
    def run(batches):
        open_file, bucket, at = None, None, 0
        encode = encoder()
        try:
            for batch in batches:
                buckets = batch.column(0).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo == hi:
                        continue
                    if buckets[lo] != bucket:
                        if open_file is not None:
                            open_file.close()
                        bucket, at = buckets[lo], 0
                        open_file = TokenFileWriter(folder, f"part-{bucket:08d}.tok.zst")
                    keys = batch.column(1).slice(lo, hi - lo).to_pylist()
                    ids, ends = encode(batch.column(2).slice(lo, hi - lo))
                    ids = np.insert(ids, ends[1:], np.uint32(end_id))
                    ends = ends + np.arange(len(ends))
                    open_file.add(keys, ids, ends)
                    counts = np.diff(ends)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"part-{bucket:08d}.tok.zst"] * len(keys)), pa.array(keys, pa.int64()),
                        pa.array(at + ends[:-1], pa.int64()), pa.array(counts, pa.int64())],
                        names=["file", "key", "file_start", "n_tokens"])
                    at += int(ends[-1])
            if open_file is not None:
                open_file.close()
                open_file = None
        finally:
            if open_file is not None:
                open_file.abandon()
    return run


def _limited(run, limit: int):
    """Batches cut so that their texts hold about ``limit`` bytes."""
    def cut(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes, dtype=np.int64)
            row = 0
            while row < len(upto):
                stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + limit, "right")))
                yield batch.slice(row, stop - row)
                row = stop
    return lambda batches: run(cut(batches))


def write_token_files(spark: SparkSession, df: DataFrame, folder: str, encoder: Callable, end_id: int,
                      key: Column, text: Column, docs_per_file: int = 5_000) -> DataFrame:
    """Encode every whole text of ``df`` with ``encoder()(texts) -> (ids, offsets)``, append ``end_id``
    and write the files below ``folder``. Returns the stored index: file, key, file_start (tokens
    before it in its file), n_tokens. Files in name order hold ascending keys; null keys come
    first and are written as -1, null texts as no ids but the end. Equal keys share a file, in
    no given order. An empty table writes no file."""
    rows = df.select(F.coalesce(key.cast("long"), F.lit(-1)).alias("key"), text.alias("text"))
    files = max(1, math.ceil(df.count() / docs_per_file))
    dealt = (rows.repartitionByRange(files, "key").sortWithinPartitions("key")
             .select(F.spark_partition_id().alias("bucket"), "key", "text"))
    index = dealt.mapInArrow(_limited(_writer(folder, encoder, end_id), 4 << 20), TABLE)
    path = f"{folder}/index.parquet"
    index.write.parquet(path)
    return spark.read.parquet(path)


def _reader(folder: str, digest: Callable[[Iterator[np.ndarray]], dict], fields: list[str], schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for name, before, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                f = TokenFile(folder, name)
                rows = range(len(f.keys)) if wanted is None else f.rows(wanted)
                for lo in range(0, len(rows), 1000):
                    part = list(rows[lo:lo + 1000])
                    out = [digest(f.pieces(r)) for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(f.keys[part], pa.int64()),
                         pa.array(before + f.starts[part], pa.int64()), pa.array(f.counts[part], pa.int64()),
                         *[pa.array([o[c] for o in out], schema.field(c).type) for c in fields]], schema=schema)
                f.close()
    return run


def read_token_files(spark: SparkSession, folder: str, digest: Callable, extra: str, wanted: DataFrame | None = None) -> DataFrame:
    """Documents read back from the files: file, key, start (ids of all documents before it), n_tokens
    and what ``digest`` makes of the frame pieces of a document (a dict with the columns of the
    DDL string ``extra``). ``wanted`` (column key) names documents; only files and frames that
    hold one are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    index = spark.read.parquet(f"{folder}/index.parquet")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a file
    jobs = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    if wanted is None:
        jobs = jobs.withColumn("wanted", F.lit(None).cast("array<long>"))
    else:
        held = index.join(wanted.select("key").distinct(), "key", "left_semi")
        # at most a file's documents
        jobs = jobs.join(held.groupBy("file").agg(F.collect_list("key").alias("wanted")), "file")
    schema = StructType.fromDDL(f"file string, key long, start long, n_tokens long, {extra}")
    fields = StructType.fromDDL(extra).names
    # a file is one job: deal them evenly
    jobs = jobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return jobs.mapInArrow(_reader(folder, digest, fields, to_arrow_schema(schema)), schema)


def crc32(pieces: Iterator[np.ndarray]) -> dict:
    value = 0
    for p in pieces:
        value = zlib.crc32(p.tobytes(), value)
    return {"ids_crc32": value}


def ids(pieces: Iterator[np.ndarray]) -> dict:
    return {"ids": [i for p in pieces for i in p.tolist()]}
