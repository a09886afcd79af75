"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each holding whole documents' ids (little-endian
unsigned 32-bit), then two skippable frames: a document index (ids and lengths, compressed, with a
crc32), and the public seekable-format table: for each frame its compressed size, decompressed size
and the low 32 bits of the xxh64 of its content, then the count, a descriptor byte and a magic
number. A reader takes the tail of the file, finds a document's frame and decompresses that alone.

Files are written under another name and renamed when whole, one for each partition, so a task that
runs again replaces its own file with an equal one.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import lean, new_path, spool
from pitlane.llm.tokens import coder, text_batches

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKED = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
_NO_ID = -(1 << 63)


def filesystem(uri: str):
    """(pyarrow file system, path) of a Hadoop-style uri."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents' ids to one file."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.ids, self.sizes, self.held, self.held_bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            frame = self.press.compress(data)
            self.out.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        import numpy as np

        self.flush()
        raw = np.array(self.ids, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes()
        index = struct.pack("<QI", len(self.ids), zlib.crc32(raw)) + self.press.compress(raw)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKED, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads a file of FrameWriter; a checksum that doesn't hold raises ValueError."""

    def __init__(self, file):
        import numpy as np
        import zstandard

        self.file, self.plain = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or kind != CHECKED:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        head = int(self.starts[-1])
        index = self._at(head + 8, table - 8 - head - 8)
        docs, crc = struct.unpack("<QI", index[:12])
        raw = self.plain.decompress(index[12:], max_output_size=12 * docs) if docs else b""
        if zlib.crc32(raw) != crc:
            raise ValueError("the document index doesn't match its checksum")
        self.ids, self.sizes = np.frombuffer(raw[: 8 * docs], "<i8"), np.frombuffer(raw[8 * docs :], "<u4").astype("i8")
        self.doc_starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.frame_starts = np.concatenate([[0], np.cumsum(self.frames[:, 1]) // 4])

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def frame(self, k: int) -> bytes:
        import xxhash

        data = self.plain.decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def document(self, i: int) -> bytes:
        """Ids of the file's i-th document; only its frame is decompressed."""
        import numpy as np

        if not self.sizes[i]:
            return b""
        k = int(np.searchsorted(self.frame_starts, self.doc_starts[i], side="right") - 1)
        at = 4 * int(self.doc_starts[i] - self.frame_starts[k])
        return self.frame(k)[at : at + 4 * int(self.sizes[i])]

    def documents(self):
        """(doc id, start in the file, ids) of every document in order; one frame in memory."""
        i = 0
        for k in range(len(self.frames)):
            data, first = self.frame(k), self.frame_starts[k]
            while i < len(self.ids) and self.doc_starts[i] < self.frame_starts[k + 1]:
                at = 4 * int(self.doc_starts[i] - first)
                yield (None if self.ids[i] == _NO_ID else int(self.ids[i])), int(self.doc_starts[i]), data[at : at + 4 * int(self.sizes[i])]
                i += 1


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        store, root = filesystem(folder)
        final, temporary = f"{root}/part-{part:06d}.zst", f"{root}/.{uuid.uuid4().hex}.tmp"
        model, writer, out = coder(tokenizer, True), None, None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_batches(batch):
                if writer is None:
                    out = store.open_output_stream(temporary)
                    writer = FrameWriter(out)
                tokens, at = model.encode_column(texts)
                data = memoryview(np.insert(tokens, at[1:], end_id).tobytes())
                at = (4 * (at + np.arange(len(at)))).tolist()
                for i in range(len(texts)):
                    writer.add(ids[first + i], data[at[i] : at[i + 1]])
        if writer is not None:
            writer.close()
            out.close()
            store.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}.zst"], "docs": [len(writer.ids)], "tokens": [sum(writer.sizes)]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, file_bytes: int = 128 << 20) -> tuple[str, DataFrame]:
    """Write docs' ids in ascending doc_id order (nulls first, ties by text): (folder, manifest of part, file, docs, tokens)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    folder = new_path(spark, "tokens")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return folder, spool(ordered.mapInArrow(lean(_write(folder, tokenizer, end_id)), "part int, file string, docs long, tokens long"), "manifest")


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        store, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    out: tuple[list, ...] = ([], [], [], [])
                    for doc_id, start, ids in FrameReader(f).documents():
                        for c, v in zip(out, (doc_id, row["base"] + start, len(ids) // 4, zlib.crc32(ids))):
                            c.append(v)
                        if len(out[0]) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files. The driver sees one row a file."""
    spark, base, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():
        rows.append((r["file"], base))
        base += r["tokens"]
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(lean(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_seekable_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(*write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
