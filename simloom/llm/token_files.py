"""Token files: one zstandard frame per document, a trailing seek table and a checksum per frame.

A file is a sequence of independent frames, one for each document in ascending id order (more only for a document whose ids pass
``FRAME_BYTES``), then a skippable frame with the document ids, then the seek table of the public seekable format: a skippable frame with
compressed size, content size and XXH64 checksum of each frame and a fixed footer. A reader fetches the tail of a file, then only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, materialized, new_folder, open_store
from simloom.llm.tokens import word_encoder
from simloom.plans.numbering import running_total

END_ID = 1
FRAME_BYTES = 1 << 28
FILE_BYTES = 64 << 20
# Fixed values of the seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_IDS = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])

MANIFEST = "file string, part int, seq int, n_docs long, n_ids long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def seek_tail(doc_ids: list[int], entries: list[tuple[int, int, int]]) -> bytes:
    """Skippable frames with the frames' document ids and the seek table. A null id is the smallest integer."""
    ids = np.array(doc_ids, "<i8").tobytes()
    body = np.array(entries, ENTRY).tobytes() + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids + struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body


@dataclass
class TokenFile:
    """Reader of one file: the tail first, then any frame by itself."""

    file: object

    def __post_init__(self):
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file with checksums")
        table = end - 9 - n * ENTRY.itemsize
        self.frames = np.frombuffer(self._read(table, n * ENTRY.itemsize), ENTRY)
        self.doc_ids = np.frombuffer(self._read(table - 8 - 8 * n, 8 * n), "<i8")
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["compressed"], dtype=np.int64)])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def content(self, k: int) -> bytes:
        """Ids of frame ``k`` as bytes, checked."""
        import xxhash
        import zstandard

        packed = self._read(int(self.offsets[k]), int(self.frames["compressed"][k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames["content"][k]) or 1)
        if len(raw) != self.frames["content"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["checksum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of one document; only its frames are read and decompressed."""
        low, high = np.searchsorted(self.doc_ids, doc_id, "left"), np.searchsorted(self.doc_ids, doc_id, "right")
        if low == high:
            raise KeyError(doc_id)
        return np.frombuffer(b"".join(self.content(k) for k in range(low, high)), "<u4")


NULL_ID = -(1 << 63)
READERS = 10_000  # most tasks that read files back


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write all texts in ascending id order; the manifest ``file, part, seq, n_docs, n_ids`` (one row per file) is the commit.

    A task writes under a name of its own, so a task that runs twice leaves files that no manifest names and harms nothing. Null texts are empty (the
    end token alone); a null id sorts first and reads back as null. Rows that repeat an id follow each other.
    """
    columns = [F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("body")]
    # Ranges over id and text: the rows of an id that very many texts share spread over parts.
    keyed = docs.select(*columns).withColumn("turn", F.xxhash64("body"))
    ordered = keyed.repartitionByRange("id", "turn").sortWithinPartitions("id", "turn", "body").select("id", "body")

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        import xxhash
        import zstandard

        part, seq = TaskContext.get().partitionId(), 0
        encoder, end = word_encoder(tokenizer), end_id.to_bytes(4, "little")
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out = None

        def close() -> dict:
            out.write(seek_tail(doc_ids, entries))
            out.close()
            return {"file": [name], "part": [part], "seq": [seq], "n_docs": [n_docs], "n_ids": [sum(e[1] for e in entries) // 4]}

        for rows in slices:
            for (doc_id, _), ids in zip(rows, encoder.encode([row[1] for row in rows])):
                if out is None:
                    name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.zst"
                    out, doc_ids, entries, written, n_docs = store.open_output_stream(f"{root}/{name}", compression=None), [], [], 0, 0
                ids += end
                n_docs += 1
                for k in range(0, len(ids), FRAME_BYTES):
                    raw = ids[k : k + FRAME_BYTES]
                    packed = compressor.compress(raw)
                    out.write(packed)
                    doc_ids.append(doc_id)
                    entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    written += len(packed)
                if written >= file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return materialized(map_rows(ordered, work, MANIFEST))


def read_entries(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that the manifest names.

    ``start`` counts the ids of all documents before it. Rows of one repeated id are told apart by their end token.
    """
    based = running_total(manifest, "base", F.col("n_ids"), [F.col("part")], [F.col("seq")], inclusive=False)
    # By a given number, which adaptive execution leaves alone: the manifest is small, what its files hold is not.
    spread = based.select("file", "base", "n_docs").repartition(min(manifest.count(), READERS) or 1, "file")

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        store, root = open_store(folder)
        for rows in slices:
            for name, base, _ in rows:
                with store.open_input_file(f"{root}/{name}") as opened:
                    tokens, start = TokenFile(opened), base
                    size, crc = 0, 0
                    out = {name: [] for name in ("doc_id", "start", "n_tokens", "ids_crc32")}
                    for k, doc_id in enumerate(tokens.doc_ids.tolist()):
                        raw = tokens.content(k)
                        crc, size = zlib.crc32(raw, crc), size + len(raw) // 4
                        more = len(raw) == FRAME_BYTES and k + 1 < len(tokens.doc_ids) and tokens.doc_ids[k + 1] == doc_id
                        if more:
                            continue
                        for column, value in zip(out.values(), (None if doc_id == NULL_ID else doc_id, start, size, crc)):
                            column.append(value)
                        start, size, crc = start + size, 0, 0
                        if len(out["doc_id"]) >= 10_000:
                            yield out
                            out = {name: [] for name in out}
                    yield out

    return map_rows(spread, work, ENTRIES)


def token_entries(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of a table to the shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_entries(write_tokens(docs, folder, tokenizer, id_column, text), folder)
