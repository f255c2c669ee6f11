"""Token-id files: independent zstandard frames, one per document, with per-frame checksums and a trailing seek table.

A file is, in this order:

* for each document one zstandard frame (content size and content checksum on) of its ids, little-endian, 2 bytes an
  id where all ids are below 65,536, else 4;
* a skippable frame (magic 0x184D2A50): ``PTOK``, a version byte, the bytes an id takes, two zero bytes, the number of
  documents (u64), then per document doc_id (i64) and its null flag (u8) in arrays;
* the seek table of the public seekable zstandard format: a skippable frame (magic 0x184D2A5E) with per frame
  compressed size, decompressed size and the low 32 bits of the content's XXH64, then the number of frames, a descriptor
  with the checksum flag, and the magic 0x8F92EAB1. A document has at most 2**32 - 1 bytes of ids.

Any reader of that format can read the files. :class:`TokenFile` reads the two tables from the file's end and
decompresses only the frames asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import discard, documents, map_rows, new_dir, only, text_batches, written

#: Bytes of text for a file, each document counting ``ROW_BYTES`` more, so that no file has too many small ones.
FILE_BYTES, ROW_BYTES = 128 << 20, 64
#: Parts of a file that long documents count by, see :func:`plan_files`, and files of one block of running sums.
FINE, FILE_BLOCK = 256, 4096

_SKIP, _TABLE, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def _fs(uri: str):
    """A file system of pyarrow and the path in it, for a local, shared or remote folder."""
    from pyarrow import fs

    u = urlparse(uri)
    return (fs.LocalFileSystem(), u.path) if u.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def frame(ids: bytes, width: int, level: int = 3) -> bytes:
    """One frame of ids that are given as unsigned 32-bit integers."""
    raw = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress(raw)


def file_tail(doc_ids: list[int | None], comp: list[int], raw: list[int], sums: list[int], width: int) -> bytes:
    """The document index and the seek table."""
    index = struct.pack("<4sBBHQ", b"PTOK", 1, width, 0, len(doc_ids))
    index += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    table = np.array([comp, raw, sums], "<u4").T.tobytes() + struct.pack("<IBI", len(comp), 0x80, _FOOT)
    return struct.pack("<II", _SKIP, len(index)) + index + struct.pack("<II", _TABLE, len(table)) + table


class TokenFile:
    """Random access to one file's documents; each frame's checksum is verified when it is read."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.f = fs.open_input_file(path)
        end = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _FOOT or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        start = end - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(start, 8)) != (_TABLE, 12 * n + 9):
            raise ValueError(f"{uri}: broken seek table")
        table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.comp, self.raw, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.comp)])
        head = int(self.at[-1])
        magic, size = struct.unpack("<II", self._at(head, 8))
        index = self._at(head + 8, size)
        name, _, self.width, _, docs = struct.unpack("<4sBBHQ", index[:16])
        if magic != _SKIP or name != b"PTOK" or docs != n:
            raise ValueError(f"{uri}: broken document index")
        ids = np.frombuffer(index[16 : 16 + 8 * n], "<i8")
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, index[16 + 8 * n :])]

    def _at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its frame alone."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.comp[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def encode_frames(docs: DataFrame, path: str, eos: int | None, width: int, files: "Files") -> DataFrame:
    """doc_id, number of ids, raw bytes, checksum, compressed frame and file number of each document; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(b: pa.RecordBatch) -> dict:
        enc, tail = encoder(path), b"" if eos is None else struct.pack("<I", eos)
        place = shared.value.of(b.column("place").to_numpy(), b.column("h").to_numpy())
        out: dict[str, list] = {"doc_id": b.column("doc_id"), "n": [], "raw": [], "sum": [], "frame": [], "range": place.tolist()}
        for ids in enc.encode([t or "" for t in b.column("text").to_pylist()]):
            ids += tail
            raw = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids
            out["n"].append(len(ids) // 4)
            out["raw"].append(len(raw))
            out["sum"].append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            out["frame"].append(frame(ids, width))
        return out

    given = docs.select("doc_id", "text", _place().alias("place"), F.xxhash64("text").alias("h"))
    return map_rows(given, run, "doc_id long, n long, raw long, sum long, frame binary, range int", keeps_cache=True)


def _place():
    """Where a document stands in the order of the files: null ids first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


@dataclass
class Files:
    """Which file a document goes to: ``edges`` (ascending, an id more than once where its rows fill several files) cut
    the order of ids, and rows of such an id are dealt out over its files by a hash of their text."""

    edges: np.ndarray

    def of(self, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.edges, place, "left"), np.searchsorted(self.edges, place, "right")
        return np.where(hi > lo, lo + 1 + h % np.maximum(hi - lo, 1), hi)


def plan_files(docs: DataFrame, file_bytes: int = FILE_BYTES, files: int | None = None) -> Files:
    """Files of about ``file_bytes`` of text each, or at most ``files`` of about the same size.

    The edges are quantiles of doc_id, weighted by bytes, from a mergeable sketch: a row stands in it once for every
    ``1 / FINE`` of a file that it fills, rounded at random. What reaches the driver is a number for each file.
    """
    sizes = written(docs.select(_place().alias("place"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("n")), "token-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_files = files or max(1, -(-total // file_bytes))
    part = max(1, total // (n_files * FINE))
    each = sizes.select(F.col("place").cast("double").alias("x"), F.floor(F.col("n") / part + F.rand(5)).cast("int").alias("times")).where("times > 0")
    each = each.select("x", F.explode(F.sequence(F.lit(1), F.col("times"))))
    got = each.approxQuantile("x", [i / n_files for i in range(1, n_files)], 0.1 / n_files) if total and n_files > 1 else []
    discard(sizes)
    return Files(np.sort(np.clip(np.array(got, np.float64), -(2.0**63), 2.0**63 - 1024).astype(np.int64)))


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str | None = None, eos: int | None = 2, files: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to files in ascending doc_id order; returns one row per file.

    The number of files follows the text (``file_bytes`` each, see :func:`plan_files`), or is at most ``files``.
    Documents are encoded and compressed where they are read, and the small frames, not texts, are dealt out by ranges
    of doc_id. A range's file is written below a name of its own and renamed when whole, so a task that runs again, after
    a lost executor, replaces it. Null doc_ids come first; rows with one doc_id follow one another in an order that
    follows from their content, also over several files. Rows that are equal in both are in one file. Very long texts are
    one frame of up to 2**32 - 1 bytes. Other columns are ignored. No rows: no files.

    Columns: part, file, n_docs, n_tokens.
    """
    path = tokenizer or tokenizer_path()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), (eos or 0) + 1) <= 1 << 16 else 4
    docs = only(docs, "doc_id", "text")
    plan = plan_files(docs, file_bytes, files)
    frames = encode_frames(docs, path, eos, width, plan)
    dealt = frames.repartition(len(plan.edges) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "n", "sum", "raw")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(out_dir)
        part, sink = None, None

        def end() -> pa.RecordBatch:
            sink.write(file_tail(doc_ids, comp, raw, sums, width))
            sink.close()
            name = f"tokens-{part:06d}.zst"
            fs.move(tmp, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([f"{out_dir}/{name}"]), "n_docs": pa.array([len(comp)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

        for b in batches:
            ranges = b.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if part != ranges[i]:
                    if sink is not None:
                        yield end()
                    part, doc_ids, comp, raw, sums, tokens = int(ranges[i]), [], [], [], [], 0
                    fs.create_dir(folder, recursive=True)
                    tmp = f"{folder}/.{part:06d}-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(tmp)
                s = b.slice(i, j - i)
                for f in s.column("frame"):
                    comp.append(len(f.as_buffer()))
                    sink.write(f.as_buffer())
                doc_ids += s.column("doc_id").to_pylist()
                raw += s.column("raw").to_pylist()
                sums += s.column("sum").to_pylist()
                tokens += sum(s.column("n").to_pylist())
        if sink is not None:
            yield end()

    return dealt.mapInArrow(write, "part int, file string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of the files that :func:`write_token_files` lists: doc_id, start, n_tokens, ids_crc32, with one task per file.

    ``start`` counts the ids of all documents before, over all files: sums within blocks of files, then over the blocks'
    totals. No files give no rows.
    """
    text_batches(files.sparkSession)
    f = files.select("part", "file", "n_tokens", F.floor(F.col("part") / FILE_BLOCK).alias("block"))
    blocks = f.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = f.join(blocks, "block").select("part", "file", (F.col("before") + own).alias("at")).repartition(max(1, files.count()), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column("file").to_pylist(), b.column("at").to_pylist()):
                f = TokenFile(file)
                for k in range(0, len(f), 4096):
                    out: list[list] = [f.doc_ids[k : k + 4096], [], [], []]
                    for j in range(k, min(k + 4096, len(f))):
                        ids = f.ids(j)
                        out[1].append(at)
                        out[2].append(len(ids))
                        out[3].append(zlib.crc32(ids.tobytes()))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the files, and read each document back from them."""
    out = new_dir(spark, "token-files")
    docs = documents(spark, sf_dir)
    return read_token_files(written(write_token_files(docs, out), "token-file-list"))
