"""Operator 5: token ids packed into rows of fixed length.

Documents are tokenised and end with a separator. What is longer than a row is cut into full rows and a remainder,
so nothing is lost. Remainders are packed by best fit decreasing: longest first, each into the fullest open row that
still holds it, found by descending a segment tree over the free lengths. A task packs its own documents in windows
of bounded size, so there is no shuffle; only the last row of a window can stay half empty. The same task writes its
rows as binary files; what counts is in a manifest that Spark commits, and rows are read back from it.
"""

from __future__ import annotations

import base64
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, small_batches, tidy

# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends each document; also fills the rest of a row, beyond the last cumulative length.
SEPARATOR = 50256
RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "row_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_rows array<long>, piece_ids array<int>, n_tokens int"
_NAMES = ("row_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_rows", "piece_ids", "n_tokens")
MANIFEST = "name string, rows long, capacity int, blocks array<struct<row: long, rows: int, segment: long>>"
#: Rows that are read at once, and found in a file by the manifest.
BLOCK = 256
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())


def tokenizer_folder() -> str:
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


@functools.cache
def encoding(folder: str):
    import tiktoken

    with open(f"{folder}/{RANKS}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenize(text: str, folder: str) -> np.ndarray:
    """Ids of a whole text. Very long texts go through the tokenizer in parts that end before a space after a letter,
    where the pattern splits in any case."""
    enc, part = encoding(folder), 1 << 20
    if len(text) <= part:
        return np.array(enc.encode_ordinary(text), np.uint16)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + part)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.uint16))
        at = end
    return np.concatenate(out)


class FreeLengths:
    """A segment tree over the lengths 0..most: how many open rows have just so much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room that is at least ``need``, and its room; it isn't open any more."""
        i = need + self.size
        if not self.count[i]:
            # up to the first ancestor whose right neighbour has a row, then down to the leftmost there
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices whose lengths, 1 to capacity each, sum to at most ``capacity``."""
    tree, rows = FreeLengths(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            rows.append([i])
            row, free = len(rows) - 1, capacity
        else:
            row, free = found
            rows[row].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], row)
    return rows


def _row(row_id: int, parts: list[tuple[int | None, int, int, np.ndarray]], capacity: int) -> tuple:
    ids, pos = np.full(capacity, SEPARATOR, "<u2"), np.zeros(capacity, "<u4")
    ends = [0]
    for *_, x in parts:
        ids[ends[-1] : ends[-1] + len(x)] = x
        pos[ends[-1] : ends[-1] + len(x)] = np.arange(len(x))
        ends.append(ends[-1] + len(x))
    return row_id, ids.tobytes(), pos.tobytes(), ends, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], ends[-1]


def _packer(capacity: int, window: int, where: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_id = number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        rows: list[tuple] = []

        def add(members: list[tuple[int | None, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal row_id
            rows.append(_row(row_id, members, capacity))
            row_id += 1
            if len(rows) >= BLOCK:
                yield batch()

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for members in best_fit_decreasing([len(x) for *_, x in held], capacity):
                yield from add([held[i] for i in members])
            held = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], list(_NAMES))
            rows.clear()
            return out

        for given in batches:
            for d, t in zip(given.column(0).to_pylist(), given.column(1)):
                ids = np.append(tokenize(t.as_py() or "", where), np.uint16(SEPARATOR))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = (d, number, piece, ids[at : at + capacity].copy())  # a view would keep the whole document
                    if len(part[3]) == capacity:
                        yield from add([part])
                    else:
                        held.append(part)
                number += 1
                if len(held) >= window:
                    yield from packed()
            tidy()
        yield from packed()
        yield batch()

    return run


def pack(docs: DataFrame, capacity: int = 2048, window: int = 4096, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``capacity`` token ids (SCHEMA): a row of the id matrix as little-endian uint16, position ids that
    restart with each segment as uint32, cumulative segment lengths from 0, and each segment's document, the number of
    its row of ``docs``, and piece.

    A document's segments, in order of piece, are its text's ids and a separator. Null and empty texts are a
    separator alone; a null id is kept as null; rows that repeat an id are packed each by itself, and told apart by
    doc_rows. ``window`` bounds the remainders that a task holds. An empty table gives no rows. Other columns aren't
    read. The ids of rows differ with the layout of the input, not with a task's retries.
    """
    return small_batches(docs).select(doc_id, text).mapInArrow(_packer(capacity, window, folder or tokenizer_folder()), SCHEMA)


def _streams(capacity: int) -> dict[str, str]:
    """The files of a part and their numbers: id matrix, position ids, cumulative lengths one row after another and
    their counts, row ids, and each segment's document (and whether it has an id), row number and piece."""
    return {"ids": "<u2", "pos": "<u2" if capacity <= 1 << 16 else "<u4", "cu": "<i4", "cun": "<i4", "row": "<i8", "doc": "<i8", "has": "<u1", "num": "<i8", "piece": "<i4"}


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name, n, segments, capacity, blocks = f"part-{uuid.uuid4().hex}", 0, 0, 0, []
        out = {k: files.open_output_stream(f"{path}/{name}.{k}", compression=None) for k in _streams(0)}
        for b in batches:
            for row_id, ids, pos, cu, docs, numbers, pieces, _ in zip(*[b.column(k) for k in _NAMES]):
                ids, ends, docs = np.frombuffer(ids.as_buffer(), "<u2"), cu.as_py(), docs.as_py()
                capacity = len(ids)
                if n % BLOCK == 0:
                    blocks.append({"row": n, "rows": 0, "segment": segments})
                values = {"ids": ids, "pos": np.frombuffer(pos.as_buffer(), "<u4"), "cu": ends, "cun": [len(ends)], "row": [row_id.as_py()], "doc": [d or 0 for d in docs], "has": [d is not None for d in docs], "num": numbers.as_py(), "piece": pieces.as_py()}
                for k, kind in _streams(capacity).items():
                    out[k].write(np.asarray(values[k]).astype(kind).tobytes())
                n, segments, blocks[-1]["rows"] = n + 1, segments + len(docs), blocks[-1]["rows"] + 1
        for x in out.values():
            x.close()
        block = pa.list_(pa.struct([("row", pa.int64()), ("rows", pa.int32()), ("segment", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([capacity], pa.int32()), pa.array([blocks], block)], ["name", "rows", "capacity", "blocks"])

    return run


def write_files(packed: DataFrame, folder: str) -> DataFrame:
    """Writes packed rows, all of one capacity, as binary files, per task an id matrix (.ids, uint16), position ids
    (.pos, uint16, or uint32 where the capacity is over 65,536), as the rows' cumulative lengths one after another
    (.cu, int32) with their counts (.cun, int32), and the rows' and segments' ids (.row, .doc, .has, .num, .piece); the
    MANIFEST of the files that count. Names are new for each attempt, so a lost task leaves nothing that counts."""
    return cut(packed.select(*_NAMES).mapInArrow(_writer(folder), MANIFEST), "packed-files")


def pack_files(docs: DataFrame, folder: str, capacity: int = 2048, window: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``write_files`` of what ``pack`` gives, by one worker a task, so that rows don't go through Spark."""
    packer, writer = _packer(capacity, window, tokenizer_folder()), _writer(folder)
    return cut(small_batches(docs).select(doc_id, text).mapInArrow(lambda batches: writer(packer(batches)), MANIFEST), "packed-files")


def read_files(manifest: DataFrame) -> DataFrame:
    """The packed rows (SCHEMA) of the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, capacity, row, n, segment in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                files, path = fs.FileSystem.from_uri(name)
                kinds = _streams(capacity)

                def read(k: str, at: int, count: int) -> np.ndarray:
                    size = np.dtype(kinds[k]).itemsize
                    with files.open_input_file(f"{path}.{k}") as f:
                        got = f.read_at(count * size, at * size)
                    if len(got) != count * size:
                        raise OSError(f"{path}.{k} is shorter than its manifest says")
                    return np.frombuffer(got, kinds[k])

                ids, pos = read("ids", row * capacity, n * capacity).tobytes(), read("pos", row * capacity, n * capacity).astype("<u4").tobytes()
                sizes = read("cun", row, n).astype(np.int64)
                total = int(sizes.sum())
                cu, parts = read("cu", segment + row, total), total - n
                at, own = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(sizes - 1))
                doc = pa.array(read("doc", segment, parts), mask=read("has", segment, parts) == 0)
                whole = lambda x, wide: pa.array([x[i * capacity * wide : (i + 1) * capacity * wide] for i in range(n)], pa.binary())  # noqa: B023, E731
                lists = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
                columns = [pa.array(read("row", row, n)), whole(ids, 2), whole(pos, 4), lists(at, pa.array(cu)), lists(own, doc), lists(own, pa.array(read("num", segment, parts))), lists(own, pa.array(read("piece", segment, parts))), pa.array(cu[at[1:] - 1])]
                yield pa.RecordBatch.from_arrays(columns, list(_NAMES))
                tidy()

    blocks = manifest.select("name", "capacity", F.explode("blocks").alias("b")).select("name", "capacity", "b.row", "b.rows", "b.segment")
    n = manifest.agg(F.sum(F.size("blocks")).alias("n")).first().n or 1
    # a task for each few blocks: rows of the manifest are tiny, so Spark must not put them together by their size
    return blocks.repartition(int(min(-(-n // 4), 50_000)), "name", "row").mapInArrow(run, SCHEMA)


def round_trip(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """The packed rows of the documents, written to the shared folder and read back through the manifest."""
    return read_files(pack_files(docs, new_folder(docs.sparkSession, "packed"), capacity))
