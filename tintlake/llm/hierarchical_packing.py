"""Operator 12: as few sequences as possible, by best fit in a tree.

Each task tokenises its documents, cuts those longer than a sequence, and packs what it holds by best fit, longest first.
Bins that are nearly full leave as sequences. The others go on as items of a fixed length, from the leaves of a tree
towards its root: the bins that some nodes left are packed by best fit again, bins whole, until one node is left.

What goes up is bounded. Of two bins that are at most half full best fit would have made one, so a node leaves at most one;
any later merge needs such a small bin, and a parent gets at most one from each child. It can use no more than the
``fan_in`` emptiest of the others of each child: whatever it would put into a fuller bin goes into one of those. So nodes
pass ``fan_in`` + 1 bins at most and no merge is lost by it. Texts and ids never move but for those few bins.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, scratch, small_batches, tidy
from .packing import best_fit_decreasing

CAPACITY = 4096
#: Ends each document.
END = 1
FAN_IN = 16
#: Bins with less room than this share of a sequence leave at once.
NEARLY = 1 / 128
#: A task packs what it holds when it has so many bytes of ids; bins that it left then are items of the next time.
WINDOW = 32 << 20
#: Pieces of words, and chunks between white space, whose ids a worker remembers: so many new ones, and as many old ones.
REMEMBERED = 1 << 19

# What the tokenizer does with printable ASCII and Latin-1 letters, said anew for speed: fixed values of its file.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

_SEGMENT = "doc_id: long, doc_row: long, piece: int, start: long, length: long"
#: input_ids: little-endian unsigned, id_bytes each; the segments follow one another in it.
SEQUENCES = f"sequence_id long, segments array<struct<{_SEGMENT}>>, id_bytes int, input_ids binary"
_LEAVES = SEQUENCES + ", node long, length int, residual boolean"
_SEGMENTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc_row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_row long"
_MERGED = "item long, into long, at long, length int, node long, open boolean"


def vocabulary() -> str:
    """The place of the default tokenizer's file; it is read on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others in order from
    U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids of texts by a tokenizer that drops white space and never looks across it.

    Chunks between ASCII white space are tokenised once and looked up. Those of printable ASCII and Latin-1 letters are
    cut into pieces here, and only a new piece goes to the tokenizer's model; all others go through the whole tokenizer.
    Either way a text's ids are the tokenizer's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old_pieces.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                ids = array(self.code, [x.id for x in self.model.tokenize(shown)]).tobytes()
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        word = _WORD.fullmatch(chunk)  # most chunks are a word, or one with a mark after it
        if word:
            own, mark = word.groups()
            return self._piece(own.lower()) + self._piece(mark) if mark else self._piece(own.lower())
        if not _PLAIN.fullmatch(chunk) or "<|" in chunk:  # that may begin a special token
            return array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._piece, _PIECES.findall(chunk.lower())))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        if len(self.pieces) > REMEMBERED:
            self.pieces, self.old_pieces = {}, self.pieces
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.get, chunks))
        for i, ids in enumerate(each):
            if ids is None:
                c = chunks[i]
                each[i] = self.known[c] = self.old.get(c) or self._chunk(c)
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
        pool, first = np.frombuffer(b"".join(each), self.kind), np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        after = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(first[codes] - after[:-1], n) + np.arange(after[-1])]
        bounds = after[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def split_open(fills: list[int], capacity: int, fan_in: int) -> list[bool]:
    """Which bins of a packed node go up: the one that is at most half full, and the ``fan_in`` emptiest others that
    aren't nearly full."""
    room = [i for i, n in enumerate(fills) if capacity - n > capacity * NEARLY]
    small = [i for i in room if 2 * fills[i] <= capacity]
    rest = sorted((i for i in room if 2 * fills[i] > capacity), key=lambda i: fills[i])[:fan_in]
    up = {*small, *rest}
    return [i in up for i in range(len(fills))]


def _leaves(path: str, capacity: int, fan_in: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, node = encoder(path), TaskContext.get().partitionId()
        number, bin_id, held, n_bytes = node << 40, node << 33, [], 0  # held: items, each a list of parts
        kind, end = encode.kind, np.array([END], encode.kind)
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, segments, contents, residual = zip(*rows) if rows else ((),) * 4
            out = [pa.array(ids, pa.int64()), pa.array(segments, _SEGMENTS), pa.array([kind.itemsize] * len(ids), pa.int32()), pa.array(contents, pa.binary())]
            out += [pa.array([node] * len(ids), pa.int64()), pa.array([len(c) // kind.itemsize for c in contents], pa.int32()), pa.array(residual, pa.bool_())]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["sequence_id", "segments", "id_bytes", "input_ids", "node", "length", "residual"])

        def leave(parts: list[tuple], residual: bool) -> Iterator[pa.RecordBatch]:
            nonlocal bin_id
            segments = [dict(doc_id=d, doc_row=r, piece=p, start=s, length=len(x)) for d, r, p, s, x in parts]
            rows.append((bin_id, segments, b"".join(x.tobytes() for *_, x in parts), residual))
            bin_id += 1
            if len(rows) == 256:
                yield block()

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_bytes
            size = [sum(len(p[4]) for p in item) for item in held]
            bins = best_fit_decreasing(size, capacity)
            up = split_open([sum(size[i] for i in b) for b in bins], capacity, fan_in)
            whole = [[p for i in b for p in held[i]] for b in bins]
            held = [] if last else [b for b, u in zip(whole, up) if u]
            n_bytes = sum(p[4].nbytes for item in held for p in item)
            for b, u in zip(whole, up):
                if last or not u:
                    yield from leave(b, u)

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), encode(pc.fill_null(batch.column(1), ""))):
                ids = np.append(ids, end)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = (d, number, piece, at, ids[at : at + capacity].copy())  # a view would keep the whole document
                    if len(part[4]) == capacity:
                        yield from leave([part], False)
                    else:
                        held.append([part])
                        n_bytes += part[4].nbytes
                number += 1
            if n_bytes >= WINDOW:
                yield from packed(False)
            tidy()
        yield from packed(True)
        yield block()

    return run


def _merge(capacity: int, fan_in: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        items, size = group["into"].to_pylist(), group["length"].to_pylist()
        order = sorted(range(len(items)), key=lambda i: items[i])  # the same whatever order rows come in
        items, size = [items[i] for i in order], [size[i] for i in order]
        bins = best_fit_decreasing(size, capacity)
        fills = [sum(size[i] for i in b) for b in bins]
        rows = []
        for b, fill, up in zip(bins, fills, split_open(fills, capacity, fan_in)):
            at = 0
            for i in b:
                rows.append((items[i], items[b[0]], at, fill, group["node"][0].as_py() // fan_in, up))
                at += size[i]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["item", "into", "at", "length", "node", "open"])

    return run


def merge_tree(left: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """Where the bins that leaves left end: bin, sequence_id, at (its place there). ``left``: node, bin, length.

    A round packs the open bins of ``fan_in`` nodes each, at most fan_in * (fan_in + 1) rows a group, and there is a round
    per level of the tree.
    """
    places = left.select(F.col("bin"), F.col("bin").alias("into"), F.lit(0).cast("long").alias("at"))
    state = left.select(F.col("bin").alias("into"), "length", "node")
    nodes = (left.agg(F.max("node").alias("m")).first().m or 0) + 1
    while nodes > 1:
        level = state.groupBy((F.col("node") / fan_in).cast("long").alias("parent")).applyInArrow(_merge(capacity, fan_in), _MERGED)
        level = cut(level, "packing-level")
        moved = level.select("item", F.col("into").alias("to"), F.col("at").alias("by"))
        places = places.join(moved, F.col("into") == F.col("item"), "left")
        places = cut(places.select("bin", F.coalesce("to", "into").alias("into"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("at")), "packing-places")
        state = level.where("open AND at = 0").select("into", "length", "node")
        nodes = -(-nodes // fan_in)
    return places.withColumnRenamed("into", "sequence_id")


def pack_sequences(docs: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed sequences (SEQUENCES) of at most ``capacity`` ids.

    A document is its text's ids and END. One that is longer than a sequence is cut into full pieces and a last one, all
    others stay whole. Null and empty texts are END alone, a null id is kept as null, rows that repeat an id are packed
    each by itself (doc_row tells them apart), an empty table gives no rows, other columns aren't read. Sequence ids and
    what is packed together depend on the layout of the input; what leaves is written, so lost executors don't change it.
    ``path``: a tokenizer's file that is on every executor.
    """
    spark = docs.sparkSession
    with scratch() as keep:
        rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        folder = new_folder(spark, "packing-bins")
        rows.mapInArrow(_leaves(path or vocabulary(), capacity, fan_in), _LEAVES).write.partitionBy("residual").parquet(folder)
        bins = spark.read.schema(_LEAVES).parquet(folder)
        bins.materialised_at = folder
        keep(bins)
        left = bins.where("residual")
        places = keep(cut(merge_tree(left.select("node", F.col("sequence_id").alias("bin"), "length"), capacity, fan_in), "packing-places"))
        left = left.join(places.select("bin", F.col("sequence_id").alias("to"), "at"), F.col("sequence_id") == F.col("bin"))
        merged = left.groupBy(F.col("to").alias("sequence_id")).agg(F.array_sort(F.collect_list(F.struct("at", "segments", "input_ids"))).alias("x"), F.first("id_bytes").alias("id_bytes"))
        joined = F.aggregate(F.col("x.input_ids"), F.lit(b""), lambda a, b: F.concat(a, b))  # at most a sequence in all
        return bins.where("NOT residual").select("sequence_id", "segments", "id_bytes", "input_ids").unionByName(
            merged.select("sequence_id", F.flatten("x.segments").alias("segments"), "id_bytes", joined.alias("input_ids"))
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    names = [c.split()[0] for c in PIECES.split(", ")]
    for b in batches:
        rows = []
        for sequence, segments, width, ids in zip(*(b.column(i) for i in range(4))):
            sequence, ids, at = sequence.as_py(), np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}").astype("<u4"), 0
            for s in segments.as_py():
                rows.append((s["doc_id"], s["piece"], s["start"], s["length"], zlib.crc32(ids[at : at + s["length"]].tobytes()), sequence, at, s["doc_row"]))
                at += s["length"]
            if at != len(ids):
                raise ValueError(f"sequence {sequence} holds {len(ids)} ids, its segments {at}")
        kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        tidy()


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per segment of SEQUENCES (PIECES): where it lies and the crc32 of its ids as unsigned 32-bit numbers, taken
    from the sequences themselves."""
    return sequences.select("sequence_id", "segments", "id_bytes", "input_ids").mapInArrow(_pieces, PIECES)
