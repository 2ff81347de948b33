"""Token ids in fixed-width bit-packed files.

Every id takes ``width`` bits, the fewest that hold the vocabulary, so id k of a block starts at bit
k * width and any range is unpacked with numpy alone. Documents are range-partitioned and sorted by
``doc_id``; each task encodes its texts and writes blocks of whole documents, and the files in name order
hold the documents in ascending order.

File: blocks, each followed by one line feed. Block (little-endian):
``b"TKPK"``, width u8, 3 zero bytes, documents u32, 4 zero bytes, ids u64, payload bytes u64, then
for each document: known u8 (0 if its id is null), doc_id i64, end u64 (ids of the block up to its end),
as three arrays; then the payload.

Texts are encoded by the tokenizers library. Its byte-level rules cut a text into pieces that are encoded
apart, so the ids of a piece are kept in a bounded table (by a 64-bit hash) and the library is asked once per piece; texts
that hold special tokens, apostrophes, control characters or other than Latin letters go to the library whole.

Defined cases: null text is empty, and each document has its end id; null ids come first; equal ids are
ordered by text; other columns are ignored; an empty table writes no blocks and gives no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm import words as W
from relevo.session import bounded_batches, checkpoint_dir, materialize

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids after which a block is closed, blocks in a file, and characters of text in a range of ids.
BLOCK_IDS = 1 << 18
BLOCKS_PER_FILE = 32
RANGE_CHARS = 24_000_000
#: Pieces whose ids a task keeps; the table is emptied when it is full.
KNOWN_PIECES = 1_000_000
HEAD = struct.Struct("<4sB3xI4xQQ")
MAGIC = b"TKPK"

#: Texts that the numpy cut leaves to the library: apostrophes (contractions have pieces of their own), control characters,
#: and characters other than ASCII and the Latin letters below U+0250.
_RARE = re.compile("['\x00-\x08\x0e-\x1f\x80-\xbf\xd7\xf7\u0250-\U0010ffff]")

# Classes of bytes in the remaining texts. Bytes from 0x80 on belong to letters there.
_SPACE, _BLANK, _LETTER, _DIGIT, _SIGN = range(5)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_CLASS[0x20] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER


def cut(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """The pieces that byte-level BPE encodes apart: runs of letters, digits or signs, each with one space before it;
    of white space before them all but the last character, and that last one if it isn't a space."""
    n = len(data)
    kind = _CLASS[data]
    blank = kind <= _BLANK
    new = np.zeros(n + 1, dtype=bool)  # a document begins here
    new[offsets] = True
    before = np.full(n, 255, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[new[:-1]] = 255
    after_blank = (before == _SPACE) | (before == _BLANK)
    last_blank = blank.copy()  # the next character is in the same document and not blank
    last_blank[:-1] &= ~blank[1:]
    last_blank &= ~new[1:]
    if n:
        last_blank[-1] = False
    start = np.where(blank, ~after_blank | last_blank, (before != kind) & (before != _SPACE))
    starts = np.flatnonzero(start)
    return W.Words(data, starts, np.append(starts[1:], n)[:len(starts)], np.searchsorted(starts, offsets))


class PieceTable:
    """Ids of pieces by the hash of the piece: open addressing in numpy arrays, looked up for many pieces at once."""

    def __init__(self, slots: int = 1 << 21):
        self.mask = np.uint64(slots - 1)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.row = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)
        self.flat = np.empty(0, dtype="<u4")

    def __len__(self) -> int:
        return len(self.first) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 if it isn't there."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            row = self.row[slot]
            hit = (row >= 0) & (self.key[slot] == h[todo])
            out[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit  # another piece sits here: look at the next slot
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        """New pieces (distinct, not in the table) and their ids."""
        rows = len(self) + np.arange(len(h))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(i) for i in ids])])
        self.flat = np.concatenate([self.flat, *ids])
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            free = np.flatnonzero(self.row[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)  # one piece a slot
            won = free[one]
            self.row[slot[won]], self.key[slot[won]] = rows[todo[won]], h[todo[won]]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, slot = todo[rest], slot[rest]
            taken = self.row[slot] >= 0
            slot = np.where(taken, (slot + np.uint64(1)) & self.mask, slot)


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: Widths of whole bytes: their bits are those of numpy's little-endian integers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in _WHOLE and (width == 32 or not len(ids) or int(ids.max()) >> width == 0):
        return ids.astype(_WHOLE[width]).tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    if bits[:, width:].any():
        raise ValueError(f"an id needs more than {width} bits")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(payload, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop-1 of a packed payload."""
    if width in _WHOLE:
        return np.frombuffer(payload, dtype=_WHOLE[width], count=stop - start, offset=start * width // 8).astype("<u4")
    first, last = start * width // 8, (stop * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, count=last - first, offset=first), bitorder="little")
    bits = bits[start * width - 8 * first:][:(stop - start) * width].reshape(-1, width)
    full = np.zeros((len(bits), 32), dtype=np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class Encoder:
    """Ids of texts. Pieces that were met before come from a table; new ones go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.table = PieceTable()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        """Words go to the library many at once: joined so that each is a piece of its own again."""
        out: list = [None] * len(pieces)
        spaced = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        bare = [i for i, p in enumerate(pieces) if p.isalpha()]
        for words, sep in ((spaced, ""), (bare, "\n")):
            step = 1 + len(sep)  # the line feeds are pieces too
            for a in range(0, len(words), 500):
                some = words[a:a + 500]
                enc = self.lib.encode(sep.join([pieces[i] for i in some]), add_special_tokens=False)
                ids, piece = np.array(enc.ids, dtype="<u4"), np.array(enc.word_ids)
                at = np.arange(0, step * len(some), step)
                for i, x, y in zip(some, np.searchsorted(piece, at).tolist(), np.searchsorted(piece, at, side="right").tolist(), strict=True):
                    out[i] = ids[x:y]
        return [self.whole(p) if o is None else o for p, o in zip(pieces, out, strict=True)]

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start."""
        texts = col.to_pylist()
        odd = {i: self.whole(t) for i, t in enumerate(texts) if _RARE.search(t) or any(s in t for s in self.special)}
        if odd:
            col = pc.if_else(pa.array([i in odd for i in range(len(texts))]), "", col)
        data, offsets = W.text_bytes(col)
        own = cut(data, offsets)
        h = own.hashes(1)
        row = self.table.find(h)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            new, one = np.unique(h[lost], return_index=True)
            if len(self.table) + len(new) > KNOWN_PIECES:
                self.table.clear()
                new, one = np.unique(h, return_index=True)
                lost = np.arange(len(h))
            at = lost[one]
            raw = data.tobytes()
            self.table.add(new, self._learn([raw[a:b].decode() for a, b in zip(own.starts[at].tolist(), own.ends[at].tolist(), strict=True)]))
            row[lost] = self.table.find(h[lost])
        n = self.table.first[row + 1] - self.table.first[row]
        total = int(n.sum())
        ids = self.table.flat[np.arange(total) + np.repeat(self.table.first[row] - (np.cumsum(n) - n), n)]
        first = np.concatenate([[0], np.cumsum(n)])[own.first]
        if odd:
            parts = [odd[i] if i in odd else ids[first[i]:first[i + 1]] for i in range(len(texts))]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def block(doc_ids: list, ids: list[np.ndarray], width: int) -> bytes:
    """One block of the file format."""
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    number = np.array([d or 0 for d in doc_ids], dtype="<i8")
    end = np.cumsum([len(x) for x in ids]).astype("<u8")
    payload = pack(np.concatenate(ids), width)
    return HEAD.pack(MAGIC, width, len(doc_ids), int(end[-1]), len(payload)) + known.tobytes() + number.tobytes() + end.tobytes() + payload


def blocks_in(data):
    """(doc_ids, ends, width, payload) of each block of a file."""
    at, view = 0, memoryview(data)
    while at < len(view):
        magic, width, docs, ids, size = HEAD.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("not a block of packed ids")
        at += HEAD.size
        known = np.frombuffer(view, np.uint8, docs, at)
        number = np.frombuffer(view, "<i8", docs, at + docs)
        end = np.frombuffer(view, "<u8", docs, at + 9 * docs)
        at += 17 * docs
        yield [int(n) if k else None for k, n in zip(known, number, strict=True)], end.astype(np.int64), width, view[at:at + size]
        at += size + 1


def _write(path: str, width: int, end_id: int, block_ids: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        enc, docs, ids, n = encoder(path), [], [], 0
        for batch in batches:
            for part in W.slices(batch):
                got, first = enc(part.column("text"))
                for d, a, b in zip(part.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                    docs.append(d)
                    ids += [got[a:b], end]
                    n += b - a + 1
                    if n >= block_ids:
                        yield pa.record_batch([pa.array([block(docs, joined(ids), width)], pa.binary())], names=["block"])
                        docs, ids, n = [], [], 0
        if docs:
            yield pa.record_batch([pa.array([block(docs, joined(ids), width)], pa.binary())], names=["block"])

    def joined(ids):
        return [np.concatenate(ids[i:i + 2]) for i in range(0, len(ids), 2)]

    return run


def write_packed(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Packed files of every document's ids under ``path``, in ascending doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(12, -(-chars // RANGE_CHARS))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    # the text sink writes a string's bytes as they are
    (ordered.mapInArrow(_write(tokenizer, bit_width(vocabulary), end_id, block_ids), "block binary").select(F.col("block").cast("string"))
     .write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path))


def _read(batches):
    names = ["file", "seq", "doc_id", "local", "n_tokens", "ids_crc32"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            seq, done = 0, 0
            for docs, end, width, payload in blocks_in(content.as_buffer()):
                raw = memoryview(unpack(payload, width, 0, int(end[-1])).tobytes())
                start = np.concatenate([[0], end[:-1]])
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                cols = [[path.rpartition("/")[2]] * len(docs), np.arange(seq, seq + len(docs)), docs, start + done, end - start, crc]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                seq, done = seq + len(docs), done + int(end[-1])


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files under ``path``; start counts the ids of all documents before."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    docs = materialize(files.mapInArrow(_read, "file string, seq long, doc_id long, local long, n_tokens long, ids_crc32 long"), "packed-index")
    # one row per file of some 8 million ids; file names follow the ranges
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = public_tokenizers.path(TOKENIZER)
    path = f"{checkpoint_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex[:12]}"
    write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True))
    return read_packed(spark, path)
