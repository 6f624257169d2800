"""Token ids in binary files with Elias-Fano document boundaries.

Documents are range-partitioned by id; each partition becomes one file in the shared folder: the concatenated ids
(2 bytes each while the vocabulary allows), then two Elias-Fano sequences, the document ends and the document ids,
then a footer. An Elias-Fano sequence keeps the low bits of ascending values packed and the high bits in unary, a
little over 2 bits a document beside the low bits; sampled select positions make the i-th boundary a short scan. Offsets
over all files come from a manifest of one row per file, so no table of 64-bit offsets exists.

Encoding is the tokenizers library's. A shard's texts are cut where its pre-tokenizer always cuts (between runs of
letters, digits and other signs), each distinct piece is encoded once by the library's model, and pieces are put
together in numpy; anything else than ASCII and Latin-1 letters, an apostrophe or a special token goes through the
library as a whole white-space word, which it never joins with its neighbours.

A file is written under a name of its attempt and then renamed, so a lost executor leaves no half file behind.

Defined cases: a null or empty text is one end id; null ids come first; repeated ids are ordered by a hash of the
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import SPACED, read_table, shards, text_bytes, word_hashes, word_spans
from touchline.llm.registry import query
from touchline.session import settle, shared_folder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FILE_BYTES = 24 << 20  # of text
SHARD_BYTES = 2 << 20
KEPT_PIECES = 2_000_000
NULL_ID = -(1 << 63)

# ---- Elias-Fano -------------------------------------------------------------------------------------------------

_SAMPLE = 256


class EliasFano:
    """Ascending values above ``base``: packed low bits, unary high bits, every 256th one's position."""

    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.base, self.width, self.low, self.high = n, base, width, low, high
        ones = np.unpackbits(high, bitorder="little")
        self.samples = np.flatnonzero(ones)[::_SAMPLE].astype(np.uint32 if len(ones) < 2 ** 32 else np.uint64)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """``values``: ascending int64."""
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64)))  # fits in 64 bits without a sign
        most = int(rest[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        bits = ((rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if n else np.zeros((0, 0), np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        place = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        high[place] = 1
        return cls(n, base, width, low, np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value: jump to the sampled one before it, scan to its own."""
        begin = int(self.samples[i // _SAMPLE])
        left, byte = i % _SAMPLE, begin >> 3
        first = np.unpackbits(self.high[byte:byte + 1], bitorder="little")
        first[:begin & 7] = 0
        size = 256
        while True:
            window = np.unpackbits(self.high[byte:byte + size], bitorder="little")
            window[:begin & 7] = 0
            ones = np.flatnonzero(window)
            if len(ones) > left:
                place = byte * 8 + int(ones[left])
                break
            size *= 4
        bits = np.unpackbits(self.low[i * self.width >> 3:((i + 1) * self.width >> 3) + 1], bitorder="little")
        own = bits[i * self.width & 7:][:self.width]
        return ((place - i) << self.width) + sum(int(b) << k for k, b in enumerate(own)) + self.base

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        low = (bits << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        high = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        return (high + low + np.uint64(self.base % (1 << 64))).view(np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack("<QqIQQ", self.n, self.base, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, base, width, n_low, n_high = struct.unpack_from("<QqIQQ", raw)
        at = struct.calcsize("<QqIQQ")
        return cls(n, base, width, np.frombuffer(raw, np.uint8, n_low, at), np.frombuffer(raw, np.uint8, n_high, at + n_low))


# ---- encoding ---------------------------------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other sign, 4 to be left to the library.
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = 3


class PieceEncoder:
    """Encodes texts by their distinct pieces; keeps what it has encoded, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        shape = json.loads(self.tokenizer.to_str())
        cut = json.dumps(shape["pre_tokenizer"])
        kinds = json.dumps(shape["normalizer"])
        # pieces are only right for this normaliser and pre-tokenizer; any other vocabulary is given whole words
        self.by_kind = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in cut and "NFC" in kinds and "Lowercase" in kinds
        self.size = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Lower-cased bytes, pieces (begin, end, row, whether the model alone may encode it)."""
        begins, finishes, rows = word_spans(data, offsets, SPACED)
        kind = _KIND[data]
        lead = data[:-1] == 0xC3  # Latin-1 letters, but for the signs of multiplication and division
        tail = data[1:]
        latin = np.flatnonzero(lead & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7) & (tail != 0x9F) & (tail <= 0xBF))
        kind[latin] = kind[latin + 1] = 1
        sharp = np.flatnonzero(lead & (tail == 0x9F))  # a small letter already
        kind[sharp] = kind[sharp + 1] = 1
        low = data.copy()
        capital = (data >= 65) & (data <= 90)
        low[capital] += 32
        upper = latin[(data[latin + 1] <= 0x9E)] + 1
        low[upper] += 32
        odd = np.concatenate([[0], np.cumsum(kind == 4)])
        whole = (odd[finishes] - odd[begins]) > 0
        if not self.by_kind:
            whole[:] = True
        # cut the other words where the kind changes and around each digit
        cut = np.zeros(len(data) + 1, bool)
        cut[begins] = True
        change = np.zeros(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        depth = np.zeros(len(data) + 1, np.int32)
        depth[begins[~whole]] += 1  # begins are distinct, and so are ends
        depth[finishes[~whole]] -= 1
        inside = np.cumsum(depth[:-1]) > 0
        cut[:-1] |= change & inside
        start = np.flatnonzero(cut[:-1])
        word = np.searchsorted(begins, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(data)), finishes[word])
        low_whole = np.where(inside, low, data)  # whole words keep their case for the library
        return low_whole, start, end, rows[word], ~whole[word]

    def _encode_new(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = np.zeros(len(pieces), np.int32), []
        for i, (piece, alone) in enumerate(zip(pieces, plain.tolist())):
            if alone:
                got = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
            else:
                got = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
            counts[i] = len(got)
            ids += got
        return counts, np.array(ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each row has."""
        data, offsets = text_bytes(texts)
        n_rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        low, start, end, row, plain = self._pieces(data, offsets)
        hashes = word_hashes(low, start, end)
        hashes ^= plain.astype(np.uint64)  # a piece and a word of the same bytes are encoded in different ways
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = low.tobytes()
            of = first[new]
            counts, ids = self._encode_new([raw[a:b] for a, b in zip(start[of].tolist(), end[of].tolist())], plain[of])
            starts = len(self.ids) + np.cumsum(counts) - counts
            place = np.searchsorted(self.hashes, unique[new])
            self.hashes = np.insert(self.hashes, place, unique[new])
            self.counts = np.insert(self.counts, place, counts)
            self.starts = np.insert(self.starts, place, starts)
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, unique)
        slot = at[inverse]
        count = self.counts[slot].astype(np.int64)
        begin = np.cumsum(count) - count
        out = self.ids[np.repeat(self.starts[slot] - begin, count) + np.arange(count.sum())]
        return out, np.bincount(row, count, n_rows).astype(np.int64)


# ---- files ------------------------------------------------------------------------------------------------------

def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


_FOOTER = "<QQQI4s"
_MAGIC = b"EFTK"


def write_token_files(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                      end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one file for each range of ids; the manifest (file, n_docs, n_ids, start), itself kept as a table."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(-(-total // file_bytes) or 1, *ordered).sortWithinPartitions(*ordered)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes, ids, out = PieceEncoder(path), [], [], None
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        fs, root = _open(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():08d}.ids"
        draft = f"{root}/_{context.taskAttemptId()}-{name}"
        for table in shards(batches, "text", SHARD_BYTES):
            got, count = encoder.encode(table["text"])
            edge = np.cumsum(count)
            got = np.insert(got, edge, end_id).astype(kind)
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(draft, compression=None)
            out.write(got.tobytes())
            sizes.append(count + 1)
            ids.append(table["id"].fill_null(NULL_ID).to_numpy() if hasattr(table["id"], "fill_null") else table["id"].to_numpy())
        if out is None:
            return
        ends, doc_ids = np.cumsum(np.concatenate(sizes)), np.concatenate(ids)
        parts = [EliasFano.encode(ends).to_bytes(), EliasFano.encode(doc_ids).to_bytes()]
        for part in parts:
            out.write(part)
        out.write(struct.pack(_FOOTER, int(ends[-1]), len(parts[0]), len(parts[1]), np.dtype(kind).itemsize, _MAGIC))
        out.close()
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": pa.array([len(ends)], pa.int64()),
                                          "n_ids": pa.array([int(ends[-1])], pa.int64())})

    manifest = settle(dealt.mapInArrow(write, "file string, n_docs long, n_ids long"))
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


class TokenFile:
    """A file of ids, opened for reading."""

    def __init__(self, folder: str, name: str):
        fs, root = _open(folder)
        self.source = fs.open_input_file(f"{root}/{name}")
        size, tail = self.source.size(), struct.calcsize(_FOOTER)
        self.n_ids, n_ends, n_docs, width, magic = struct.unpack(_FOOTER, self.source.read_at(tail, size - tail))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        self.kind = f"<u{width}"
        at = self.n_ids * width
        self.ends = EliasFano.from_bytes(self.source.read_at(n_ends, at))
        self.doc_ids = EliasFano.from_bytes(self.source.read_at(n_docs, at + n_ends))

    def ids(self, begin: int, finish: int) -> np.ndarray:
        width = np.dtype(self.kind).itemsize
        return np.frombuffer(self.source.read_at((finish - begin) * width, begin * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(folder, name)
                ends, doc_ids = file.ends.all(), file.doc_ids.all()
                begins = np.concatenate([[0], ends[:-1]])
                for k in range(0, len(ends), 8192):
                    first = int(begins[k])
                    b, e = begins[k:k + 8192] - first, ends[k:k + 8192] - first
                    got = file.ids(first, first + int(e[-1])).astype("<u4")
                    crc = [zlib.crc32(got[x:y].tobytes()) for x, y in zip(b.tolist(), e.tolist())]
                    own = doc_ids[k:k + 8192]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID), "start": b + first + start, "n_tokens": e - b,
                        "ids_crc32": pa.array(crc, pa.int64())})

    # one row per file: dealt out, so that files are read side by side
    spread = manifest.select("file", "start").repartition("file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids to a new folder beside the checkpoints and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, path=path), folder)


@query("op3_token_files")
def _(spark, d):
    return token_output(read_table(spark, d, "documents"))
