"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids go together in the corpus.

A is a byte-level vocabulary read by ``tokenizers`` (with a space before the text), B one with byte fallback read by
``sentencepiece``, which adds that space itself. Neither joins anything across a single space between two printable ASCII
characters (``Pair`` checks B's vocabulary for that), so texts are cut there into chunks, a shard's distinct chunks are
encoded once, as running text, and a document is a list of chunk numbers.

Token ends come from the libraries' spans as coarse cuts: character offsets of A, turned into bytes, and byte spans of the
sentencepiece proto of B. Where several tokens share a span (parts of one character, byte fallback), the lengths of their
decoded bytes place the inner ends. All decoded bytes are compared with the text; a chunk that differs (a normalised
character, a literal U+2581) takes its documents out. Groups end where A and B both end; links are overlaps.

Two passes over Spark:
1. Tasks write a row for each block of documents: its distinct (A, B) pairs with their counts, which chunks hold which
   pairs, and the chunks of each document, beside the document's own columns. Ids are never linked one by one.
2. Pairs are summed over blocks, and each B id gets its highest count. A block asks for its own pairs only: a pair is
   one row a block, however often the documents hold it, so no frequent pair makes a hot key. The answers come back to
   the block by its number, and counts are added up over chunks and documents.

Memory follows a shard: a longer text is encoded in runs of chunks of ``RUN_BYTES`` and is a block by itself; a stretch
without any cut place is encoded whole.

Defined cases: null and empty texts, and texts whose decoded bytes differ, have zeros and an empty digest and add nothing
to counts; ids may be null or repeated, each row is a document; special strings in texts are plain text; with no links a
document's sums are 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import read_table, shards, text_bytes
from touchline.llm.registry import query
from touchline.session import settle

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARD_BYTES = 1 << 20
RUN_BYTES = 128 << 10
#: Chunks that a task keeps encoded; beyond that it starts anew.
KEPT_CHUNKS = 300_000
#: Strings joined at a time for a digest.
_JOINED = 1 << 16


def _byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Bytes:
    """Decoded bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.begin[ids] - begin, size) + np.arange(size.sum())]


def refined_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of tokens from their byte spans, and the coarse cuts whose tokens' decoded sizes do not fill them.

    A token ends a coarse segment if its span is not empty and the next one begins at its end. Inside a segment of
    several tokens the sizes of the decoded bytes place the ends.
    """
    coarse = end > begin
    coarse[:-1] &= begin[1:] == end[:-1]
    coarse[-1] = True
    last = np.flatnonzero(coarse)
    start = np.concatenate([[0], end[last[:-1]]])
    segment = np.concatenate([[0], np.cumsum(coarse)[:-1]])
    total = np.cumsum(size)
    before = np.concatenate([[0], total[last[:-1]]])
    ends = start[segment] + total - before[segment]
    wrong = total[last] - before != end[last] - start
    return np.where(coarse, end, ends), end[last][wrong]


@lru_cache(maxsize=1)
def _tokenizers(byte_path: str, piece_path: str) -> tuple:
    """Both tokenizers and the decoded bytes of their ids; loaded once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
    a.encode_special_tokens = True
    with open(byte_path, encoding="utf-8") as file:
        entries = json.load(file)
    vocabulary = entries["model"]["vocab"] | {t["content"]: t["id"] for t in entries["added_tokens"]}
    letters, decoded = _byte_of_letter(), [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        decoded[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("B has pieces that reach over a space; texts cannot be cut there")
    return a, b, _Bytes(decoded), _Bytes([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


class Pair:
    """The two tokenizers and the chunks that they have encoded for a task."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b, self.a_bytes, self.b_bytes = _tokenizers(byte_path, piece_path)
        self.forget()

    def forget(self) -> None:
        self.keys = pa.array([], pa.binary())
        self.good, self.strings = np.zeros(0, bool), pa.array([], pa.string())
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encode_run(self, data: np.ndarray, text: str) -> tuple:
        """Ids and byte ends in ``data`` (a space, then ``text``) of both sides, and bytes where one does not give its own back."""
        got = self.a.encode(" " + text, add_special_tokens=False)
        a_ids = np.array(got.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        if spans[-1, 1] != len(data):  # characters of several bytes
            spans = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[spans]
        a_ends, a_wrong = refined_ends(spans[:, 0], spans[:, 1], self.a_bytes.size[a_ids])
        pieces = self.b.encode(text, return_type="proto").pieces
        b_ids = np.array([p.id for p in pieces], np.int64)
        end = np.array([p.end for p in pieces], np.int64) + 1  # the space that B adds has no place in the text
        begin = np.concatenate([[0], end[:-1]])  # spans follow each other
        b_ends, b_wrong = refined_ends(begin, end, self.b_bytes.size[b_ids])
        wrong = np.concatenate([a_wrong, b_wrong])
        if not len(wrong):
            a, b = self.a_bytes.of(a_ids), self.b_bytes.of(b_ids)
            if len(a) != len(data) or len(b) != len(data):
                wrong = np.array([len(data)])
            else:
                wrong = np.flatnonzero((a != data) | (b != data)) + 1
        return a_ids, a_ends, b_ids, b_ends, wrong

    def _aligned(self, chunks: pa.Array) -> tuple:
        """Which chunks give their bytes back, their digest strings, sizes, numbers of links, and links, from one running text."""
        good = np.zeros(len(chunks), bool)
        held, begins, data, got = np.arange(len(chunks)), None, None, None
        while len(held):
            part = chunks.take(pa.array(held))
            raw, offsets = text_bytes(part)
            data = np.full(len(raw) + len(held), 0x20, np.uint8)  # a space before each chunk
            ends = offsets[1:] + np.arange(1, len(held) + 1)
            data[np.arange(len(raw)) + np.repeat(np.arange(1, len(held) + 1), np.diff(offsets))] = raw
            got = self._encode_run(data, data[1:].tobytes().decode("utf-8"))
            if not len(got[4]):
                good[held], begins = True, ends
                break
            bad = np.unique(np.searchsorted(ends, got[4], side="left"))  # a wrong place k is the end of byte k - 1
            held = np.delete(held, np.minimum(bad, len(held) - 1))
        sizes, strings = np.zeros((len(chunks), 4), np.int64), [""] * len(chunks)
        pairs, many = np.zeros(0, np.int64), np.zeros(len(chunks), np.int64)
        if len(held):
            a_ids, a_ends, b_ids, b_ends, _ = got
            cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
            group_a, group_b, owner = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), np.searchsorted(begins, cuts)
            n_a, n_b, n_g = (np.bincount(o, minlength=len(held)) for o in (owner[group_a], owner[group_b], owner))
            sizes[held] = np.stack([n_a, n_b, n_g, n_a + n_b - n_g], 1)
            # links: B tokens from the one that holds an A token's first byte to the one that holds its last
            low = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), side="right")
            high = np.searchsorted(b_ends, a_ends, side="left")
            span = high - low + 1
            begin = np.cumsum(span) - span
            links = np.repeat(a_ids << 32, span) | b_ids[np.repeat(low - begin, span) + np.arange(span.sum())]
            many[held] = np.bincount(owner[np.repeat(group_a, span)], minlength=len(held))
            pairs = links
            joined = pc.binary_join_element_wise(_joined(a_ids, group_a, len(cuts), ","), _joined(b_ids, group_b, len(cuts), ","), "|")
            edges = np.searchsorted(owner, np.arange(len(held) + 1)).astype(np.int32)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), joined), ";")
            if len(held) == len(chunks):
                strings = whole
            else:
                place = np.full(len(chunks), -1)
                place[held] = np.arange(len(held))
                strings = pc.fill_null(whole.take(pa.array(place, mask=place < 0)), "")
        return good, strings if isinstance(strings, pa.Array) else pa.array(strings, pa.string()), sizes, many, pairs

    def _add(self, chunks: pa.Array) -> None:
        """Encode new chunks, in runs, and keep the results.

        Chunks with a printable ASCII character at both ends can stand in a run, with the space of a cut between them; one
        that begins or ends a text with anything else is encoded by itself.
        """
        raw, offsets = text_bytes(chunks)
        edges = np.stack([raw[offsets[:-1]], raw[offsets[1:] - 1]])
        joins = ((edges > 0x20) & (edges < 0x7F)).all(0)
        chunks = pa.concat_arrays([chunks.filter(pa.array(joins)), chunks.filter(pa.array(~joins))])
        length = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin, joined, made = 0, int(joins.sum()), []
        while begin < len(chunks):
            finish = begin + 1
            if begin < joined:
                finish = min(joined, max(finish, int(np.searchsorted(length, (length[begin - 1] if begin else 0) + RUN_BYTES, side="right"))))
            made.append(self._aligned(chunks.slice(begin, finish - begin)))
            begin = finish
        good, strings, sizes, many, pairs = zip(*made)
        self.keys = pa.concat_arrays([self.keys, chunks])
        self.strings = pa.concat_arrays([self.strings, *strings])
        self.good, self.sizes = np.concatenate([self.good, *good]), np.concatenate([self.sizes, *sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(many))])
        self.pairs = np.concatenate([self.pairs, *pairs])

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct ``chunks`` is kept; the new ones are encoded."""
        if len(self.keys) > KEPT_CHUNKS:
            self.forget()
        new = chunks.filter(pc.invert(pc.is_in(chunks, self.keys))) if len(self.keys) else chunks
        if len(new):
            self._add(new)
        return pc.index_in(chunks, self.keys).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(ids: np.ndarray, group: np.ndarray, n: int, mark: str) -> pa.Array:
    """The decimal ids of each group, joined."""
    edges = np.searchsorted(group, np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids).cast(pa.string())), mark)


def cut_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All chunks of the texts, without the spaces between them, and the row of each."""
    shown = (data > 0x20) & (data < 0x7F)
    at = np.flatnonzero((data[1:-1] == 0x20) & shown[:-2] & shown[2:]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    if len(at):
        row = np.searchsorted(offsets, at, side="right") - 1
        at = at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]  # the neighbours are of the same text
    held = np.flatnonzero(np.diff(offsets))
    begins, finishes = np.sort(np.concatenate([offsets[held], at + 1])), np.sort(np.concatenate([offsets[held + 1], at]))
    inner = np.ones(len(data), bool)
    inner[at] = False
    places = np.concatenate([[0], np.cumsum(finishes - begins)]).astype(np.int32)
    kept = np.ascontiguousarray(data[inner])
    chunks = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return chunks, np.searchsorted(offsets, begins, side="right") - 1


_BLOCK = ("block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,n_chunks:int>>, "
          "chunks binary, chunk_sizes binary, chunk_pairs binary, pairs array<long>, counts array<long>")


def packed(values: np.ndarray) -> bytes:
    """Numbers of a block in 16 or 32 bits, compressed; ``unpacked`` reads them."""
    kind = np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32
    return struct.pack("<BQ", np.dtype(kind).itemsize, len(values)) + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    return np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), f"<u{width}").astype(np.int64)


def _block(table: pa.Table, pair: Pair, number: int) -> pa.RecordBatch:
    """Documents of a shard with their chunks, the chunks' pairs, and the counts of the distinct pairs."""
    data, offsets = text_bytes(table["text"])
    n = table.num_rows
    chunks, row = cut_chunks(data, offsets)
    coded = chunks.dictionary_encode()
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    slot = pair.slots(coded.dictionary)
    whole = np.bincount(row, ~pair.good[slot][own], n) == 0 if n else np.zeros(0, bool)
    keep = whole[row]
    row, own = row[keep], own[keep]
    seen, local = np.unique(own, return_inverse=True)  # chunks of documents that count
    at = slot[seen]
    sums = np.stack([np.bincount(row, pair.sizes[at, j][local], n) for j in range(4)], 1).astype(np.int64)
    many = pair.first[at + 1] - pair.first[at]
    begin = np.cumsum(many) - many
    links = pair.pairs[np.repeat(pair.first[at] - begin, many) + np.arange(many.sum())]
    distinct, place = np.unique(links, return_inverse=True)
    times = np.bincount(place, np.repeat(np.bincount(local, minlength=len(seen)), many), len(distinct)).astype(np.int64)
    edges = np.searchsorted(row, np.arange(n + 1))
    texts, digests = pair.strings, []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        digest = hashlib.sha256()
        for k in range(a, b, _JOINED):
            part = texts.take(pa.array(at[local[k:min(k + _JOINED, b)]]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ";")[0].as_buffer()
            digest.update(b";" if k > a else b"")
            digest.update(joined)
        digests.append(digest.hexdigest() if b > a else "")
    docs = pa.StructArray.from_arrays([table["doc_id"].combine_chunks(), *(pa.array(sums[:, j]) for j in range(4)), pa.array(digests, pa.string()),
                                       pa.array(np.diff(edges).astype(np.int32))],
                                      ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_chunks"])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [pa.array([number]), one(docs), *(pa.array([packed(v)], pa.binary()) for v in (local, many, place)), one(pa.array(distinct)), one(pa.array(times))],
        ["block", "docs", "chunks", "chunk_sizes", "chunk_pairs", "pairs", "counts"])


def aligned_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", byte_path: str | None = None,
                   piece_path: str | None = None) -> DataFrame:
    """A written table of blocks of documents with their aligned chunks."""
    paths = byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = None, TaskContext.get().partitionId() << 32
        for table in shards(batches, "text", SHARD_BYTES):
            pair = pair or Pair(*paths)
            yield _block(table, pair, number)
            number += 1

    return settle(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _BLOCK))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): links of each id pair in the corpus; ``best`` if no A id has more with this B id."""
    summed = settle(blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.counts").alias("count")))
    parted = summed.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
    highest = parted.groupBy("b").agg(F.max("count").alias("highest"))  # a row for each B id at most
    return settle(parted.join(highest, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each document, from the counts that a block's pairs got."""
    for batch in batches:
        for i in range(batch.num_rows):
            def flat(name: str, i: int = i, batch: pa.RecordBatch = batch) -> pa.Array:
                return batch.column(name).slice(i, 1).flatten()

            docs = flat("docs")
            answers = flat("answers")
            place, count, best = (np.asarray(answers.field(f).to_numpy(zero_copy_only=False)) for f in ("place", "count", "best"))
            of_pair = np.zeros((2, len(place)), np.int64)
            of_pair[:, place] = best, count
            chunks, sizes, links = (unpacked(batch.column(c)[i].as_py()) for c in ("chunks", "chunk_sizes", "chunk_pairs"))
            until = np.concatenate([[[0], [0]], np.cumsum(of_pair[:, links], 1)], 1)
            ends = np.cumsum(sizes)
            of_chunk = until[:, ends] - until[:, ends - sizes]
            until = np.concatenate([[[0], [0]], np.cumsum(of_chunk[:, chunks], 1)], 1)
            edge = np.concatenate([[0], np.cumsum(docs.field("n_chunks").to_numpy(zero_copy_only=False).astype(np.int64))])
            sums = until[:, edge[1:]] - until[:, edge[:-1]]
            yield pa.RecordBatch.from_arrays([*(docs.field(f) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]),
                                              docs.field("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, **options) -> DataFrame:
    """One row a document: tokens, groups, links, links that are the best of their B id, summed counts, digest of the groups."""
    blocks = aligned_blocks(docs, **options)
    counts = pair_counts(blocks).select("pair", "count", "best")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("answers"))
    answered = blocks.drop("pairs", "counts").join(answers, "block", "left").withColumn(
        "answers", F.coalesce("answers", F.expr("array()").cast("array<struct<place:int,count:long,best:boolean>>")))
    return answered.mapInArrow(_added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


@query("op11_tokenizer_alignment")
def _(spark, d):
    return align(read_table(spark, d, "documents"))
