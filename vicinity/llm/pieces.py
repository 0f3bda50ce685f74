"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a character before a white-space marker, no merge
crosses from a word into the marker after it.  A text then falls into chunks
(one or more markers and the characters up to the next marker) that are
segmented independently, and natural text has few distinct ones:

1. tasks collect the distinct chunks of their texts and send them, once a task, to the
   shard that a chunk's hash names;
2. a shard segments each of its distinct chunks once, and decodes it again to see
   whether it comes back as it was;
3. it stores them in the shared folder as arrays sorted by hash, which workers map into
   memory;
4. a task looks the distinct chunks of a slice of texts up (hash, then bytes) and
   joins ids and characters back by position.

Only distinct chunks are shuffled, never a text.  A chunk beyond ``LONG``
characters (a text without spaces, say) is no word that others share: it is
segmented where it stands, so no row of the table is large.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.arraystore import map_array, write_array
from vicinity.llm.bytetext import slices
from vicinity.session import checkpoint_dir

MARK = "▁"
LONG = 4096            # characters of a chunk from which on it isn't in the table
HELD = 200_000         # distinct chunks that a task gathers before it sends them
SLICE = 8 << 20        # bytes of text whose chunks are looked up together
_CHUNK = re.compile(" +[^ ]*")


def chunks_of(text: str) -> list[str]:
    """The marked chunks of a text in order; a space stands for the marker."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


class Segmenter:
    """Ids and decoded characters of marked chunks, for one model."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.numerals = [str(i) for i in range(len(pieces))]
        self.by_chunk = (not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
                         and self.sp.normalize("a  \n") == f"{MARK}a{MARK}{MARK}\n")

    def text(self, ids: list[int]) -> str:
        numerals = self.numerals
        return " ".join([numerals[i] for i in ids])

    def segment(self, chunks: list[str]) -> tuple[list[str], list[str | None]]:
        """Ids as text, and the decoded characters of chunks that don't come back as they were, else None."""
        # the library puts one marker before every text, so a chunk is handed over without its first
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x if len(c) > 1 else [self.sp.piece_to_id(MARK)] for c, x in zip(chunks, ids)]
        decoded: list[str | None] = [None] * len(chunks)
        if self.sp.decode([i for x in ids for i in x]) != "".join(chunks)[1:]:
            decoded = [d if d != c[1:] else None for c, d in zip(chunks, self.sp.decode(ids, num_threads=1))]
        return [self.text(x) for x in ids], decoded


@dataclasses.dataclass(frozen=True)
class ChunkTable:
    """The stored table: ``2 ** bits`` shards under ``base``, a chunk in the shard of its hash's leading bits."""

    base: str
    bits: int
    chunks: int

    def find(self, chunks: list[str]) -> Iterator[tuple[str, str, str | None] | str]:
        """``(chunk, ids as text, decoded characters or None)`` of each chunk, or the chunk alone if the table hasn't it."""
        raw = [c.encode() for c in chunks]
        hashes = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        order = np.argsort(shard, kind="stable")
        for s, (lo, hi) in enumerate(zip(*(np.searchsorted(shard[order], np.arange(1 << self.bits), side) for side in ("left", "right")))):
            if lo == hi:
                continue
            keys = np.asarray(map_array(self.base, f"hashes-{s}", "u8"))
            ends = [np.asarray(map_array(self.base, f"{kind}_ends-{s}", "u4")) for kind in _BLOBS]
            blobs = [memoryview(map_array(self.base, f"{kind}-{s}", "u1")) for kind in _BLOBS]
            mine = order[lo:hi]
            at = np.searchsorted(keys, hashes[mine])
            there = np.zeros(len(mine), bool)
            there[at < len(keys)] = keys[at[at < len(keys)]] == hashes[mine[at < len(keys)]]
            cuts = [(np.where(at[there] > 0, e[at[there] - 1], 0).tolist(), e[at[there]].tolist()) for e in ends]  # begin, end
            yield from (chunks[i] for i in mine[~there].tolist())
            for k, (i, *cut) in enumerate(zip(mine[there].tolist(), *cuts[0], *cuts[1], *cuts[2])):
                if blobs[0][cut[0]:cut[1]] == raw[i]:
                    # a decoded text has a byte before it, so that an empty one is told from none
                    yield (chunks[i], str(blobs[1][cut[2]:cut[3]], "ascii"),
                           str(blobs[2][cut[4] + 1:cut[5]], "utf-8") if cut[5] > cut[4] else None)
                else:
                    yield self._beyond(chunks[i], raw[i], int(at[there][k]), keys, ends, blobs)

    @staticmethod
    def _beyond(chunk: str, raw: bytes, at: int, keys, ends, blobs) -> tuple[str, str, str | None] | str:
        """The chunk among the others that have its hash."""
        key = keys[at]
        while at < len(keys) and keys[at] == key:
            found, ids, decoded = (bytes(b[e[at - 1] if at else 0:e[at]]) for b, e in zip(blobs, ends))
            if found == raw:
                return chunk, ids.decode(), decoded[1:].decode() if decoded else None
            at += 1
        return chunk


_BLOBS = ("chunk", "ids", "decoded")


def hashes_of(chunks: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(c.encode()) for c in chunks], np.uint64)


def task_chunks(docs: DataFrame, bits: int, text_col: str = "text") -> DataFrame:
    """``shard, chunk``: the different chunks of all texts, each once for a task, but for those beyond ``LONG`` characters.

    A task gathers ``HELD`` chunks before it sends them and then remembers their hashes alone.  A chunk whose hash another
    one has is not sent; the table lacks it, and it is segmented where it stands.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        held: set[str] = set()
        sent = np.zeros(0, np.uint64)

        def send():
            nonlocal sent
            rows = np.array([c for c in held if len(c) <= LONG], object)
            held.clear()
            keys = hashes_of(rows)
            at = np.searchsorted(sent, keys)
            new = np.ones(len(keys), bool)
            new[at < len(sent)] = sent[at[at < len(sent)]] != keys[at < len(sent)]
            sent = np.union1d(sent, keys)
            shard = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            return pa.RecordBatch.from_arrays([pa.array(shard[new]), pa.array(rows[new], pa.string())], ["shard", "chunk"])

        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    held.update(chunks_of(t or ""))
                if len(held) > HELD:
                    yield send()
        yield send()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shard int, chunk string")


def store_table(chunks: DataFrame, model: bytes, bits: int) -> ChunkTable:
    """The table of the distinct rows of ``chunks`` (:func:`task_chunks`), each segmented once, in the shared folder.

    A shard lists its chunks by hash, with places in one string of all chunks,
    one of all ids and one of what is decoded otherwise.
    """
    spark = chunks.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(model)

    def store(table: pa.Table) -> pa.Table:
        shard, distinct = table.column("shard")[0].as_py(), table.column("chunk").unique().to_pylist()
        keys = hashes_of(distinct)
        order = np.argsort(keys, kind="stable")
        distinct = [distinct[i] for i in order]
        segmenter = Segmenter(shared.value)
        columns: list[list[bytes]] = [[], [], []]
        for at in range(0, len(distinct), 10_000):
            some = distinct[at:at + 10_000]
            ids, decoded = segmenter.segment(some)
            columns[0] += [c.encode() for c in some]
            columns[1] += [x.encode() for x in ids]
            columns[2] += [b"" if d is None else b"=" + d.encode() for d in decoded]
        write_array(base, f"hashes-{shard}", keys[order])
        for kind, data in zip(_BLOBS, columns):
            write_array(base, f"{kind}_ends-{shard}", np.cumsum([len(d) for d in data], dtype=np.int64).astype(np.uint32))
            write_array(base, f"{kind}-{shard}", np.frombuffer(b"".join(data), np.uint8))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(distinct)], pa.int64())})

    rows = chunks.groupBy("shard").applyInArrow(store, "shard int, n long").collect()  # a row per shard
    for shard in set(range(1 << bits)) - {r["shard"] for r in rows}:
        for name, kind in (("hashes", "u8"), *((f"{b}_ends", "u4") for b in _BLOBS), *((b, "u1") for b in _BLOBS)):
            write_array(base, f"{name}-{shard}", np.zeros(0, kind))
    return ChunkTable(base, bits, sum(r["n"] for r in rows))


def encode_texts(texts: list[str], segmenter: Segmenter, table: ChunkTable | None) -> Iterator[tuple[str, str]]:
    """Per text its ids as text (without an end id) and the decoded text."""
    if table is None:
        for t in texts:
            ids = segmenter.sp.encode(t)
            yield segmenter.text(ids), segmenter.sp.decode(ids)
        return
    chunked = [chunks_of(t) for t in texts]
    ids: dict[str, str] = {}
    odd: dict[str, str] = {}
    rest: list[str] = []
    wanted = set().union(*chunked)
    for found in table.find([c for c in wanted if len(c) <= LONG]):
        if isinstance(found, str):
            rest.append(found)  # a source that gave another text on its second reading
            continue
        ids[found[0]] = found[1]
        if found[2] is not None:
            odd[found[0]] = found[2]
    rest += [c for c in wanted if len(c) > LONG]
    for c in rest:
        (ids[c],), (decoded,) = segmenter.segment([c])
        if decoded is not None:
            odd[c] = decoded
    for t, chunks in zip(texts, chunked):
        yield (" ".join([ids[c] for c in chunks]),
               t.replace(MARK, " ") if odd.keys().isdisjoint(chunks) else " ".join([odd.get(c, c[1:]) for c in chunks]))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes (a vocabulary file: its size does not depend on the data)."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                  add_end: bool = True) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every whole text.

    The table of all distinct chunks is built and stored first; a model whose pieces cross markers has none, and its texts
    are encoded whole.  Ids equal the library's own ``encode(text)`` (plus its end id) and ``decoded`` its ``decode(ids)``.  A null text
    counts as empty and has the end id alone; rows, ids and nulls repeat as they come; an empty table has no rows; other
    columns are not read.
    """
    return _map(docs, model, id_col, text_col, add_end, digest=False)


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                   add_end: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: :func:`encode_decode` with digests in place of ids and text."""
    return _map(docs, model, id_col, text_col, add_end, digest=True)


def _map(docs, model, id_col, text_col, add_end, digest):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = None
    if Segmenter(model).by_chunk:
        bits = max(0, docs.rdd.getNumPartitions() - 1).bit_length()  # a shard gets about what one task sends
        table = store_table(task_chunks(docs, bits, text_col), model, bits)

    def run(batches: Iterator[pa.RecordBatch]):
        segmenter = Segmenter(shared.value)
        end = str(segmenter.sp.eos_id()) if add_end else ""
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = []
                for ids, decoded in encode_texts(texts, segmenter, table):
                    ids = f"{ids} {end}" if ids and end else ids or end
                    if digest:
                        out.append((ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(),
                                    hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        out.append((list(map(int, ids.split())), decoded))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*out), types)], names)

    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest
                          else "doc_id long, ids array<int>, decoded string")
