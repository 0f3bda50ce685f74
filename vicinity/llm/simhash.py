"""SimHash near-dedup with deletion-variant signatures.

Every text gets a 64-bit fingerprint: each bit is the majority over the XXH64
hashes of its word shingles.  Two texts are linked when their fingerprints
differ in at most ``max_bits`` bits, and documents linked directly or through
others form a component.

Finding the links.  Cut into ``s`` segments, two fingerprints within
``max_bits < 2 s`` have a segment in which they differ by at most one bit (with
4 bits, three segments do; exact matching would need five, each too short to
select much).  Deleting bit p of a segment for every p gives one-wildcard
variants, and two segments within one bit share at least one variant.  So each
*distinct* fingerprint yields 64 signatures (segment, wildcard, remaining 20 or
21 bits), equal signatures meet by an equality shuffle, and each meeting is
verified on the whole fingerprints.

Groups of equal signatures are never expanded into pairs: a spanning forest of
the verified links is emitted, which connects the same fingerprints.  A group
larger than ``BLOCK`` is passed on as blocks, and pairs of blocks are compared
in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.llm.fixed_filter import row_key, without_rows
from vicinity.session import cut_lineage

BLOCK = 8192
SHORT_RUN = 64


# ---- fingerprints

def shingle_spans(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(from_word, to_word, per_text)``: first and last word of each shingle, and the number of shingles per text.

    A text with fewer than ``size`` words has one shingle of all of them, a text without words none.
    """
    words = np.diff(first)
    per_text = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(per_text)[:-1])), per_text) + np.arange(per_text.sum())
    return at, at + np.repeat(np.minimum(words, size), per_text) - 1, per_text


def fingerprints(col: pa.Array, size: int, seed: int) -> np.ndarray:
    """uint64 SimHash of each text of an Arrow string column."""
    data, offsets = bt.flat(col)
    data = bt.LOWER[data]
    start, end, first = bt.word_spans(data, offsets)
    lengths = end - start
    joined = np.full(int(lengths.sum()) + len(start), 32, np.uint8)  # the words, one space after each
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(start)), lengths)] = data[~bt.IS_SEPARATOR[data]]
    ends = np.cumsum(lengths + 1) - 1
    lo, hi, per_text = shingle_spans(first, size)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip((ends - lengths)[lo].tolist(), ends[hi].tolist())], "<u8")
    out = np.zeros(len(col), np.uint64)
    some = np.flatnonzero(per_text)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate(([0], np.cumsum(per_text[some])[:-1]))
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > per_text[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id",
                      text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a long) of every whole text, and ``k1, k2`` of its row; map only."""
    keys = ["k1", "k2"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                fp = fingerprints(part.column("text"), size, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), *map(part.column, keys)],
                                                 ["doc_id", "fp", *keys])

    key = row_key(id_col, text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *(key[k].alias(k) for k in keys))
    return src.mapInArrow(run, "doc_id long, fp long" + "".join(f", {k} long" for k in keys))


# ---- links

def signatures(fp: Column, max_bits: int) -> Column:
    """Array of the one-wildcard signatures of a fingerprint: (deleted bit, rest of its segment) as longs."""
    parts = max(2, max_bits // 2 + 1)  # the fewest segments of which one differs by at most one bit
    cuts = [64 * i // parts for i in range(parts + 1)]
    room = max(hi - lo for lo, hi in zip(cuts, cuts[1:])) - 1
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        seg = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        for p in range(hi - lo):
            rest = F.shiftleft(F.shiftright(seg, p + 1), p).bitwiseOR(seg.bitwiseAND(F.lit((1 << p) - 1).cast("long")))
            out.append(rest.bitwiseOR(F.lit((lo + p) << room).cast("long")))
    return F.array(*out)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as pairs; at most one fewer than there are."""
    left, a, b = fps, [], []
    while len(left):
        front, left = [left[:1]], left[1:]
        while front and len(left):
            at = front.pop()
            for x in at:
                near = np.bitwise_count(left ^ x) <= max_bits
                if near.any():
                    new, left = left[near], left[~near]
                    a.append(np.full(len(new), x))
                    b.append(new)
                    front.append(new)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


LINKS = "a long, b long, sig long, block int, members binary"


def _link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
         pa.nulls(n, pa.binary())], ["a", "b", "sig", "block", "members"])


def _block_row(sig: int, block: int, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([sig], pa.int64()), pa.array([block], pa.int32()),
         pa.array([members.tobytes()], pa.binary())], ["a", "b", "sig", "block", "members"])


def link_runs(batches: Iterator[pa.RecordBatch], max_bits: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal ``sig`` (rows sorted by it); runs longer than ``block`` also give their blocks."""
    sig, fp, blocks = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

    def whole_runs(sig, fp):
        """Links of complete runs: all verified meetings of short ones, a forest of long ones."""
        heads = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(heads, len(sig)))
        size = np.repeat(sizes, sizes)
        for lag in range(1, min(int(sizes.max(initial=1)), SHORT_RUN)):
            i = np.flatnonzero((sig[lag:] == sig[:-lag]) & (size[lag:] <= SHORT_RUN))
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= max_bits]
            if len(i):
                yield _link_rows(fp[i], fp[i + lag])
        for at, n in zip(heads[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
            yield _link_rows(*forest(fp[at:at + n], max_bits))

    def last_block(sig, fp):
        if len(fp):
            yield _link_rows(*forest(fp, max_bits))
            yield _block_row(int(sig[0]), blocks, fp)

    for b in batches:
        sig = np.concatenate((sig, b.column("sig").to_numpy()))
        fp = np.concatenate((fp, b.column("fp").to_numpy().view(np.uint64)))
        if not len(sig):
            continue
        if blocks:  # the first run goes on from blocks that are already out
            n = int(np.searchsorted(sig, open_sig, side="right"))
            if n < len(sig):
                yield from last_block(sig[:n], fp[:n])
                sig, fp, blocks = sig[n:], fp[n:], 0
        if not blocks:
            n = int(np.searchsorted(sig, sig[-1], side="left"))
            if n:
                yield from whole_runs(sig[:n], fp[:n])
                sig, fp = sig[n:], fp[n:]
        while len(fp) > block:
            open_sig = int(sig[0])
            yield _link_rows(*forest(fp[:block], max_bits))
            yield _block_row(open_sig, blocks, fp[:block])
            sig, fp, blocks = sig[block:], fp[block:], blocks + 1
    if blocks:
        yield from last_block(sig, fp)
    elif len(sig):
        yield from whole_runs(sig, fp)


def link_blocks(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links across pairs of blocks of one signature."""
    for batch in batches:
        for a, b in zip(batch.column("members").to_pylist(), batch.column("others").to_pylist()):
            both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
            x, y = forest(both, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """``a, b`` with ``a < b``: links that connect exactly the fingerprints (column ``fp``, distinct) the full set connects."""
    sigs = distinct.select("fp", F.explode(signatures(F.col("fp"), max_bits)).alias("sig"))
    met = cut_lineage(sigs.repartition("sig").sortWithinPartitions("sig", "fp")
                      .mapInArrow(lambda it: link_runs(it, max_bits, block), LINKS))
    blocks = met.filter("sig is not null").select("sig", "block", "members")
    others = blocks.select("sig", F.col("block").alias("other"), F.col("members").alias("others"))
    crossed = (blocks.join(others, "sig").filter("block < other").select("members", "others")
               .mapInArrow(lambda it: link_blocks(it, max_bits), "a long, b long"))
    return (met.filter("sig is null").select("a", "b").unionByName(crossed)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


# ---- components

def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root``: every node of ``edges`` (``a``, ``b``) with the smallest node of its component.

    Alternating star contractions: each node's larger neighbours are re-hung on its smallest neighbour, then its
    smaller ones.  A round is two partial aggregations and two joins on the node, whose hot keys the engine can split;
    the edges are stored in the shared folder after each round, and only their number and a checksum reach the driver.
    """
    def store(e):
        e = cut_lineage(e.distinct())
        return e, e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e, mark = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = store(small.unionByName(low.withColumnRenamed("m", "v")))
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links).

    * null, empty or blank text: fingerprint zero, linked like any other; fewer than ``size`` words: one shingle;
    * null id: its row gets the component of the others, whose ids alone count; null if no row of it has an id;
    * repeated rows: repeated in the result; empty table: no rows; other columns are not read.
    """
    prints = cut_lineage(fingerprint_table(docs, size, seed, id_col, text_col))
    return with_least(prints, F.col("doc_id"), max_bits, block).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def with_least(prints: DataFrame, value: Column, max_bits: int, block: int) -> DataFrame:
    """``prints`` (``fp``; stored) with the smallest ``value`` of each row's component as ``least``."""
    distinct = prints.groupBy("fp").agg(F.min(value).alias("first"))
    roots = components(links(distinct, max_bits, block)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # stored, so that the join has an exchange on both sides and the engine can split the partitions of a large component
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("least")))
    classes = rooted.join(least, "root")
    return prints.join(classes.select("fp", "least"), "fp")


def drop_near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id",
                         text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest id, then the smallest hash of id and text.

    Rows are told apart by id and text, so each is judged by its own text, whatever other rows have its id; rows
    without an id come last, and rows that are the same in both are interchangeable.
    """
    prints = cut_lineage(fingerprint_table(docs, size, seed, id_col, text_col, keyed=True))
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k1", "k2")
    key = F.struct("k1", "k2")
    judged = with_least(prints, rank, max_bits, block).select(
        key.alias("_key"), ((F.col("least.k1") == F.col("k1")) & (F.col("least.k2") == F.col("k2"))).alias("_one"))
    gone = judged.filter(~F.col("_one")).distinct()
    twice = judged.filter("_one").groupBy("_key", "_one").count().filter("count > 1").drop("count")
    return without_rows(docs, row_key(id_col, text_col), gone.unionByName(twice))
