"""Text to vectors.

Vectors live in long tables: ``(pid, pos, vec)`` for multi-vector passages and
``(pid, vec)`` for single vectors.  Built-in encoders:

* :class:`HashedTokenEncoder` - deterministic 8-dim vector per token (md5 bytes),
  a JVM-side expression, used as the reference-free stand-in for a trained model;
* :func:`lookup_token_vectors` - vocabulary table join (Word2Vec output, E2);
* :class:`ArrowBatchEncoder` - user model hook run in ``mapInArrow`` (E3, E4).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (registers pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.text import encode_sequence, simple_tokens
from vicinity.functions.vectors import l2_normalize, with_hashed_vectors
from vicinity.operators.similarity import broadcast_limit
from vicinity.session import cut_lineage

HASHED_DIM = 8


def token_table(df: DataFrame, id_col: str = "pid", text: str = "text", tokens: str | None = None,
                distinct: bool = False) -> DataFrame:
    """``(pid, pos, token)``; ``distinct`` de-duplicates tokens inside each row
    (valid for the document side of MaxSim, where only the max counts)."""
    toks = F.col(tokens) if tokens else simple_tokens(text)
    if distinct:
        toks = F.array_distinct(toks)
    return df.select(id_col, F.posexplode(toks).alias("pos", "token"))


def token_lists(df: DataFrame, id_col: str = "pid", text: str = "text", distinct: bool = False) -> DataFrame:
    """``(pid, tokens)``, a row per passage; ``distinct`` as in :func:`token_table`."""
    toks = simple_tokens(text)
    return df.select(F.col(id_col).cast("long").alias("pid"), (F.array_distinct(toks) if distinct else toks).alias("tokens"))


class HashedTokenEncoder:
    """Multi-vector encoder: one L2-normalised hashed vector per token."""

    embedding_dim = HASHED_DIM

    def encode_tokens(self, tokens: DataFrame) -> DataFrame:
        return with_hashed_vectors(tokens, "token", "vec")

    def encode_passages(self, df: DataFrame, id_col: str = "pid", text: str = "text",
                        distinct: bool = False) -> DataFrame:
        return self.encode_tokens(token_table(df, id_col, text, distinct=distinct)).select(id_col, "pos", "token", "vec")

    def encode_packed(self, df: DataFrame, id_col: str = "pid", text: str = "text",
                      distinct: bool = False) -> DataFrame:
        """``(pid, vecs ARRAY<ARRAY<DOUBLE>>)`` per passage, shuffle-free.

        Tokens come from the JVM tokenizer; the vectors are computed in Arrow
        batches with a per-batch token cache (the same md5 formula as the JVM
        expression, checked equal in the tests), so nothing is exploded or
        regrouped.
        """
        return self.encode_token_lists(token_lists(df, id_col, text, distinct)).withColumnRenamed("pid", id_col)

    def encode_token_lists(self, df: DataFrame) -> DataFrame:
        """``(pid, tokens)`` -> ``(pid, vecs)``, a vector per token; each distinct token of a slice is hashed once."""
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    yield hashed_vectors_batch(b.slice(at, 512))

        return df.select("pid", "tokens").mapInArrow(run, "pid long, vecs array<array<double>>")

    def encode_queries(self, df: DataFrame, id_col: str = "qid", text: str = "text") -> DataFrame:
        t = token_table(df, id_col, text).withColumnRenamed("pos", "qpos")
        return self.encode_tokens(t).select(id_col, "qpos", "token", "vec")


def hashed_vector_np(tokens) -> np.ndarray:
    """numpy twin of :func:`vicinity.functions.vectors.hashed_components` for a list of tokens."""
    import hashlib
    if len(tokens) == 0:
        return np.zeros((0, HASHED_DIM))
    raw = np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8")).digest()[:HASHED_DIM] for t in tokens),
                        dtype=np.uint8).reshape(len(tokens), HASHED_DIM).astype(np.float64)
    v = (raw - 127.5) / 127.5
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.where(n > 0, v / np.where(n > 0, n, 1.0), v)


def hashed_vectors_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    """``(pid, tokens)`` batch -> ``(pid, vecs)``: each distinct token of the batch hashed once."""
    tok = b.column("tokens")
    flat = tok.flatten().dictionary_encode()
    vecs = hashed_vector_np(flat.dictionary.to_pylist())[flat.indices.to_numpy()] if len(flat) else np.zeros((0, HASHED_DIM))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) * HASHED_DIM + 1, HASHED_DIM, dtype=np.int32)),
                                     pa.array(vecs.reshape(-1), pa.float64()))
    offsets = tok.offsets
    if tok.offset != 0 or len(offsets) != len(tok) + 1:
        offsets = pa.array(np.r_[0, np.cumsum(pa.compute.list_value_length(tok).fill_null(0).to_numpy())]
                           .astype(np.int32))
    else:
        offsets = pa.array((offsets.to_numpy() - offsets.to_numpy()[0]).astype(np.int32))
    outer = pa.ListArray.from_arrays(offsets, inner)
    return pa.RecordBatch.from_arrays([b.column("pid"), outer], names=["pid", "vecs"])


def vocabulary_vectors(tokens: DataFrame, encoder: HashedTokenEncoder | None = None) -> DataFrame:
    """``(token, vec)`` for the distinct tokens (the role of a trained word-vector table)."""
    enc = encoder or HashedTokenEncoder()
    return enc.encode_tokens(tokens.select("token").distinct())


def lookup_token_vectors(tokens: DataFrame, vocab: DataFrame, normalize: bool = True) -> DataFrame:
    """Token vector lookup by equi-join, order kept by ``pos``, optional L2 norm.

    Tokens missing from the vocabulary are dropped (D16); :mod:`vicinity.operators.subword` composes theirs.  A
    vocabulary within the broadcast limit is broadcast; beyond it only the vectors of heavy tokens are, of which there
    are at most four times as many as shuffle partitions, and the rest is joined by token.
    """
    v = cut_lineage(vocab.select("token", F.col("vec").alias("_v")))
    cap = broadcast_limit(v.sparkSession) // max(64, 16 * vector_length(v, "_v"))
    if len(v.select(F.lit(1)).take(cap + 1)) <= cap:
        out = tokens.join(F.broadcast(v), "token")
    else:
        # a token that is more than its share of a partition is joined where it stands: by definition there are few
        share = max(1, tokens.count() // (4 * int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        heavy = cut_lineage(tokens.groupBy("token").count().filter(F.col("count") > share).select("token").join(v, "token"))
        light = tokens.join(F.broadcast(heavy.select("token")), "token", "left_anti")
        out = tokens.join(F.broadcast(heavy), "token").unionByName(light.join(v, "token"))
    return out.withColumn("vec", l2_normalize("_v") if normalize else F.col("_v").cast("array<double>")).drop("_v")


def checked_length(vec: str, dim: int):
    """The vector, or an error if it hasn't ``dim`` components."""
    return F.when(F.col(vec).isNull() | (F.size(vec) == dim), F.col(vec)).otherwise(
        F.raise_error(F.concat(F.lit(f"a vector has not {dim} components but "), F.size(vec).cast("string"))))


def vector_length(df: DataFrame, vec: str = "vec") -> int:
    """Number of components of the first vector (0 without rows); the others are checked where they are used."""
    row = df.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    return int(row["d"]) if row else 0


def group_mean(df: DataFrame, keys: list[str], dim: int | None = None, vec: str = "vec", normalize: bool = True) -> DataFrame:
    """Component-wise mean of the vectors of each group, optionally L2-normalised.

    One ``avg`` per component: partial aggregation before the shuffle, no
    collection of group members, so large groups cost nothing extra.  Every
    vector must have ``dim`` components (those of the first row, if not given);
    a ragged input is an error.
    """
    dim = vector_length(df, vec) if dim is None else dim
    src = df.withColumn(vec, checked_length(vec, dim))
    mean = F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)]).cast("array<double>")
    out = src.groupBy(*keys).agg(mean.alias(vec))
    return out.withColumn(vec, l2_normalize(vec)) if normalize else out


def position_vectors(vecs: DataFrame, which: str = "first") -> DataFrame:
    """First-token (``first``), marker (``second``) vectors per passage."""
    pos = {"first": 0, "second": 1}[which]
    return vecs.filter(F.col("pos") == pos).select("pid", "vec")


def inner_vectors(vecs: DataFrame, start: int = 1, end_trim: int = 1) -> DataFrame:
    """Vectors at positions ``start .. len - 1 - end_trim`` (E10 inner tokens, T5 on long tables)."""
    from pyspark.sql import Window
    n = F.max("pos").over(Window.partitionBy("pid")) + 1
    return vecs.withColumn("_n", n).filter((F.col("pos") >= start) & (F.col("pos") < F.col("_n") - end_trim)).drop("_n")


def spread_labels(vecs: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Passage label on every token row."""
    return vecs.join(labels.select("pid", label), "pid")


def pack_vectors(vecs: DataFrame) -> DataFrame:
    """Long table -> ``(pid, vecs ARRAY<ARRAY<DOUBLE>>)`` ordered by pos (E9). One passage per
    group: bounded by the passage length."""
    packed = vecs.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("_p"))
    return packed.select("pid", F.transform("_p", lambda x: x["vec"]).alias("vecs"))


def sequence_tokens(df: DataFrame, marker: str, id_col: str = "pid", text: str = "text",
                    max_length: int | None = None) -> DataFrame:
    """Encoder input sequence ``[CLS] marker tokens [SEP]`` as a long table (T4 + posexplode);
    whole texts unless a ``max_length`` is given."""
    seq = encode_sequence(simple_tokens(text), marker, max_length=max_length)
    return df.select(id_col, F.posexplode(seq).alias("pos", "token"))


_MODELS: dict[str, Callable] = {}  # of this worker process, by encoder


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's instance of an encoder's model; at most two encoders' are kept."""
    if key not in _MODELS:
        while len(_MODELS) >= 2:
            del _MODELS[next(iter(_MODELS))]
        _MODELS[key] = factory()
    return _MODELS[key]


class ArrowBatchEncoder:
    """User model hook (E3 / E4 / E5): ``fn(list[str]) -> list[np.ndarray]`` per Arrow batch.

    ``fn`` returns, per text, a (length, dim) array (multi-vector) or a (dim,)
    array (single vector).  Runs in ``mapInArrow`` with no driver round trip:
    ``fn`` gets at most ``texts_per_call`` texts, and an output batch holds
    about ``MAX_VECTORS`` vectors (or those of one text, if it has more).  The
    id column keeps its type.

    Instead of ``fn``, ``factory`` may be given: it is called once in a worker
    process and what it returns serves all tasks of that worker, so a model is
    loaded once and not pickled into tasks.  ``window`` calls' worth of texts
    are sorted by length before they are dealt to calls, so texts of a call are
    of like length; rows come out in their order.
    """

    MAX_VECTORS = 16_384

    def __init__(self, fn: Callable[[list[str]], list[np.ndarray]] | None = None, multi_vector: bool = True,
                 texts_per_call: int = 512, factory: Callable[[], Callable] | None = None, window: int = 1):
        if (fn is None) == (factory is None):
            raise ValueError("give a function or a factory of one")
        if texts_per_call < 1 or window < 1:
            raise ValueError("texts_per_call and window must be positive")
        self.factory = factory or (lambda: fn)
        self.key = uuid.uuid4().hex
        self.multi_vector = multi_vector
        self.texts_per_call = texts_per_call
        self.window = window

    def encode(self, df: DataFrame, id_col: str = "pid", text: str = "text") -> DataFrame:
        key, factory, multi, step, most = self.key, self.factory, self.multi_vector, self.texts_per_call, self.MAX_VECTORS
        window = step * self.window
        id_type = df.schema[id_col].dataType.simpleString()
        schema = f"{id_col} {id_type}, " + ("pos int, vec array<double>" if multi else "vec array<double>")

        def lists(vectors: np.ndarray) -> pa.Array:
            n, dim = vectors.shape
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dim)),
                                            pa.array(vectors.reshape(-1)))

        def encoded(texts: list) -> list[np.ndarray]:
            fn = _model(key, factory)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
            outs: list = [None] * len(texts)
            for at in range(0, len(order), step):
                call = order[at:at + step]
                for i, m in zip(call, fn([texts[i] for i in call]), strict=True):
                    outs[i] = np.asarray(m, dtype=np.float64)
            return outs

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, window):
                    ids, part = b.column(id_col).slice(at, window), b.column(text).slice(at, window)
                    outs = encoded(part.to_pylist())
                    if not multi:
                        yield pa.RecordBatch.from_arrays([ids, lists(np.stack(outs))], [id_col, "vec"])
                        continue
                    sizes = np.array([len(m) for m in outs])
                    ends = np.cumsum(sizes)
                    lo = 0
                    while lo < len(outs):
                        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
                        n = sizes[lo:hi]
                        if n.sum():
                            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(np.repeat(np.arange(lo, hi), n))), pa.array(pos.astype(np.int32)),
                                 lists(np.concatenate([m for m in outs[lo:hi] if len(m)]))], [id_col, "pos", "vec"])
                        lo = hi

        return df.select(id_col, text).mapInArrow(run, schema)
