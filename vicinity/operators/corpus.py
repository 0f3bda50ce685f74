"""Labelled-corpus preparation.

Label lists are handled in exploded long form (``pid, pos, label``) so every
step is a shuffle-friendly join or aggregate; the label dictionary is a small
table (one row per distinct label).  Seeded selections (splits, subsamples,
per-class caps) use :func:`exact_cut`, which picks exactly ``quota`` rows per
group by the md5 order without sorting any whole group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vicinity.functions.hashing import uniform
from vicinity.operators.similarity import small_side

CUT_ROWS = 1 << 16      # rows of a hash bucket of a seeded selection, whatever the table size


# --------------------------------------------------------------------------- P1 / P2 / P3

def column_contract(df: DataFrame, required: dict[str, str] | list[str], drop: list[str] | None = None) -> DataFrame:
    """Check presence, rename to canonical names (``{source: target}``), drop listed columns."""
    mapping = dict(required) if isinstance(required, dict) else {c: c for c in required}
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available {df.columns}")
    for src, dst in mapping.items():
        if src != dst:
            df = df.withColumnRenamed(src, dst)
    return df.drop(*(drop or []))


def concat_fields(title, text, sep: str = " \n"):
    """``title + " \\n" + text``."""
    t = F.col(title) if isinstance(title, str) else title
    x = F.col(text) if isinstance(text, str) else text
    return F.concat(t, F.lit(sep), x)


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop rows with empty or null text."""
    return df.filter(F.length(F.col(text)) > 0)


# --------------------------------------------------------------------------- P16

def map_rows(df: DataFrame, fn: Callable, added: str, columns: list[str] | None = None, remove: list[str] | tuple = (),
             batched: bool = False, index_by: str | None = None, **options) -> DataFrame:
    """Columns computed by a Python function, in Arrow batches (P16): ``df`` without ``remove`` and with ``added`` (DDL).

    ``fn`` gets the values of ``columns`` (all, unless given) in order and ``options`` by name, and returns a dictionary with
    the added columns; with ``batched`` it gets and returns a list a column.  ``index_by`` names a unique column: the row's
    place in its order, from 0, is then the last positional argument (numbered by ranges, not in one task).  An added
    column replaces one of its name.  Prefer column expressions where they can say it.
    """
    new = T.StructType.fromDDL(added)
    absent = [c for c in [*(columns or []), *remove, *([index_by] if index_by else [])] if c not in df.columns]
    if absent:
        raise ValueError(f"no columns {absent}; available {df.columns}")
    names = list(columns or df.columns)
    kept = [c for c in df.columns if c not in remove and c not in new.names]
    src = df.select(*dict.fromkeys([*kept, *names, *([index_by] if index_by else [])]))
    if index_by:
        from vicinity.operators.sampling import running_total
        src = running_total(src, [index_by], F.lit(1), "_index")
        names.append("_index")
    kinds = {f.name: to_arrow_type(f.dataType) for f in new}

    def run(batches):
        for b in batches:
            values = [b.column(c).to_pylist() for c in names]
            if batched:
                out = fn(*values, **options)
            else:
                rows = [fn(*row, **options) for row in zip(*values)]
                out = {c: [r[c] for r in rows] for c in kinds}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(out[c], k) for c, k in kinds.items())],
                                             [*kept, *kinds])

    return src.mapInArrow(run, T.StructType([*(src.schema[c] for c in kept), *new]))


# --------------------------------------------------------------------------- P4 / P5 / P6

def explode_labels(df: DataFrame, labels: str = "labels", id_col: str = "pid") -> DataFrame:
    return df.select(id_col, *([c for c in ("split",) if c in df.columns]),
                     F.posexplode(labels).alias("pos", "label"))


def label_counts_train(long: DataFrame, split_col: str = "split", train: str = "train") -> DataFrame:
    return long.filter(F.col(split_col) == train).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_dictionary(long: DataFrame, keep: DataFrame, split_col: str = "split", train: str = "train",
                     id_col: str = "pid") -> DataFrame:
    """Dense ids ``0..L-1`` in first-seen order over the train rows (P5).

    First seen = smallest ``(pid, pos)``.  The window runs over the distinct
    label table only (one row per label).
    """
    first = (long.filter(F.col(split_col) == train).join(keep.select("label"), "label", "left_semi")
             .groupBy("label").agg(F.min(F.struct(id_col, "pos")).alias("first")))
    return first.select(F.col("label").alias("name"),
                        (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label_id"))


def prune_and_reindex(df: DataFrame, min_count: int, labels: str = "topics", id_col: str = "pid"):
    """P4 + P5 + P6: drop labels seen fewer than ``min_count`` times in train (from
    train and test), re-index to dense ids, collapse duplicates, drop rows left
    without labels.  Returns ``(rows(pid, split, labels ARRAY<INT>), dictionary)``.
    """
    long = explode_labels(df, labels, id_col)
    keep = label_counts_train(long).filter(F.col("n") >= min_count)
    dictionary = label_dictionary(long, keep, id_col=id_col)
    dictionary = small_side(dictionary)
    ids = (long.join(dictionary, long["label"] == dictionary["name"])
           .groupBy(id_col, "split").agg(F.array_sort(F.collect_set("label_id")).alias("labels")))
    return ids.filter(F.size("labels") > 0), dictionary


def single_label_reduction(ml: DataFrame, min_count: int = 2, id_col: str = "pid"):
    """Keep rows with exactly one label, ``label = labels[0]``, drop labels with fewer than
    ``min_count`` train rows, re-index in first-seen train order.  Returns ``(rows, dictionary)``
    with the dictionary mapping old id (``name``) -> new id."""
    one = ml.filter(F.size("labels") == 1).select(id_col, "split", F.element_at("labels", 1).alias("label"))
    long = one.withColumn("pos", F.lit(0))
    keep = label_counts_train(long).filter(F.col("n") >= min_count)
    dictionary = small_side(label_dictionary(long, keep, id_col=id_col))
    rows = one.join(dictionary, one["label"] == dictionary["name"]).select(
        id_col, "split", F.col("label_id").alias("label"))
    return rows, dictionary


def decode_labels(df: DataFrame, dictionary: DataFrame, label: str = "label", unknown: str = "?") -> DataFrame:
    """id -> name by a dictionary join; missing names become ``'?'``."""
    d = small_side(dictionary.select(F.col("label_id").alias("_lid"), F.col("name").alias("_name")))
    return (df.join(d, df[label] == d["_lid"], "left")
            .withColumn("name", F.coalesce(F.col("_name").cast("string"), F.lit(unknown))).drop("_lid", "_name"))


def coarse_label(name) -> F.Column:
    """Super-label: the part before ``:``."""
    return F.split_part(F.col(name) if isinstance(name, str) else name, F.lit(":"), F.lit(1))


def fine_label(name) -> F.Column:
    return F.split_part(F.col(name) if isinstance(name, str) else name, F.lit(":"), F.lit(2))


# --------------------------------------------------------------------------- P10-P13 seeded selections

def exact_cut(df: DataFrame, quota: DataFrame | int, seed: int, id_col: str = "pid",
              keys: list[str] | None = None, flag: str = "selected", n_rows: int | None = None) -> DataFrame:
    """Flag exactly ``quota`` rows per key group: the smallest ``(u, id)`` with
    ``u = uniform(seed, id)``.

    Rows are put into buckets of ``u``, as many as keep a bucket at about
    ``CUT_ROWS`` rows (``n_rows`` is counted unless given); a histogram per
    (group, bucket) finds the boundary bucket, whole buckets are taken or left,
    and only rows of the boundary bucket are ranked - a bounded window, never a
    sort of a whole (possibly dominant) group in one task.  The selection
    does not depend on the number of buckets.
    """
    buckets = max(64, math.ceil((df.count() if n_rows is None else n_rows) / CUT_ROWS))
    keys = list(keys or [])
    u = uniform(seed, id_col)
    d = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets).cast("long"))
    hist = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w))
    if isinstance(quota, int):
        hist = hist.withColumn("_quota", F.lit(int(quota)))
    else:
        hist = hist.join(quota.withColumnRenamed("quota", "_quota"), keys, "left").fillna({"_quota": 0})
    take = (F.when(F.col("_cum") <= F.col("_quota"), F.lit(-1))
            .when(F.col("_cum") - F.col("_cnt") < F.col("_quota"), F.col("_quota") - (F.col("_cum") - F.col("_cnt")))
            .otherwise(F.lit(0)))
    hist = hist.select(*keys, "_b", take.alias("_take"))
    j = d.join(hist, keys + ["_b"])
    whole = j.filter(F.col("_take") <= 0).withColumn(flag, F.col("_take") == -1)
    wr = Window.partitionBy(*keys, "_b").orderBy("_u", id_col)
    edge = (j.filter(F.col("_take") > 0).withColumn("_rn", F.row_number().over(wr))
            .withColumn(flag, F.col("_rn") <= F.col("_take")).drop("_rn"))
    return whole.unionByName(edge).drop("_u", "_b", "_take")


def _target(n: int, size: int | float) -> int:
    if isinstance(size, float) and size < 1.0:
        return int(math.ceil(size * n))
    return int(size)


def random_split(df: DataFrame, size: int | float, seed: int, id_col: str = "pid",
                 names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Seeded split; ``size`` rows (int) or ``ceil(size * n)`` (fraction) go to ``names[1]`` (P10)."""
    n = df.count()
    cut = exact_cut(df, _target(n, size), seed, id_col, flag="_sel", n_rows=n)
    return cut.withColumn("split", F.when(F.col("_sel"), F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_sel")


def stratified_quota(df: DataFrame, size: int | float, label: str = "label") -> DataFrame:
    """Per-label quotas proportional to class size; largest remainders (ties: smaller label)
    get the leftover rows so quotas sum to the requested size (P11)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_l"))
    total = F.sum("n_l").over(Window.partitionBy())
    if isinstance(size, float) and size < 1.0:
        target = F.ceil(F.lit(float(size)) * total)
    else:
        target = F.lit(int(size))
    c = counts.withColumn("_t", target).withColumn("_n", total)
    c = c.withColumn("_exact", F.col("_t") * F.col("n_l") / F.col("_n"))
    c = c.withColumn("_floor", F.floor("_exact")).withColumn("_frac", F.col("_exact") - F.col("_floor"))
    c = c.withColumn("_left", F.col("_t") - F.sum("_floor").over(Window.partitionBy()))
    c = c.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_frac").desc(), F.col(label))))
    return c.select(label, (F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
                    .cast("long").alias("quota"))


def stratified_split(df: DataFrame, size: int | float, seed: int, label: str = "label", id_col: str = "pid",
                     names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Class proportions kept; exactly the stratified quota per label goes to ``names[1]``."""
    q = stratified_quota(df, size, label)
    cut = exact_cut(df, q, seed, id_col, keys=[label], flag="_sel")
    return cut.withColumn("split", F.when(F.col("_sel"), F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_sel")


def subsample(df: DataFrame, size: int | float | None, seed: int, stratify: bool = False,
              label: str = "label", id_col: str = "pid") -> DataFrame:
    """``None`` = identity, int = rows, float = fraction; optional stratification."""
    if size is None:
        return df
    if stratify:
        cut = exact_cut(df, stratified_quota(df, size, label), seed, id_col, keys=[label], flag="_sel")
    else:
        n = df.count()
        cut = exact_cut(df, _target(n, size), seed, id_col, flag="_sel", n_rows=n)
    return cut.filter("_sel").drop("_sel")


def subsample_passages(vecs: DataFrame, size: int | float, seed: int, id_col: str = "pid") -> DataFrame:
    """Multi-vector form: sample passage ids, keep all their vectors (semi join)."""
    ids = vecs.select(id_col).distinct()
    picked = subsample(ids, size, seed, id_col=id_col)
    return vecs.join(picked, id_col, "left_semi")


def cap_per_class(df: DataFrame, n: int, seed: int, label: str = "label", id_col: str = "pid") -> DataFrame:
    """At most ``n`` rows per class, without replacement, by md5 order."""
    q = df.groupBy(label).agg(F.least(F.count(F.lit(1)), F.lit(int(n))).alias("quota"))
    return exact_cut(df, q, seed, id_col, keys=[label], flag="_sel").filter("_sel").drop("_sel")


# --------------------------------------------------------------------------- M1-M3

def label_frequency(df: DataFrame, label: str = "label", multilabel: bool = False,
                    by: list[str] | None = None) -> DataFrame:
    """Label counts, exploding label lists for multi-label data (M1)."""
    col = F.explode(label).alias("label") if multilabel else F.col(label).alias("label")
    return df.select(*(by or []), col).groupBy(*(by or []), "label").agg(F.count(F.lit(1)).alias("n"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def frequency_curve(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Counts in descending order with their rank (M3, W3); runs on the small count table."""
    w = Window.orderBy(F.col(n).desc(), F.col(label).asc())
    return counts.select(F.row_number().over(w).cast("int").alias("rank"), label, n)
