"""Hard-negative and n-way tuple sampling.

The reference lists, per anchor, every same-label and every other-label
passage: O(N^2).  Here no candidate pool is ever materialised:

* passages are numbered so that each label is a contiguous position range
  ``[start, start + cnt)`` (N1) in hash order; numbering is done per (label,
  range of the hash) with prefix offsets, ranges sized so that no label is
  ranked in one task, and the order does not depend on their number;
* a uniform draw is an offset into that range (positives: skipping the anchor;
  negatives: an offset into ``[0, N - cnt)`` shifted past the anchor's range)
  followed by one equi-join on the position;
* several distinct draws use Floyd's algorithm (an ``aggregate`` over
  ``sequence``), so negatives are drawn **without replacement** (D21);
* weighted draws over bounded candidate lists use Efraimidis-Spirakis keys
  ``ln(u) / w`` with ``u`` hashed from (seed, anchor, pid) (N11).

All randomness is a function of the seed and ids: reruns after executor loss
give the same tuples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.hashing import uniform
from vicinity.operators.similarity import small_side
from vicinity.session import cut_lineage

POOL_TARGET = 1 << 20       # rows per (label, bucket) numbering group


# --------------------------------------------------------------------------- N1 pools

def running_total(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before, in the order of ``order`` (a key of ``rows``).

    Ranges of the order are summed in tasks of their own and the sums of the ranges before are added (a number per range
    reaches the driver), so no task sees the whole table.
    """
    ranged = cut_lineage(rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("_range").agg(F.sum("_value")).collect())
    before = [(r[0], sum(x[1] for x in sums[:i])) for i, r in enumerate(sums)]
    offsets = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets), "_range")
            .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_range", "_before", "_value"))


def label_pools(passages: DataFrame, seed: int, target: int = POOL_TARGET, many: bool = False):
    """Position numbering with contiguous label ranges.

    ``passages(pid, label)`` -> ``positions(pid, label, gpos)`` and
    ``pools(label, cnt, start)``.  Order: label, uniform hash of the pid, pid.
    ``many``: there may be nearly as many labels as passages, so they are numbered by ranges.
    """
    lc = passages.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    lc = lc.withColumn("nb", F.ceil(F.col("cnt") / F.lit(float(target))))
    pb = (passages.join(small_side(lc.select("label", "nb")), "label")
          .withColumn("u", uniform(seed, F.lit("b"), "pid"))
          .withColumn("b", F.floor(F.col("u") * F.col("nb")).cast("long")))
    counts = pb.groupBy("label", "b").agg(F.count(F.lit(1)).alias("n"))
    if many:
        counts = running_total(counts, ["label", "b"], F.col("n"), "off")
    else:  # prefix offsets over the small (label, bucket) table
        w = Window.orderBy("label", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("off", F.sum("n").over(w) - F.col("n"))
    wr = Window.partitionBy("label", "b").orderBy("u", "pid")
    counts = cut_lineage(counts)
    positions = (pb.join(small_side(counts.select("label", "b", "off")), ["label", "b"])
                 .withColumn("gpos", F.col("off") + F.row_number().over(wr) - 1)
                 .select("pid", "label", "gpos"))
    pools = counts.groupBy("label").agg(F.sum("n").alias("cnt"), F.min("off").alias("start"))
    # both tables feed several branches (anchors, draws, position lookups): compute
    # them once, in the shared checkpoint folder
    return cut_lineage(positions), cut_lineage(pools)


# --------------------------------------------------------------------------- distinct draws

def floyd(seed, tag: str, keys, size: Column, m: Column) -> Column:
    """``m`` distinct offsets in ``[0, size)`` (Floyd's algorithm), in emission order.

    Step j (from size - m to size - 1) picks t uniform in [0, j] hashed from
    (seed, keys, tag, j) and takes j instead when t was already chosen.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def pick(j):
        return F.floor(uniform(seed, *keys, F.lit(tag), j) * (j + 1)).cast("long")
    seq = F.when(m > 0, F.sequence((size - m).cast("long"), (size - 1).cast("long"))).otherwise(
        F.array().cast("array<long>"))
    return F.aggregate(seq, F.array().cast("array<long>"),
                       lambda acc, j: F.when(F.array_contains(acc, pick(j)), F.concat(acc, F.array(j)))
                       .otherwise(F.concat(acc, F.array(pick(j)))))


def _anchors(positions: DataFrame, pools: DataFrame) -> DataFrame:
    return (positions.join(small_side(pools), "label")
            .select(F.col("pid").alias("anchor"), "label", "cnt", "start",
                    (F.col("gpos") - F.col("start")).alias("lpos")))


def _to_pid(draws: DataFrame, positions: DataFrame) -> DataFrame:
    return draws.join(positions.select("gpos", "pid"), "gpos").drop("gpos")


def _positive_gpos(seed) -> Column:
    """Uniform same-label position skipping the anchor; the anchor itself when alone."""
    o = F.floor(uniform(seed, "anchor", F.lit("pos")) * (F.col("cnt") - 1)).cast("long")
    local = o + F.when(o >= F.col("lpos"), 1).otherwise(0)
    return F.when(F.col("cnt") > 1, F.col("start") + local).otherwise(F.col("start") + F.col("lpos"))


def _negative_gpos(o: Column) -> Column:
    """Offset in ``[0, N - cnt)`` -> global position outside the anchor's label range."""
    return F.when(o < F.col("start"), o).otherwise(o + F.col("cnt"))


# --------------------------------------------------------------------------- N2 / N4 random tuples

def random_tuples(passages: DataFrame, nway: int, seed: int) -> DataFrame:
    """Anchor, 1 uniform positive (same label, not self), ``nway-2`` distinct uniform
    negatives (other labels) -> ``(anchor, slot, pid)`` (N2 + N11 uniform)."""
    if nway < 3:
        raise ValueError("n-way tuples need at least anchor, positive, negative")
    positions, pools = label_pools(passages, seed)
    n_total = passages.count()
    a = _anchors(positions, pools)
    pos = a.select("anchor", F.lit(1).alias("slot"), _positive_gpos(seed).alias("gpos"))
    m_neg = F.lit(n_total) - F.col("cnt")
    neg = (a.withColumn("sel", floyd(seed, "neg", "anchor", m_neg, F.least(F.lit(nway - 2), m_neg)))
           .select("anchor", "start", "cnt", F.posexplode("sel").alias("k", "o"))
           .select("anchor", (F.col("k") + 2).alias("slot"), _negative_gpos(F.col("o")).alias("gpos")))
    drawn = _to_pid(pos.unionByName(neg), positions)
    own = passages.select(F.col("pid").alias("anchor"), F.lit(0).alias("slot"), "pid")
    return own.unionByName(drawn.select("anchor", "slot", "pid")).withColumn("slot", F.col("slot").cast("int"))


def classwise_tuples(passages: DataFrame, nway: int, seed: int) -> DataFrame:
    """Equal number of negatives from every other class (N4; D3 fixed: ``(nway-2)/(L-1)``
    per other class, self excluded from positives)."""
    positions, pools = label_pools(passages, seed)
    labels = [r["label"] for r in pools.select("label").orderBy("label").collect()]  # L rows
    L = len(labels)
    if L < 2 or (nway - 2) % (L - 1) != 0:
        raise ValueError("nway must be 2 + n * (num_labels - 1)")
    per = (nway - 2) // (L - 1)
    a = _anchors(positions, pools)
    pos = a.select("anchor", F.lit(1).alias("slot"), _positive_gpos(seed).alias("gpos"))
    other = (a.select("anchor", F.col("label").alias("own"),
                      F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
             .filter(F.col("label") != F.col("own")).join(small_side(pools), "label"))
    ci = F.dense_rank().over(Window.partitionBy("anchor").orderBy("label")) - 1  # bounded: L-1 rows per anchor
    neg = (other.withColumn("ci", ci)
           .withColumn("sel", floyd(seed, "cw", ["anchor", "label"], F.col("cnt"), F.least(F.lit(per), F.col("cnt"))))
           .select("anchor", "ci", "start", F.posexplode("sel").alias("k", "o"))
           .select("anchor", (F.col("ci") * per + F.col("k") + 2).alias("slot"),
                   (F.col("start") + F.col("o")).alias("gpos")))
    drawn = _to_pid(pos.unionByName(neg), positions)
    own = passages.select(F.col("pid").alias("anchor"), F.lit(0).alias("slot"), "pid")
    return own.unionByName(drawn.select("anchor", "slot", "pid")).withColumn("slot", F.col("slot").cast("int"))


# --------------------------------------------------------------------------- N5 / N7 searched candidates

def searched_candidates(matches: DataFrame, passages: DataFrame, n_pos: int, n_neg: int, seed: int,
                        positive_always_random: bool = False) -> DataFrame:
    """Split own search matches into same-label positives and other-label negatives
    (self removed, order and scores kept) and fill deficits with random
    non-retrieved passages scored at the minimum retrieved score, or 1 (N5, N7, N8).

    -> ``(anchor, role, pid, score, ord, is_fill)``; ``ord`` is the candidate order
    (retrieved by rank, then fill-ups, numbered on from the anchor's last rank), used by rank weights.
    """
    positions, pools = label_pools(passages, seed)
    n_total = passages.count()
    lab = passages.select("pid", "label")
    m = (matches.filter(F.col("pid") != F.col("qid"))
         .join(lab.withColumnRenamed("pid", "qid").withColumnRenamed("label", "alabel"), "qid")
         .join(lab, "pid")
         .select(F.col("qid").alias("anchor"), "rank", "pid", "score",
                 F.when(F.col("label") == F.col("alabel"), F.lit("pos")).otherwise(F.lit("neg")).alias("role")))
    if positive_always_random:
        m = m.filter(F.col("role") == "neg")
    m = cut_lineage(m)          # labelled matches feed the split, the stats and the fill-ups
    ret = m.select("anchor", "role", "pid", "score", F.col("rank").cast("long").alias("ord"),
                   F.lit(False).alias("is_fill"))
    stats = m.groupBy("anchor").agg(
        F.max("rank").cast("long").alias("lastrank"),
        F.sum(F.when(F.col("role") == "pos", 1).otherwise(0)).alias("npos"),
        F.sum(F.when(F.col("role") == "neg", 1).otherwise(0)).alias("nneg"),
        F.min(F.when(F.col("role") == "pos", F.col("score"))).alias("minpos"),
        F.min(F.when(F.col("role") == "neg", F.col("score"))).alias("minneg"))
    a = (_anchors(positions, pools).join(stats, "anchor", "left")
         .fillna({"npos": 0, "nneg": 0, "lastrank": 0}))
    size_pos = F.col("cnt") - 1
    size_neg = F.lit(n_total) - F.col("cnt")
    # always-random positives (N8): the reference lists the whole label pool with
    # uniform weights and draws one; drawing the one positive uniformly from the
    # pool is the same distribution without materialising the pool
    want_pos = F.least(F.lit(1 if positive_always_random else n_pos), size_pos)
    dpos = F.greatest(want_pos - F.col("npos"), F.lit(0))
    dneg = F.greatest(F.least(F.lit(n_neg), size_neg) - F.col("nneg"), F.lit(0))
    a = a.withColumn("dpos", dpos).withColumn("dneg", dneg)

    # positives: Floyd over the pool minus self, enough draws to survive removing retrieved ones
    fp = (a.filter(F.col("dpos") > 0)
          .withColumn("sel", floyd(seed, "fp", "anchor", size_pos, F.least(size_pos, F.col("dpos") + F.col("npos"))))
          .select("anchor", "start", "lpos", "dpos", "minpos", "lastrank", F.explode("sel").alias("o"))
          .withColumn("gpos", F.col("start") + F.col("o") + F.when(F.col("o") >= F.col("lpos"), 1).otherwise(0))
          .select("anchor", "gpos", "lastrank", F.coalesce("minpos", F.lit(1.0)).alias("score"),
                  F.lit("pos").alias("role"), F.col("dpos").alias("need")))
    fn = (a.filter(F.col("dneg") > 0)
          .withColumn("sel", floyd(seed, "fn", "anchor", size_neg, F.least(size_neg, F.col("dneg") + F.col("nneg"))))
          .select("anchor", "start", "cnt", "dneg", "minneg", "lastrank", F.explode("sel").alias("o"))
          .withColumn("gpos", _negative_gpos(F.col("o")))
          .select("anchor", "gpos", "lastrank", F.coalesce("minneg", F.lit(1.0)).alias("score"),
                  F.lit("neg").alias("role"), F.col("dneg").alias("need")))
    fills = _to_pid(fp.unionByName(fn), positions)
    fills = fills.join(ret.select("anchor", "pid"), ["anchor", "pid"], "left_anti")
    wf = Window.partitionBy("anchor", "role").orderBy(uniform(seed, "anchor", "pid", F.lit("f")), "pid")
    fills = (fills.withColumn("fi", F.row_number().over(wf)).filter(F.col("fi") <= F.col("need"))
             .select("anchor", "role", "pid", "score", (F.col("lastrank") + F.col("fi")).cast("long").alias("ord"),
                     F.lit(True).alias("is_fill")))
    return ret.unionByName(fills)


def missing_report(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Average number of fill-up (non-retrieved) positives / negatives per anchor."""
    filled = candidates.filter("is_fill").groupBy("anchor").agg(
        F.sum(F.when(F.col("role") == "pos", 1).otherwise(0)).alias("mp"),
        F.sum(F.when(F.col("role") == "neg", 1).otherwise(0)).alias("mn"))
    return (anchors.select("anchor").join(filled, "anchor", "left")
            .agg(F.round(F.avg(F.coalesce("mp", F.lit(0))), 9).alias("missing_pos"),
                 F.round(F.avg(F.coalesce("mn", F.lit(0))), 9).alias("missing_neg")))


# --------------------------------------------------------------------------- N9 weights / N11 draws

def candidate_weights(candidates: DataFrame, probability: str = "scores", lower_ranked_positives: bool = False,
                      uniform_positives: bool = False) -> DataFrame:
    """Min-max normalised weights per (anchor, role) (N9; D8, D9).

    ``scores``: the similarity scores; ``ranks``: n..1 in candidate order
    (flipped for positives with ``lower_ranked_positives``); ``uniform``: 1.
    All-equal inputs, or a single candidate, give uniform weight 1.
    """
    w = Window.partitionBy("anchor", "role")
    if probability == "scores":
        x = F.col("score")
    elif probability == "ranks":
        n = F.count(F.lit(1)).over(w)
        idx = F.row_number().over(w.orderBy("ord")) - 1
        x = (n - idx).cast("double")
        if lower_ranked_positives:
            x = F.when(F.col("role") == "pos", (idx + 1).cast("double")).otherwise(x)
    elif probability == "uniform":
        x = F.lit(1.0)
    else:
        raise ValueError(probability)
    c = candidates.withColumn("_x", x)
    mn, mx = F.min("_x").over(w), F.max("_x").over(w)
    weight = F.when(mx > mn, (F.col("_x") - mn) / (mx - mn)).otherwise(F.lit(1.0))
    if uniform_positives:
        weight = F.when(F.col("role") == "pos", F.lit(1.0)).otherwise(weight)
    return c.withColumn("weight", weight).drop("_x")


def draw_tuples(weighted: DataFrame, nway: int, seed: int) -> DataFrame:
    """Anchor, 1 positive by weight, ``nway-2`` negatives by weight without
    replacement (Efraimidis-Spirakis; zero weights only after all others) (N11)."""
    u = uniform(seed, "anchor", "pid", "role")
    key = F.when(F.col("weight") > 0, F.log(u) / F.col("weight"))
    w = Window.partitionBy("anchor", "role").orderBy(
        (F.col("weight") > 0).desc(), F.col("_key").desc(), F.col("_u").desc(), F.col("pid"))
    r = (weighted.withColumn("_u", u).withColumn("_key", key)
         .withColumn("_r", F.row_number().over(w)))
    pos = r.filter((F.col("role") == "pos") & (F.col("_r") == 1)).select("anchor", F.lit(1).alias("slot"), "pid")
    neg = (r.filter((F.col("role") == "neg") & (F.col("_r") <= nway - 2))
           .select("anchor", (F.col("_r") + 1).alias("slot"), "pid"))
    own = weighted.select("anchor").distinct().select("anchor", F.lit(0).alias("slot"), F.col("anchor").alias("pid"))
    # an anchor alone in its label has no positive: the anchor itself takes the slot
    lone = (own.join(pos.select("anchor"), "anchor", "left_anti")
            .select("anchor", F.lit(1).alias("slot"), F.col("anchor").alias("pid")))
    return own.unionByName(pos).unionByName(lone).unionByName(neg).withColumn("slot", F.col("slot").cast("int"))


def materialise_tuples(tuples: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """Passages of each tuple in slot order plus target label 0 (the positive is first)."""
    j = tuples.join(passages.select("pid", text), "pid")
    packed = j.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", text))).alias("_t"))
    return packed.select("anchor", F.transform("_t", lambda x: x[text]).alias("texts"), F.lit(0).alias("target"))


# --------------------------------------------------------------------------- N3 / N6 multi-label

def searched_candidates_ml(matches: DataFrame, passages: DataFrame) -> DataFrame:
    """Multi-label split of own matches: positives share >= 1 label, negatives none."""
    lab = passages.select("pid", "labels")
    return (matches.filter(F.col("pid") != F.col("qid"))
            .join(lab.withColumnRenamed("pid", "qid").withColumnRenamed("labels", "alabels"), "qid")
            .join(lab, "pid")
            .select(F.col("qid").alias("anchor"), "rank", "pid", "score",
                    F.when(F.arrays_overlap("labels", "alabels"), F.lit("pos")).otherwise(F.lit("neg")).alias("role")))


def searched_filled_ml(matches: DataFrame, passages: DataFrame, k: int, n_pos: int, n_neg: int, seed: int) -> DataFrame:
    """Multi-label searched candidates with fill-ups (N6, N7): ``(anchor, role, pid, score, ord, is_fill)``.

    ``matches`` hold at most ``k`` rows per anchor.  An anchor short of positives or negatives gets random non-retrieved
    ones that share a label or none, at the lowest retrieved score of the role or 1.  The draws are those of
    :func:`random_candidates_ml` with ``k`` spare ones, so enough remain when the retrieved are taken out.
    """
    m = cut_lineage(searched_candidates_ml(matches, passages))
    ret = m.select("anchor", "role", "pid", "score", F.col("rank").cast("long").alias("ord"), F.lit(False).alias("is_fill"))
    stats = m.groupBy("anchor").agg(
        F.max("rank").cast("long").alias("lastrank"),
        *(f(F.when(F.col("role") == r, x)).alias(f"{n}{r}") for r in ("pos", "neg")
          for f, x, n in ((F.count, F.lit(1), "n"), (F.min, F.col("score"), "min"))))
    draws = random_candidates_ml(passages, n_pos + k if n_pos else 0, n_neg + k if n_neg else 0, seed)
    fresh = (draws.join(ret.select("anchor", "pid"), ["anchor", "pid"], "left_anti")
             .join(stats, "anchor", "left").fillna({"lastrank": 0, "npos": 0, "nneg": 0}))
    positive = F.col("role") == "pos"
    need = F.when(positive, F.lit(n_pos) - F.col("npos")).otherwise(F.lit(n_neg) - F.col("nneg"))
    score = F.coalesce(F.when(positive, F.col("minpos")).otherwise(F.col("minneg")), F.lit(1.0))
    w = Window.partitionBy("anchor", "role").orderBy("i")
    fills = (fresh.withColumn("fi", F.row_number().over(w)).filter(F.col("fi") <= need)
             .select("anchor", "role", "pid", score.alias("score"), (F.col("lastrank") + F.col("fi")).cast("long").alias("ord"),
                     F.lit(True).alias("is_fill")))
    return ret.unionByName(fills)


def signature_pools(passages: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Numbering of multi-label passages by their label sets: ``positions(pid, sig, gpos)`` and ``related(sig, starts, ends)``.

    Labels are ranked by frequency and passages ordered by their ascending list of ranks, so passages with one label set
    (a signature) are neighbours, and those with a frequent label form a few ranges: the commonest one range, the next at
    most two, and a rare label has few signatures.  ``related``: the disjoint ranges of positions, ascending, whose
    passages share a label with the signature; all others share none.
    """
    lab = passages.select("pid", F.array_distinct(F.coalesce("labels", F.array().cast(passages.schema["labels"].dataType))).alias("labels"))
    sets = cut_lineage(lab.select("pid", F.array_sort("labels").alias("labels")))
    counts = sets.groupBy("labels").agg(F.count(F.lit(1)).alias("cnt"))
    exploded = cut_lineage(counts.select("labels", "cnt", F.explode("labels").alias("label")))
    frequency = exploded.groupBy("label").agg(F.sum("cnt").alias("n")).withColumn("_less", -F.col("n"))
    ranks = cut_lineage(running_total(frequency, ["_less", "label"], F.lit(1), "lr").select("label", "lr"))
    keys = (exploded.join(small_side(ranks), "label").groupBy("labels").agg(F.array_sort(F.collect_list("lr")).alias("key")))
    keyed = counts.join(keys, "labels", "left").withColumn("key", F.coalesce("key", F.array().cast("array<bigint>")))
    signatures = cut_lineage(running_total(keyed, ["key"], F.lit(1), "sig"))
    positions, pools = label_pools(sets.join(small_side(signatures.select("labels", "sig")), "labels")
                                   .select("pid", F.col("sig").alias("label")), seed, many=True)
    # ranges of neighbouring signatures that have a label: those without a predecessor begin one, without a successor end it
    held = cut_lineage(signatures.select("sig", F.explode("key").alias("lr")))
    ends = []
    for step, name in ((1, "first"), (-1, "last")):
        beside = held.select((F.col("sig") + step).alias("sig"), "lr")
        w = Window.partitionBy("lr").orderBy("sig")  # the ranges of a label
        ends.append(held.join(beside, ["sig", "lr"], "left_anti").withColumn("i", F.row_number().over(w))
                    .select("lr", "i", F.col("sig").alias(name)))
    spans = pools.select(F.col("label").alias("sig"), "start", (F.col("start") + F.col("cnt")).alias("stop"))
    ranges = (ends[0].join(ends[1], ["lr", "i"]).join(spans.select(F.col("sig").alias("first"), "start"), "first")
              .join(spans.select(F.col("sig").alias("last"), "stop"), "last").select("lr", "start", "stop"))
    parts = (held.join(small_side(ranges), "lr").groupBy("sig")
             .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("parts")))

    def merge(batches):
        for b in batches:
            parts, sizes = b.column("parts"), pc.list_value_length(b.column("parts")).to_numpy(zero_copy_only=False)
            start, stop = (parts.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            out, at = [], 0
            for n in sizes:
                reach = np.maximum.accumulate(stop[at:at + n])
                heads = np.flatnonzero(np.concatenate(([True], start[at + 1:at + n] > reach[:-1])))
                out.append((start[at:at + n][heads], reach[np.append(heads[1:], n) - 1]))
                at += n
            yield pa.RecordBatch.from_arrays(
                [b.column("sig"), *(pa.array([o[i] for o in out], pa.list_(pa.int64())) for i in (0, 1))], ["sig", "starts", "ends"])

    related = cut_lineage(parts.mapInArrow(merge, "sig long, starts array<long>, ends array<long>"))
    return cut_lineage(positions.select("pid", F.col("label").alias("sig"), "gpos")), related


def random_candidates_ml(passages: DataFrame, n_pos: int, n_neg: int, seed: int) -> DataFrame:
    """``(anchor, role, i, pid)``: multi-label random candidates (N3), uniform and without replacement.

    Per anchor ``n_pos`` other passages that share a label and ``n_neg`` that share none, or all where there are fewer, in
    the order of the draw (``i`` from 0).  :func:`signature_pools` says which positions share a label, so a draw is a rank
    among those that do or among those that don't (Floyd), turned into a position by the prefix sums of the ranges: the
    work is one row an anchor and one a draw, however few passages qualify.
    """
    positions, related = signature_pools(passages, seed)
    total = positions.count()
    starts, ends = (F.coalesce(c, F.array().cast("array<long>")) for c in ("starts", "ends"))
    shared = F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    anchors = (positions.join(small_side(related), "sig", "left")
               .select(F.col("pid").alias("anchor"), "gpos", starts.alias("starts"), ends.alias("ends"),
                       F.greatest(shared, F.lit(1)).alias("size")))  # an anchor without labels is related to itself
    picks = []
    for role, n, size in (("pos", n_pos, F.col("size") - 1), ("neg", n_neg, F.lit(total) - F.col("size"))):
        picks.append(floyd(seed, role, "anchor", size, F.least(F.lit(n), size)).alias(role))
    drawn = anchors.select("anchor", "gpos", "starts", "ends", *picks)
    kind = positions.schema["pid"].dataType.simpleString()

    def place(batches):
        for b in batches:
            found = {"pos": [], "neg": []}
            for row in b.select(["gpos", "starts", "ends", "pos", "neg"]).to_pylist():
                own = row["gpos"]
                first, last = np.array(row["starts"] or [own], np.int64), np.array(row["ends"] or [own + 1], np.int64)
                inside = np.concatenate(([0], np.cumsum(last - first)))   # related positions before each range
                outside = first - inside[:-1]                             # others before it
                j = int(np.searchsorted(first, own, side="right")) - 1
                r = np.array(row["pos"], np.int64)
                r += r >= inside[j] + own - first[j]                       # the anchor itself is none
                at = np.searchsorted(inside, r, side="right") - 1
                found["pos"].append(first[at] + r - inside[at])
                r = np.array(row["neg"], np.int64)
                found["neg"].append(r + inside[np.searchsorted(outside, r, side="right")])
            for role, places in found.items():
                n = np.array([len(p) for p in places], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("anchor").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([role] * int(n.sum()), pa.string()),
                     pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)),
                     pa.array(np.concatenate(places) if places else np.zeros(0, np.int64), pa.int64())], ["anchor", "role", "i", "gpos"])

    return _to_pid(drawn.mapInArrow(place, f"anchor {kind}, role string, i long, gpos long"), positions)


def random_tuples_ml(passages: DataFrame, nway: int, seed: int) -> DataFrame:
    """Multi-label random tuples (N3): ``(anchor, slot, pid)``; the positive shares a label (the anchor itself when no
    other passage does, as the reference warns), the ``nway - 2`` negatives share none."""
    drawn = cut_lineage(random_candidates_ml(passages, 1, nway - 2, seed))
    own = passages.select(F.col("pid").alias("anchor"), F.lit(0).alias("slot"), "pid")
    positive = drawn.filter("role = 'pos'").select("anchor", F.lit(1).alias("slot"), "pid")
    lone = (own.join(positive.select("anchor"), "anchor", "left_anti").withColumn("slot", F.lit(1)))
    negative = drawn.filter("role = 'neg'").select("anchor", (F.col("i") + 2).alias("slot"), "pid")
    return (own.unionByName(positive).unionByName(lone).unionByName(negative)
            .withColumn("slot", F.col("slot").cast("int")))
