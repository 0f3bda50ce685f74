"""Neighbour-vote classification (C1, C2, C7) and the linear-head baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_LABEL = -1


def _ks_col(ks) -> F.Column:
    return F.array(*[F.lit(int(k)) for k in sorted(set(ks))])


def _class_id(label: str, rows: DataFrame) -> F.Column:
    """The label as an int; an error for labels that are no class ids (from 0 on, or -1 for none)."""
    kind = rows.schema[label].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"labels are integers, not {kind}; number them with corpus.label_dictionary")
    c = F.col(label)
    return F.when(c.isNull() | c.between(MISSING_LABEL, (1 << 31) - 1), c).otherwise(
        F.raise_error(F.concat(F.lit("no class id: "), c.cast("string")))).cast("int").alias("label")


def knn_vote(matches: DataFrame, pid_labels: DataFrame, queries: DataFrame, ks,
             ignore_missing: bool = False) -> DataFrame:
    """Majority label of the first k matches, for every k in ``ks`` from one search.

    ``matches(qid, rank, pid)``, ``pid_labels(pid, label)``, ``queries(qid)``
    -> ``(k, qid, pred)``.  Ties go to the smallest label.  With the default
    ``ignore_missing=False`` each missing neighbour (fewer than k matches, or
    a match without label) votes the label -1, as the padded tensors of the
    reference do; queries without any match therefore predict -1.
    """
    ks = sorted({int(k) for k in ([ks] if isinstance(ks, int) else ks)})
    hits = (matches.select("qid", "rank", "pid")
            .join(pid_labels.select("pid", _class_id("label", pid_labels)), "pid", "left")
            .withColumn("label", F.coalesce(F.col("label"), F.lit(MISSING_LABEL)))
            .withColumn("k", F.explode(F.filter(_ks_col(ks), lambda k: k >= F.col("rank")))))
    votes = hits.groupBy("k", "qid", "label").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("label") != MISSING_LABEL
    # one pass per (k, query): best real label by (count desc, label asc), the -1 votes
    # and how many neighbours exist - no self join of the match table
    # (count desc, label asc) packed into one long so the pass stays a hash aggregate:
    # key = n * 2^32 - label, max(key) -> most votes, then smallest label
    span = F.lit(1 << 32)
    per = votes.groupBy("k", "qid").agg(
        F.max(F.when(real, F.col("n") * span - F.col("label").cast("long"))).alias("best_key"),
        F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum("n").alias("have"))
    best_n = F.ceil(F.col("best_key") / span)
    per = per.withColumn("best", F.when(F.col("best_key").isNotNull(), F.struct(
        (-best_n).alias("neg_n"), (best_n * span - F.col("best_key")).cast("int").alias("label"))))
    if not ignore_missing:
        grid = queries.select("qid").distinct().withColumn("k", F.explode(_ks_col(ks)))
        per = grid.join(per, ["k", "qid"], "left")
        m1 = F.coalesce(F.col("n_missing"), F.lit(0)) + F.col("k") - F.coalesce(F.col("have"), F.lit(0))
    else:
        m1 = F.lit(0)
    best_n = -F.col("best.neg_n")
    # -1 is smaller than every class id, so it wins ties
    pred = (F.when(F.col("best").isNull() | (m1 >= best_n), F.lit(MISSING_LABEL))
            .otherwise(F.col("best.label")))
    if ignore_missing:
        pred = F.col("best.label")
        per = per.filter(F.col("best").isNotNull())
    return per.select(F.col("k").cast("int"), "qid", pred.cast("int").alias("pred"))


def topk_labels(preds: DataFrame, k: int, col: str = "preds") -> DataFrame:
    """Cut a ranked label list to its first k entries."""
    return preds.withColumn(col, F.slice(F.col(col), 1, int(k)))


def linear_head(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label",
                max_iter: int = 50, reg: float = 0.0):
    """Arg-max of vector x weight without bias, trained by multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                            fitIntercept=False, maxIter=max_iter, regParam=reg)
    model = lr.fit(train)
    return model, model.transform(test)
