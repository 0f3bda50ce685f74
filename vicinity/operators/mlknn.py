"""ML-kNN multi-label classification (C3-C7, S5) with sparse counts.

Only non-zero neighbour-label counts are materialised: work is
O(matches x labels per passage), never O(passages x labels).  The j = 0
cells of the posterior come from class totals by subtraction, and labels that
are positive even with zero neighbour votes ("default-on") are added to the
predictions from a small model-side table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators.similarity import small_side
from vicinity.session import cut_lineage


@dataclass
class MLKNNModel:
    prior: DataFrame          # (label, p1, p0)
    posterior: DataFrame      # (label, j, post1, post0)
    k: int
    s: float
    num_labels: int
    num_examples: int

    def table(self) -> DataFrame:
        """Model rows ``(label, j, y1, y0)``: prior x posterior, the decision inputs."""
        return (self.posterior.join(self.prior, "label")
                .select("label", "j", (F.col("p1") * F.col("post1")).alias("y1"),
                        (F.col("p0") * F.col("post0")).alias("y0")))

    def save(self, path: str) -> None:
        """Three tables: prior, posterior, one metadata row."""
        spark = self.prior.sparkSession
        self.prior.write.mode("overwrite").parquet(f"{path}/prior")
        self.posterior.write.mode("overwrite").parquet(f"{path}/posterior")
        spark.createDataFrame([(self.k, float(self.s), self.num_labels, self.num_examples)],
                              "k int, s double, num_labels int, num_examples long") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "MLKNNModel":
        meta = spark.read.parquet(f"{path}/metadata").first()
        return MLKNNModel(spark.read.parquet(f"{path}/prior"), spark.read.parquet(f"{path}/posterior"),
                          meta["k"], meta["s"], meta["num_labels"], meta["num_examples"])


def explode_labels(rows: DataFrame, id_col: str = "pid", labels: str = "labels") -> DataFrame:
    return rows.select(F.col(id_col).alias("pid"), F.explode(F.array_distinct(labels)).alias("label"))


def neighbour_counts(matches: DataFrame, train_long: DataFrame, k: int) -> DataFrame:
    """``(qid, label, j)``: how many of the first k neighbours carry each label (C4); non-zero only."""
    return (matches.filter(F.col("rank") <= k).select("qid", "pid")
            .join(train_long, "pid").groupBy("qid", "label").agg(F.count(F.lit(1)).cast("int").alias("j")))


def fit(train: DataFrame, train_matches: DataFrame, k: int = 10, s: float = 1.0,
        id_col: str = "pid", labels: str = "labels") -> MLKNNModel:
    """Prior (C3) and posterior (C5) from the train rows and their own search results.

    ``train_matches(qid, rank, pid)`` is the train table searched against itself;
    as in the reference the row itself may be among its neighbours (D6).
    """
    spark = train.sparkSession
    long = explode_labels(train, id_col, labels)
    stats = train.agg(F.count(F.lit(1)).alias("n"),
                      F.max(F.array_max(labels)).alias("mx")).first()
    n_ex, num_labels = int(stats["n"]), int(stats["mx"]) + 1
    N = float(n_ex)
    lab = spark.range(num_labels).select(F.col("id").cast("int").alias("label"))
    n_l = long.groupBy("label").agg(F.count(F.lit(1)).alias("n_l"))
    base = lab.join(n_l, "label", "left").fillna({"n_l": 0})
    p1 = (F.lit(float(s)) + F.col("n_l")) / F.lit(2.0 * s + N)
    prior = base.select("label", p1.alias("p1")).withColumn("p0", 1.0 - F.col("p1"))

    counts = neighbour_counts(train_matches, long, k)
    member = long.select(F.col("pid").alias("qid"), "label", F.lit(1).alias("b"))
    cb = (counts.join(member, ["qid", "label"], "left").fillna({"b": 0})
          .groupBy("label", "j").agg(F.sum("b").alias("c1"), F.sum(1 - F.col("b")).alias("c0")))
    grid = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(int(k)))))
    nz = cb.groupBy("label").agg(F.sum("c1").alias("nz1"), F.sum("c0").alias("nz0"))
    g = (grid.join(cb, ["label", "j"], "left").join(nz, "label", "left")
         .fillna({"c1": 0, "c0": 0, "nz1": 0, "nz0": 0}))
    tot1 = F.col("n_l")
    tot0 = F.lit(N) - F.col("n_l")
    c1 = F.when(F.col("j") == 0, tot1 - F.col("nz1")).otherwise(F.col("c1"))
    c0 = F.when(F.col("j") == 0, tot0 - F.col("nz0")).otherwise(F.col("c0"))
    denom = F.lit(float(s) * (k + 1))
    posterior = g.select(
        "label", F.col("j").cast("int").alias("j"),
        ((F.lit(float(s)) + c1) / (denom + tot1)).alias("post1"),
        ((F.lit(float(s)) + c0) / (denom + tot0)).alias("post0"))
    # the model is an artefact (prior: L rows, posterior: L x (k+1) rows): materialise it
    # once so predictions never re-run the training search
    return MLKNNModel(cut_lineage(prior), cut_lineage(posterior), k, s, num_labels, n_ex)


def predict_long(model: MLKNNModel, test_ids: DataFrame, test_matches: DataFrame, train: DataFrame,
                 id_col: str = "pid", labels: str = "labels") -> DataFrame:
    """Positive labels per test row with confidence ``r = y1 / (y0 + y1)``.

    Label l is positive iff ``p1 * post1[l, C] >= p0 * post0[l, C]`` (ties positive).
    Labels with a non-zero count are decided from the sparse counts; labels
    positive at count 0 ("default-on") are added to every row lacking a count.
    """
    long = explode_labels(train, id_col, labels)
    t = model.table()
    counts = cut_lineage(neighbour_counts(test_matches, long, model.k))   # decided + anti join
    decided = (counts.join(small_side(t), ["label", "j"])
               .select("qid", "label", "y1", "y0"))
    pos_nz = decided.filter(F.col("y1") >= F.col("y0"))
    # default-on labels: one model-side row holding at most num_labels entries
    on = (t.filter((F.col("j") == 0) & (F.col("y1") >= F.col("y0")))
          .agg(F.collect_list(F.struct("label", "y1", "y0")).alias("on")).withColumn("_one", F.lit(1)))
    on_rows = (test_ids.select("qid").withColumn("_one", F.lit(1)).join(F.broadcast(on), "_one")
               .select("qid", F.explode("on").alias("o")).select("qid", "o.label", "o.y1", "o.y0")
               .join(counts.select("qid", "label"), ["qid", "label"], "left_anti"))
    out = pos_nz.unionByName(on_rows.select("qid", "label", "y1", "y0"))
    return out.select("qid", "label", (F.col("y1") / (F.col("y0") + F.col("y1"))).alias("r"))


def pack_predictions(pred_long: DataFrame, test_ids: DataFrame, order: str = "desc") -> DataFrame:
    """``(qid, preds ARRAY<INT>, ranks ARRAY<DOUBLE>)`` sorted by confidence.

    ``order="asc"`` reproduces the reference's ascending sort (D5); ties by label.
    Rows without any positive label keep empty lists.
    """
    key = F.col("r") if order == "asc" else -F.col("r")
    packed = (pred_long.groupBy("qid")
              .agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "label", "r"))).alias("_p")))
    packed = packed.select("qid", F.transform("_p", lambda x: x["label"]).alias("preds"),
                           F.transform("_p", lambda x: x["r"]).alias("ranks"))
    return (test_ids.select("qid").join(packed, "qid", "left")
            .select("qid", F.coalesce("preds", F.array().cast("array<int>")).alias("preds"),
                    F.coalesce("ranks", F.array().cast("array<double>")).alias("ranks")))
