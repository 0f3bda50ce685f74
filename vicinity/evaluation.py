"""Evaluation and sampling runs over a stored index.

An :class:`EvaluationRun` ties labelled rows to an index, a search, an evaluate function and a sampler.  Its index and
its matches are stored in folders named by what they depend on: the fingerprint of the rows, the name of the embedding
and the configuration.  A later run with the same ones opens them; one that differs in anything gets folders of its own,
so nothing stale is ever read.  An index or a match table counts as stored when its last row, the ``done`` table, is there.

The evaluate function and the sampler take the run: they ask it for rows and matches, so a search is done once however
many of them use it.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators import classify, corpus, metrics, mlknn, sampling, token_index
from vicinity.pipeline import IndexConfig, SearchConfig, VectorIndex, build_index, search, stored_index
from vicinity.session import checkpoint_dir


class ProbabilityType(str, Enum):
    scores = "scores"
    ranks = "ranks"
    uniform = "uniform"


class SamplingMethod(str, Enum):
    random = "random"
    class_wise_random = "class_wise_random"
    searched = "searched"


def _checked(config, **kinds: type) -> None:
    """Plain strings become the values of their enumeration (ValueError for others)."""
    for name, kind in kinds.items():
        object.__setattr__(config, name, kind(getattr(config, name)))


def _checked_size(name: str, size: int | float | None) -> None:
    if size is not None and (size <= 0 or (isinstance(size, float) and size > 1)):
        raise ValueError(f"{name} must be a number of rows, a share up to 1, or None; got {size}")


@dataclasses.dataclass(frozen=True)
class SamplingConfig:
    """How n-way tuples are drawn; ``searcher_sampling_k`` neighbours are searched for the searched method."""

    sampling_method: SamplingMethod | str = "random"
    probability_type: ProbabilityType | str = "uniform"
    searcher_sampling_k: int = 256
    nway: int = 3
    positive_always_random: bool = False
    lower_ranked_positives: bool = False
    n_positives: int = 1
    n_negatives: int | None = None  # nway - 2 unless given
    subsample: int | float | None = None
    seed: int = 42

    def __post_init__(self):
        _checked(self, sampling_method=SamplingMethod, probability_type=ProbabilityType)
        _checked_size("subsample", self.subsample)
        if self.nway < 3:
            raise ValueError("n-way tuples need at least anchor, positive, negative")
        if self.searcher_sampling_k < 1 or self.n_positives < 0 or (self.n_negatives or 0) < 0:
            raise ValueError("searcher_sampling_k must be positive, n_positives and n_negatives not negative")

    @property
    def negatives(self) -> int:
        return self.nway - 2 if self.n_negatives is None else self.n_negatives


@dataclasses.dataclass(frozen=True)
class EvaluatorConfig:
    """``output_dir``: where indexes and matches are stored; the session's shared folder unless given."""

    output_dir: str | None = None
    reuse_index: bool = True
    eval_ks: tuple[int, ...] = (1,)
    subsample_train: int | float | None = None
    subsample_eval: int | float | None = None
    label_column: str = "label"
    prefix: str = "test"
    stratify_splits: bool = True
    seed: int = 42

    def __post_init__(self):
        object.__setattr__(self, "eval_ks", tuple(sorted(set(self.eval_ks))))
        _checked_size("subsample_train", self.subsample_train)
        _checked_size("subsample_eval", self.subsample_eval)
        if not self.eval_ks or self.eval_ks[0] < 1:
            raise ValueError("eval_ks must be positive")


@dataclasses.dataclass(frozen=True)
class EvaluatorMLCConfig(EvaluatorConfig):
    label_column: str = "labels"
    stratify_splits: bool = False
    mlknn_s: float = 1.0
    mlknn_k: int = 10

    def __post_init__(self):
        super().__post_init__()
        if self.mlknn_k < 1 or self.mlknn_s <= 0:
            raise ValueError("mlknn_k and mlknn_s must be positive")
        if self.stratify_splits:
            raise ValueError("rows with several labels have no strata")


def row_fingerprint(rows: DataFrame) -> str:
    """Number and order-independent hash of the rows, over all their columns by name."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(rows.columns))).alias("x"),
                 F.sum(F.pmod(F.xxhash64(F.lit(1), *sorted(rows.columns)), F.lit(1 << 31))).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def _key(*parts) -> str:
    return hashlib.sha256("|".join(map(repr, parts)).encode()).hexdigest()[:24]


def _done(spark: SparkSession, path: str) -> bool:
    return bool(token_index._rows(spark, f"{path}/done"))


def _finish(spark: SparkSession, path: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done")


def store_index(vectors: DataFrame, config: IndexConfig, path: str) -> VectorIndex:
    """Build the index of ``vectors`` and store it at ``path``; what an earlier, broken build left is written anew, but for
    the finished shards of an index of residual codes."""
    spark = vectors.sparkSession
    if token_index.parse_residual_layout(config.layout) is not None:
        build_index(vectors, config, path=f"{path}/tokens", resume=True)
    else:
        built = build_index(vectors, config)
        built.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        if built.centroids is not None:
            built.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    _finish(spark, path)
    return load_index(spark, config, path)


def load_index(spark: SparkSession, config: IndexConfig, path: str) -> VectorIndex:
    """The finished index that :func:`store_index` left at ``path``."""
    if token_index.parse_residual_layout(config.layout) is not None:
        return stored_index(token_index.open_token_index(spark, f"{path}/tokens"), config)
    centroids = spark.read.parquet(f"{path}/centroids") if config.layout != "Flat" else None
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), config, centroids)


def vectors_of(rows: DataFrame) -> DataFrame:
    """The embedding of rows that have their vectors: ``(pid, vec)``, or ``(pid, pos, vec)``."""
    return rows.select("pid", *(["pos"] if "pos" in rows.columns else []), "vec")


class EvaluationRun:
    """``train`` and ``evaluation`` (``pid``, the label column and what ``embed`` reads) under a configuration.

    ``embed(rows) -> (pid, vec)`` or ``(pid, pos, vec)`` is part of the key by its ``name``: give a new name to a new
    model.  ``evaluate(run) -> (metric, k, value)`` and ``sampler(run, config) -> (anchor, slot, pid)`` may be any
    functions of the run.  ``built`` lists what was computed and ``reused`` what was opened.
    """

    def __init__(self, train: DataFrame, evaluation: DataFrame, config: EvaluatorConfig = EvaluatorConfig(),
                 index: IndexConfig = IndexConfig(), search: SearchConfig = SearchConfig(),
                 embed: Callable[[DataFrame], DataFrame] = vectors_of, name: str = "vectors",
                 evaluate: Callable[[EvaluationRun], DataFrame] | None = None,
                 sampler: Callable[[EvaluationRun, SamplingConfig], DataFrame] | None = None):
        self.config, self.index_config, self.search_config, self.embed, self.name = config, index, search, embed, name
        many = isinstance(config, EvaluatorMLCConfig)
        self.evaluate = evaluate or (evaluate_mlc if many else evaluate_votes)
        self.sampler = sampler or (sample_multi_label if many else sample_single_label)
        self.spark = train.sparkSession
        self.built: list[str] = []
        self.reused: list[str] = []
        self._prints: dict[str, str] = {}
        stratify, label = config.stratify_splits, config.label_column
        self.train = corpus.subsample(train, config.subsample_train, config.seed, stratify, label)
        self.evaluation = corpus.subsample(evaluation, config.subsample_eval, config.seed, stratify, label)

    @property
    def folder(self) -> str:
        return (self.config.output_dir or f"{checkpoint_dir(self.spark).rstrip('/')}/evaluations").rstrip("/")

    def _print(self, side: str) -> str:
        """Fingerprint of what the vectors of ``train`` or ``evaluation`` are made of: every column but the label."""
        if side not in self._prints:
            self._prints[side] = row_fingerprint(getattr(self, side).drop(self.config.label_column))
        return self._prints[side]

    def _stored(self, kind: str, key: str, write: Callable[[str], None]) -> str:
        path = f"{self.folder}/{kind}-{key}"
        if self.config.reuse_index and _done(self.spark, path):
            self.reused.append(kind)
        else:
            write(path)
            _finish(self.spark, path)
            self.built.append(kind)
        return path

    @property
    def index_key(self) -> str:
        return _key(self.name, dataclasses.astuple(self.index_config), self._print("train"))

    def index(self) -> VectorIndex:
        """The index of the train rows, built or opened."""
        if not hasattr(self, "_index"):
            path = self._stored("index", self.index_key, lambda p: store_index(self.embed(self.train), self.index_config, p))
            self._index = load_index(self.spark, self.index_config, path)
        return self._index

    def matches(self, side: str = "evaluation", k: int | None = None) -> DataFrame:
        """``(qid, rank, pid, score)``: the ``k`` best train rows of each row of ``evaluation`` or ``train``.

        The largest k that was searched answers the smaller ones, where the search doesn't depend on k.
        """
        k = k or self.search_config.k
        config = dataclasses.replace(self.search_config, k=k)
        key = _key(self.index_key, self._print(side), dataclasses.astuple(config))

        def write(path):
            vectors = self.embed(getattr(self, side)).withColumnRenamed("pid", "qid")
            vectors = vectors.withColumnRenamed("pos", "qpos") if "pos" in vectors.columns else vectors
            search(self.index(), vectors, config).write.mode("overwrite").parquet(f"{path}/matches")

        return self.spark.read.parquet(f"{self._stored('matches', key, write)}/matches")

    def labels(self, side: str, as_name: str = "label") -> DataFrame:
        return getattr(self, side).select("pid", F.col(self.config.label_column).alias(as_name))

    def run(self, step: int = 0) -> DataFrame:
        """``(key, step, value)``: the metrics under their logged names, per k and (no k) the best or uncut ones."""
        return metrics.rename_metrics(self.evaluate(self), self.config.prefix, step)

    def sample(self, config: SamplingConfig = SamplingConfig()) -> DataFrame:
        """``(anchor, slot, pid)``: n-way tuples of the train rows."""
        return self.sampler(self, config)


def evaluate_votes(run: EvaluationRun) -> DataFrame:
    """``(metric, k, value)`` of the neighbour vote for every k, and the best over them (k null); one search at the largest k."""
    ks = list(run.config.eval_ks)
    truth = run.labels("evaluation", "y_true").withColumnRenamed("pid", "qid")
    voted = classify.knn_vote(run.matches(k=max(ks)), run.labels("train"), truth, ks)
    per_k = metrics.multiclass_metrics(voted.join(truth, "qid").withColumnRenamed("pred", "y_pred"))
    best = metrics.best_over_ks(per_k).select("metric", F.lit(None).cast("int").alias("k"), "value")
    return per_k.select("metric", F.col("k").cast("int").alias("k"), "value").unionByName(best)


def evaluate_mlc(run: EvaluationRun) -> DataFrame:
    """``(metric, k, value)`` of ML-kNN's predictions cut to every k, and uncut (k null).

    The model is fitted on the train rows' own matches and stored beside the index.
    """
    config = run.config
    train, test = run.labels("train", "labels"), run.labels("evaluation", "labels")
    found = run.matches("train", config.mlknn_k)
    path = run._stored("mlknn", _key(run.index_key, config.mlknn_k, config.mlknn_s, row_fingerprint(train), dataclasses.astuple(run.search_config)),
                       lambda p: mlknn.fit(train, found, config.mlknn_k, config.mlknn_s).save(p))
    model = mlknn.MLKNNModel.load(run.spark, path)
    ids = test.select(F.col("pid").alias("qid"))
    packed = mlknn.pack_predictions(mlknn.predict_long(model, ids, run.matches("evaluation", config.mlknn_k), train), ids)
    ks = [0, *config.eval_ks]  # 0: uncut
    cut = F.filter(F.array(*map(F.lit, ks)), lambda k: (k == 0) | (F.col("pos") < k))
    preds = (packed.select("qid", F.posexplode("preds").alias("pos", "label"))
             .select(F.explode(cut).alias("k"), F.col("qid").alias("id"), "label"))
    truth = test.select(F.col("pid").alias("id"), F.explode("labels").alias("label"))
    both = metrics.multilabel_join(preds, truth, ks)
    stats = test.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("labels")).alias("mx")).first()
    out = metrics.multilabel_metrics(
        metrics.multilabel_confusion(preds, truth, ks, both=both), int(stats["n"]), max(model.num_labels, int(stats["mx"] or 0) + 1),
        metrics.subset_exact(preds, truth, ks, test.select(F.col("pid").alias("id")), both=both))
    return out.select("metric", F.when(F.col("k") > 0, F.col("k")).cast("int").alias("k"), "value")


def _sampled(run: EvaluationRun, config: SamplingConfig, label: str) -> DataFrame:
    return corpus.subsample(run.labels("train", label), config.subsample, config.seed)


def _drawn(candidates: DataFrame, config: SamplingConfig) -> DataFrame:
    weighted = sampling.candidate_weights(candidates, config.probability_type.value, config.lower_ranked_positives,
                                          uniform_positives=config.positive_always_random)
    return sampling.draw_tuples(weighted, config.nway, config.seed)


def _own_matches(run: EvaluationRun, config: SamplingConfig, rows: DataFrame) -> DataFrame:
    """Matches among the sampled rows (all of them, without a subsample)."""
    found = run.matches("train", config.searcher_sampling_k)
    if config.subsample is None:
        return found
    ids = rows.select("pid")
    return found.join(ids, "pid", "left_semi").join(ids.withColumnRenamed("pid", "qid"), "qid", "left_semi")


def sample_single_label(run: EvaluationRun, config: SamplingConfig) -> DataFrame:
    """Tuples by the configured method for rows with one label."""
    rows = _sampled(run, config, "label")
    if config.sampling_method is SamplingMethod.random:
        return sampling.random_tuples(rows, config.nway, config.seed)
    if config.sampling_method is SamplingMethod.class_wise_random:
        return sampling.classwise_tuples(rows, config.nway, config.seed)
    return _drawn(sampling.searched_candidates(_own_matches(run, config, rows), rows, config.n_positives, config.negatives, config.seed,
                                               config.positive_always_random), config)


def sample_multi_label(run: EvaluationRun, config: SamplingConfig) -> DataFrame:
    """Tuples by the configured method for rows with several labels."""
    rows = _sampled(run, config, "labels")
    if config.sampling_method is SamplingMethod.random:
        return sampling.random_tuples_ml(rows, config.nway, config.seed)
    if config.sampling_method is SamplingMethod.class_wise_random:
        raise ValueError("rows with several labels have no classes to draw from in turn")
    return _drawn(sampling.searched_filled_ml(_own_matches(run, config, rows), rows, config.searcher_sampling_k, config.n_positives,
                                              config.negatives, config.seed), config)
