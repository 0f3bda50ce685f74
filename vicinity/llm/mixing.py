"""Mixing to target weights with soft domain membership.

1. A classifier learned from a labelled table gives each document a posterior
   over domains.  It has one score per domain, the sum of log ratios of the
   words and word shapes whose document frequency differs significantly between
   domains; a softmax layer fitted on the other half of the labelled rows turns
   the scores into calibrated probabilities.
2. Rates r >= 0 are fitted so that the expected tokens of domain d,
   ``sum_i r_i t_i p_id``, meet the target T_d: least squares in
   ``(total_d - T_d) / sqrt(T_d)`` by projected gradient from r = 1.  The
   gradient is taken in the metric of the token counts, so a step moves r_i by
   ``-eta * sum_d p_id g_d`` and every rate follows from the document's
   posterior and the few numbers ``g`` of each step.  A step is one pass over
   the stored posteriors; the driver holds domain totals only.  Where a target
   is still missed after ``rounds`` steps, long steps follow: one whose ``g`` is
   the exact minimiser of the objective with a faint pull towards the rates
   before, found by Newton's method in as many unknowns as there are domains.
   Rates have no upper bound.  Where no nonnegative rates come notably nearer to
   the targets, the rates stay and a warning names the miss of each domain.
3. A document is taken floor(r) times and once more with the probability of the
   rest, by a hash of its id.
"""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.llm import ngrams
from vicinity.llm.importance import labelled_texts, one_label
from vicinity.session import cut_lineage

MAX_LABELLED = 20_000  # bound on the labelled rows that the classifier is fitted on
MIN_Z = 4.5            # standard deviations of a word's document frequency
# the mixture of the query and of the pipeline: domain -> share of tokens
WEIGHTS = {"clean": 0.85, "low": 0.1, "toxic": 0.05}
FILL = 1.1             # tokens of the first domain, as a multiple of what there is
BATCH_BYTES = 16 << 20  # of repeated rows that are handed on at a time
PULL = 1e-6            # weight of a long step's pull towards the rates before it
WORTH = 0.8            # share of the objective that a long step may leave


def domain_label() -> Column:
    """Domain of a row of ``labels`` (quality, toxic)."""
    return F.when(F.col("toxic") >= 1, "toxic").when(F.col("quality") < 1, "low").when(F.col("quality") >= 1, "clean")


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, word hashes, shape hashes)`` at every word of each text."""
    first, word, _, shape, shape_before = ngrams.hashes(col)
    return first, word, bt.join_hashes(shape_before, shape)


def changes(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins, and the length at the end."""
    new = np.ones(len(sorted_by[0]) + 1, bool)
    if len(new) > 1:
        new[1:-1] = np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)
    return np.flatnonzero(new) if len(new) > 1 else np.zeros(1, np.int64)


@dataclasses.dataclass
class DomainClassifier:
    """``keys`` sorted; ``weights[keys, domains]``; softmax of ``layer`` over the transformed scores."""

    domains: list[str]
    keys: np.ndarray
    weights: np.ndarray
    layer: np.ndarray | None = None

    def features(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``([texts, features], words per text)``."""
        first, *found = words_of(col)
        sums = np.zeros((len(col), len(self.domains)))
        words = np.diff(first)
        if len(self.keys):
            for h in found:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                doc = np.searchsorted(first, hit, side="right") - 1
                for d in range(len(self.domains)):
                    sums[:, d] += np.bincount(doc, self.weights[at[hit], d], minlength=len(col))
        damped = np.sign(sums) * np.log1p(np.abs(sums))
        dense = sums / np.sqrt(np.maximum(words, 1))[:, None]
        return np.concatenate((damped, np.clip(dense, -20, 20), np.ones((len(col), 1))), 1), words

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.layer
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, decay: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Multinomial logistic regression by Newton steps (few features, bounded rows)."""
    w = np.zeros((x.shape[1], classes))
    onehot = np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = (x.T @ (p - onehot) / len(x) + decay * w).ravel("F")
        hess = np.zeros((grad.size, grad.size))
        f = x.shape[1]
        for a in range(classes):
            for b in range(classes):
                hess[a * f:(a + 1) * f, b * f:(b + 1) * f] = x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]) / len(x)
        step = np.linalg.solve(hess + (decay + 1e-9) * np.eye(grad.size), grad).reshape(w.shape, order="F")
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, max_labelled: int = MAX_LABELLED,
                   seed: int = 42) -> DomainClassifier:
    """Classifier of ``docs`` (``doc_id``, ``text``) into the domains that occur among the labelled rows."""
    sample = cut_lineage(ngrams.labelled_sample(one_label(labels, domain), max_labelled, seed, "_label_id"))
    labelled = cut_lineage(labelled_texts(docs, sample).withColumn(
        "_fit", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(2)) == 0))
    totals = {r[0]: r[1] for r in labelled.groupBy("_label").count().collect()}  # a row per domain
    domains = sorted(totals)
    if not domains:
        return DomainClassifier([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    index = {d: i for i, d in enumerate(domains)}

    def frequencies(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                first, *found = words_of(part.column("text"))
                cls = np.array([index[x] for x in part.column("_label").to_pylist()], np.int32)
                doc, h = np.repeat(np.arange(len(cls)), np.diff(first)), np.concatenate(found)
                doc = np.concatenate((doc, doc))
                order = np.lexsort((h, doc))
                once = changes(doc[order], h[order])[:-1]
                h, c = h[order][once], cls[doc[order][once]]
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                heads = changes(h, c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[heads[:-1]].view(np.int64)), pa.array(c[heads[:-1]]), pa.array(np.diff(heads))], ["h", "cls", "n"])

    fit = labelled.filter("_fit")
    size = {r[0]: r[1] for r in fit.groupBy("_label").count().collect()}
    n_fit = max(sum(size.values()), 1)
    df = (fit.select("text", "_label").mapInArrow(frequencies, "h long, cls int, n long")
          .groupBy("h").agg(*(F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
                              for i in range(len(domains)))))
    total = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    expected = [total * (size.get(d, 0) / n_fit) for d in domains]
    z = F.greatest(*(F.abs(F.col(f"n{i}") - e) / F.sqrt(e + 1) for i, e in enumerate(expected)), F.lit(0.0))
    table = df.withColumn("z", z).filter(F.col("z") >= MIN_Z).toPandas()  # words that several rows of the sample have
    keys = table["h"].to_numpy(np.int64).view(np.uint64)
    counts = table[[f"n{i}" for i in range(len(domains))]].to_numpy(float)
    shares = np.array([size.get(d, 0) for d in domains]) / n_fit
    e = counts.sum(1, keepdims=True) * shares
    weights = np.where(np.abs(counts - e) >= MIN_Z * np.sqrt(e + 1), np.log((counts + 2) / (e + 2)), 0.0)
    order = np.argsort(keys)
    model = DomainClassifier(domains, keys[order], weights[order])

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                x, _ = model.features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], ["_label", "x"])

    held = labelled.filter(~F.col("_fit")).select("text", "_label").mapInArrow(features, "_label string, x array<double>")
    rows = held.collect()  # a row per id of the sample
    if rows:
        x = np.array([r["x"] for r in rows])
        model.layer = fit_softmax(x, np.array([index[r["_label"]] for r in rows]), len(domains))
    else:
        model.layer = np.zeros((2 * len(domains) + 1, len(domains)))
    return model


@dataclasses.dataclass
class Mixer:
    """Classifier, and the steps that turn a posterior into a rate."""

    classifier: DomainClassifier
    targets: np.ndarray
    steps: np.ndarray  # [steps, domains]: what a step takes off a rate, per unit of posterior
    max_rate: float = np.inf
    miss: dict[str, float] = dataclasses.field(default_factory=dict)  # domain -> (expected tokens - target) / target

    def unclipped(self, p: np.ndarray) -> np.ndarray:
        """Rates before the last step is projected."""
        r = np.ones(len(p))
        for g in self.steps:
            r = np.clip(r, 0, self.max_rate) - p @ g
        return r

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = self.unclipped(p)
        return np.clip(r, 0, self.max_rate) if len(self.steps) else r


def _posterior_table(docs: DataFrame, model: DomainClassifier) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                x, words = model.features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words, pa.int64()),
                     pa.array(list(model.posteriors(x)), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = batch.column("n_tokens").to_numpy().astype(float)
    return t, batch.column("p").flatten().to_numpy().reshape(len(t), -1)


def domain_totals(table: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, float]:
    """``(totals [d], curvature [d, d], potential)`` of the rates so far, one partial row per task.

    The sums of r t p, of t p p^T over the rates that the last step did not clip, and of t (r u - r^2 / 2) where u is
    the rate before it is clipped: as a function of the last step, the totals are minus the potential's gradient and
    the curvature its second derivative.
    """
    d = len(mixer.targets)

    def run(batches: Iterator[pa.RecordBatch]):
        out = np.zeros(d + d * d + 1)
        for batch in batches:
            t, p = _arrays(batch)
            u = mixer.unclipped(p)
            r = np.clip(u, 0, mixer.max_rate) if len(mixer.steps) else u
            out[:d] += (r * t) @ p
            out[d:-1] += ((p * (t * (r == u))[:, None]).T @ p).ravel()
            out[-1] += t @ (r * u - r * r / 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["i", "x"])

    sums = dict(map(tuple, table.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect()))
    flat = np.array([sums.get(i, 0.0) for i in range(d + d * d + 1)])
    return flat[:d], flat[d:-1].reshape(d, d), float(flat[-1])


def _objective(totals: np.ndarray, targets: np.ndarray) -> float:
    return float(((totals - targets) ** 2 / targets).sum() / 2)


def _long_step(table: DataFrame, mixer: Mixer, tolerance: float, newton: int = 100) -> np.ndarray | None:
    """Adds to ``mixer`` the step that minimises the objective with ``PULL`` towards the rates before; the new totals.

    The dual of that problem is smooth and strictly convex in the step's d numbers; Newton's method with step halving
    solves it, one pass over the posteriors a trial.  It ends early where all targets are met.  None, and no step, if
    the objective does not come down to ``WORTH`` of what it was; the dual's value proves that after a few trials.
    """
    before, targets = mixer.steps, mixer.targets
    scale = 1 / np.sqrt(targets)

    def at(g):
        mixer.steps = np.concatenate((before, g[None]))
        totals, curve, potential = domain_totals(table, mixer)
        return totals, curve, PULL / 2 * (targets * g) @ g + targets @ g + potential

    g = np.zeros(len(targets))
    totals, curve, value = at(g)
    enough, start = WORTH * _objective(totals, targets), value
    for _ in range(newton):
        slope = PULL * targets * g + targets - totals
        hess = PULL * np.eye(len(g)) + curve * np.outer(scale, scale)
        move = -scale * np.linalg.solve(hess, scale * slope)
        gain = -slope @ move
        if (np.abs(totals / targets - 1).max() < tolerance or gain <= 1e-12 * targets.sum()
                or PULL * (start - value) > enough):  # no less is left of the objective with the pull
            break
        width = 1.0
        while width > 1e-9:
            found = at(g + width * move)
            if found[2] <= value - 1e-4 * width * gain:
                break
            width /= 2
        else:
            break
        g = g + width * move
        totals, curve, value = found
    if _objective(totals, targets) > enough:
        mixer.steps = before
        return None
    mixer.steps = np.concatenate((before, g[None]))
    return totals


def fit_rates(table: DataFrame, model: DomainClassifier, weights: dict[str, float], fill: float = FILL,
              max_rate: float = np.inf, rounds: int = 40, tolerance: float = 1e-3) -> Mixer:
    """Rates for the stored posterior ``table``.  Domains without labelled rows are left out and the others' weights scaled.

    The tokens to reach are set by the first domain of ``weights`` that occurs: ``fill`` times what it has.  After
    ``rounds`` gradient steps, long steps go on until every total is within ``tolerance`` of its target or none is worth
    it (:func:`_long_step`); then a warning names the miss of each domain, as ``Mixer.miss`` does.
    """
    share = np.array([max(weights.get(d, 0.0), 0.0) for d in model.domains])
    if not share.sum():
        raise ValueError("no domain of the labelled rows has a weight")
    share /= share.sum()
    mixer = Mixer(model, share, np.zeros((0, len(share))), max_rate)
    have, curve, _ = domain_totals(table, mixer)
    lead = next(model.domains.index(d) for d in weights if d in model.domains and weights[d] > 0)
    mixer.targets = np.maximum(share * fill * have[lead] / share[lead], 1e-6 * max(have.sum(), 1.0))
    scale = 1 / mixer.targets

    def worst(total):
        return np.abs((total - mixer.targets) * scale).max()

    # steps of 1 / (largest eigenvalue of the scaled curvature)
    eta = 1 / max(np.linalg.eigvalsh(curve * np.sqrt(np.outer(scale, scale))).max(), 1e-12)
    total = have
    for _ in range(rounds if have.sum() else 0):
        if worst(total) < tolerance:
            break
        mixer.steps = np.concatenate((mixer.steps, eta * ((total - mixer.targets) * scale)[None]))
        total = domain_totals(table, mixer)[0]
    while have.sum() and worst(total) >= tolerance:
        nearer = _long_step(table, mixer, tolerance)
        if nearer is None:
            break
        total = nearer
    mixer.miss = dict(zip(model.domains, ((total - mixer.targets) * scale).tolist()))
    if have.sum() and worst(total) >= tolerance:
        warnings.warn("mixing: targets out of reach; expected tokens over target - 1: "
                      + ", ".join(f"{d} {m:+.4f}" for d, m in mixer.miss.items()), stacklevel=2)
    return mixer


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from each id."""
    return (bt.join_hashes(np.full(len(ids), seed, np.uint64), ids.view(np.uint64)) >> np.uint64(11)) / float(1 << 53)


def copies_of(rates: np.ndarray, ids: pa.Array, seed: int) -> np.ndarray:
    return np.floor(rates + uniform(ids.fill_null(-1).to_numpy(zero_copy_only=False), seed)).astype(np.int64)


def repeats(n: np.ndarray, nbytes: int) -> Iterator[np.ndarray]:
    """Row numbers, row i ``n[i]`` times, in runs of about ``BATCH_BYTES`` where all rows together have ``nbytes``."""
    rows = np.flatnonzero(n)
    small = max(int(BATCH_BYTES // max(nbytes, 1)), 1)  # copies of all rows that a batch may hold
    done = 0
    while len(rows):
        yield np.repeat(rows, np.minimum(n[rows] - done, small))
        done += small
        rows = rows[n[rows] > done]


def _fitted(docs, labels, weights, domain, seed, options) -> tuple[Mixer | None, DataFrame]:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_classifier(src, labels, domain_label() if domain is None else domain, seed=seed)
    if not model.domains:
        return None, src
    table = cut_lineage(_posterior_table(src, model))
    return fit_rates(table, model, weights, **options), table


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, domain: Column | None = None,
        seed: int = 42, **options) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, p_<domain> ..., rate, copies`` (in the order of the domains' names).

    Tokens are words.  Columns for domains of ``weights`` that no labelled row has are 0.

    * null, empty or blank text: no tokens; its posterior is the layer's for a text without words;
    * null id: scored, never labelled; repeated rows: each has a row; an id that several rows share is labelled once, by
      the smallest of its texts; labels repeated for an id: the smallest counts;
    * no labelled rows: all posteriors 0 and every rate 1; empty table: no rows; further columns are not read.
    """
    mixer, table = _fitted(docs, labels, weights, domain, seed, options)
    names = sorted(set(weights) | set(mixer.classifier.domains if mixer else ()))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if mixer is None:
                p, words = None, np.diff(bt.word_spans(*bt.flat(batch.column("text")))[2])
                r = np.ones(batch.num_rows)
            else:
                words, p = batch.column("n_tokens").to_numpy(), _arrays(batch)[1]
                r = mixer.rates(p)
            own = mixer.classifier.domains if mixer else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()),
                 *(pa.array(p[:, own.index(d)] if d in own else np.zeros(len(r))) for d in names),
                 pa.array(r), pa.array(copies_of(r, batch.column("doc_id"), seed))],
                ["doc_id", "n_tokens", *(f"p_{d}" for d in names), "rate", "copies"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, " + "".join(f"`p_{d}` double, " for d in names)
                            + "rate double, copies long")


def mixed_rows(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, domain: Column | None = None,
               seed: int = 42, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, all columns kept.

    The rates are worked out again from the texts in one map over the rows, so no text is shuffled.
    """
    mixer, _ = _fitted(docs, labels, weights, domain, seed, options)
    if mixer is None:
        return docs
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in bt.slices(batch, f"c{text_at}"):
                x, _ = mixer.classifier.features(part.column(text_at))
                n = copies_of(mixer.rates(mixer.classifier.posteriors(x)), part.column(id_at), seed)
                for rows in repeats(n, part.nbytes):
                    yield part.take(pa.array(rows)).rename_columns(docs_columns)

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)
