"""Quality rules by weak supervision: rules vote or abstain, EM finds how far each can be trusted.

Every rule reads a few exact counts of a text and votes "good", "bad" or
abstains.  Nothing is labelled: the rules' votes over *all* documents are
counted by pattern (at most 3^rules patterns, whatever the corpus), and
expectation-maximisation on those counts estimates the share of good documents
and, for each rule, how it votes on good and on bad ones.  A document's
posterior probability of being good then follows from its pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt

# fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_IS_LETTER = _IS_UPPER | _IS_LOWER | (np.arange(256) >= 128)
_IS_CLOSER = np.isin(np.arange(256), list(b".,;:!?"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_shouts", "n_closed", "n_plain")


def count_features(col: pa.Array) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text of an Arrow string column."""
    data, offsets = bt.flat(col)
    start, end, first = bt.word_spans(data, offsets)
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    per_byte = {"word_chars": ((data & 0xC0) != 0x80) & ~bt.IS_SEPARATOR[data], "n_symbols": _IS_SYMBOL[data],
                "n_upper": _IS_UPPER[data], "n_lower": _IS_LOWER[data], "n_shouts": data == ord("!")}
    out = {k: bt.sums_between(v, offsets) for k, v in per_byte.items()}
    out["n_words"] = np.diff(first)
    closed = _IS_CLOSER[data[end - 1]] if len(end) else np.zeros(0, bool)
    out["n_closed"] = bt.sums_between(closed, first)
    # plain: letters, at most the first a capital, at most one closing mark at the end
    odd = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~_IS_LETTER[data] | _IS_UPPER[data], out=odd[1:])
    opened = _IS_UPPER[data[start]] if len(start) else closed
    plain = odd[end] - odd[start] == closed + opened.astype(np.int32) * (end - start > closed)
    out["n_plain"] = bt.sums_between(plain & (end - start > closed), first)

    lo, hi = bt.line_spans(data, offsets)
    with_word = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[with_word], hi[with_word]
    line_doc = np.searchsorted(offsets[1:], lo, side="right")
    first_line = bt.first_equal(bt.join_hashes(bt.span_hashes(data, lo, hi), line_doc), lambda i, j: (
        (line_doc[i] == line_doc[j]) & bt.same_bytes(data, lo, hi, i, j)))
    seen = first_line != np.arange(len(lo))
    out["n_lines"] = np.bincount(line_doc, minlength=len(col))
    out["n_dup_lines"] = np.bincount(line_doc[seen], minlength=len(col))

    word = bt.first_equal(bt.span_hashes(data, start, end), lambda i, j: bt.same_bytes(data, start, end, i, j))
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        first_window = bt.first_equal(bt.join_hashes(word[at], word[at + 1], word[at + 2], doc[at]), lambda i, j: (
            (doc[at[i]] == doc[at[j]]) & (word[at[i]] == word[at[j]]) & (word[at[i] + 1] == word[at[j] + 1])
            & (word[at[i] + 2] == word[at[j] + 2])))
        at = at[np.bincount(first_window, minlength=len(at))[first_window] > 1]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    out["n_repeat_words"] = bt.sums_between(covered, first)
    return out


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the ``COUNTS`` (long) of every whole text; map only."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                counts = count_features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def default_rules() -> dict[str, Column]:
    """Rule name -> vote over the ``COUNTS``: 0 bad, 1 good, 2 abstain."""
    words, letters = F.greatest("n_words", F.lit(1)), F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    plain, symbols, upper = F.col("n_plain") / words, F.col("n_symbols") / words, F.col("n_upper") / letters
    repeats, again = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    shouts, closed, mean = F.col("n_shouts") / words, F.col("n_closed") / words, F.col("word_chars") / words
    return {
        "symbols": _vote(symbols < 0.05, symbols > 0.1),
        "plain_words": _vote(plain > 0.85, plain < 0.7),
        "capitals": _vote(upper < 0.15, upper > 0.3),
        "shouting": _vote(shouts < 0.05, shouts > 0.1),
        "repeated_words": _vote(repeats < 0.1, repeats > 0.3),
        "repeated_lines": _vote((again < 0.1) & (F.col("n_lines") > 2), again > 0.3),
        "sentence_marks": _vote(closed.between(0.03, 0.4), closed > 0.6),
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 14)),
    }


def fit_em(patterns: np.ndarray, counts: np.ndarray, trust: float = 0.01, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """``(posterior of good per pattern, P(vote bad | class, rule) [2, rules], share of good)`` from vote patterns and counts.

    Two classes, 0 bad and 1 good; an abstention says nothing.  A rule's accuracies on both classes are estimated
    with a prior that weighs ``trust`` of all documents: it votes bad on 2 % of good and on half of the bad ones.
    That prior says which class is which, and as a share it acts alike at every size.
    """
    weight = counts.astype(float)
    prior = np.array([[0.5], [0.02]])  # P(vote bad) in the bad and in the good class
    strength = trust * max(weight.sum(), 1.0)
    bad, good = (patterns == 0).astype(float), (patterns == 1).astype(float)
    rate, share = np.repeat(prior, patterns.shape[1], 1), 0.8
    post = np.zeros(len(weight))
    for _ in range(steps):
        score = np.log(rate) @ bad.T + np.log1p(-rate) @ good.T
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1] + np.log((1 - share) / share), -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
        mass = np.stack([weight * (1 - post), weight * post])
        rate = (mass @ bad + strength * prior) / (mass @ (bad + good) + strength)
        share = (mass[1].sum() + 0.8 * strength) / (mass.sum() + strength)
    return post, rate, float(share)


def judge(counts: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """``counts`` with ``p_good double``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows.  ``kept``: not
    ``base_failed`` and ``p_good >= threshold``.  An empty table gives no rows; one pattern alone keeps the verdict
    of its votes' balance.  ``counts`` is read twice: hand in a stored table.
    """
    rules = rules or default_rules()
    vote = sum((v * 3 ** i for i, v in enumerate(rules.values())), F.lit(0)).cast("int")
    voted = counts.withColumn("_pattern", vote)
    seen = voted.groupBy("_pattern").count().collect()  # at most 3^rules rows
    code = np.array([r["_pattern"] for r in seen], np.int64)
    patterns = code[:, None] // 3 ** np.arange(len(rules)) % 3 if len(code) else np.zeros((0, len(rules)), np.int64)
    post, _, _ = fit_em(patterns, np.array([r["count"] for r in seen], float))
    verdicts = counts.sparkSession.createDataFrame(
        [(int(c), float(p)) for c, p in zip(code, post)], "_pattern int, p_good double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (voted.join(F.broadcast(verdicts), "_pattern").drop("_pattern")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))
