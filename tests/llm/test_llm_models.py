"""Language models and classifiers: exact probabilities by hand, held-out quality, odd input."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinity.llm import arraystore, importance, langid, mixing, ngrams, queries, word_lm
from tests.conftest import SF_MID, SF_SMALL


def _tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


@pytest.mark.parametrize("shards", [1, 5])
def test_word_model_equals_its_definition(spark, docs_of, small_texts, shards):
    rows = small_texts
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    docs = docs_of(rows)
    model = word_lm.train(docs.filter(langid.fold("doc_id", 7) != 2), shards=shards)
    c, pairs = Counter(), Counter()
    for _, t in train:
        k = _tokens(t)
        c.update(k)
        pairs.update(zip([0] + k, k))
    n, v = sum(c.values()), len(c)
    assert (model.train_tokens, model.vocabulary, model.pair_types) == (n, v, len(pairs))
    follows, kinds, total = Counter(b for _, b in pairs), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), x in pairs.items():
        kinds[a][min(x, 3) - 1] += 1
        total[a] += x

    def discounts(values):
        seen = Counter(values)
        return [0, *word_lm.discounts(np.array([seen[k] for k in (1, 2, 3, 4)]))]
    d2, d1 = discounts(pairs.values()), discounts(follows.values())
    spare = sum(d1[min(f, 3)] for f in follows.values()) / len(pairs) / (v + 1)

    def p1(b):
        return max(follows[b] - d1[min(follows[b], 3)], 0) / len(pairs) + spare

    def p(a, b):
        if not total[a]:
            return p1(b)
        x = pairs[a, b]
        return (max(x - d2[min(x, 3)], 0) + sum(d * k for d, k in zip(d2[1:], kinds[a])) * p1(b)) / total[a]
    assert abs(sum(p(0, b) for b in c) + p(0, "never seen") - 1) < 1e-9
    got = word_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in got:
        ks = [_tokens(t) for t in by_id[r["doc_id"]]]
        k = next(k for k in ks if len(k) == r["n_tokens"])
        assert r["n_known"] == sum(c[w] > 0 for w in k) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in k), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip([0] + k, k)), rel_tol=1e-9)


def test_word_model_without_training_text(docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in word_lm.score(docs, word_lm.train(docs.limit(0))).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["score"] == got[1]["base_score"] == 0.0
    assert word_lm.score(docs.limit(0), word_lm.train(docs)).count() == 0


def test_word_model_beats_its_base_on_held_out_texts(spark):
    d = queries.QUERIES["op8_lm_scoring"](spark, SF_MID).toPandas()
    for _, part in d.groupby("held_out"):
        assert part.score.sum() > part.base_score.sum()


def test_packed_arrays():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (arraystore.unpack(arraystore.pack(keys, True), np.uint64, True) == keys).all()
    for x in (np.arange(5), np.zeros(0, np.int64), np.array([7], np.uint32)):
        assert (arraystore.unpack(arraystore.pack(x), x.dtype) == x).all()


def test_arrays_outside_a_mounted_folder(tmp_path, monkeypatch):
    monkeypatch.setattr(arraystore, "_local", lambda base: None)
    arraystore.write_array(f"file://{tmp_path}/m", "x-0", np.arange(4, dtype=np.uint64))
    arraystore.write_array(f"file://{tmp_path}/m", "x-1", np.zeros(0, np.uint64))
    assert arraystore.map_array(f"file://{tmp_path}/m", "x-0", "u8").tolist() == [0, 1, 2, 3]
    assert len(arraystore.map_array(f"file://{tmp_path}/m", "x-1", "u8")) == 0


def test_pair_counts_beyond_32_bits(tmp_path):
    for top, bits in ((2 ** 32 - 1, 32), (2 ** 32, 64), (5 * 10 ** 9, 64)):
        base = f"file://{tmp_path}/{top}"
        counts = np.array([3, top, 1])
        arraystore.write_array(base, "pairs-0", np.array([2, 5, 9], np.uint64))
        arraystore.write_array(base, "pair_counts-0", word_lm.narrow(counts))
        assert word_lm.narrow(counts).itemsize * 8 == bits
        model = word_lm.WordModel(base, 0, np.array([0, 10]), 10, 1)
        assert model.pair_counts(np.array([2, 4, 5, 9], np.uint64), np.ones(4, np.int64)).tolist() == [3, 0, top, 1]


def test_char_model_probabilities_sum_to_one():
    texts = ["abra kadabra", "abba", "cab a"]
    codes, first = langid.symbols(texts)
    assert first.tolist() == [0, 13, 18, 24]
    columns = langid.histories(codes)
    at, number = langid._group(columns)
    counts = np.stack([np.bincount(number, minlength=len(at)), np.zeros(len(at))], 1).astype(float)
    m = langid.kneser_ney([c[at] for c in columns], counts, ["x", "none"])
    letters = [0, *map(ord, "abcdkr")]
    for context in ([], [ord("a")], [ord("b"), ord("a")], [ord("r"), ord("b"), ord("a")], [ord("q")] * 3):
        history = [np.array([c] * (len(letters) + 1), np.uint64) for c in context + [0] * (3 - len(context))]
        p = 2 ** m.log_probs([np.array([*letters, ord("q")], np.uint64), *history])
        assert np.allclose(p.sum(0), 1)


def test_language_of_held_out_texts(spark):
    d = queries.QUERIES["op5_language_id"](spark, SF_MID)
    truth = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    j = d.join(truth, "doc_id").filter("held_out").toPandas()
    assert (j.lang == j.lang_pred).mean() > 0.98 and j.score.between(0, 1).all() and j.rejected.mean() < 0.1


def test_language_of_odd_texts(docs_of):
    rows = [(i, "the cat and the dog walk to the house " * 3, "en") for i in range(40)]
    rows += [(100 + i, "der hund und die katze gehen in das haus " * 3, "de") for i in range(40)]
    model = langid.train(docs_of(rows))
    odd = docs_of([(1, None), (2, ""), (3, "12 !? \n"), (4, "Die Katze"), (4, "Die Katze"), (None, "the dog"), (6, "漢字" * 9000)])
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect()), key=repr)
    assert [g for g in got if g[0] != 6] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en")]
    assert langid.train(docs_of([(1, None, "en"), (2, "x", None)])) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(docs_of([]), model).count() == 0


def test_languages_with_few_texts(spark, docs_of):
    pick = F.pmod(F.xxhash64(F.lit(43), F.col("id")), F.lit(5)) == 0
    fifth = [r[0] for r in spark.range(1000, 1100).filter(pick).limit(2).collect()]  # ids that would calibrate
    rows = [(i, "the cat and the dog walk to the house " * 3, "en") for i in range(60)]
    rows += [(i, "der hund und die katze gehen in das haus " * 3, "de") for i in fifth]
    got = langid.identify(docs_of([(1, "die katze und der hund"), (2, "the dog")]), langid.train(docs_of(rows))).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "de", 2: "en"}
    one = langid.train(docs_of([(fifth[0], "der hund", "de")]))
    assert langid.identify(docs_of([(1, "das haus")]), one).first()["lang_pred"] == "de"
    assert langid.train(docs_of([(1, "12 !", "en"), (2, "", "de")])) is None


def test_quality_classifier_follows_the_labels(spark):
    d = queries.QUERIES["op6_quality_classifier"](spark, SF_MID)
    j = d.join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").toPandas()
    assert j.kept[j.quality == 1].mean() > 0.99 and j.kept[j.quality == 0].mean() < 0.05


@pytest.mark.parametrize("k", [0, 1, 2, 5, 500, 999, 1000, 2000])
def test_gumbel_top_k_is_exact(spark, k):
    scored = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("log_ratio"))
    got = importance.gumbel_top_k(scored, k, seed=3).toPandas().sort_values("key", ascending=False)
    assert got.kept.tolist() == [True] * min(k, 1000) + [False] * (1000 - min(k, 1000))


def test_kth_largest_narrows_and_breaks_ties(spark):
    rows = [(float(i % 10), i) for i in range(500)] + [(1e9, 1000), (-1e9, 1001)]
    keyed = spark.createDataFrame(rows, "key double, doc_id long")
    ranked = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 37, 251, 502):
        assert importance.kth_largest(keyed, k, small=8, bins=4) == ranked[k - 1]


def test_threshold_between_classes():
    assert importance.best_threshold(np.array([1.0, 2.0]), np.array([-3.0, -1.0])) == 0.0
    assert importance.best_threshold(np.array([]), np.array([1.0])) == -np.inf
    assert 1 < importance.best_threshold(np.array([1.0, 2, 2, 2]), np.array([1.0, 1, 1])) <= 1.5


def test_quality_classifier_odd_input(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    docs = docs_of([(1, "fine words here"), (2, "### ###"), (3, None), (3, None), (None, "fine"), (5, "")])
    out = importance.resample(docs, labels).collect()
    assert len(out) == 6 and {r["doc_id"] for r in out if not r["kept"]} <= {2}
    kept = importance.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 5
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert all(r["kept"] for r in importance.resample(docs, labels.limit(0)).collect())


def test_quality_classifier_judges_rows_not_ids(spark, docs_of):
    good, bad = "plain words of a good text " * 40, "@@ ## $$ !! " * 80
    rows = [(i, good) for i in range(40)] + [(100 + i, bad) for i in range(40)]
    rows += [(None, bad), (None, good), (1000, bad), (1000, good)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    docs = docs_of(rows)
    kept = importance.drop_rejected(docs, labels, temperature=0.0)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([r for r in rows if r[1] == good], key=repr)


def _brute_rates(t, p, targets, steps, max_rate):
    r = np.ones(len(t))
    curve = (p * t[:, None]).T @ p
    eta = 1 / np.linalg.eigvalsh(curve / np.sqrt(np.outer(targets, targets))).max()
    for _ in range(steps):
        r = np.clip(r - eta * p @ (((r * t) @ p - targets) / targets), 0, max_rate)
    return r


def test_mixing_rates_equal_projected_gradient(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(1, 500, 300)
    p = rng.dirichlet([0.3, 0.2, 0.1], 300)
    table = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))],
                                  "doc_id long, n_tokens long, p array<double>").repartition(3)
    model = mixing.DomainClassifier(["a", "b", "c"], np.zeros(0, np.uint64), np.zeros((0, 3)))
    mixer = mixing.fit_rates(table, model, {"b": 0.5, "a": 0.2, "c": 0.3}, fill=1.0, rounds=200)
    assert np.allclose(mixer.rates(p), _brute_rates(t.astype(float), p, mixer.targets, len(mixer.steps), 4.0))
    assert np.abs((mixer.rates(p) * t) @ p / mixer.targets - 1).max() < 2e-3


def test_mixing_meets_the_weights(spark):
    d = queries.QUERIES["op4_mixing"](spark, SF_MID).toPandas()
    totals = np.array([(d.rate * d.n_tokens * d[f"p_{x}"]).sum() for x in ("clean", "low", "toxic")])
    assert np.abs(totals / totals.sum() - [0.85, 0.1, 0.05]).max() < 0.01
    assert (d.copies - d.rate).abs().max() < 1
    j = d.merge(spark.read.parquet(f"{SF_MID}/labels.parquet").toPandas(), on="doc_id")
    clean = j[(j.quality == 1) & (j.toxic == 0)]
    assert (clean.copies >= 1).mean() > 0.97


@pytest.mark.parametrize("share", [0.01, 0.0002])
def test_mixing_raises_a_rare_domain_to_its_target(spark, share):
    rng = np.random.default_rng(2)
    n = 20_000
    t, domain = rng.integers(1, 500, n), rng.choice(3, n, p=[0.95 - share, share, 0.05])
    p = np.stack([rng.dirichlet(np.where(np.arange(3) == d, 8.0, 0.05)) for d in domain])
    table = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))],
                                  "doc_id long, n_tokens long, p array<double>").repartition(3)
    model = mixing.DomainClassifier(["clean", "low", "toxic"], np.zeros(0, np.uint64), np.zeros((0, 3)))
    mixer = mixing.fit_rates(table, model, mixing.WEIGHTS)
    rates = mixer.rates(p)
    assert rates.min() >= 0 and rates.max() > 4
    assert np.abs((rates * t) @ p / mixer.targets - 1).max() < 1.01e-3 and max(map(abs, mixer.miss.values())) < 1e-3


def test_mixing_names_the_miss_of_targets_out_of_reach(spark):
    p = np.array([[0.7, 0.3], [0.6, 0.4], [0.9, 0.1]])
    t = np.array([10, 20, 30])
    table = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))],
                                  "doc_id long, n_tokens long, p array<double>")
    model = mixing.DomainClassifier(["a", "b"], np.zeros(0, np.uint64), np.zeros((0, 2)))
    with pytest.warns(UserWarning, match="out of reach"):
        mixer = mixing.fit_rates(table, model, {"a": 0.2, "b": 0.8}, fill=1.0)
    r = mixer.rates(p)
    total = (r * t) @ p
    assert np.allclose(total / mixer.targets - 1, [mixer.miss["a"], mixer.miss["b"]])
    assert mixer.miss["b"] < -0.1 and mixing._objective(total, mixer.targets) < mixing._objective(t @ p, mixer.targets)


def test_repeated_rows_come_in_bounded_batches():
    n = np.array([0, 3, 1000, 1])
    got = list(mixing.repeats(n, mixing.BATCH_BYTES // 10))
    assert np.bincount(np.concatenate(got), minlength=4).tolist() == n.tolist()
    assert max(np.bincount(g).max() for g in got) <= 10
    assert sum(map(len, mixing.repeats(np.array([2, 1]), 10 * mixing.BATCH_BYTES))) == 3


def test_mixing_odd_input(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "good words"), (2, "## ##"), (3, "bad words"), (4, None), (4, None), (None, "x"), (6, "")])
    out = mixing.mix(docs, labels)
    assert out.columns == ["doc_id", "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"] and out.count() == 7
    rows = mixing.mixed_rows(docs, labels)
    assert rows.columns == docs.columns and rows.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mixed_rows(docs, labels.limit(0)).count() == 7
    assert [r["rate"] for r in mixing.mix(docs, labels.limit(0)).collect()] == [1.0] * 7
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_labelled_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"))
    assert ngrams.labelled_sample(labels, 500).count() == 500 and ngrams.labelled_sample(labels, 5000).count() == 5000


@pytest.mark.parametrize("ids", ["1L", "cast(null as long)", "1152921504606846976L + id", "if(id % 3 = 0, null, -9223372036854775807L + id % 7)",
                                 "if(id % 2 = 0, -9223372036854775808L, 9223372036854775807L - id)"])
def test_cut_among_tied_keys(spark, ids):
    rows = spark.range(20_000).selectExpr(f"{ids} as doc_id", "if(id < 5, 2.0D, if(id < 19990, 1.0D, 0.5D)) as key").repartition(4)
    stored = rows.persist()
    ranked = sorted(((r["key"], r["doc_id"]) for r in stored.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (1, 5, 6, 10_000, 19_990, 19_991, 20_000):
        assert importance.kth_largest(stored, k) == ranked[k - 1]
        assert importance.kth_largest(stored, k, small=3, bins=16) == ranked[k - 1]
    stored.unpersist()


def test_cut_among_neighbouring_doubles(spark):
    keys = [1.0]
    for _ in range(300):
        keys.append(float(np.nextafter(keys[-1], 2)))
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(keys * 3)], "key double, doc_id long").persist()
    ranked = sorted(((r["key"], r["doc_id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 450, 903):
        assert importance.kth_largest(rows, k, small=2, bins=8) == ranked[k - 1]


def test_gumbel_top_k_with_a_hot_id(spark):
    scored = spark.range(30_000).selectExpr("if(id < 12000, 7L, if(id < 24000, null, id)) as doc_id", "0.0D as log_ratio").persist()
    kept = importance.gumbel_top_k(scored, 15_000).filter("kept").count()
    assert kept >= 15_000 and kept in {c + n for c in (0, 12_000, 24_000) for n in range(6001)}


def _collected(monkeypatch):
    """Sizes of what reaches the driver as rows or as a pandas table."""
    from pyspark.sql.classic.dataframe import DataFrame
    sizes = []
    for name in ("collect", "toPandas"):
        def counted(self, _inner=getattr(DataFrame, name)):
            out = _inner(self)
            sizes.append((len(out), "text" in self.columns or "log_ratio" in self.columns or "x" in self.columns or "bits" in self.columns))
            return out
        monkeypatch.setattr(DataFrame, name, counted)
    return sizes


@pytest.mark.parametrize("hot", [7, None])
def test_labelled_rows_on_the_driver_are_bounded(spark, docs_of, monkeypatch, hot):
    """One id (or none) that a third of the rows share: no more rows of documents than labelled ids reach the driver."""
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "eta"]
    rows = [(i, " ".join(rng.choice(words, 30)), "en" if i % 2 else "de") for i in range(1000)]
    rows += [(hot, f"same {i % 40} text " * 5, "en") for i in range(500)]
    docs = docs_of(rows).repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    sizes = _collected(monkeypatch)
    importance.resample(docs, labels, max_labelled=50)
    monkeypatch.setattr(mixing, "MAX_LABELLED", 50)
    mixing.fit_classifier(docs, labels, mixing.domain_label(), max_labelled=50)
    assert max(n for n, of_docs in sizes if of_docs) <= 50
    sizes.clear()
    assert langid.train(docs, max_docs=60).langs == ["de", "en"]
    assert max(n for n, of_docs in sizes if of_docs) <= 2 * 60


def test_bucket_counts_and_ratios_by_definition(spark, docs_of, small_texts):
    """The log ratios of the classifier from n-gram counts taken word by word."""
    docs = [(i, t) for i, t in small_texts if i is not None]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i, _ in docs[::2]], "doc_id long, quality int, toxic int")

    def buckets(text):
        _, found = ngrams.streams(pa.array([text or ""]))
        return np.concatenate(found) if len(found[0]) else np.zeros(0, np.int64)

    first = {}
    for i, t in docs:
        if t is not None:
            first[i] = min(first.get(i, t), t)
    label = {r["doc_id"]: r["quality"] for r in labels.groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "quality").collect()}
    target, raw = np.zeros(ngrams.BUCKETS), np.zeros(ngrams.BUCKETS)
    for i, t in small_texts:
        np.add.at(raw, buckets(t), 1)
    for i, q in label.items():
        if q:
            np.add.at(target, buckets(first.get(i)), 1)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + 20) / (expected + 20))
    got = {(r["doc_id"], round(r["log_weight"], 6)) for r in importance.resample(docs_of(small_texts), labels).collect()}
    assert got == {(i, round(float(ratio[buckets(t)].sum()), 6)) for i, t in small_texts}
