"""Kernels, quality rules, pieces and token counts against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from vicinity.llm import bytetext as bt
from vicinity.llm import pieces, quality_rules, token_counts
from vicinity.llm.queries import PIECE_MODEL, RANKS


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _counts(text):
    text, w = text or "", _words(text)
    lines = [x for x in text.split("\n") if _words(x)]
    found = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if found[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("limit", [1, 500, 4 << 20])
def test_count_features(small_texts, limit):
    texts = [t for _, t in small_texts]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(2)
    got = []
    for part in bt.slices(batch, "text", limit):
        f = quality_rules.count_features(part.column("text"))
        got += zip(*(f[c].tolist() for c in quality_rules.COUNTS[:5]))
    assert got == [_counts(t) for t in texts[2:]]


def test_span_hashes_tell_words_apart():
    col = pa.array(["ab ab ba a b aa  \x00 \x00\x00", None, "ab" * 700_000 + " ab"])
    data, offsets = bt.flat(col)
    start, end, first = bt.word_spans(data, offsets)
    h = bt.span_hashes(data, start, end)
    words = [bytes(data[a:b]) for a, b in zip(start, end)]
    assert first.tolist() == [0, 8, 8, 10]
    assert len(set(words)) == len(set(h.tolist())) and h[0] == h[1] == h[9]


def _thue_morse():
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_polynomial_twins_differ():
    a, b = _thue_morse()  # equal under every polynomial in the bytes modulo 2^64
    f = quality_rules.count_features(pa.array([f"{a}\n{b}", f"{a} x y {b} x y", f"{a}\n{a}", f"{a} x y {a} x y"]))
    assert f["n_dup_lines"].tolist() == [0, 0, 1, 0] and f["n_repeat_words"].tolist() == [0, 0, 0, 6]
    data, offsets = bt.flat(pa.array([f"{a} {b} {a}"]))
    h = bt.span_hashes(data, *bt.word_spans(data, offsets)[:2])
    assert h[0] != h[1] and h[0] == h[2]


def test_equal_hashes_of_different_spans(small_texts, monkeypatch):
    monkeypatch.setattr(bt, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(bt, "join_hashes", lambda *parts: parts[0].astype(np.uint64) % np.uint64(5))
    texts = [t for _, t in small_texts if len(t or "") < 300][-20:]
    f = quality_rules.count_features(pa.array(texts))
    assert list(zip(*(f[c].tolist() for c in quality_rules.COUNTS[:5]))) == [_counts(t) for t in texts]


def test_plain_words():
    f = quality_rules.count_features(pa.array(["Der gute, Mann. ganz! GROSS a1 x,, , été #"]))
    assert f["n_plain"].tolist() == [5]


def test_quality_rules_verdicts(docs_of):
    good = "The cat sat on a mat and saw tall trees there.\n"
    letters = "abcdefghijklmnopqrst"
    def text(i):
        return "".join(f"{x}{letters[i % 20]} {x}{letters[i // 20]} walked to town{x}.\n" for x in letters)
    rows = [(i, text(i)) for i in range(60)] + [(100 + i, re.sub(r"(\w+)", r"\1### ***", text(i))) for i in range(12)]
    rows += [(200, None), (201, good), (202, "one two three " * 60), (203, "")]
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.quality_counts(docs_of(rows))).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(12))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (200, 201, 202, 203))
    assert got[202]["n_repeat_words"] == 180 and not got[100]["base_failed"]


def test_quality_rules_empty_table(docs_of):
    assert quality_rules.judge(quality_rules.quality_counts(docs_of([]))).count() == 0


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.85
    miss, false = np.array([0.2, 0.3, 0.4]), np.array([0.02, 0.05, 0.01])  # bad kept by, good flagged by each rule
    bad_vote = np.where(good[:, None], rng.random((20_000, 3)) < false, rng.random((20_000, 3)) >= miss)
    votes = np.where(rng.random((20_000, 3)) < 0.1, 2, np.where(bad_vote, 0, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, rate, share = quality_rules.fit_em(patterns, counts)
    assert abs(share - 0.85) < 0.02 and np.abs(rate[1] - false).max() < 0.02 and np.abs(rate[0] - (1 - miss)).max() < 0.05


def test_pieces_equal_the_library(spark, docs_of, small_texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    model = pieces.read_model(spark, PIECE_MODEL)
    assert pieces.read_model(spark, f"file://{PIECE_MODEL}") == model
    assert pieces.Segmenter(model).by_chunk
    got = pieces.encode_decode(docs_of(small_texts), model).collect()
    want = [(i, sp.encode(t or "") + [sp.eos_id()]) for i, t in small_texts]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(
        ((i, ids, sp.decode(ids)) for i, ids in want), key=repr)
    digests = pieces.encode_digests(docs_of(small_texts), model).collect()
    assert sorted((tuple(r) for r in digests), key=repr) == sorted(
        ((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
          hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for i, ids in want), key=repr)
    assert pieces.encode_decode(docs_of([]), model).count() == 0


def test_pieces_segments_each_chunk_once(spark, docs_of, small_texts, monkeypatch):
    """The stored table has every distinct chunk once, in shards of bounded size, and is all that encoding asks."""
    model = pieces.read_model(spark, PIECE_MODEL)
    texts = [t or "" for _, t in small_texts]
    segmenter = pieces.Segmenter(model)
    monkeypatch.setattr(pieces, "HELD", 300)
    monkeypatch.setattr(pieces, "LONG", 1000)
    distinct = {c for t in texts for c in pieces.chunks_of(t)}
    chunks = pieces.task_chunks(docs_of(small_texts).repartition(4), 3)
    sent = [r["chunk"] for r in chunks.collect()]
    once = [r["chunk"] for r in pieces.task_chunks(docs_of(small_texts).coalesce(1), 3).collect()]
    assert sorted(once) == sorted(set(sent))
    assert set(sent) == {c for c in distinct if len(c) <= 1000} and any(len(c) > 1000 for c in distinct) and len(sent) > len(set(sent))
    table = pieces.store_table(chunks, model, 3)
    assert (table.bits, table.chunks) == (3, len(set(sent)))
    whole = list(pieces.encode_texts(texts, segmenter, None))
    seen = []
    segment = pieces.Segmenter.segment
    monkeypatch.setattr(pieces.Segmenter, "segment", lambda self, c: (seen.extend(c), segment(self, c))[1])
    assert list(pieces.encode_texts(texts, segmenter, table)) == whole
    assert set(seen) == {c for c in distinct if len(c) > 1000}
    assert [x for i in range(0, len(texts), 7) for x in pieces.encode_texts(texts[i:i + 7], segmenter, table)] == whole
    assert list(table.find([" not there"])) == [" not there"]


def test_pieces_with_one_hash(spark, docs_of, small_texts, monkeypatch):
    model = pieces.read_model(spark, PIECE_MODEL)
    texts = [t or "" for _, t in small_texts][-40:]

    class Hash:  # three values of the hash
        @staticmethod
        def xxh64_intdigest(raw, _sum=sum):
            return _sum(raw) % 3 << 62

    monkeypatch.setattr(pieces, "xxhash", Hash)
    store = pieces.ChunkTable("", 2, 0)
    blobs = {}
    monkeypatch.setattr(pieces, "map_array", lambda base, name, kind: blobs[name])
    distinct = sorted({c for t in texts for c in pieces.chunks_of(t) if len(c) <= pieces.LONG})
    segmenter = pieces.Segmenter(model)
    for s in range(4):
        mine = [c for c in distinct if sum(c.encode()) % 3 == s]
        ids, decoded = segmenter.segment(mine) if mine else ([], [])
        columns = [[c.encode() for c in mine], [x.encode() for x in ids], [b"" if d is None else b"=" + d.encode() for d in decoded]]
        blobs[f"hashes-{s}"] = np.full(len(mine), s << 62, np.uint64)
        for kind, data in zip(("chunk", "ids", "decoded"), columns):
            blobs[f"{kind}_ends-{s}"] = np.cumsum([len(d) for d in data]).astype(np.uint32)
            blobs[f"{kind}-{s}"] = np.frombuffer(b"".join(data), np.uint8)
    assert list(pieces.encode_texts(texts, segmenter, store)) == list(pieces.encode_texts(texts, segmenter, None))


def test_token_counts(spark, docs_of, small_texts):
    ranks = token_counts.read_ranks(spark, RANKS)
    assert token_counts.read_ranks(spark, f"file://{RANKS}") == ranks
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(enc.encode_ordinary(t or "")) for _, t in small_texts])
    table = token_counts.token_counts(docs_of(small_texts), ranks).cache()
    got = {r["n_tokens"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(n.tolist()))
    for x, r in got.items():
        assert (r["n_docs"], r["docs_upto"], r["tokens_upto"], r["docs_from"], r["tokens_from"], r["truncated_total"]) == (
            (n == x).sum(), (n <= x).sum(), n[n <= x].sum(), (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum())
    limits = [0, 1, 17, 512, 10 ** 6]
    assert token_counts.at_limits(table, limits) == {x: np.minimum(n, x).sum() for x in limits}
    q = token_counts.quantiles(table, [0.0, 0.5, 0.99, 1.0])
    assert all((n <= v).mean() >= s for s, v in q.items()) and q[1.0] == n.max()
    empty = token_counts.token_counts(docs_of([]), ranks)
    assert empty.count() == 0 and token_counts.at_limits(empty, [5]) == {5: 0}


def test_long_white_space(docs_of):
    ranks = token_counts.read_ranks(None, RANKS)
    encoding, whole = (tiktoken.Encoding("v", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                       for p in (token_counts.PATTERN, r"(?s).+"))
    runs = [" " * 1000, " " * 5000, "\n" * 3001, "\t \n" * 700, "\u3000" * 1500, "\x85\xa0" * 900 + " ", " " * 999, "\x1c" * 2000]
    for run in runs:
        for text in (run, "a" + run, run + "b", f"it{run}'s{run}ü{run}12{run}", f"!{run}?\n{run}\n "):
            assert token_counts.length_of(text, encoding, whole, token_counts.LONG_RUN) == len(encoding.encode_ordinary(text))
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000 + "end"), (3, "x" * 2_000_000), (4, None)]
    got = {r["n_tokens"]: r["n_docs"] for r in token_counts.token_counts(docs_of(rows), ranks).collect()}
    assert got == {2_000_000: 1, 1_000_002: 1, len(encoding.encode_ordinary("x" * 2_000_000)): 1, 0: 1}
