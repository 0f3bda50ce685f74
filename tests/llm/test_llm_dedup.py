"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import exact_dedup, fixed_filter, simhash


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return out


def test_exact_groups_match_brute_force(docs_of, small_texts):
    rows = small_texts + [(20_000 + k, t if k % 2 else f" {t} ") for k, (_, t) in enumerate(small_texts[:40])]
    got = exact_dedup.exact_groups(docs_of(rows)).collect()
    assert sorted((tuple(r)[:3] + (r["text_sha256"],) for r in got), key=repr) == sorted(_exact(rows), key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_filter_size_changes_nothing(docs_of, small_texts, monkeypatch):
    docs = docs_of(small_texts)
    whole = sorted(map(repr, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(fixed_filter, "_SLICE", 8)  # 2,048 bits: nearly every bit is set
    assert sorted(map(repr, exact_dedup.exact_groups(docs, filter_mb=1).collect())) == whole


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(docs_of):
    docs = docs_of([(1, "a b"), (2, "ab"), (2, "ab"), (3, "c"), (3, "c"), (None, "d"), (None, None), (5, " ")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(1, "a b"), (3, "c"), (None, "d"), (5, " ")], key=repr)


def test_exact_empty_table(docs_of):
    docs = docs_of([])
    assert exact_dedup.exact_groups(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_exact_plan_runs_no_python(docs_of, small_texts):
    plan = exact_dedup.exact_groups(docs_of(small_texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def _fingerprint(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits):
            root[find(i)] = find(i + 1 + int(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs_of, small_texts):
    rows = [r for r in small_texts if r[0] is not None]
    base = [t for _, t in rows if t and 300 < len(t.split())][:10]
    rows = rows + [(30_000 + 10 * k + j, t + " more" * j) for k, t in enumerate(base) for j in range(3)]
    fps = [_fingerprint(t) for _, t in rows]
    roots, least = _components(fps, 4), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))
    docs = docs_of(rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())


def test_near_dedup_judges_rows_not_ids(docs_of):
    long = " ".join(f"w{i}" for i in range(300))
    near = long + " end"
    assert bin(int(np.bitwise_xor(*simhash.fingerprints(pa.array([long, near]), 4, 42)))).count("1") <= 4
    rows = [(1, long), (7, near), (7, "a text of its own, unlike all others"), (None, near), (None, "once more new words"),
            (None, "once more new words"), (9, "the same row twice"), (9, "the same row twice")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs_of(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)


@pytest.mark.parametrize("bits,block", [(4, 40), (4, 8192), (3, 20), (2, 8192), (6, 100), (1, 30)])
def test_links_connect_what_all_pairs_connect(spark, bits, block):
    rng = np.random.default_rng(bits)
    fps = {int(x) for x in rng.integers(0, 2 ** 63, 100, dtype=np.uint64)} | {0, 2 ** 64 - 1}
    for base in rng.integers(0, 2 ** 63, 3, dtype=np.uint64):
        for _ in range(120):
            x = int(base)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, block)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > bits).count() == 0
    roots = dict(map(tuple, simhash.components(links).collect()))
    got, want = {}, {}
    for x, r in zip(signed, _components(fps, bits)):
        got.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_simhash_empty_table_and_null_ids(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    rows = simhash.near_duplicates(docs_of([(None, "x"), (None, ""), (4, None), (4, None)])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=repr) == [(4, 4), (4, 4), (None, 4), (None, None)]
