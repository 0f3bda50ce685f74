"""Licence scan: the automaton against substring search, spans and digests against plain Python."""

import random
import re

import pyarrow as pa
import pytest

from vicinity.llm import license_scan as ls
from vicinity.llm.license_texts import PHRASES, TEMPLATES
from vicinity.llm.queries import QUERIES

MIT = next(t for name, _, t in TEMPLATES if name == "mit-permission")


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    letters = rng.choice([2, 3, 5])
    known = [[rng.randrange(letters) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
    known.append(known[0][: max(1, len(known[0]) // 2)])
    stream = [rng.randrange(letters + 1) for _ in range(60)] + known[0] + known[-1]
    automaton = ls.SuffixAutomaton(known, 2)

    def ends(run):  # places where a run ends in the known sequences
        return {(k, i + len(run)) for k, s in enumerate(known) for i in range(len(s) - len(run) + 1) if s[i:i + len(run)] == run}

    for at, (state, n) in enumerate(automaton.statistics(stream)):
        best = max((m for m in range(at + 2) if m == 0 or ends(stream[at + 1 - m:at + 1])), default=0)
        assert n == best
        if n >= 2:
            assert set(automaton.places[state]) == ends(stream[at + 1 - n:at + 1])
        whole = {k for k in automaton.whole[state] if len(known[k]) <= n}
        assert whole == {k for k, s in enumerate(known) if s == stream[max(0, at + 1 - len(s)):at + 1]}


def test_base_places_and_edges(docs_of, small_texts):
    texts = ["MIT License, mit  license MIT-licenses; mit\x00license", "General public license. the gnu general public LICENSE",
             "apache license mit", "license mit license", "émit license", "mitlicense mit licenseé", "mit", "license",
             "MIT\nlicense " * 5000, "apache " * 3 + "license", MIT]
    docs = small_texts + [(20_000 + i, t) for i, t in enumerate(texts)] + [(20_000, texts[0]), (None, texts[1])]
    got = ls.digest(ls.scan_licenses(docs_of(docs).repartition(3))).collect()
    want = []
    for i, t in docs:
        w = _words(t)
        found = [(p, label) for phrase, label in PHRASES.items() for p in _places(w, phrase)]
        starts = [p for p, _ in found]
        want.append((i, len(w), len(found), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({label for _, label in found}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_slices_do_not_join_texts(docs_of):
    scanner = ls.LicenseScanner()
    words, covered, spans = scanner.scan(pa.array(["the mit", "license", None, "", "apache license"]))
    assert words.tolist() == [2, 1, 0, 0, 2] and covered == [0, 0, 0, 0, 2]
    assert [len(s) for s in spans] == [0, 0, 0, 0, 1]


def _spans(docs_of, text, **options):
    return ls.scan_licenses(docs_of([(1, text)]), ls.LicenseScanner(**options)).first()


def test_whole_and_changed_templates(docs_of):
    for name, label, text in TEMPLATES:
        row = _spans(docs_of, "zz " * 50 + text + " zz" * 30)
        found = [s for s in row["spans"] if s["template"] == name]
        n = len(_words(text))
        assert [(s["label"], s["first_word"], s["n_words"], s["matched"]) for s in found] == [(label, 50, n, n)]
        assert row["covered_words"] >= n
    words = _words(MIT)
    changed = words[:20] + ["foo", "bar"] + words[22:60] + words[63:]  # two words replaced, three left out
    (span,) = [s for s in _spans(docs_of, "x y " + " ".join(changed))["spans"] if s["template"] == "mit-permission"]
    assert (span["first_word"], span["n_words"], span["matched"]) == (2, len(changed), len(words) - 5)


def test_parts_below_the_cover_are_no_span(docs_of):
    words = _words(MIT)
    assert _spans(docs_of, " ".join(words[:40]))["spans"] == []
    assert [s["label"] for s in _spans(docs_of, " ".join(words[:40]), min_cover=0.3)["spans"]] == ["mit"]
    far = " ".join(words[:45]) + " zz" * 40 + " " + " ".join(words[45:])
    assert _spans(docs_of, far)["spans"] == []  # further apart than a gap


def test_repeated_template_is_a_span_each(docs_of):
    n = len(_words(MIT))
    row = _spans(docs_of, (MIT + "\n") * 200)
    assert [s["first_word"] for s in row["spans"] if s["template"] == "mit-permission"] == [i * n for i in range(200)]
    assert row["covered_words"] == row["n_words"] == 200 * n


def test_words_of_one_and_clashing_templates(docs_of):
    row = _spans(docs_of, "a b unlicense c d e f g b c", phrases={"unlicense": "u"}, notices={"b c": "n"},
                 templates=[("t", "t", "c d e f g"), ("t2", "t2", "d e f g b c d")], min_match=3, min_cover=0.8)
    assert [(s["label"], s["first_word"], s["matched"]) for s in row["spans"]] == [("u", 2, 1), ("t", 3, 5), ("t2", 4, 6), ("n", 8, 2)]
    with pytest.raises(ValueError):
        ls.LicenseScanner(phrases={"--": "x"})


def test_empty_table_and_query(spark, docs_of):
    assert ls.digest(ls.scan_licenses(docs_of([]))).collect() == []
    got = QUERIES["op13_license_scan"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = got.filter("labels <> ''").collect()
    assert {r["base_labels"] for r in rows} == {"", "mit", "apache", "gpl"} and any("cc-by-nc" in r["labels"] for r in rows)
