"""Licence scan: matching statistics against a generalised suffix automaton of licence words.

All phrases, notices and template texts go into one suffix automaton over words.  A text's words are streamed through
it: the matching statistic of a word is the length of the longest run of words ending there that stands in some
template.  A state knows which phrases end in it (through its suffix links), so every place of a phrase is read off the
stream; and runs of at least ``min_match`` words that can't be extended are chained, template by template, over gaps of
changed words into spans.  A span counts when it covers enough of its template.

Only runs of words whose neighbours stand side by side in some template can have a statistic above 1, so the words
between them, nearly all of a corpus, are passed over by array operations (their statistic, 0 or 1, matters nowhere).
The automaton's size depends on the templates alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.llm.license_texts import NOTICES, PHRASES, TEMPLATES

MIN_MATCH = 5     # words of a match that may begin or carry on a span
MAX_GAP = 12      # words between two matches of a span, in the text and in the template
MIN_COVER = 0.6   # share of a template's words that a span must match

# capital letters count as small ones; every other byte below 0x80 that is no digit or letter separates
SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

SPAN = "struct<label:string,kind:string,template:string,first_word:long,n_words:long,matched:long,template_words:long>"
SCHEMA = f"doc_id long, n_words long, covered_words long, spans array<{SPAN}>"


def words_of(text: str) -> list[bytes]:
    data = bt.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = bt.word_spans(data, np.array([0, len(data)]), SEPARATES)
    return [data[s:e].tobytes() for s, e in zip(start, end)]


class SuffixAutomaton:
    """Suffix automaton of several word sequences; state 0 stands for the empty run."""

    def __init__(self, sequences: Sequence[Sequence[int]], min_match: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, int]] = [{}]  # of a whole prefix's state: sequence -> words up to here
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words, 1):
                last = self._extend(last, word)
                ends += [{} for _ in range(len(self.next) - len(ends))]
                ends[last].setdefault(number, at)
        # the places a state's runs end at are its own and those of the states that link to it
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.whole: list[list[int]] = [[] for _ in self.next]  # sequences that are a suffix of the state's longest run
        by_length = sorted(range(1, len(self.next)), key=lambda v: -self.length[v])
        for v in by_length:
            self.places[v] += ends[v].items()
            if self.length[self.link[v]] >= min_match:
                self.places[self.link[v]] += self.places[v]
        lengths = [len(s) for s in sequences]
        for v in reversed(by_length):
            own = [s for s, at in ends[v].items() if at == lengths[s]]
            self.whole[v] = own + self.whole[self.link[v]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the run that ``word`` after the run of ``last`` makes."""
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        made = None if known is not None else self._state(self.length[last] + 1, 0, {})
        v = last
        while made is not None and v >= 0 and word not in self.next[v]:
            self.next[v][word] = made
            v = self.link[v]
        if v < 0:
            return made
        target = self.next[v][word]
        if self.length[target] == self.length[v] + 1:
            self.link[made] = target
            return made
        # the shorter runs of the target end at more places now: they get a state of their own
        split = self._state(self.length[v] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = split
        if made is not None:
            self.link[made] = split
        while v >= 0 and self.next[v].get(word) == target:
            self.next[v][word] = split
            v = self.link[v]
        return split if made is None else made

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """``(state, length)`` of the longest known run that ends at each word."""
        v = n = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v, n = (self.next[v][word], n + 1) if word in self.next[v] else (0, 0)
            yield v, n


@dataclass
class Chain:
    """Matches of one template in order: words ``first`` to ``last`` of the text, up to ``end`` of the template."""
    first: int
    last: int
    end: int
    matched: int
    pieces: list[tuple[int, int]] = field(default_factory=list)


def chain(matches: Sequence[tuple[int, int, int]], max_gap: int) -> list[Chain]:
    """Chains of ``(first word in the text, first word in the template, words)``, sorted by place in the text.

    A match carries on the open chain that reaches furthest in the template without passing it, if the gaps on both
    sides are at most ``max_gap``; words that the chain has already are cut off its front.  A chain further back than
    that is closed, so the open ones are few.
    """
    done: list[Chain] = []
    open_: list[Chain] = []
    for first, begin, n in matches:
        done += [c for c in open_ if first - c.last > max_gap + 1]
        open_ = [c for c in open_ if first - c.last <= max_gap + 1]
        best = None
        for c in open_:
            cut = max(0, c.last + 1 - first, c.end - begin)
            if cut < n and begin + cut - c.end <= max_gap and (best is None or c.end > best[0].end):
                best = c, cut
        if best is None:
            open_.append(Chain(first, first + n - 1, begin + n, n, [(first, first + n)]))
        else:
            c, cut = best
            c.last, c.end, c.matched = first + n - 1, begin + n, c.matched + n - cut
            c.pieces.append((first + cut, first + n))
    return done + open_


class LicenseScanner:
    """The automaton of a set of phrases (label by phrase), notices (likewise) and templates (name, label, text)."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES,
                 templates: Sequence[tuple[str, str, str]] = TEMPLATES, min_match: int = MIN_MATCH,
                 max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.entries = ([("phrase", p, label) for p, label in phrases.items()]
                        + [("notice", p, label) for p, label in notices.items()]
                        + [("template", name, label) for name, label, _ in templates])
        texts = [words_of(t) for t in [*phrases, *notices, *(text for _, _, text in templates)]]
        if not all(texts):
            raise ValueError("a phrase, notice or template has no words")
        self.ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        sequences = [[self.ids[w] for w in t] for t in texts]
        self.lengths = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences, min_match)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        data = np.frombuffer(b"".join(self.ids), np.uint8)
        ends = np.cumsum([len(w) for w in self.ids])
        hashes = bt.span_hashes(data, ends - np.array([len(w) for w in self.ids]), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.beside = np.zeros((len(self.ids) + 1, len(self.ids) + 1), bool)  # by word, then the next; the last: any other
        self.opens, self.alone = np.zeros_like(self.beside), np.zeros(len(self.ids) + 1, bool)  # phrases' first words
        for s, (kind, _, _) in zip(sequences, self.entries):
            self.beside[s[:-1], s[1:]] = True
            if kind != "template" and len(s) == 1:
                self.alone[s[0]] = True
            elif kind != "template":
                self.opens[s[0], s[1]] = True

    def scan(self, col: pa.Array) -> tuple[np.ndarray, list[int], list[list[tuple]]]:
        """``(words, covered words, spans)`` of each text of an Arrow string column."""
        data, offsets = bt.flat(col)
        data = bt.LOWER[data]
        start, end, first = bt.word_spans(data, offsets, SEPARATES)
        spans: list[list[tuple]] = [[] for _ in range(len(col))]
        covered = [0] * len(col)
        for text, runs in self._runs(data, start, end, first):
            spans[text], covered[text] = self._spans(runs)
        return np.diff(first), covered, spans

    def _runs(self, data, start, end, first) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
        """For each text that has any: its runs of neighbours that stand side by side in some template, by first word.

        Runs that are shorter than a match and in which no phrase begins are left out.
        """
        if not len(start):
            return
        hashes = bt.span_hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.where(self.hashes[at] == hashes, self.order[at], len(self.ids))
        joined = self.beside[word[:-1], word[1:]]
        heads = first[1:-1]
        joined[heads[(heads > 0) & (heads < len(word))] - 1] = False
        marks = self.alone[word]
        marks[:-1] |= joined & self.opens[word[:-1], word[1:]]
        lo = np.concatenate(([0], np.flatnonzero(~joined) + 1))
        hi = np.append(lo[1:], len(word))
        marked = np.concatenate(([0], np.cumsum(marks)))
        kept = (hi - lo >= self.min_match) | (marked[hi] > marked[lo])
        lo, hi = lo[kept], hi[kept]
        text = np.searchsorted(first, lo, side="right") - 1
        unknown = len(self.ids)  # a word whose hash is a template word's, but not its bytes
        bounds = np.flatnonzero(np.diff(text, prepend=-1, append=len(first)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(text[a]), [(int(x - first[text[a]]), [self.ids.get(data[start[i]:end[i]].tobytes(), unknown) for i in range(x, y)])
                                 for x, y in zip(lo[a:b], hi[a:b])]

    def _spans(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple], int]:
        """``(spans, words they cover)`` of one text."""
        spans, pieces = [], []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for begin, words in runs:
            previous = (0, 0)
            stream = [*self.automaton.statistics(words), (0, 0)]
            for at, (state, n) in enumerate(stream):
                if n <= previous[1] and previous[1] >= self.min_match:  # the run up to the word before goes no further
                    for number, to in self.automaton.places[previous[0]]:
                        matches.setdefault(number, []).append((begin + at - previous[1], to - previous[1], previous[1]))
                for number in self.automaton.whole[state]:
                    kind, name, label = self.entries[number]
                    size = self.lengths[number]
                    if kind != "template" and size <= n:
                        where = begin + at - size + 1
                        spans.append((label, kind, name, where, size, size, size))
                        pieces.append((where, where + size))
                previous = (state, n)
        for number, found in matches.items():
            kind, name, label = self.entries[number]
            for c in chain(sorted(found), self.max_gap) if kind == "template" else ():
                if c.matched >= self.min_cover * self.lengths[number]:
                    spans.append((label, kind, name, c.first, c.last - c.first + 1, c.matched, self.lengths[number]))
                    pieces += c.pieces
        covered = reach = 0
        for lo, hi in sorted(pieces):
            covered += max(0, hi - max(lo, reach))
            reach = max(reach, hi)
        return sorted(spans, key=lambda s: (s[3], s[4], s[:3])), covered


def scan_licenses(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCHEMA``: for every text its words, the words inside licence spans and the spans; map only.

    A span has the label, kind (``phrase``, ``notice`` or ``template``) and name of what it matches, its place in the
    text in words, and how many of the template's words it matches.  Phrases and notices are listed at every place.

    * null, empty or blank text: no words, no spans; null or repeated ids, repeated rows: a row each;
    * empty table: no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or LicenseScanner())

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                words, covered, spans = shared.value.scan(part.column("text"))
                names = ("label", "kind", "template", "first_word", "n_words", "matched", "template_words")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(covered, pa.int64()),
                     pa.array([[dict(zip(names, s)) for s in found] for found in spans], _SPANS)],
                    ["doc_id", "n_words", "covered_words", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("template", pa.string()), ("first_word", pa.int64()),
                             ("n_words", pa.int64()), ("matched", pa.int64()), ("template_words", pa.int64())]))


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` from :func:`scan_licenses`.

    The phrases are the base; ``labels`` has those of all spans; ``score`` is the share of the words inside spans.
    """
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    starts = F.transform(base, lambda s: s["first_word"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        (F.col("covered_words") / F.greatest("n_words", F.lit(1))).alias("score"))
