"""Text Column expressions: tokenizer (T1), sentence splitter (T2), sequence
encoding with role markers (T4) and special-position stripping (T5).

Everything is a JVM-side regex / array expression: no Python on the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------------
# simple tokenizer: maximal runs of word characters that are not decimal digits,
# lower-cased, length 2..15, not starting with "_"; the reference's optional cut to
# the first 512 tokens is a parameter (queries here process whole texts)
TOKEN_PATTERN = r"[\p{L}\p{Nl}\p{No}_]+"
TOKEN_MIN_LEN = 2
TOKEN_MAX_LEN = 15
MAX_TOKENS = 512

# sentence splitter word lists and patterns
SENT_ALPHABETS = "([A-Za-z])"
SENT_PREFIXES = "(Mr|St|Mrs|Ms|Dr)[.]"
SENT_SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
SENT_STARTERS = (r"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s"
                 r"|That\s|This\s|Wherever)")
SENT_ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
SENT_WEBSITES = "[.](com|net|org|io|gov|edu|me)"
SENT_DIGITS = "([0-9])"
MAX_SENTENCES = 16

# role markers and special tokens of the sequence encoder
QUERY_MARKER = "[Q]"
DOC_MARKER = "[D]"
CLS_TOKEN = "[CLS]"
SEP_TOKEN = "[SEP]"
MAX_LENGTH = 512
# -----------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_tokens(text, min_len: int = TOKEN_MIN_LEN, max_len: int = TOKEN_MAX_LEN,
                  max_tokens: int | None = None) -> Column:
    """Lower-cased word tokens without digits, ``min_len..max_len`` characters,
    not starting with ``_`` (T1); ``max_tokens`` (the reference uses 512) keeps
    only the first tokens - off by default, whole texts are tokenized."""
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), F.lit(0))
    toks = F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len) & ~t.startswith("_"))
    return F.slice(toks, 1, int(max_tokens)) if max_tokens else toks


def _sub(col: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(repl))


def _lit_replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def split_sentences(text, max_sentences: int | None = None) -> Column:
    """Rule-based sentence splitter (T2) as a chain of JVM regex replaces.

    ``max_sentences`` (the reference uses 16) keeps the first sentences; off
    by default.  Python's ``\\s`` is Unicode-aware, hence ``(?U)``; a run of n >= 2 dots
    becomes n protected dots plus a break (two replaces, no callback needed).
    """
    s = F.concat(F.lit(" "), _c(text), F.lit("  "))
    s = _lit_replace(s, "\n", " ")
    s = _sub(s, SENT_PREFIXES, "$1<prd>")
    s = _sub(s, SENT_WEBSITES, "<prd>$1")
    s = _sub(s, SENT_DIGITS + "[.]" + SENT_DIGITS, "$1<prd>$2")
    s = _sub(s, r"(\.{2,})", "$1<stop>")
    s = _sub(s, r"\.(?=\.)|(?<=\.)\.", "<prd>")
    s = _lit_replace(s, "Ph.D.", "Ph<prd>D<prd>")
    s = _sub(s, r"(?U)\s" + SENT_ALPHABETS + "[.] ", " $1<prd> ")
    s = _sub(s, "(?U)" + SENT_ACRONYMS + " " + SENT_STARTERS, "$1<stop> $2")
    s = _sub(s, SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]", "$1<prd>$2<prd>$3<prd>")
    s = _sub(s, SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]", "$1<prd>$2<prd>")
    s = _sub(s, "(?U) " + SENT_SUFFIXES + "[.] " + SENT_STARTERS, " $1<stop> $2")
    s = _sub(s, " " + SENT_SUFFIXES + "[.]", " $1<prd>")
    s = _sub(s, " " + SENT_ALPHABETS + "[.]", " $1<prd>")
    s = _lit_replace(s, ".”", "”.")
    s = _lit_replace(s, '."', '".')
    s = _lit_replace(s, '!"', '"!')
    s = _lit_replace(s, '?"', '"?')
    s = _lit_replace(s, ".", ".<stop>")
    s = _lit_replace(s, "?", "?<stop>")
    s = _lit_replace(s, "!", "!<stop>")
    s = _lit_replace(s, "<prd>", ".")
    parts = F.transform(F.split(s, "<stop>"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    parts = F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""),
                   F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.slice(parts, 1, int(max_sentences)) if max_sentences else parts


def split_sentences_sql(text_expr: str, max_sentences: int | None = None) -> str:
    """DuckDB (RE2) twin of :func:`split_sentences`; RE2 has no look-around, so the
    dot-run rule protects pairs and then a protected dot followed by a dot."""
    def sub(e, pat, rep):
        pat = pat.replace("'", "''")
        rep = rep.replace("'", "''")
        return f"regexp_replace({e}, '{pat}', '{rep}', 'g')"

    def rep(e, old, new):
        return f"replace({e}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"

    s = f"(' ' || {text_expr} || '  ')"
    s = rep(s, "\n", " ")
    s = sub(s, SENT_PREFIXES, r"\1<prd>")
    s = sub(s, SENT_WEBSITES, r"<prd>\1")
    s = sub(s, SENT_DIGITS + "[.]" + SENT_DIGITS, r"\1<prd>\2")
    s = sub(s, r"(\.{2,})", r"\1<stop>")
    s = sub(s, r"\.\.", "<prd><prd>")
    s = sub(s, r"<prd>\.", "<prd><prd>")
    s = rep(s, "Ph.D.", "Ph<prd>D<prd>")
    s = sub(s, r"\s" + SENT_ALPHABETS + "[.] ", r" \1<prd> ")
    s = sub(s, SENT_ACRONYMS + " " + SENT_STARTERS, r"\1<stop> \2")
    s = sub(s, SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]", r"\1<prd>\2<prd>\3<prd>")
    s = sub(s, SENT_ALPHABETS + "[.]" + SENT_ALPHABETS + "[.]", r"\1<prd>\2<prd>")
    s = sub(s, " " + SENT_SUFFIXES + "[.] " + SENT_STARTERS, r" \1<stop> \2")
    s = sub(s, " " + SENT_SUFFIXES + "[.]", r" \1<prd>")
    s = sub(s, " " + SENT_ALPHABETS + "[.]", r" \1<prd>")
    s = rep(s, ".”", "”.")
    s = rep(s, '."', '".')
    s = rep(s, '!"', '"!')
    s = rep(s, '?"', '"?')
    s = rep(s, ".", ".<stop>")
    s = rep(s, "?", "?<stop>")
    s = rep(s, "!", "!<stop>")
    s = rep(s, "<prd>", ".")
    parts = f"list_transform(string_split({s}, '<stop>'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g'))"
    dropped = (f"(CASE WHEN len({parts}) > 0 AND {parts}[-1] = '' "
               f"THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")
    return f"{dropped}[1:{int(max_sentences)}]" if max_sentences else dropped


def encode_sequence(tokens, marker: str | None = DOC_MARKER, max_length: int | None = MAX_LENGTH,
                    special: bool = True) -> Column:
    """``[CLS] marker tokens... [SEP]`` cut to ``max_length`` keeping the end token (T4);
    ``max_length=None`` keeps the whole text.

    An empty / ``None`` marker means no marker (the reference's empty string option).
    """
    content = _c(tokens)
    if marker:
        content = F.concat(F.array(F.lit(marker)), content)
    if not special:
        return F.slice(content, 1, max_length) if max_length else content
    body = F.slice(content, 1, max_length - 2) if max_length else content
    return F.concat(F.array(F.lit(CLS_TOKEN)), body, F.array(F.lit(SEP_TOKEN)))


def inner_tokens(seq, has_marker: bool = True) -> Column:
    """Drop ``[CLS]`` (+ marker) and ``[SEP]``: positions ``start .. len-2`` (T5)."""
    start = 3 if has_marker else 2
    s = _c(seq)
    return F.slice(s, start, F.greatest(F.size(s) - start, F.lit(0)))
