"""Text expressions: folding, tokens, aliases, boilerplate, phrases.

Everything is a column expression. Texts of ASCII only, which one comparison of lengths tells, stay on
the JVM; others go through Arrow, for compatibility normalisation, full case folding and accents,
which Spark has no built-in for. The two ways give the same for ASCII, so there is one tokeniser.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)[\s\x1c-\x1f]+"
LIST = T.ArrayType(T.StringType())
SLICE = 1 << 20  # bytes of text that are Python strings at once


def in_slices(texts: pa.Array, use: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """use of each text, null for null, with about SLICE bytes of them as Python strings at a time; a longer text is alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = [pa.array([None if t is None else use(t) for t in part.to_pylist()], kind) for part in slices_of(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def slices_of(texts: pa.Array) -> Iterator[pa.Array]:
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > start and size + (n or 0) > SLICE:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(texts):
        yield texts.slice(start)


def python_fold(value: str) -> str:
    return value.lower() if value.isascii() else unicodedata.normalize("NFKC", value).casefold()


@F.arrow_udf(T.StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return in_slices(texts, python_fold, pa.string())


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def apart(col: Column, plain: Column, other: Callable[[Column], Column]) -> Column:
    """plain for ASCII texts, other, which sees only the rest, for all else."""
    return F.when(is_ascii(col), plain).otherwise(other(F.when(~is_ascii(col), col)))


def fold(col: Column) -> Column:
    """Compatibility form with case folded. Null stays null."""
    return apart(col, F.lower(col), _fold)


def fold_any(col: Column) -> Column:
    """fold for a computed column, which it reads once: everything goes through Arrow."""
    return _fold(col)


def let(col: Column, use: Callable[[Column], Column]) -> Column:
    """use(col) with col computed once, however often use refers to it. Python functions can't stand in use."""
    return F.element_at(F.transform(F.array(col), use), 1)


def newlines(col: Column) -> Column:
    """Valid UTF-8 with all line ends as a line feed."""
    return F.regexp_replace(F.make_valid_utf8(col), "\r\n?", "\n")


def split_hyphens(col: Column) -> Column:
    return F.translate(col, "-‐‑‒–—", "      ")


def drop_apostrophes(col: Column) -> Column:
    return F.translate(col, "'’", "")


TOKEN = re.compile(r"[^\W_]+")
APART = {ord(c): " " for c in "-‐‑‒–—"} | {ord(c): None for c in "'’"}


def python_tokens(value: str) -> list[str]:
    """The runs of letters and numbers of the folded text, in order, repeats kept."""
    return TOKEN.findall(python_fold(value).translate(APART))


def python_alias(token: str) -> str:
    """A token without combining accents."""
    return token if token.isascii() else "".join(c for c in unicodedata.normalize("NFD", token) if unicodedata.category(c) != "Mn")


def python_query_tokens(value: str) -> list[str]:
    """Tokens, then each new accent-free spelling once."""
    toks = python_tokens(value)
    known = set(toks)
    return toks + [a for a in dict.fromkeys(map(python_alias, toks)) if a not in known]


@F.arrow_udf(LIST)
def _tokens(texts: pa.Array) -> pa.Array:
    return in_slices(texts, python_tokens, pa.list_(pa.string()))


@F.arrow_udf(LIST)
def _query_tokens(texts: pa.Array) -> pa.Array:
    return in_slices(texts, python_query_tokens, pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def _alias(texts: pa.Array) -> pa.Array:
    return in_slices(texts, python_alias, pa.string())


@F.arrow_udf(T.StringType())
def _phrase(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda t: " ".join(TOKEN.findall(python_fold(t))), pa.string())


@F.arrow_udf(LIST)
def _author_keys(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda t: [" ".join(sorted(python_tokens(a))) for a in t.split(";") if a.strip()], pa.list_(pa.string()))


def words(ascii_text: Column) -> Column:
    """The tokens of a text of ASCII only."""
    return F.regexp_extract_all(drop_apostrophes(split_hyphens(F.lower(ascii_text))), F.lit("([a-z0-9]+)"), F.lit(0))


def tokens(col: Column) -> Column:
    """Document tokens. Null gives an empty list."""
    return F.coalesce(apart(col, words(col), _tokens), F.array().cast("array<string>"))


def strip_accents(col: Column) -> Column:
    """Letters without combining accents."""
    return apart(col, col, _alias)


def query_tokens(col: Column) -> Column:
    """Tokens, then each new accent-free spelling once."""
    return F.coalesce(apart(col, words(col), _query_tokens), F.array().cast("array<string>"))


def _first_line(lines: Column, mark: str) -> Column:
    return F.array_position(F.transform(lines, lambda x: x.rlike(rf"(?i)\*\*\* {mark} OF")), True)


def _between(lines: Column, found: Column) -> Column:
    start, end, n = found["start"], found["end"], F.size(lines)
    low = F.when(start > 0, start + 1).otherwise(1).cast("int")
    high = F.when(end > 0, end - 1).otherwise(n).cast("int")
    kept = F.when(high >= low, F.slice(lines, low, F.greatest(high - low + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(kept, "\n")


def strip_boilerplate(text: Column) -> Column:
    """What stands between the first START and the first END line; with one of them, that half; else all."""

    def cut(t: Column) -> Column:
        def inner(lines: Column) -> Column:
            marks = F.struct(_first_line(lines, "START").alias("start"), _first_line(lines, "END").alias("end"))
            return let(marks, lambda m: _between(lines, m))

        return F.when(t.rlike(r"(?i)\*\*\* (START|END) OF"), let(F.split(t, "\n", -1), inner)).otherwise(t)

    return let(text, cut)


def squeeze(col: Column) -> Column:
    """White space runs as one blank, none outside."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def metadata_form(col: Column) -> Column:
    """Folded, hyphens as blanks, no apostrophes, punctuation kept. Null gives an empty text."""
    return squeeze(drop_apostrophes(split_hyphens(fold(F.coalesce(col, F.lit(""))))))


def sorted_key(col: Column) -> Column:
    return F.array_join(F.array_sort(tokens(col)), " ")


def author_keys(col: Column) -> Column:
    """The sorted tokens of each author between semicolons."""
    text = F.coalesce(col, F.lit(""))
    plain = F.transform(F.filter(F.split(text, ";"), lambda a: F.trim(a) != ""), lambda a: F.array_join(F.array_sort(words(a)), " "))
    return apart(text, plain, _author_keys)


def phrase_form(col: Column) -> Column:
    """Folded, everything but letters and numbers as one blank."""
    text = F.coalesce(col, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return apart(text, plain, _phrase)


def phrase_query(raw: Column) -> Column:
    """The quoted spans if there are any with a word, else the whole query."""
    spans = F.filter(F.transform(F.regexp_extract_all(raw, F.lit('"(.*?)"'), F.lit(1)), F.trim), lambda x: x != "")
    quoted = phrase_form(F.array_join(spans, " "))
    return F.coalesce(F.nullif(quoted, F.lit("")), phrase_form(raw))


def plain_number(col: Column) -> Column:
    """The digit run of a book number without leading zeros and decimal part; null without digits."""
    digits = F.regexp_extract(col, r"(\d+)", 1)
    return F.when(digits != "", F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))
