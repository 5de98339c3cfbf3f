"""Text columns: tokens, sentences, document type, content profile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
# What marks a line or span as markdown.
MARKDOWN = (
    r"^#{1,6}\s+",
    r"```[\s\S]*?```",
    r"^\s*[-*+]\s+",
    r"^\s*\d+\.\s+",
    r"\|.*\|",
    r"^\s*>\s+",
    r"\[.*\]\(.*\)",
    r"\*\*.*\*\*",
    r"\*.*\*",
)
#: Java's multi-line mode and dot with \n as the one line end.
_LINES = "(?md)"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands in it; inside lambdas nothing else shares what is common."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def filled(text: Column) -> Column:
    """Whether a text holds more than white space."""
    return text.rlike(r"\S")


def raw_sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space; blanks dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), filled)


def sentences(text: Column) -> Column:
    """Sentences without the white space around them."""
    return F.transform(raw_sentences(text), trimmed)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_LINES + pattern))


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def markdown_score(text: Column) -> Column:
    return sum((_count(text, p) for p in MARKDOWN), F.lit(0)) / F.greatest(n_lines(text), F.lit(1))


def document_type(score: Column) -> Column:
    return F.when(score > 0.1, "markdown").when(score > 0.02, "mixed").otherwise("plain_text")


def mean(values: Column) -> Column:
    """Mean of an array of numbers, 0 of an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def mean_line(text: Column) -> Column:
    return mean(F.transform(F.filter(F.split(text, "\n"), filled), lambda s: F.length(s).cast("double")))


def mean_sentence(text: Column) -> Column:
    return mean(F.transform(F.filter(F.split(text, "[.!?]+"), filled), lambda s: F.length(trimmed(s)).cast("double")))


def code_ratio(text: Column) -> Column:
    return _count(text, r"```[\s\S]*?```") / F.greatest(n_lines(text), F.lit(1))


def list_density(text: Column) -> Column:
    return _count(text, r"^\s*[-*+\d]+\.?\s+") / F.greatest(n_lines(text), F.lit(1))


def header_count(text: Column) -> Column:
    return _count(text, r"^#{1,6}\s+")


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), filled))


def one_line(text: Column) -> Column:
    """A text's lines joined by a space; a line end at the very end goes without one."""
    return F.regexp_replace(F.regexp_replace(text, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", " ")


#: Letters whose shares make the vector of a text, in place of a remote model.
LETTERS = "aeinstroldcum"


def letter_vector(text: Column) -> Column:
    """Shares of some letters in a text: a vector that needs no model; a blank text has none (all zero)."""
    share = lambda b: [(b["n"] - F.length(F.replace(b["low"], F.lit(c), F.lit("")))) / F.greatest(b["n"], F.lit(1)) for c in LETTERS]
    return let(F.lower(text), lambda low: let(F.struct(low.alias("low"), F.length(low).alias("n")), lambda b: F.array(*share(b))))


def letter_shares(lowered: pa.Array) -> np.ndarray:
    """The same vectors for texts that are lower-cased already, from the bytes of all of them at once."""
    lowered = lowered.cast(pa.large_string()).fill_null("") if lowered.null_count or not pa.types.is_large_string(lowered.type) else lowered
    ends = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1] if len(lowered) else np.zeros(1, np.int64)
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(lowered)), np.diff(ends))
    counts = np.bincount(row * (len(LETTERS) + 2) + _KIND[data], minlength=len(lowered) * (len(LETTERS) + 2)).reshape(len(lowered), len(LETTERS) + 2)
    # all bytes but those that go on with a character
    n = counts[:, :-1].sum(1)
    return counts[:, : len(LETTERS)] / np.maximum(n, 1)[:, None]


#: Of a byte of UTF-8: the letter that it is, another first byte, or one that goes on.
_KIND = np.array([LETTERS.index(chr(b)) if chr(b) in LETTERS else len(LETTERS) + (b & 0xC0 == 0x80) for b in range(256)])
