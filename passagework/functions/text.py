"""Text functions, all built-in expressions.

Java patterns take ``(?U)`` wherever classes and word edges must know Unicode, and ``(?d)``
where a dot must stop at \\n alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what stands for them.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2011": "-", "\u00a0": " ", "\u200b": ""}
SOFT_HYPHEN = "\u00ad"
SPACE = r"(?U)\s+"


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column, space: str = SPACE) -> Column:
    """Runs of white space (Unicode's, or what ``space`` matches) as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, space, " "), F.lit(" "))


def normalize(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens dropped, white space collapsed."""
    return collapse(_replaced(text, {**LIGATURES, SOFT_HYPHEN: "", "\t": " "}))


def words(text: Column) -> Column:
    """Words between Unicode white space; no words in an empty text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def estimate(n_words: Column) -> Column:
    """Estimated tokens of so many words: 1.3 times, halves to even."""
    return F.bround(n_words.cast("double") * F.lit(1.3)).cast("int")


def estimate_tokens(text: Column) -> Column:
    return estimate(word_count(text))


def fold(text: Column) -> Column:
    """Caseless form for matching: lower case, sharp s spelled out, plain apostrophe and space."""
    return _replaced(F.lower(text), {"ß": "ss", "\u2019": "'", "\u00a0": " "})


def is_form_blank(text: Column) -> Column:
    """More underscores than letters and digits, and at least one."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit("_"), F.lit("")))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (blanks > 0) & (blanks > alnum)


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def letterspaced(text: Column) -> Column:
    """At least 8 runs of ASCII letters of which over 45 % have 1 or 2 letters."""
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    short = F.size(F.filter(tokens, lambda t: F.length(t) <= 2))
    return (F.size(tokens) >= 8) & (short > F.size(tokens) * F.lit(0.45))


def same_title(heading: Column, title: Column) -> Column:
    """Equal up to case and outer dots and spaces, or one of 12 characters or more begins the other."""
    left, right = (F.btrim(_replaced(F.lower(x), {"ß": "ss"}), F.lit(" .")) for x in (heading, title))
    return (left == right) | ((F.length(left) >= 12) & (F.startswith(right, left) | F.startswith(left, right)))


def preview(text: Column, limit: int = 160) -> Column:
    """White space collapsed; over the limit, cut to it with three dots."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def markdown_cell(text: Column) -> Column:
    return F.replace(normalize(text), F.lit("|"), F.lit("\\|"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def markdown_table(header: Column, rows: Column) -> Column:
    """Header row, separator row, and data rows padded or cut to the header's width."""
    n = F.size(header)
    padded = lambda r: F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(r, i), F.lit("")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(markdown_row(header), rule), F.transform(rows, lambda r: markdown_row(padded(r)))), "\n")
