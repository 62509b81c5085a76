"""Text functions with Python's meaning of white space, words, lines and JSON, as JVM-side columns."""

from __future__ import annotations

import textwrap
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() and str.strip() take for white space.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_JSON_SCALAR = (
    r"""\A(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity"""
    r"""|"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")\z"""
)
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def lines(text: Column) -> Column:
    """As splitlines()."""
    return F.split(text, r"\R|[\x1c-\x1e]")


def stripped_words(text: Column, marks: str = ".,!?;:\"'") -> Column:
    """Lower-cased words without those marks on either end."""
    inside = "".join(f"\\{m}" for m in marks)
    return F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, rf"\A[{inside}]+|[{inside}]+\z", ""))


def occurrences(text: Column, part: Column) -> Column:
    """Number of non-overlapping occurrences; of the empty part 0."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-cased text holds the word between word boundaries."""
    escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return text.rlike(rf"(?U)\b{escaped}\b")


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether the lower-cased text contains one of the parts anywhere."""
    low = F.lower(text)
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(low, F.lit(p))
    return found


def is_json(text: Column) -> Column:
    """Whether json.loads takes a scalar, or anything looks like an object or a list."""
    trimmed = strip(text)
    body = F.when(trimmed.rlike(_FENCE), strip(F.regexp_extract(trimmed, _FENCE, 1))).otherwise(trimmed)
    return text.rlike(r"\{[\s\S]*\}|\[[\s\S]*\]") | body.rlike(_JSON_SCALAR)


def parses_as_json(text: Column) -> Column:
    """Whether json.loads takes the text, or what stands in its first fence. An object that names a key twice does not pass.

    The parser stops behind the first value, whatever follows it. Within a list only a comma and more values may follow,
    within an object only a comma and a key with its value: what passes in both is one value and nothing else.
    """
    trimmed = strip(text)
    body = F.when(trimmed.rlike(_FENCE), strip(F.regexp_extract(trimmed, _FENCE, 1))).otherwise(trimmed)
    within = [F.try_parse_json(F.concat(F.lit(head), body, F.lit(tail))).isNotNull() for head, tail in (("[", "]"), ('{"":', "}"))]
    return (within[0] & within[1]) | body.rlike(_JSON_SCALAR)


def without_quotes(text: Column) -> Column:
    """Drop one pair of equal outer quotes, then strip."""
    trimmed = strip(text)
    return strip(F.regexp_replace(trimmed, r"""(?s)\A(["'])(.*)\1\z""", "$2"))


def split_list(text: Column) -> Column:
    """Trimmed parts between commas; null if there is none."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that hangs on the keys and the seed alone, so results do not depend on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def chart_cell(text: Column, most: int = 260) -> Column:
    """Text for a small cell: other scripts become a mark, white space one blank, long text is cut."""
    shown = F.coalesce(F.when(text != "", text), F.lit("N/A"))
    latin = F.regexp_replace(shown, "[^\\x{00}-\\x{24F}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}\\x{20A0}-\\x{20CF}]+", " […] ")
    flat = strip(F.regexp_replace(latin, rf"{SPACE}+", " "))
    return F.when(F.length(flat) > most, F.concat(rstrip(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def wrapped(text: Column, width: int = 50) -> Column:
    """Lines of at most width characters, as textwrap.fill breaks them; nothing becomes a mark. For the few cells of a chart."""

    def fill(cells: pd.Series) -> pd.Series:
        return cells.map(lambda t: textwrap.fill(t or "", width=width) or "N/A")

    return F.pandas_udf(fill, "string")(text)
