"""Quality rules by distribution divergence.

Each document gets a histogram of character classes and one of common words. The references are the sums of these over
all documents of a language that pass the base rules. A document is dropped if its Jensen-Shannon distance (base 2) to
its language's reference exceeds the limit for characters or for words. Short texts have ragged histograms, so each
distance counts only from a minimum length on, and only against references of a minimum length; the limits fall with the
square root of the text's length, as the distances of clean text do.

Letters hide points and symbols in the histogram of classes, so these two, against all other characters, are judged once
more with a limit of their own. Its reference is summed over the documents that the first two distances leave: junk of
marks would otherwise move it.

Null and empty text has 0 words and so fails the base rule. A null lang is a language like any other. Repeated rows are
judged alike and each counts in its reference. No documents give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.llm.common import WORD, drop_stored, held, ship, small, stored, with_python

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Characters that a text must have for its classes to be judged, and words for its words.
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 100
#: Characters of a reference.
MIN_REFERENCE = 20_000
#: Languages whose references, 1 KB each, are broadcast; with more, documents meet them in a shuffled join.
MOST_REFERENCES = 10_000
#: Limits as (floor, spread): floor + spread / sqrt(characters or words of the text). Measured on sf0.1, see README.
CHAR_LIMIT = (0.15, 2.0)
WORD_LIMIT = (0.15, 1.5)
MAX_MARK_DISTANCE = 0.12

#: Frequent function words of English, French, German and Spanish.
COMMON_WORDS = """
the of and to in a is that it for was on are as with be by this at he
le la les de des du un une et est en que qui dans pour pas au sur par il
der die das und ist ein eine zu den von mit sich nicht auf dem im für des auch als
el los las y es en un una por con no para su se lo como más del al
""".split()
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "mark", "other")

_TRACKED = {w: k for k, w in enumerate(dict.fromkeys(COMMON_WORDS))}
N_WORDS = len(_TRACKED) + 1
_LETTERS = re.compile(r"[^\W\d_]+")


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c in ".,;:!?'\"()-":
        return 4
    return {"Lu": 1, "Lt": 1, "Nd": 2}.get(kind) or (3 if c.isspace() else 0 if kind[0] == "L" else 6 if kind[0] == "M" else 5 if kind[0] in "PS" else 7)


class Measure:
    """Base figures and histograms of texts."""

    def __init__(self) -> None:
        self.classes = np.fromiter(map(_class_of, map(chr, range(0x110000))), np.int8, 0x110000)

    def one(self, text: str) -> tuple:
        words = WORD.findall(text)
        n = len(words)
        repeated = 0
        if n > 3:
            windows = list(zip(words, words[1:], words[2:], strict=False))
            if len(set(windows)) < len(windows):
                times, upto = Counter(windows), 0  # upto: end of what is counted
                for k, w in enumerate(windows):
                    if times[w] > 1:
                        repeated += k + 3 - max(k, upto)
                        upto = k + 3
        lines, doubled = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                doubled += line in lines
                lines.add(line)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.bincount(self.classes[codes], minlength=len(CLASSES))
        spoken = Counter(_LETTERS.findall(text.lower()))
        common = [0] * N_WORDS
        for w in spoken.keys() & _TRACKED.keys():
            common[_TRACKED[w]] = spoken[w]
        common[-1] = spoken.total() - sum(common)
        return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), doubled, repeated, chars.tolist(), common

    def __call__(self, texts: list[str | None]) -> list[list]:
        return [list(x) for x in zip(*(self.one(t or "") for t in texts), strict=True)]


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add the base figures, base_failed and the two histograms, from one pass over the texts."""
    figures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"
    measured = with_python(docs, ["text"], keep, figures, lambda: held("quality", Measure))
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of both histograms, end to end, for each language that it meets."""
    totals: dict = {}
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "chars", "words")), strict=True)
        for lang, chars, words in rows:
            both = np.array(chars + words, np.int64)
            totals[lang] = totals[lang] + both if lang in totals else both
    for lang, both in totals.items():
        size = len(both)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(range(size), pa.int32()), pa.array(both)], ["lang", "bin", "n"])


def references(measured: DataFrame) -> DataFrame:
    """One row per language: its histograms, summed over all its documents that pass the base rules."""
    ship(measured.sparkSession)
    passed = measured.filter(~F.col("base_failed")).select(F.col("lang").cast("string").alias("lang"), "chars", "words")
    bins = passed.mapInArrow(_sums, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    whole = bins.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("n"))
    return whole.select(F.col("lang").alias("_lang"), F.slice("n", 1, len(CLASSES)).alias("ref_chars"), F.slice("n", len(CLASSES) + 1, N_WORDS).alias("ref_words"))


def distances(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, from 0 to 1, of each row's histogram to the same row's reference; nan if either is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (x / x.sum(axis=1, keepdims=True) for x in (rows, references))
        both = (p + q) / 2
        parts = [np.where(x > 0, x * np.log2(x / both), 0.0) for x in (p, q)]
        empty = (rows.sum(axis=1) == 0) | (references.sum(axis=1) == 0)
        return np.where(empty, np.nan, np.sqrt(np.maximum(0.0, sum(parts).sum(axis=1) / 2)))


def _judged(chars: list, words: list, ref_chars: list, ref_words: list) -> list[list]:
    """Distances of a batch, null where a text or its reference is too short."""
    none = ([0] * len(CLASSES), [0] * N_WORDS)
    of = [np.array([x or none[k % 2] for x in column], float) for k, column in enumerate((chars, words, ref_chars, ref_words))]
    able = of[2].sum(axis=1) >= MIN_REFERENCE
    out = []
    for rows, references, least in ((of[0], of[2], MIN_CHARS_JUDGED), (of[1], of[3], MIN_WORDS_JUDGED)):
        found = distances(rows, references)
        usable = able & (rows.sum(axis=1) >= least) & ~np.isnan(found)
        out.append([float(x) if ok else None for x, ok in zip(found, usable, strict=True)])
    return out


def _marks(measured: DataFrame) -> DataFrame:
    """Add marks: points, symbols and all other characters of each text."""
    point, symbol = (F.element_at("chars", CLASSES.index(c) + 1).cast("long") for c in ("point", "symbol"))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    return measured.withColumn("marks", F.array(point, symbol, total - point - symbol))


def _mark_distance() -> Column:
    """Jensen-Shannon distance of marks to ref_marks, null where either is too short."""
    sizes = [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in ("marks", "ref_marks")]
    terms = []
    for k in range(3):
        p, q = (F.col(c)[k] / n for c, n in zip(("marks", "ref_marks"), sizes, strict=True))
        terms += [F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0) for x in (p, q)]
    found = F.sqrt(F.greatest(F.lit(0.0), sum(terms[1:], terms[0]) / 2))
    return F.when((sizes[0] >= MIN_CHARS_JUDGED) & (sizes[1] >= MIN_REFERENCE), found)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base figures, base_failed, the three distances (null where not judged) and kept."""
    measured = stored(_marks(measure(docs, ["doc_id", "lang"])), "quality-measured")
    refs = stored(references(measured), "quality-references")
    refs = small(refs, refs.count(), MOST_REFERENCES)
    joined = measured.join(refs, measured["lang"].cast("string").eqNullSafe(refs["_lang"]), "left")
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    inputs = ["chars", "words", "ref_chars", "ref_words"]
    sized = joined.withColumns({f"{c}_size": F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in ("chars", "words")})
    both = with_python(sized, inputs, ["doc_id", "lang", *figures, "chars_size", "words_size", "marks"], "char_distance double, word_distance double", lambda: _judged, rows=2048)
    limits = (("char_distance", "chars_size", CHAR_LIMIT), ("word_distance", "words_size", WORD_LIMIT))
    near = [F.coalesce(F.col(c) <= floor + spread / F.sqrt(size), F.lit(True)) for c, size, (floor, spread) in limits]
    judged = stored(both.withColumn("kept", ~F.col("base_failed") & near[0] & near[1]), "quality-judged")
    sums = [F.sum(F.when(F.col("kept"), F.col("marks")[k]).otherwise(0)) for k in range(3)]
    drop_stored(measured, refs)
    left = stored(judged.groupBy(F.col("lang").cast("string").alias("_lang")).agg(F.array(*sums).alias("ref_marks")), "quality-marks")
    left = small(left, left.count(), MOST_REFERENCES)
    again = judged.join(left, judged["lang"].cast("string").eqNullSafe(left["_lang"]), "left").withColumn("mark_distance", _mark_distance())
    close = F.coalesce(F.col("mark_distance") <= MAX_MARK_DISTANCE, F.lit(True))
    return again.select("doc_id", "lang", *figures, "char_distance", "word_distance", "mark_distance", (F.col("kept") & close).alias("kept"))
