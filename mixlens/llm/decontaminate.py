"""Benchmark decontamination by question templates.

Words are stripped of outer punctuation and lower-cased; a number becomes a typed placeholder, one with a unit behind or
attached another, and a capitalised word inside a sentence a third. Windows of WIDTH template words are hashed. A bitmap
of 8 bits for each of the benchmark's windows, 8 MB at most, passes possible hits; those meet the benchmark in a hash join.

A text can leak an item only if hits cover at least COVERAGE of the item's windows, so it hits one of the item's rarest
windows, that share and one more: texts and items meet on these alone, and only then on all windows. Hits lie on
diagonals (position in the text less position in the item). Diagonals near each other, and at any distance those with a run
of FAR_RUN windows, as what stands before and after a long insertion, are put together as long as the slots agree: each value of the item has one value in the text, and each name or unit of the text stands for one of the
item. What most windows agree on counts; diagonals that contradict it do not.

Windows of more than MAX_SLOTS placeholders say too little about a text. So windows of the literal words, in lower case
and with the sign before a number, are a second stream; a third is the whole of an item of fewer than WIDTH words, again
literal. Each stream is judged by itself, and the best one counts: other numbers, units or names are found by the template,
and a copy of any item in any case, however many numbers and names it has, by its words.

A capitalised word that starts a sentence may be a name or not. It is a plain word in the template, and a placeholder in
a second one, whose windows must hold at least COVERAGE of the item's words.

Null and empty texts leak nothing. Items without a letter or digit are never found. Rows with the same doc_id are told apart
by their text; repeated rows leak once; items with the same item_id count as one item of all their windows. Empty tables
give no rows. Further columns, whatever their names, are left out by leaks and kept by without_leaks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, release, ship, stored, trim, unused, with_python
from mixlens.llm.hashing import BASE, batches_of, hashed_words, mixed, window_hashes

WIDTH = 5
MAX_SLOTS = 2
COVERAGE = 0.6
#: How far apart diagonals of few windows that are put together may lie, in words, and the run of windows that one further
#: off must have: ten words in a row.
SHIFT = 64
FAR_RUN = 6
#: Bounds of the binary logarithm of the bitmap's bits: 512 KB to 8 MB.
BITS = (22, 26)

#: Units that may follow a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml h hr hrs hour hours min minute minutes s sec second seconds day days week weeks month months year years percent pct usd eur dollar dollars euro euros cent cents kmh mph kw w v hz gb mb kb".split()
#: Signs that are a unit at either side of a number.
_CURRENCY = "$€£%"

_OUTER = r"^[^\pL\pN\pM]+|[^\pL\pN\pM]+$"
_NUMBER = r"^[0-9]+(?:[.,:/][0-9]+)*"
_ATTACHED = rf"{_NUMBER}(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})$"
_PLAIN_NUMBER = rf"{_NUMBER}(?:st|nd|rd|th)?$"
_VALUE = re.compile(_NUMBER)
_ENDS = r"[.!?:][^\pL\pN]*$"
#: What stands between numbers; it is part of the literal number behind it.
_SIGNS = r"^[-+*/=<>^\x{d7}\x{f7}\x{2212}]+$"
PLAIN, NUMBER, UNIT, CAPITAL = range(4)
_POWERS = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(WIDTH)]
#: Kinds of windows; that of a short item is its number of words, negative.
TEMPLATE, OPENED, LITERAL = range(3)
_NUMBER_HASH, _QUANTITY_HASH, _NAME_HASH = mixed(np.arange(1, 4, dtype=np.uint64))
HITS = "stream int, window long, at int, slots array<string>"


class Vocabulary:
    """What each distinct word of a batch is: bare form, hash, kind, and whether it ends a sentence, is a sign or carries a unit."""

    def __init__(self, words: pa.Array) -> None:
        self.words = words
        self.bare = pc.replace_substring_regex(words, _OUTER, "")
        low = pc.utf8_lower(self.bare)
        of = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        self.ends = of(pc.match_substring_regex(words, _ENDS))
        self.sign = of(pc.match_substring_regex(words, _SIGNS))
        attached = of(pc.match_substring_regex(low, _ATTACHED))
        number = attached | of(pc.match_substring_regex(low, _PLAIN_NUMBER))
        marked = of(pc.match_substring_regex(words, f"[{re.escape(_CURRENCY)}]"))
        unit = of(pc.is_in(low, value_set=pa.array(UNITS))) | of(pc.match_substring_regex(words, f"^[{re.escape(_CURRENCY)}]+$"))
        first = pc.utf8_slice_codeunits(self.bare, 0, 1)
        capital = of(pc.utf8_is_upper(first)) & ~of(pc.utf8_is_upper(self.bare))
        self.kind = np.select([number, unit, capital], [NUMBER, UNIT, CAPITAL], PLAIN).astype(np.int8)
        self.measured = number & (attached | marked)
        # a word's own hash; a unit of signs alone has no letters, and neither has a sign; of a number, that of the unit attached
        named = pc.if_else(pc.and_(pc.equal(pc.binary_length(self.bare), 0), pa.array(unit)), words, low)
        joined = pa.array(attached)
        self.hashes = self._hashes(pc.if_else(joined, pc.replace_substring_regex(low, "[a-z]+$", ""), named))
        self.attached = self._hashes(pc.if_else(joined, pc.replace_substring_regex(low, _NUMBER, ""), ""))
        self.signs, _ = hashed_words(words)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        """Hash of each word; 0 of the empty one."""
        hashes, at = hashed_words(words)
        found, some = np.zeros(len(words), np.uint64), np.diff(at) > 0
        found[some] = hashes[at[:-1][some]] | np.uint64(1)
        return found

    def values(self, k: int, behind: int) -> list[str]:
        """Slot values of a placeholder, typed: of a number itself, then its unit, which may be the word behind."""
        bare = self.bare[k].as_py().lower()
        if self.kind[k] != NUMBER:
            return [f"c{bare}"]
        value = _VALUE.match(bare)[0]
        if behind >= 0:
            return [f"n{value}", f"u{(self.bare[behind].as_py() or self.words[behind].as_py()).lower()}"]
        if self.measured[k]:
            return [f"n{value}", "u" + (bare[len(value) :] or "".join(c for c in self.words[k].as_py() if c in _CURRENCY))]
        return [f"n{value}"]


class Templates:
    """Windows of texts with their positions and slot values, those that the bitmap passes if there is one."""

    def __init__(self, bitmap: np.ndarray | None = None, width: int = WIDTH, short: Iterable[int] = (), whole: bool = False) -> None:
        """short: widths of the benchmark's short items; whole: make all windows of each stream, as for an item."""
        self.bitmap, self.width, self.short, self.whole = bitmap, width, list(short), whole

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int, list[str]]]:
        """(number of the text, stream, window, position, slot values). Windows equal to those of the template are left out of the other streams, unless all are asked for."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = split.flatten()
        offsets = split.offsets.to_numpy()
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        some = pc.greater(pc.binary_length(flat), 0)
        owner = owner[some.to_numpy(zero_copy_only=False)]
        if not len(owner):
            return []
        numbered = flat.filter(some).dictionary_encode()
        known, ids = Vocabulary(numbered.dictionary), numbered.indices.to_numpy()
        # place by place: words with their kinds; a unit behind a number is part of its placeholder
        kinds, able = known.kind[ids], known.hashes[ids] != 0
        opens = np.ones(len(ids), bool)
        opens[1:] = owner[1:] != owner[:-1]
        unit = np.flatnonzero((kinds == UNIT) & ~opens)
        unit = unit[kinds[unit - 1] == NUMBER]
        able[unit] = False
        behind = np.full(len(ids), -1)
        behind[unit - 1] = ids[unit]
        keep = np.flatnonzero(able)
        owner, kinds, literal = owner[keep], kinds[keep], known.hashes[ids[keep]]
        first = opens[keep] | known.ends[ids[keep - 1]]
        number, capital = kinds == NUMBER, kinds == CAPITAL
        name = capital & ~first
        hashes = literal.copy()
        hashes[number] = np.where(known.measured[ids[keep[number]]] | (behind[keep[number]] >= 0), _QUANTITY_HASH, _NUMBER_HASH)
        hashes[name] = _NAME_HASH
        signed = np.flatnonzero(number & ~opens[keep] & known.sign[ids[keep - 1]])
        literal[signed] ^= known.signs[ids[keep[signed] - 1]]
        units = np.where(behind[keep] >= 0, known.hashes[behind[keep]], known.attached[ids[keep]])
        literal ^= np.where(number & (units != 0), mixed(units), np.uint64(0))
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        inside = self._inside(owner, self.width)
        slots = number | name
        count = self._slots(slots)

        def passed(stream: int, found: np.ndarray, at: np.ndarray, slots: np.ndarray | None = None) -> list:
            if self.bitmap is not None:
                bits = found & np.uint64(64 * len(self.bitmap) - 1)
                ok = (self.bitmap[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
                at, found = at[ok], found[ok]
            texts_of = owner[at]
            out = []
            for w, k, t, s in zip(found.view(np.int64).tolist(), at.tolist(), texts_of.tolist(), starts[texts_of].tolist(), strict=True):
                values = [] if slots is None else [v for i in range(k, k + self.width) if slots[i] for v in known.values(ids[keep[i]], behind[keep[i]])]
                out.append((t, stream, w, k - s, values))
            return out

        at = np.flatnonzero(inside & (count <= MAX_SLOTS))
        out = passed(TEMPLATE, window_hashes(hashes, self.width)[at], at, slots)
        opening = capital & first
        if self.whole or opening.any():
            opened_slots = slots | opening
            opened = self._slots(opened_slots)
            usable = inside & (opened <= MAX_SLOTS) & (self.whole | (opened > count))
            if self.whole:
                self._drop_thin(usable, starts)
            hashes[opening] = _NAME_HASH
            at = np.flatnonzero(usable)
            out += passed(OPENED, self._hashes(hashes, at), at, opened_slots)
        at = np.flatnonzero(inside & ((count > 0) | self.whole))
        out += passed(LITERAL, self._hashes(literal, at), at)
        lengths = np.diff(starts)
        for width in {int(n) for n in lengths if 0 < n < self.width} if self.whole else self.short:
            at = np.flatnonzero(self._inside(owner, width))
            if self.whole:
                at = at[lengths[owner[at]] == width]
            if len(at):
                out += passed(-width, window_hashes(literal, width)[at], at)
        return out

    @staticmethod
    def _inside(owner: np.ndarray, width: int) -> np.ndarray:
        """Whether each window lies in one text."""
        return owner[width - 1 :] == owner[: max(0, len(owner) - width + 1)]

    def _slots(self, slots: np.ndarray) -> np.ndarray:
        """Slots in each window."""
        sums = np.concatenate([[0], np.cumsum(slots)])
        return sums[self.width :] - sums[: max(0, len(slots) - self.width + 1)]

    def _hashes(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What window_hashes gives at these positions, without the others."""
        with np.errstate(over="ignore"):
            return mixed(sum((hashes[at + k] * _POWERS[k] for k in range(1, self.width)), hashes[at]))

    def _drop_thin(self, usable: np.ndarray, starts: np.ndarray) -> None:
        """Leave out items whose windows hold less than COVERAGE of their words: an item must not be known by one odd window."""
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            held = np.zeros(b - a, bool)
            for k in np.flatnonzero(usable[a:b]).tolist():
                held[k : k + self.width] = True
            if b > a and held.mean() < COVERAGE:
                usable[a:b] = False

    def streams(self, text: str | None) -> list[tuple[int, int, int, list[str]]]:
        """What hits gives of one text."""
        return [x[1:] for x in self.hits(pa.array([text], pa.string()))]

    def windows(self, text: str | None) -> list[tuple[int, int, list[str]]]:
        """The windows of the template alone."""
        return [(w, k, s) for stream, w, k, s in self.streams(text) if stream == TEMPLATE]


def _finder(keys: list[str], make: Callable[[], Templates]) -> Callable:
    """A row for each hit, with the row's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        templates = make()
        for batch in batches_of(batches, "text"):
            found = templates.hits(batch.column("text"))
            if found:
                at, stream, window, place, slots = zip(*found, strict=True)
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
                made = [pa.array(stream, pa.int32()), pa.array(window, pa.int64()), pa.array(place, pa.int32()), pa.array(slots, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keys, *(c.split()[0] for c in HITS.split(", "))])
        trim()

    return run


def _hits(df: DataFrame, keys: list[str], make: Callable[[], Templates]) -> DataFrame:
    ship(df.sparkSession)
    named = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "text").mapInArrow(_finder(keys, make), f"{named}, {HITS}")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    made = _hits(benchmark, ["item_id"], lambda: Templates(whole=True))
    return made.withColumnsRenamed({"at": "item_at", "slots": "item_slots"})


def probes(items: DataFrame, coverage: float) -> DataFrame:
    """item_id, stream and window of each item's rarest windows, so many that a text which leaks the item has one of them."""
    common = items.groupBy("window").agg(F.count_distinct("item_id").alias("_k"))
    places = items.join(common, "window").groupBy("item_id", "stream", "item_at").agg(F.max("_k").alias("_k"), F.collect_set("window").alias("windows"))
    of_item = Window.partitionBy("item_id", "stream")
    ranked = places.withColumn("_at", F.row_number().over(of_item.orderBy("_k", "item_at"))).withColumn("_n", F.count("*").over(of_item))
    return ranked.filter(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * coverage - 1e-9) + 1).select("item_id", "stream", F.explode("windows").alias("window")).distinct()


def bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of all windows; at most 2**26 / 64 rows of two numbers come to the driver, however long the benchmark is."""
    size = min(BITS[1], max(BITS[0], windows.count().bit_length() + 3))
    bit = F.col("window").bitwiseAND(F.lit((1 << size) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    words = np.zeros((1 << size) // 64, np.int64)
    words[rows["word"]] = rows["bits"]
    return words.view(np.uint64)


def _maker(shared, short: list[int]) -> Callable[[], Templates]:  # noqa: ANN001  a broadcast of the bitmap
    return lambda: Templates(shared.value, short=short)


def longest_run(ats: Iterable[int]) -> int:
    """Most positions in a row."""
    known = set(ats)
    best = 0
    for at in known:
        if at - 1 not in known:
            end = at
            while end + 1 in known:
                end += 1
            best = max(best, end - at + 1)
    return best


def agreeing(lines: list[dict]) -> int:
    """Most positions of an item that diagonals cover together while their slots agree.

    lines has diagonal, ats (positions in the item) and pairs (item, text) of slot values. Each diagonal is tried as the
    first; those around it, and those with a long run wherever they lie, join it, the nearest first, unless they contradict
    what is agreed.
    """
    lines = sorted(lines, key=lambda x: x["diagonal"])
    diagonals = [x["diagonal"] for x in lines]
    far = [k for k, x in enumerate(lines) if len(x["ats"]) >= FAR_RUN and longest_run(x["ats"]) >= FAR_RUN]
    best = 0
    for k in sorted(range(len(lines)), key=lambda k: -len(lines[k]["ats"])):
        here = diagonals[k]
        low, high = bisect_left(diagonals, here - SHIFT), bisect_right(diagonals, here + SHIFT)
        near = [*range(low, high), *(j for j in far if not low <= j < high)]
        if len(set().union(*(lines[j]["ats"] for j in near))) <= best:
            continue
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        held: set[int] = set()
        for j in sorted(near, key=lambda j: (abs(diagonals[j] - here), j != k)):
            more, behind = dict(there), dict(back)
            pairs = [(p["item"], p["text"]) for p in lines[j]["pairs"]]
            # two numbers of an item may get one value, two names or units may not
            if all(more.setdefault(i, t) == t and (i[0] == "n" or behind.setdefault(t, i) == i) for i, t in pairs):
                there, back = more, behind
                held.update(lines[j]["ats"])
            elif j == k:
                break
        best = max(best, len(held))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row (a hash of the text), item_id, n_windows of the item, n_found and coverage, for each leaked item; stored."""
    spark = docs.sparkSession
    items = stored(benchmark_windows(benchmark), "benchmark-windows")
    shared = spark.sparkContext.broadcast(bitmap(items))
    short = [-r.stream for r in items.filter("stream < 0").select("stream").distinct().collect()]  # at most WIDTH - 1 rows
    # the width of a window must not turn on the text's hash: rows of the same doc_id and text are one
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    hits = stored(_hits(texts, ["doc_id", "row"], _maker(shared, short)).distinct(), "benchmark-hits")
    # a text's window need not be of the item's stream, as equal ones are made once; but the text's second template adds
    # no slots to the item's first, where they could only contradict what else is found
    fits = lambda of: (F.col("_stream") != OPENED) | (of == OPENED)
    seen = hits.withColumnRenamed("stream", "_stream")
    rare = probes(items, coverage)
    asked = seen.join(rare, "window").filter(fits(rare["stream"])).select("doc_id", "row", "item_id", "stream").distinct()
    every = items.withColumnsRenamed({"item_id": "_item", "stream": "_kind"})
    same = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("stream") == F.col("_kind"))
    wanted = asked.join(every, same).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "item_id", "stream", "window", "item_at", "item_slots")
    met = wanted.join(seen, "window").filter(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")) & fits(F.col("stream")))
    diagonal = met.groupBy("doc_id", "row", "item_id", "stream", (F.col("at") - F.col("item_at")).alias("diagonal"))
    pairs = F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("text"))))
    lines = diagonal.agg(F.collect_set("item_at").alias("ats"), F.array_distinct(pairs).alias("pairs"))
    gathered = lines.groupBy("doc_id", "row", "item_id", "stream").agg(F.collect_list(F.struct("diagonal", "ats", "pairs")).alias("lines"))
    found = with_python(gathered, ["lines"], ["doc_id", "row", "item_id", "stream"], "n_found long", lambda: lambda all_lines: [[agreeing(x) for x in all_lines]])
    sizes = every.groupBy("_item", "_kind").agg(F.count_distinct("item_at").alias("n_windows"))
    judged = found.join(sizes, same).drop("_item", "_kind")
    share = judged.withColumn("coverage", F.col("n_found") / F.col("n_windows")).filter(F.col("coverage") >= coverage)
    best = share.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("coverage", "n_windows", "n_found")).alias("best"))
    result = stored(best.select("doc_id", "row", "item_id", "best.n_windows", "best.n_found", "best.coverage"), "leaks")
    drop_stored(items, hits)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that leak no item of benchmark."""
    doc, row = unused(docs, "doc", "row")
    gone = leaks(docs, benchmark, coverage).select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[row]), "left_anti")
