"""ROUGE-L by a bit-parallel longest common subsequence of many pairs at once, on Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from mixlens.shipping import ship

#: Pairs for each word of a row from which a step over all of them at once is cheaper than one over each.
TOGETHER = 24
#: Bytes of both sides that are read at once; one pair may have more.
BATCH_BYTES = 8_000_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens(texts: pa.Array) -> pa.ListArray:
    """Runs of ASCII letters and digits of lower-cased texts; null has none."""
    runs = pc.utf8_trim(pc.replace_substring_regex(texts.fill_null(""), "[^a-z0-9]+", " "), " ")
    split = pc.split_pattern(runs, " ")
    empty = pc.equal(pc.binary_length(runs), 0)
    if not pc.any(empty).as_py():
        return split
    # a text without a token is split into one empty part
    sizes = np.where(empty.to_numpy(zero_copy_only=False), 0, np.diff(split.offsets.to_numpy()))
    values = split.flatten()
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values.filter(pc.greater(pc.binary_length(values), 0)))


def _stepped(rows: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The next row of each table (Hyyrö 2004): words of 64 bits, the lowest first, with a carry from one to the next."""
    met = rows & match
    total = rows + met
    if rows.shape[1] > 1:
        carry = total[:, 0] < rows[:, 0]
        for w in range(1, rows.shape[1]):
            first = total[:, w]
            again = carry & (first == _ALL)
            over = first < rows[:, w]
            total[:, w] = first + carry
            carry = over | again
    return total | (rows & ~match)


def _alone(row: np.ndarray, matches: np.ndarray) -> np.ndarray:
    """The row after all steps of one pair, as one long integer."""
    n = row.nbytes
    whole, full = int.from_bytes(row.tobytes(), "little"), (1 << 8 * n) - 1
    for match in (int.from_bytes(raw, "little") for raw in map(bytes, matches.view(np.uint8))):
        met = whole & match
        whole = ((whole + met) | (whole - met)) & full
    return np.frombuffer(whole.to_bytes(n, "little"), np.uint64)


def _group(sizes: np.ndarray, masks: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Common lengths of pairs whose rows have equally many words.

    sizes: tokens of the short sides; masks: where a token stands in its short side; steps: the mask of each step, end to
    end by pair; counts: steps of each pair. Pairs with more steps come first.
    """
    width = masks.shape[1]
    rows = np.full((len(sizes), width), _ALL)
    starts, left = np.cumsum(counts) - counts, len(sizes)
    k = 0
    while left and k < counts[0]:
        left = int(np.searchsorted(-counts, -k, "left"))  # pairs with more than k steps
        if left < TOGETHER * width:
            break
        rows[:left] = _stepped(rows[:left], masks[steps[starts[:left] + k]])
        k += 1
    for pair in range(left):
        if counts[pair] > k:
            rows[pair] = _alone(rows[pair], masks[steps[starts[pair] + k : starts[pair] + counts[pair]]])
    # a token of the short side is in the common subsequence where its bit is gone
    bits = np.arange(width * 64)[None, :] < sizes[:, None]
    inside = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return np.bitwise_count(~rows & inside).sum(axis=1)


def lcs_lengths(one: pa.ListArray, two: pa.ListArray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of token lists."""
    n = len(one)
    sizes = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (one, two)]
    numbered = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode()
    sides = np.split(numbered.indices.to_numpy().astype(np.int64), [int(sizes[0].sum())])
    kinds = len(numbered.dictionary)
    out = np.zeros(n, np.int64)
    short = np.minimum(*sizes)
    pair = [np.repeat(np.arange(n), s) for s in sizes]
    place = [np.arange(len(p)) - np.repeat(np.cumsum(s) - s, s) for p, s in zip(pair, sizes, strict=True)]
    first_is_short = sizes[0] <= sizes[1]
    of_short = [first_is_short[pair[0]], ~first_is_short[pair[1]]]
    joined = lambda parts, of: np.concatenate([x[m] for x, m in zip(parts, of, strict=True)])
    keys = [p * kinds + t for p, t in zip(pair, sides, strict=True)]
    short_key, short_pair, short_place = joined(keys, of_short), joined(pair, of_short), joined(place, of_short)
    of_long = [~m for m in of_short]
    long_key, long_pair, long_place = joined(keys, of_long), joined(pair, of_long), joined(place, of_long)
    known, at = np.unique(short_key, return_inverse=True)
    if not len(known):
        return out
    # a token that the short side lacks changes nothing
    found = np.searchsorted(known, long_key)
    hit = known[np.minimum(found, len(known) - 1)] == long_key
    found, long_pair, long_place = found[hit], long_pair[hit], long_place[hit]
    counts = np.bincount(long_pair, minlength=n)
    width = -(-short // 64)
    for w in np.unique(width[(width > 0) & (counts > 0)]).tolist():
        mine = np.flatnonzero((width == w) & (counts > 0))
        mine = mine[np.argsort(-counts[mine], kind="stable")]
        rank = np.full(n, -1)
        rank[mine] = np.arange(len(mine))
        own = rank[known // kinds] >= 0
        number = np.cumsum(own) - 1
        masks = np.zeros((int(own.sum()), w), np.uint64)
        bits = rank[short_pair] >= 0
        np.bitwise_or.at(masks, (number[at[bits]], short_place[bits] // 64), np.uint64(1) << (short_place[bits] % 64).astype(np.uint64))
        steps = np.flatnonzero(rank[long_pair] >= 0)
        steps = steps[np.lexsort((long_place[steps], rank[long_pair[steps]]))]
        out[mine] = _group(short[mine], masks, number[found[steps]], counts[mine])
    return out


def lcs_length(one: list[str], two: list[str]) -> int:
    """The same for one pair."""
    return int(lcs_lengths(pa.array([one], pa.list_(pa.string())), pa.array([two], pa.list_(pa.string())))[0])


def f_measures(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Harmonic mean of the shares that the common subsequence has of either text's tokens; 0 if nothing is common."""
    first, second = tokens(one), tokens(two)
    common = lcs_lengths(first, second).astype(float)
    sizes = [np.maximum(np.diff(x.offsets.to_numpy()), 1) for x in (first, second)]
    precision, recall = common / sizes[1], common / sizes[0]
    return np.divide(2 * precision * recall, precision + recall, out=np.zeros(len(common)), where=common > 0)


def _parts(one: pa.Array, two: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The pairs in runs within the bound of bytes."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two)))
    low = 0
    while low < len(one):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        yield one.slice(low, high - low), two.slice(low, high - low)
        low = high


@arrow_udf(DoubleType())
def _rouge(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0), *(f_measures(a, b) for a, b in _parts(one, two))]))


def rouge_l(reference: Column, response: Column) -> Column:
    """0 if either is empty."""
    ship(SparkSession.active())
    return _rouge(F.lower(reference), F.lower(response))
