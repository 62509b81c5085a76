"""Vectorised 64-bit hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                steps = np.full(size, BASE, np.uint64)
                steps[0] = 1
                back = np.full(size, _INVERSE, np.uint64)
                back[0] = 1
                self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


#: Bytes of the texts that are hashed at once; a longer word is hashed whole.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A number for each byte.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def _chunk_hashes(data: np.ndarray, limits: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, and where they start; a word also ends at each of the limits."""
    word = ~_SPACE[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = limits[(limits > 0) & (limits < len(data))]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _POWERS.get(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up, dtype=np.uint64, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the place of each text's first word, with the end of the last one.

    A word is a run of bytes other than ASCII white space; a null text has none. The hash is a polynomial of the word's
    bytes, mixed. Texts are hashed a chunk at a time, all words of a chunk at once; chunks end behind a word.
    """
    texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    values = _VALUES[_LOWER] if lower else _VALUES
    hashes, places, low = [], [], 0
    while low < len(data):
        high = min(low + CHUNK, len(data))
        while high < len(data) and not _SPACE[data[high]]:
            free = np.flatnonzero(_SPACE[data[high : high + 4096]])
            nearest = offsets[np.searchsorted(offsets, high)]
            high = int(min(high + free[0] if len(free) else high + 4096, nearest, len(data)))
            if high == nearest:
                break
        limits = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low
        found, starts = _chunk_hashes(data[low:high], limits, values)
        hashes.append(found)
        places.append(starts + low)
        low = high
    places = np.concatenate(places) if places else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.searchsorted(places, offsets)


def batches_of(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and bytes of a text column unless one row has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + size, "right"))), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of width words: a polynomial from prefix sums, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _POWERS.get(len(words))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
        return mixed((sums[width:] - sums[:n]) * down[:n])


def span_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run words[start:end]; runs of other lengths differ too."""
    up, down = _POWERS.get(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
