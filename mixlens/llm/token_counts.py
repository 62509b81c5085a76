"""Token counts without ids: byte-pair merges of many pieces of text at once, by rank.

A splitter cuts a text into pieces, and no merge crosses a piece. The bytes of all pieces that a worker has not met yet
lie end to end in one array. In each round every piece applies its own lowest-ranked pair, wherever it occurs; a piece
with no pair left is done, and what it has left is its count. A piece of more than LONG bytes keeps its pairs by rank, so
a round touches the places of one pair alone, and text without any blank takes no quadratic time.

Null text is the empty text and has no tokens. Every row gets its counts, so repeated rows and a null doc_id stay; an
empty table gives an empty one. Columns named like the counts are replaced. Strings of special tokens inside a text are
one token each, as the library takes them by default; nothing is added, cut or padded.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from mixlens.llm.common import held, with_python

LIMIT = 1024
#: The splitter of byte-level tokenizers, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker keeps: about 150 bytes each.
KNOWN = 300_000
#: Characters of a text that are split at once, up to the next place where a piece surely ends.
CHUNK = 1 << 20
LONG = 512
#: Bytes that are merged at once; one piece may have more.
MERGED_BYTES = 1 << 20
NONE = np.int64(1 << 40)
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def newer_characters() -> np.ndarray:
    """Whether this Python's tables lack a character; the splitter's own tables may be newer than the library's."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Merges:
    """Ranked pairs of symbols, as arrays."""

    def __init__(self, model: dict) -> None:
        numbers = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.base = max(numbers.values()) + 1
        self.bytes = np.array([numbers[s] for s in byte_symbols()], np.int64)
        self.made = np.array([numbers[a + b] for a, b in pairs], np.int64)
        sides = np.array([[numbers[a], numbers[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        born = np.full(self.base, -1)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (born[sides].max(axis=1, initial=-1) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol that a later one makes, so all places of a pair cannot go at once")
        keys = sides[:, 0] * self.base + sides[:, 1]
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for those that never merge."""
        wanted = left * self.base + right
        at = np.searchsorted(self.keys, wanted)
        out = np.full(len(wanted), NONE)
        found = self.keys[at] == wanted
        out[found] = self.order[at[found]]
        return out

    @staticmethod
    def apart(places: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Places in order, without every second one of a run in which each starts where the one before ends."""
        touches = np.concatenate([[False], places[1:] == following[:-1]])
        if not touches.any():
            return places
        at = np.arange(len(places))
        first = np.maximum.accumulate(np.where(touches, 0, at))
        return places[(at - first) % 2 == 0]

    def counts(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What is left of each piece; data holds the bytes of all pieces, and none is empty."""
        out, left = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        symbols, sizes = self.bytes[data], sizes.astype(np.int64)
        while len(left):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            ranks = np.full(len(symbols), NONE)
            ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NONE
            lowest = np.minimum.reduceat(ranks, starts)
            at = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks < NONE))
            at = self.apart(at, at + 1)
            symbols[at] = self.made[ranks[at]]
            done = lowest == NONE
            out[left[done]] = sizes[done]
            stays = np.repeat(~done, sizes)
            stays[at + 1] = False
            sizes = (sizes - np.bincount(np.searchsorted(ends, at, "right"), minlength=len(sizes)))[~done]
            symbols, left = symbols[stays], left[~done]
        return out

    def long_count(self, data: np.ndarray) -> int:
        """The same for one long piece: places of pairs wait by rank, and symbols are a linked list."""
        symbols, n = self.bytes[data], len(data)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.append(self.ranks(symbols[:-1], symbols[1:]), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] < NONE]
            places = places[np.argsort(ranks[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(ranks[places])) + 1
            for group in np.split(places, cuts) if len(places) else []:
                rank = int(ranks[group[0]])
                if rank not in waiting:
                    heapq.heappush(heap, rank)
                waiting.setdefault(rank, []).append(group)

        wait(np.arange(n))
        total = n
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[ranks[at] == rank]
            at = self.apart(at, after[at])
            gone = after[at]
            symbols[at], ranks[gone] = self.made[rank], NONE
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            total -= len(at)
            changed = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            last = after[changed] >= n
            ranks[changed[last]] = NONE
            changed = changed[~last]
            ranks[changed] = self.ranks(symbols[changed], symbols[after[changed]])
            wait(changed)
        return total


class Counter:
    """Counts of the tokens of whole texts by a byte-level tokenizer's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        special = spec.get("added_tokens") or []
        if not plain or odd or spec.get("normalizer") or any(t.get(k) for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is no plain byte-level pair encoding")
        self.path, self.merges = path, Merges(model)
        self.split, self.newer, self.library = regex.compile(PIECES), newer_characters(), None
        words = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, words))) if words else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.split.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    @staticmethod
    def chunks(text: str) -> Iterator[str]:
        """The text, cut before single blanks between other characters, where a piece always starts."""
        low = 0
        while low < len(text):
            cut = _SAFE.search(text, low + CHUNK)
            high = cut.start() if cut else len(text)
            yield text[low:high]
            low = high

    def learn(self, fresh: list[str]) -> None:
        """Merge pieces, as many at once as the bound of bytes lets."""
        raw = [p.encode() for p in fresh]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for k in np.flatnonzero(sizes > LONG):
            self.known[fresh[k]] = self.merges.long_count(np.frombuffer(raw[k], np.uint8))
        short = np.flatnonzero(sizes <= LONG)
        blocks = np.cumsum(sizes[short]) // MERGED_BYTES
        for part in np.split(short, np.flatnonzero(np.diff(blocks)) + 1) if len(short) else []:
            data = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
            self.known.update(zip((fresh[k] for k in part), self.merges.counts(data, sizes[part]).tolist(), strict=True))

    def chunk_counts(self, parts: list[str]) -> list[int]:
        found = [self.pieces(p) for p in parts]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.learn(list(set(chain.from_iterable(found)) - self.known.keys()))
        return [sum(map(self.known.__getitem__, p)) for p in found]

    def __call__(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; parts of texts are merged together until they hold a chunk's characters."""
        totals, owners, parts, held_chars = [0] * len(texts), [], [], 0

        def settle() -> None:
            for k, n in zip(owners, self.chunk_counts(parts), strict=True):
                totals[k] += n
            owners.clear()
            parts.clear()

        for k, text in enumerate(texts):
            text = text or ""
            if self.special is not None:
                totals[k] = sum(1 for _ in self.special.finditer(text))
            for plain in self.special.split(text) if totals[k] else [text]:
                for part in self.chunks(plain):
                    owners.append(k)
                    parts.append(part)
                    held_chars += len(part)
                    if held_chars >= CHUNK:
                        settle()
                        held_chars = 0
        settle()
        return totals


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """docs, or the columns in keep, with n_bytes, n_tokens and over_limit, which is true for more than limit tokens."""

    def factory():
        count = held(("token counts", tokenizer), lambda: Counter(tokenizer))

        def measure(texts: list[str | None]) -> list:
            tokens = count(texts)
            return [[len((t or "").encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return measure

    return with_python(docs, ["text"], docs.columns if keep is None else keep, "n_bytes long, n_tokens long, over_limit boolean", factory)
