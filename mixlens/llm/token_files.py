"""Token ids as flat binary files.

A data set is a folder of parts, in ascending doc_id order over all parts:

* ``part-N.ids``: unsigned little-endian integers, end to end; 2 bytes each where the vocabulary allows it, else 4
* ``part-N.idx``: the 64-bit offset of each document in its part, in ids, and the end of the last one
* ``part-N.doc``: the 64-bit doc_id of each document, then one byte each that is 1 where the doc_id is null

The base of a part is the prefix sum of the parts before it. The manifest holds a row per part; only parts of task
attempts that were committed are in it, so a repeated attempt leaves at most a file that nothing refers to.

There are as many parts as the bytes and the number of documents ask for, at least one for each core, and no part is cut
within a document. A document of more bytes than a part is meant to have makes a larger part; files are written batch by
batch and read in blocks, so memory holds a document's ids only while it is encoded. Workers get few texts at once and give
freed memory back as they go, as an executor whose JVM has grown to its bound has little left for them.

Null text is the empty text: its document has the end id alone. doc_id must be a number or cast to one; another raises
under ANSI rules. A null doc_id sorts first. Rows with the same doc_id each get a document, by text; many of them are
spread over parts by the first letters of their texts. No documents give no parts. Further columns are not stored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import batches_of, held, scratch, ship, stored, trim

END_ID = 2
#: Units of text whose ids a worker keeps: about 30 bytes each.
CACHE_UNITS = 200_000
#: Bounds of what is encoded at once, in documents and bytes; one document may have more bytes.
BATCH_DOCS = 1024
BATCH_BYTES = 2_000_000
#: Bytes of text that a worker is given at once, and after which it gives freed memory back.
GIVEN_BYTES = 4_000_000
TRIM_BYTES = 16_000_000
#: What a part is meant to hold, in bytes of text and documents; a document takes 17 bytes of a reader's memory.
PART_BYTES = 128_000_000
PART_DOCS = 1_000_000
#: Letters of a text that tell ranges of one doc_id apart; the driver gets a sample of them.
HEAD = 16
#: Bounds of a block of the reader, in documents and ids; a document of more ids is read in several blocks.
BLOCK_DOCS = 4096
BLOCK_IDS = 2_000_000
#: Units in one text for the tokenizer.
LEARN_UNITS = 256
#: Marks that a byte-level word splitter always cuts off behind a letter or digit, as one piece.
MARKS = ".,;:!?%*$&#|)"
MANIFEST = "part long, path string, width int, n_docs long, n_ids long"


class Ragged:
    """Runs of ids end to end."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes.astype(np.int64)

    def take(self, at: np.ndarray) -> Ragged:
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat((starts - ends + sizes).astype(np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64), sizes)
        shift += np.arange(total, dtype=shift.dtype)
        return Ragged(self.ids[shift], sizes)

    @staticmethod
    def joined(parts: list[Ragged]) -> Ragged:
        return Ragged(np.concatenate([p.ids for p in parts]), np.concatenate([p.sizes for p in parts]))


class Encoder:
    """Ids of whole texts, through a table of blank-separated units.

    A byte-level tokenizer with the usual word splitter always cuts before a single blank between two other
    characters, so a text's ids are those of its units. Texts where blanks meet other white space go in whole. Arrow
    splits a batch and numbers its distinct units; the tokenizer meets those that the table lacks, each once, and the
    ids of the batch are one gather over the table. No step runs for each word in Python.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = len(blank) == 1 and token.startswith(blank[0])
        self.forget()

    def forget(self) -> None:
        self.units, self.ids, self.met = pa.array([], pa.string()), Ragged(np.empty(0, self.kind), np.empty(0)), np.empty(0, np.int32)

    def packed(self, texts: list[str]) -> Ragged:
        found = []
        for low in range(0, len(texts), LEARN_UNITS):
            found += [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts[low : low + LEARN_UNITS], add_special_tokens=False)]
        return Ragged(np.concatenate([np.empty(0, self.kind), *found]), np.array([len(x) for x in found]))

    def learn(self, units: list[str]) -> Ragged:
        """Ids of units, many in one text. A token with a leading blank starts a unit, as no unit holds a blank."""
        parts = []
        for low in range(0, len(units), LEARN_UNITS):
            chunk = units[low : low + LEARN_UNITS]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(chunk)], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(chunk):
                parts.append(Ragged(ids.astype(self.kind), np.diff(np.append(at, len(ids)))))
            else:  # a tokenizer that joins or splits otherwise
                parts.append(self.packed([" " + u for u in chunk]))
        return Ragged.joined(parts)

    def places(self, units: pa.Array) -> np.ndarray:
        """Place of each of these distinct units in the table, which learns those that it lacks; the table is searched once."""
        # a letter or digit before closing marks ends a piece, so stems and marks are learnt apart
        stems = pc.ascii_rtrim(units, MARKS)
        last = pc.utf8_slice_codeunits(stems, -1)
        cut = pc.and_(pc.not_equal(stems, units), pc.or_(pc.utf8_is_alpha(last), pc.utf8_is_decimal(last)))
        stems, cut = stems.filter(cut), cut.to_numpy(zero_copy_only=False)
        n = len(units)
        found = pc.index_in(pa.concat_arrays([units, stems]), value_set=self.units).fill_null(-1).to_numpy().astype(np.int64)
        at, of_stem = found[:n], found[n:]
        marked, plain = (at < 0) & cut, (at < 0) & ~cut
        stems, of_stem = stems.filter(pa.array(marked[cut])), of_stem[marked[cut]]
        fresh = pa.concat_arrays([units.filter(pa.array(plain)), stems.filter(pa.array(of_stem < 0))]).dictionary_encode()
        new = fresh.indices.to_numpy().astype(np.int64) + len(self.units)
        split = int(plain.sum())
        if len(new):
            self.add(fresh.dictionary, self.learn(fresh.dictionary.to_pylist()))
        at[plain] = new[:split]
        of_stem[of_stem < 0] = new[split:]
        if len(of_stem):
            whole = units.filter(pa.array(marked))
            ends = [m[len(s) :] for m, s in zip(whole.to_pylist(), stems.to_pylist(), strict=True)]
            at[marked] = len(self.units) + np.arange(len(of_stem))  # a unit that ends in marks is no stem
            self.add(whole, self.with_ends(self.ids.take(of_stem), ends))
        return at

    def with_ends(self, stems: Ragged, ends: list[str]) -> Ragged:
        """The ids of stems, each with those of its marks behind."""
        kinds = {m: k for k, m in enumerate(dict.fromkeys(ends))}
        tails = self.packed(list(kinds)).take(np.fromiter(map(kinds.__getitem__, ends), np.int64, len(ends)))
        both = Ragged.joined([stems, tails])
        n = len(ends)
        pairs = both.take(np.arange(2 * n).reshape(2, n).T.ravel())
        return Ragged(pairs.ids, pairs.sizes.reshape(n, 2).sum(axis=1))

    def add(self, units: pa.Array, ids: Ragged) -> None:
        self.units = pa.concat_arrays([self.units, units])
        self.ids = Ragged.joined([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int32)])

    def shrink(self) -> None:
        """Keep the half of the table that most batches met."""
        if len(self.units) > CACHE_UNITS:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: CACHE_UNITS // 2])
            self.units, self.ids, self.met = self.units.take(pa.array(keep)), self.ids.take(keep), self.met[keep] // 2

    def __call__(self, texts: pa.Array) -> Ragged:
        """Ids of each text, null being empty, with the end id behind."""
        n = len(texts)
        split = pc.split_pattern(texts.fill_null(""), " ")
        first = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        units, at = numbered.dictionary, numbered.indices.to_numpy()
        first, at = first[:-1] - first[0], at.astype(np.int64)
        sizes = np.diff(np.append(first, len(at)))
        # units with white space at either side do not stand alone, nor do heads with white space behind
        odd = pc.or_(pc.equal(pc.binary_length(units), 0), pc.not_equal(pc.utf8_trim_whitespace(units), units)).to_numpy(zero_copy_only=False)
        odd_at = odd[at]
        heads = units.take(pa.array(at[first]))
        odd_at[first] = pc.not_equal(pc.utf8_rtrim_whitespace(heads), heads).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(odd_at, first) if n else np.empty(0, bool)
        inner = np.repeat(~whole, sizes)
        inner[first] = False
        used = np.zeros(len(units), bool)
        used[at[inner]] = True
        self.shrink()
        places = np.zeros(len(units), np.int64)
        places[used] = self.places(units.filter(pa.array(used)))
        self.met[places[used]] += 1
        opening = self.packed([t if w else h for t, h, w in zip(texts.fill_null("").to_pylist(), heads.to_pylist(), whole.tolist(), strict=True)])
        table = Ragged.joined([self.ids, opening, Ragged(np.array([END_ID], self.kind), np.array([1]))])
        # of each text: its head, or all of it, its other units, and the end
        told = np.where(inner, places[at], 0)
        told[first] = len(self.ids.sizes) + np.arange(n)
        shown = inner
        shown[first] = True
        counts = np.add.reduceat(shown, first) if n else np.empty(0, np.int64)
        sequence = np.full(int(counts.sum()) + n, len(self.ids.sizes) + n)
        body = np.ones(len(sequence), bool)
        ends = np.cumsum(counts + 1) - 1
        body[ends] = False
        sequence[body] = told[shown]
        made = table.take(sequence)
        totals = np.cumsum(made.sizes)[ends]
        return Ragged(made.ids, np.diff(totals, prepend=0))


def encoder(path: str) -> Encoder:
    """One for each worker, so that later tasks find its cache filled."""
    return held(("encoder", path), lambda: Encoder(path))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices within the bounds of a batch."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(sizes[low - 1]) if low else 0
            high = min(low + BATCH_DOCS, max(low + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right"))), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stem = offsets = None
        for batch in _small(batches):
            if stem is None:
                encode = encoder(tokenizer)
                files, root = _open(folder)
                files.create_dir(root, recursive=True)
                stem = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
                out = files.open_output_stream(f"{stem}.ids")
                offsets, docs, nulls = array("q", [0]), array("q"), bytearray()
                told = 0
            made = encode(batch.column(1))
            out.write(made.ids.tobytes())
            offsets.extend((np.cumsum(made.sizes) + offsets[-1]).tolist())
            docs.extend(batch.column(0).fill_null(0).to_pylist())
            nulls.extend(batch.column(0).is_null().to_pylist())
            told += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if told > TRIM_BYTES:
                told = 0
                trim()
        if stem is None:
            return
        out.close()
        with files.open_output_stream(f"{stem}.idx") as f:
            f.write(np.array(offsets, "<i8").tobytes())
        with files.open_output_stream(f"{stem}.doc") as f:
            f.write(np.array(docs, "<i8").tobytes() + bytes(nulls))
        name = stem.rsplit("/", 1)[1]
        row = [[part], [f"{folder}/{name}"], [encode.width], [len(docs)], [offsets[-1]]]
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "width", "n_docs", "n_ids"])

    return write


def part_count(docs: DataFrame) -> int:
    """Number of parts for doc_id and text of docs, from all bytes and documents."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES), -(-n // PART_DOCS))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write doc_id and text of docs as token files below folder; return the manifest, with each part's base."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    first = F.col("doc_id").asc_nulls_first()
    ranges = rows.repartitionByRange(part_count(rows), first, F.substring("text", 1, HEAD).asc_nulls_first())
    ordered = ranges.sortWithinPartitions(first, F.col("text").asc_nulls_first())
    with batches_of(spark, GIVEN_BYTES):
        manifest = stored(ordered.mapInArrow(_writer(folder, tokenizer), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: the window has as many rows as there are files
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


class Part:
    """One part, memory-mapped where its file system is local."""

    def __init__(self, path: str, width: int) -> None:
        files, root = _open(path)
        self.local = isinstance(files, pafs.LocalFileSystem)
        self.kind = np.dtype(f"<u{width}")
        with files.open_input_file(f"{root}.idx") as f:
            self.offsets = np.frombuffer(f.read(), "<i8")
        n = len(self.offsets) - 1
        with files.open_input_file(f"{root}.doc") as f:
            raw = f.read()
        self.nulls = np.frombuffer(raw[8 * n :], np.uint8).astype(bool)
        self.docs = np.frombuffer(raw[: 8 * n], "<i8")
        self.file = None if self.local else files.open_input_file(f"{root}.ids")
        self.map = np.memmap(f"{root}.ids", self.kind, "r") if self.local else None

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from one place of the part to another, in one read."""
        if self.local:
            return self.map[first:last]
        return np.frombuffer(self.file.read_at((last - first) * self.kind.itemsize, first * self.kind.itemsize), self.kind)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents within the bounds of a block, but for a document that is alone."""
        low, n = 0, len(self.docs)
        while low < n:
            fit = int(np.searchsorted(self.offsets, self.offsets[low] + BLOCK_IDS, "right")) - 1
            high = min(low + BLOCK_DOCS, max(fit, low + 1), n)
            yield low, high
            low = high

    def checksums(self, low: int, high: int) -> list[int]:
        """The checksum of the ids of each of these documents as 32-bit integers."""
        first, last = int(self.offsets[low]), int(self.offsets[high])
        if high == low + 1:
            check = 0
            for k in range(first, last, BLOCK_IDS):
                check = zlib.crc32(self.ids(k, min(k + BLOCK_IDS, last)).astype("<u4"), check)
            return [check]
        wide = memoryview(self.ids(first, last).astype("<u4")).cast("B")
        cuts = (4 * (self.offsets[low : high + 1] - first)).tolist()
        return [zlib.crc32(wide[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, width, base in zip(*(batch.column(k).to_pylist() for k in ("path", "width", "base")), strict=True):
            part = Part(path, width)
            for low, high in part.blocks():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.docs[low:high], mask=part.nulls[low:high]),
                        pa.array(part.offsets[low:high] + base),
                        pa.array(np.diff(part.offsets[low : high + 1])),
                        pa.array(part.checksums(low, high), pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of each document, read from the files."""
    spark = manifest.sparkSession
    ship(spark)
    parts = manifest.count()  # a number given keeps the partitions apart, where adaptive execution would join them
    rows = manifest.select("part", "path", "width", "base").repartitionByRange(max(1, parts), "part")
    return rows.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
