"""Substring dedup on a compacted De Bruijn graph of words.

An edge of the graph is a run of WINDOW words; a document is a walk over its edges. The walk is cut into paths where the
minimiser of the edge (the least hash of its runs of ANCHOR words) changes, so that equal edges lie in paths with equal
minimisers wherever they occur: the partition of the published compaction algorithms. Then

1. a join on the minimiser drops paths whose minimiser occurs once: none of their edges is repeated;
2. paths with the same words are one, with a count, what follows them, and the coordinates of one source. All edges of a
   path that occurs twice are repeated;
3. nonbranching paths compact: a join on what follows tells the paths that one path alone follows, as often, so that
   no walk enters or leaves between them. In a document such paths make one long repeated span;
4. at branches, where paths with one minimiser differ, the texts at the source coordinates are read again and their
   edges compared one by one.

Every word that a repeated edge covers is removed, the first occurrence included. Paths and edges are compared only
under the same minimiser, by 64-bit hashes each, which makes an identity of 128 bits.

Null text has no words; its kept text is empty. Texts shorter than an edge stay whole. Rows with the same doc_id are
told apart by their text; repeated rows repeat each other's edges. No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import BROADCAST_ROWS, WORD_BYTES, Bitmap, drop_stored, ship, small, stored, trim, with_python
from mixlens.llm.hashing import batches_of, hashed_words, span_hash, window_hashes

WINDOW = 35
ANCHOR = 12
#: Texts with one path from which on it is hot; the list of hot paths is broadcast if it is short.
HOT = 1000
PATH = "doc_id long, row long, anchor long, span long, first int, edges int, loops boolean, following long"


def _words(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass"))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by doubling."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def paths_of(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Minimiser, hash of all words, first edge, number of edges, whether an edge comes twice, and the hash of the next path, of each path of a text's word hashes."""
    if len(hashes) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool, np.int64))
    least = sliding_min(window_hashes(hashes, anchor), window - anchor + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(first[1:], len(least))
    spans = span_hash(hashes, first, ends + window - 1)
    loops = np.zeros(len(first), bool)
    edges = window_hashes(hashes, window)
    if len(np.unique(edges)) < len(edges):
        for k, (a, b) in enumerate(zip(first, ends, strict=True)):
            loops[k] = len(np.unique(edges[a:b])) < b - a
    spans = spans.view(np.int64)
    return least[first].view(np.int64), spans, first.astype(np.int32), (ends - first).astype(np.int32), loops, np.append(spans[1:], 0)


def _cut(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text"):
            hashes, first = hashed_words(part.column("text"))
            found = [paths_of(hashes[a:b], window, anchor) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            times = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(times), part.column(1).take(times), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], [c.split()[0] for c in PATH.split(", ")])
        trim()

    return run


def _edges_at(window: int):
    """Hashes of the edges of the paths asked for, as one list each of what says where they are."""

    def make(texts: list[str | None], asked: list[list[dict]]) -> list[list]:
        out = []
        hashes, first = hashed_words(pa.array(texts, pa.string()))
        for k, paths in enumerate(asked):
            edges = window_hashes(hashes[first[k] : first[k + 1]], window).view(np.int64)
            out.append([{"anchor": p["anchor"], "edge": int(e), "at": p["first"] + j, "single": p["single"]} for p in paths for j, e in enumerate(edges[p["first"] : p["first"] + p["edges"]])])
        return [out]

    return make


def _removed(texts: list[str | None], spans: list[list[dict] | None]) -> list[list]:
    out: list[list] = [[], [], []]
    for text, found in zip(texts, spans, strict=True):
        words = _words(text)
        n = len(words)
        if found:
            marks = np.zeros(n + 1, np.int32)
            np.add.at(marks, [s["start"] for s in found], 1)
            np.add.at(marks, [s["end"] for s in found], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(marks[:n]) == 0)]
        for column, value in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
            column.append(value)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, row (a hash of the text) and spans, an array of word positions (start, end) that repeated edges cover.

    docs has doc_id, text and row. Each document's array is bounded by its length.
    """
    ship(docs.sparkSession)
    paths = stored(docs.select("doc_id", "row", "text").mapInArrow(_cut(window, anchor), PATH), "paths")
    often = paths.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_or("loops").alias("loops")).filter("n > 1 OR loops").select("anchor")
    shared = stored(paths.join(often, "anchor"), "shared-paths")
    drop_stored(paths)
    source = F.min(F.struct("doc_id", "row", "first")).alias("source")
    compact = stored(shared.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.max("edges").alias("edges"), F.bool_or("loops").alias("loops"), source, F.min("following").alias("next"), F.max("following").alias("last")), "compact-paths")
    spans = long_spans(repeated_paths(shared, compact), window)
    # branches: minimisers with a path that occurs once beside another path, or beside itself
    branching = compact.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.bool_or(F.col("loops") & (F.col("n") == 1)).alias("own"))
    asked = compact.join(branching.filter("least = 1 AND (k > 1 OR own)").select("anchor"), "anchor")
    asked = asked.groupBy("source.doc_id", "source.row").agg(F.collect_list(F.struct("anchor", F.col("source.first").alias("first"), "edges", (F.col("n") == 1).alias("single"))).alias("asked"))
    asked = stored(asked, "asked-paths")
    marked = Bitmap(asked, ["row"], asked.count()).marked(docs, ["row"], "maybe")
    texts = at_rows(marked.filter("maybe").drop("maybe"), asked, "inner")
    made = with_python(texts, ["text", "asked"], ["doc_id", "row"], "made array<struct<anchor:bigint,edge:bigint,at:int,single:boolean>>", lambda: _edges_at(window))
    # repeated rows ask for the same coordinates twice: told apart, they would repeat every edge of theirs
    edges = stored(made.select("doc_id", "row", F.explode("made").alias("e")).select("doc_id", "row", "e.*"), "branch-edges")
    places = edges.select("anchor", "edge", "doc_id", "row", "at").distinct() if _has_repeats(docs) else edges
    again = places.groupBy("anchor", "edge").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "edge")
    single = edges.filter("single").join(again, ["anchor", "edge"]).select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    found = stored(spans.unionByName(single).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-spans")
    drop_stored(shared, compact, asked, edges)
    return found


def repeated_paths(shared: DataFrame, compact: DataFrame) -> DataFrame:
    """The paths whose words occur twice or more, with joined: whether the next path belongs to the same long span.

    It does if it follows wherever the path occurs, and occurs as often. Paths that very many texts have meet what is
    known of them without a shuffle.
    """
    often = compact.filter("n > 1").select("anchor", "span", "n", F.when(F.col("next") == F.col("last"), F.col("next")).alias("next"))
    after = often.select(F.col("span").alias("next"), F.col("n").alias("times")).distinct()
    known = stored(often.join(after, "next", "left").select("anchor", "span", "n", F.coalesce(F.col("times") == F.col("n"), F.lit(False)).alias("joined")), "repeated-paths")
    hot = known.filter(F.col("n") > HOT).select("anchor", "span", F.col("joined").alias("hot"))
    if (count := hot.count()) > BROADCAST_ROWS:
        return shared.join(known.drop("n"), ["anchor", "span"])
    told = shared.join(small(hot, count), ["anchor", "span"], "left")
    rest = told.filter("hot IS NULL").drop("hot").join(known.filter(F.col("n") <= HOT).drop("n"), ["anchor", "span"])
    return told.filter("hot IS NOT NULL").withColumnRenamed("hot", "joined").unionByName(rest)


def long_spans(paths: DataFrame, window: int) -> DataFrame:
    """doc_id, row, start and end of runs of paths that belong together; a window has the paths of one text."""
    of_text = Window.partitionBy("doc_id", "row").orderBy("first")
    before = F.lag(F.when(F.col("joined"), F.col("first") + F.col("edges"))).over(of_text)
    opened = paths.withColumn("opens", F.coalesce((before != F.col("first")).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("opens").over(of_text))
    runs = numbered.groupBy("doc_id", "row", "run").agg(F.min("first").alias("start"), (F.max(F.col("first") + F.col("edges")) + window - 1).alias("end"))
    return runs.select("doc_id", "row", "start", "end")


def _has_repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id", "row").count().filter("count > 1").isEmpty()


def at_rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join to docs what was found for each doc_id and row."""
    other = found.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_doc"]) & (docs["row"] == other["_row"]), how).drop("_doc", "_row")


def row_of(text: Column) -> Column:
    return F.xxhash64(text)


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text", row_of(F.col("text")).alias("row"))
    found = at_rows(keyed, repeated_spans(keyed, window, anchor), "left")
    return with_python(found, ["text", "spans"], ["doc_id"], "n_words long, n_removed long, kept_sha256 string", lambda: _removed)
