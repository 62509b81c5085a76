"""Vectors as codes: a codebook for each part of a vector, trained by Lloyd rounds that filter entries with kd-trees.

Components become whole numbers, so sums, means and distances are exact and do not depend on how rows are dealt out. In
every round each partition cuts its rows into blocks and builds a kd-tree over each part of a block; every node caches
the box around its points, their sum and their count. Going down a tree, an entry leaves the candidates of a node when
another is nearer to every place in the node's box, and a node with one candidate left adds its cached sum as a whole.
Spark adds up one row a partition, part and entry.

Kept are vectors without null or non-finite components whose length is a positive multiple of the number of parts and
that of the kept vector with the smallest vec_id; others are dropped. The first entries are the vectors of the smallest
vec_ids, null last, ties by the vector; with fewer vectors than entries there are as many entries as vectors. Repeated
rows each count and each get a code. Components beyond 2**27 in size are taken as 2**27, since no long holds larger
distances. An empty table, or one without a kept vector, gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, hot_join, ship, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 27
#: Rows whose trees a task holds at once, and points below which a node is not divided.
BLOCK_ROWS = 16_384
LEAF = 8


def whole_numbers(rows: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the kept vectors as whole numbers, in a column named code."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), large), -large)).cast("long"))
    return rows.filter(vector.isNotNull() & finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).select("vec_id", "label", whole.alias("code"))


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest vec_ids, a row each."""
    found = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "code").limit(entries).select("code").collect()
    return np.array([r.code for r in found], np.int64)


@dataclass
class Tree:
    """Nodes level by level; a node at place k of a level has its halves at 2k and 2k + 1 of the next."""

    order: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def kd_tree(points: np.ndarray) -> Tree:
    """A balanced tree over the points: each node is cut at the median of its widest side, all nodes of a level at once."""
    n = len(points)
    tree = Tree(np.arange(n), [], [], [], [])
    bounds = np.array([0, n])
    while True:
        placed = points[tree.order]
        tree.bounds.append(bounds)
        tree.low.append(np.minimum.reduceat(placed, bounds[:-1]))
        tree.high.append(np.maximum.reduceat(placed, bounds[:-1]))
        tree.sums.append(np.add.reduceat(placed, bounds[:-1]))
        sizes = np.diff(bounds)
        if sizes.min() < 2 * LEAF:
            return tree
        widest = np.repeat((tree.high[-1] - tree.low[-1]).argmax(axis=1), sizes)
        node = np.repeat(np.arange(len(sizes)), sizes)
        tree.order = tree.order[np.lexsort((placed[np.arange(n), widest], node))]
        bounds = np.append(np.stack([bounds[:-1], bounds[:-1] + sizes // 2], axis=1).ravel(), n)


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point by all distances, ties to the lower index."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def least(distances: np.ndarray, owners: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
    """The entry of the least distance of each of n owners, ties to the lower index; pairs stand by owner, then entry."""
    lowest = np.minimum.reduceat(distances, np.searchsorted(owners, np.arange(n)))
    at = np.flatnonzero(distances == lowest[owners])[::-1]
    best = np.empty(n, np.int64)
    best[owners[at]] = entries[at]  # of equal ones the first is written last
    return best


def not_beaten(low: np.ndarray, high: np.ndarray, entries: np.ndarray, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Which pairs of node and candidate stay: those that the candidate nearest to the middle of the box does not beat everywhere in it."""
    other = entries[candidates]
    # twice the middle against twice the entries keeps whole numbers
    best = least((((low + high)[owners] - 2 * other) ** 2).sum(axis=1), owners, candidates, len(low))[owners]
    chosen = entries[best]
    # the corner of the box that lies furthest towards the other entry
    corner = np.where(other > chosen, high[owners], low[owners])
    theirs, own = ((corner - other) ** 2).sum(axis=1), ((corner - chosen) ** 2).sum(axis=1)
    return (own > theirs) | ((own == theirs) & (best >= candidates))


def filtered(points: np.ndarray, entries: np.ndarray, take: Callable[[np.ndarray, np.ndarray, np.ndarray | None], None]) -> None:
    """Deal the points to entries through their tree. take gets entries, places of points, and sums where nodes go whole.

    With sums, the places are pairs of bounds in the tree's order; without, they are points. The tree's order itself comes
    last, with no entries.
    """
    tree = kd_tree(points)
    live, owners, candidates = np.zeros(1, np.int64), np.zeros(len(entries), np.int64), np.arange(len(entries))
    for level, bounds in enumerate(tree.bounds):
        stays = not_beaten(tree.low[level][live], tree.high[level][live], entries, owners, candidates)
        owners, candidates = owners[stays], candidates[stays]
        single = np.bincount(owners, minlength=len(live)) == 1
        of_single = single[owners]
        if single.any():
            whole = live[single]
            take(candidates[of_single], np.stack([bounds[whole], bounds[whole + 1]], axis=1), tree.sums[level][whole])
        owners, candidates = (np.cumsum(~single) - 1)[owners[~of_single]], candidates[~of_single]
        live = live[~single]
        if not len(live):
            break
        if level + 1 < len(tree.bounds):
            owners, candidates, live = *halves(owners, candidates), np.stack([2 * live, 2 * live + 1], axis=1).ravel()
    if len(live):
        sizes, counts = bounds[live + 1] - bounds[live], np.bincount(owners, minlength=len(live))
        rows = tree.order[runs(bounds[live], sizes)]
        point = np.repeat(np.arange(len(rows)), np.repeat(counts, sizes))
        asked = candidates[runs(np.repeat(np.cumsum(counts) - counts, sizes), np.repeat(counts, sizes))]
        take(least(((points[rows][point] - entries[asked]) ** 2).sum(axis=1), point, asked, len(rows)), rows, None)
    take(np.empty(0, np.int64), tree.order, None)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on of each run, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def halves(owners: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of both halves of each owner, by half, then candidate."""
    counts = np.bincount(owners)
    twice = np.repeat(counts, 2)
    return np.repeat(np.arange(len(twice)), twice), candidates[runs(np.repeat(np.cumsum(counts) - counts, 2), twice)]


def block_sums(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points that each entry gets."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)

    def take(to: np.ndarray, places: np.ndarray, whole: np.ndarray | None) -> None:
        if len(to):
            np.add.at(sums, to, points[places] if whole is None else whole)
            np.add.at(counts, to, 1 if whole is None else places[:, 1] - places[:, 0])

    filtered(points, entries, take)
    return sums, counts


def block_codes(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    codes, spans = np.empty(len(points), np.int64), []

    def take(to: np.ndarray, places: np.ndarray, whole: np.ndarray | None) -> None:
        if whole is not None:
            spans.append((to, places))
        elif len(to):
            codes[places] = to
        else:  # the tree's order comes last
            for entry, (low, high) in ((e, p) for found, pairs in spans for e, p in zip(found.tolist(), pairs.tolist(), strict=True)):
                codes[places[low:high]] = entry

    filtered(points, entries, take)
    return codes


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows by the block, with their vectors."""
    waiting, rows = [], 0

    def block() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        return whole, whole.column("code").flatten().to_numpy().reshape(-1, width)

    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(low, BLOCK_ROWS)
            if rows + part.num_rows > BLOCK_ROWS:
                yield block()
                waiting, rows = [], 0
            waiting.append(part)
            rows += part.num_rows
    if rows:
        yield block()


def lloyd(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """books, parts by entries by places, after one round; an entry that no part is nearest to stays."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for _, found in _blocks(batches, parts * size):
            for p in range(parts):
                s, n = block_sums(np.ascontiguousarray(found[:, p * size : (p + 1) * size]), books[p])
                sums[p] += s
                counts[p] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    told = vectors.select("code").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    # decimals, as a sum over very many rows may pass a long
    total = [F.sum(F.col("sums")[k].cast("decimal(20,0)")).alias(f"s{k}") for k in range(size)]
    after = books.copy()
    for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry
        after[r.part, r.entry] = [int(r[f"s{k}"]) // r.n for k in range(size)]
    return after


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, the code of each vector and its error."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _blocks(batches, parts * size):
            codes, error = np.empty((len(found), parts), np.uint8), np.zeros(len(found), np.int64)
            for p in range(parts):
                points = np.ascontiguousarray(found[:, p * size : (p + 1) * size])
                own = block_codes(points, books[p])
                codes[:, p] = own
                error += ((points - books[p][own]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            step = 2 * parts
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector of rows."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    ship(rows.sparkSession)
    out = "vec_id", "code", "error", "label_error", "codebooks_sha256"
    vectors = stored(whole_numbers(rows, parts, scale), "vectors")
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "code").select(F.size("code").alias("n")).head()
    width = head.n if head else parts
    kept = vectors.filter(F.size("code") == width)
    first = first_entries(kept, entries).reshape(-1, parts, width // parts)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    for _ in range(rounds if head else 0):
        books = lloyd(kept, books)
    found = stored(coded(kept, books), "codes")
    drop_stored(vectors)
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return hot_join(found, labels, "label", "n").withColumn("codebooks_sha256", F.lit(books_digest(books))).select(*out)


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, size: int = 4) -> str:
    """The same in SQL for vectors of parts * size components, by all distances."""
    steps = [f"""
kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pieces AS (SELECT vec_id, p, list_slice(v, p * {size} + 1, (p + 1) * {size}) AS v FROM kept, range({parts}) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM pieces QUALIFY e < {entries})"""]
    distance = "list_sum(list_transform(range(1, {n}), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))".format(n=size + 1)
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (SELECT a.vec_id, a.p, min((CAST({distance} AS HUGEINT) * {entries} + b.e)) AS best, any_value(a.v) AS v FROM pieces AS a JOIN book{k} AS b USING (p) GROUP BY ALL HAVING true)""".replace(" GROUP BY ALL HAVING true", " GROUP BY a.vec_id, a.p"))
        if k < rounds:
            means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, size + 1))
            steps.append(f"""
mean{k} AS (SELECT p, best % {entries} AS e, [{means}] AS v FROM near{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} AS b LEFT JOIN mean{k} AS m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {','.join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest"""


COMPRESS_SQL = compress_sql()
