"""The prefix trie of conversations, built as a Patricia tree from sorted paths.

A turn is its digest (16 bytes of SHA-256 over role and text), so texts are read once and never shuffled. A conversation's
path is cut into blocks of WIDTH turns; a block knows its start by a 128-bit sum of the blocks before it, so blocks of the
same start lie in the same subtree, and no row or task holds a whole conversation. Equal blocks are merged and sorted; the
longest common prefix of neighbours is where paths branch. Only branch points, ends, leaves and block borders become
points, each with the edge above it. Members are summed at points alone, and nodes inside an edge are expanded at last
from the suffix sums of its texts.

What a subtree saves is summed over its members in place of its nodes: with shares(c), the code points that conversation c
has in common with conversations of smaller id, a point of smallest member m saves the sum of shares(c) - above over its
other members c, where above is the code points of the texts above the point. So no step goes down or up the tree level by
level.

Rows without a conv_id are in no conversation. Turns of a conversation stand by turn, null first, those of the same turn by
digest, and repeated rows are turns of their own. Null role or text is empty. An empty table gives no nodes. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, hot_join, ship, stored

#: A conversation starts with up to five turns of the first of its hundred.
FAMILY = 100
GRAFTS = 6
#: Turns of a block, and bytes of a turn's digest. A mask of depths has 64 bits at most.
WIDTH = 32
BYTES = 16
#: Distinct blocks that a task sorts and holds, about 200 bytes each.
ROWS_A_PART = 200_000
#: Blocks of a conversation that one window runs over.
RUN = 1024
#: Ids in a piece of text to hash.
PIECE_IDS = 512
#: The common prefix with a row that is not there.
OPEN = 99
KEY = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """conv, turn, digest and chars of each turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, BYTES)
    return rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place, from 1, of each row in its conv. A conv may span many partitions.

    Rows are dealt to ranges and counted as they pass. A run that opens a partition may go on from the one before, so at
    most one conv a partition needs what the partitions before it hold.
    """
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, first = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy()
            first = int(conv[0]) if first is None else first
            at = np.arange(n)
            new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, seen + at, at - start) + 1
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place), pa.array(conv == first)], [*batch.schema.names, "part", name, "opening"])

    ordered = rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    told = stored(ordered.mapInArrow(count, f"{kinds}, part int, {name} long, opening boolean"), f"turns-by-{name}")
    # at most one conv opens a partition, so these are no more rows than partitions
    openers = told.filter(F.col("opening") & (F.col(name) == 1)).select("conv").distinct()
    cells = told.join(F.broadcast(openers), "conv", "left_semi").groupBy("conv", "part").agg(F.max(name).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spark.createDataFrame(cells.withColumn("offset", before).filter("offset > 0").select("conv", "part", "offset").collect(), "conv long, part int, offset long")
    return told.join(F.broadcast(offsets), ["conv", "part"], "left").withColumn(name, F.col(name) + F.coalesce("offset", F.lit(0))).drop("offset", "part", "opening")


def grafted(turns: DataFrame, family: int = FAMILY, grafts: int = GRAFTS) -> tuple[DataFrame, DataFrame]:
    """Turns by depth of conversations whose first turns are those of the first of their family; and all convs."""
    places = numbered(turns, ["turn", "digest"], "place")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % grafts
    convs = places.filter("place = 1").select("conv")
    heads = places.filter((F.col("conv") % family == 0) & (F.col("place") < grafts)).select(F.col("conv").alias("leader"), "place", "digest", "chars")
    told = convs.withColumns({"leader": F.col("conv") - F.col("conv") % family, "taken": taken}).join(heads, "leader")
    led = told.filter(F.col("place") <= F.col("taken")).select("conv", "place", "digest", "chars")
    own = places.filter(F.col("place") > taken).select("conv", "place", "digest", "chars")
    return numbered(own.unionByName(led), ["place"], "depth").drop("place"), convs


def _sum(part: int, block: Column, content: Column) -> Column:
    return F.xxhash64(F.lit(part), block, content)


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The blocks of all paths, with their start, what comes before them, and whether the path ends there.

    A conversation without turns has an empty block.
    """
    block = F.floor((F.col("depth") - 1) / WIDTH).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("depth", "digest", "chars")))  # no more than WIDTH
    plain = turns.groupBy("conv", block.alias("block")).agg(rows.alias("rows"))
    content = F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["digest"]))
    none = convs.join(turns.filter("depth = 1").select("conv"), "conv", "left_anti")
    none = none.select("conv", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("content"), F.array().cast("array<bigint>").alias("chars"))
    made = plain.select("conv", "block", content.alias("content"), F.transform("rows", lambda r: r["chars"]).alias("chars")).unionByName(none)
    made = made.withColumns({"x1": _sum(1, F.col("block"), F.col("content")), "x2": _sum(2, F.col("block"), F.col("content"))})
    made = made.withColumns({"sum": F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c), "run": F.floor(F.col("block") / RUN)})
    made = stored(made, "path-blocks")
    # what comes before a block: the runs before its run, and the blocks before it in the run
    runs = made.groupBy("conv", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"), F.sum("sum").alias("chars"), F.max("block").alias("top"))
    so_far = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = {"r1": F.bit_xor("r1").over(so_far), "r2": F.bit_xor("r2").over(so_far), "rc": F.sum("chars").over(so_far), "top": F.max("top").over(Window.partitionBy("conv"))}
    runs = runs.select("conv", "run", *(c.alias(k) for k, c in before.items()))
    inner = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = made.withColumns({"i1": F.bit_xor("x1").over(inner), "i2": F.bit_xor("x2").over(inner), "ic": F.sum("sum").over(inner)}).join(runs, ["conv", "run"])
    both = lambda a, b: F.coalesce(F.col(a), F.lit(0)).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))
    told = here.select("conv", "block", both("r1", "i1").alias("s1"), both("r2", "i2").alias("s2"), "content", "chars", (F.coalesce("rc", F.lit(0)) + F.coalesce("ic", F.lit(0))).alias("above"), (F.col("block") == F.col("top")).alias("last"))
    out = stored(told, "blocks")
    drop_stored(made)
    return out


def key_of(at: Column) -> list[Column]:
    """Depth and sums of the point so many turns into a block."""
    head = F.substring(F.col("content"), F.lit(1), at * BYTES)
    keyed = [F.when(at == 0, F.col(f"s{p}")).otherwise(F.col(f"s{p}").bitwiseXOR(_sum(p, F.col("block"), head))) for p in (1, 2)]
    return [F.col("block") * WIDTH + at, *keyed]


def common_turns(content: pa.Array, starts: np.ndarray) -> np.ndarray:
    """Turns that each content has in common with the one before it of the same start, -1 if that differs."""
    n = len(content)
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(content.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets) // BYTES
    grid = np.zeros((n, WIDTH * BYTES), np.uint8)
    filled = np.arange(WIDTH * BYTES)[None, :] < (sizes * BYTES)[:, None]
    grid[filled] = raw[offsets[0] : offsets[-1]]
    turns = grid.view(np.int64).reshape(n, WIDTH, BYTES // 8)
    same = (turns[1:] == turns[:-1]).all(axis=2) & (np.arange(WIDTH)[None, :] < np.minimum(sizes[1:], sizes[:-1])[:, None])
    common = np.where(same.all(axis=1), WIDTH, same.argmin(axis=1))
    return np.where((starts[1:] == starts[:-1]).all(axis=1), common, -1)


def branch_depths(common: np.ndarray) -> np.ndarray:
    """For each row, bits of the depths where it, or a row that shares as much with it, parts from the one before.

    common[k] is what row k shares with row k - 1; OPEN at 0.
    """
    at, bits = np.arange(len(common)), np.zeros(len(common), np.int64)
    for depth in range(WIDTH):
        branched = np.maximum.accumulate(np.where(common == depth, at, -1))
        parted = np.maximum.accumulate(np.where(common < depth, at, -1))
        bits |= (branched > parted).astype(np.int64) << depth
    return bits


def low_bits(depth: Column) -> Column:
    """Bits 0 to depth; none for -1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.least(depth, F.lit(WIDTH)) + 1).cast("int")) - 1


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """The distinct blocks with a mask of the depths in them where paths branch.

    Each partition of the sorted blocks finds the branches between its own neighbours; what crosses from one partition to
    the next is a mask a partition, carried over all partitions from either side.
    """
    spark = blocks.sparkSession
    last = F.when(F.col("last"), F.col("conv"))
    distinct = blocks.groupBy("block", "s1", "s2", "content").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count(last).alias("n_ends"), F.min(last).alias("first_end"), F.first("chars").alias("chars"), F.first("above").alias("above"))
    distinct = stored(distinct, "distinct-blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // ROWS_A_PART))
    order = ["block", "s1", "s2", "content"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows = [b for b in batches if b.num_rows]
        if not held_rows:
            return
        part, common, before = TaskContext.get().partitionId(), [np.array([OPEN])], None
        for batch in held_rows:
            for low in range(0, batch.num_rows, 4096):
                rows = batch.slice(low, 4096)
                joined = pa.Table.from_batches([rows] if before is None else [before, rows]).combine_chunks().to_batches()[0]
                starts = np.stack([joined.column(c).to_numpy() for c in order[:3]], axis=1)
                common.append(common_turns(joined.column("content"), starts))
                before = rows.slice(rows.num_rows - 1)
        common = np.concatenate(common)
        n = len(common)
        left, least = branch_depths(common), np.minimum.accumulate(common)
        # from the other side, what a row shares with the next one
        back = np.append(common[1:], OPEN)[::-1]
        right, least_right = branch_depths(back)[::-1], np.minimum.accumulate(back)[::-1]
        edge = np.zeros(n, bool)
        edge[[0, -1]] = True
        low = 0
        for batch in held_rows:
            here = slice(low, low + batch.num_rows)
            low += batch.num_rows
            added = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(np.arange(here.start, here.stop)), pa.array(left[here]), pa.array(right[here]), pa.array(least[here].astype(np.int32)), pa.array(least_right[here].astype(np.int32)), pa.array(edge[here])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "at", "lefts", "rights", "least", "least_right", "edge"])

    kinds = ", ".join(f"{c} {t}" for c, t in distinct.dtypes)
    ordered = distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    told = stored(ordered.mapInArrow(mark, f"{kinds}, part int, at long, lefts long, rights long, least int, least_right int, edge boolean"), "sorted-blocks")
    drop_stored(distinct)
    edges = told.filter("edge").select("part", *order, "lefts", "rights", "least", "least_right").orderBy("part", "at").collect()  # two rows a partition
    carried = spark.createDataFrame(carries(edges), "part int, from_left long, from_right long")
    crossed = lambda c, least: F.col(c).bitwiseAND(low_bits(F.col(least)))
    mask = F.col("lefts").bitwiseOR(F.col("rights")).bitwiseOR(crossed("from_left", "least")).bitwiseOR(crossed("from_right", "least_right"))
    return told.join(F.broadcast(carried), "part").withColumn("mask", mask).drop("part", "at", "lefts", "rights", "least", "least_right", "edge", "from_left", "from_right")


def carries(edges: list) -> list[tuple[int, int, int]]:
    """part and the masks that come into it from the left and from the right; edges are first and last rows by part."""
    firsts, lasts = {}, {}
    for r in edges:
        firsts.setdefault(r.part, r)
        lasts[r.part] = r
    parts = sorted(firsts)
    low = lambda depth: (1 << min(depth, WIDTH) + 1) - 1

    def shared(a, b) -> int:
        if (a.block, a.s1, a.s2) != (b.block, b.s1, b.s2):
            return -1
        k = 0
        while k < min(len(a.content), len(b.content)) and a.content[k : k + BYTES] == b.content[k : k + BYTES]:
            k += BYTES
        return k // BYTES

    border = [shared(lasts[a], firsts[b]) for a, b in zip(parts, parts[1:], strict=False)]
    step = lambda mask, depth: mask & low(depth) | (1 << depth if depth >= 0 else 0)
    left, right = [0] * len(parts), [0] * len(parts)
    for k, depth in enumerate(border):
        row = lasts[parts[k]]
        left[k + 1] = step(row.lefts | left[k] & low(row.least), depth)
    for k, depth in reversed(list(enumerate(border))):
        row = firsts[parts[k + 1]]
        right[k] = step(row.rights | right[k + 1] & low(row.least_right), depth)
    return [(p, x, y) for p, x, y in zip(parts, left, right, strict=True)]


def with_points(blocks: DataFrame) -> DataFrame:
    """A row for each point at or below the start of a block: its key, that of the point above, and the edge between.

    The start of a block is a point of the block before, so only the root, at the start of the first, has its row here.
    """
    turns = F.floor(F.octet_length("content") / BYTES).cast("int")
    is_point = lambda k: (k == turns) | (k == 0) | (F.call_function("shiftright", F.col("mask"), k).bitwiseAND(F.lit(1)) == 1)
    found = blocks.withColumn("stops", F.filter(F.sequence(F.lit(0), turns), is_point)).withColumn("turns", turns)
    pairs = F.transform(F.col("stops"), lambda k, i: F.struct(F.when(i > 0, F.element_at("stops", F.greatest(i, F.lit(1)))).alias("up"), k.alias("at")))
    rows = found.withColumn("pair", F.explode(pairs)).withColumns({"up": F.col("pair.up"), "at": F.col("pair.at")}).filter("up IS NOT NULL OR block = 0")
    over = F.aggregate(F.slice("chars", F.lit(1), F.coalesce("up", F.lit(0))), F.lit(0).cast("long"), lambda a, c: a + c)
    edge = F.when(F.col("up").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.slice("chars", F.coalesce("up", F.lit(0)) + 1, F.col("at") - F.coalesce("up", F.lit(0))))
    named = dict(zip(KEY, key_of(F.col("at")), strict=True)) | {"up_key": F.when(F.col("up").isNotNull(), F.struct(*(c.alias(k) for k, c in zip(KEY, key_of(F.coalesce("up", F.lit(0))), strict=True))))}
    return rows.withColumns(named | {"edge": edge, "over": F.col("above") + over, "ends_here": F.col("at") == F.col("turns")})


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and the hash of the ascending, comma-joined convs of each point where paths end.

    A hash over a list is one pass over it. Ranges of the sorted rows write their ids as pieces of text; then each point's
    pieces pass through the hash one after another, and no more than a piece is held.
    """
    text = "depth long, k1 long, k2 long, first long, piece binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
            conv = batch.column("conv").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            cuts = [c for a, b in zip(new.tolist(), [*new[1:].tolist(), len(conv)], strict=True) for c in range(a, b, PIECE_IDS)]
            ids = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[cuts, k]) for k in range(3)), pa.array(conv[cuts]), pa.array(ids, pa.binary())], ["depth", "k1", "k2", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        flush = lambda: pa.RecordBatch.from_arrays([*(pa.array([d[0][k] for d in done], pa.int64()) for k in range(3)), pa.array([d[1] for d in done], pa.string())], [*KEY, "ends_sha256"])
        for batch in batches:
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece")), strict=True):
                if key == now:
                    sha.update(b"," + piece)
                    continue
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(piece)
            if len(done) >= 4096:
                yield flush()
                done.clear()
        if now is not None:
            done.append((now, sha.hexdigest()))
            yield flush()

    ordered = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(pieces, text)
    return ordered.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of turns by conv and depth; convs also holds those without a turn."""
    ship(turns.sparkSession)
    blocks = blocks_of(turns, convs)
    masked = stored(sorted_blocks(blocks), "masked-blocks")
    here = lambda c: F.sum(F.when(F.col("ends_here"), F.col(c)))
    points = with_points(masked).groupBy(*KEY).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv_id"), F.coalesce(here("n_ends"), F.lit(0)).alias("n_ends"), F.min(F.when(F.col("ends_here"), F.col("first_end"))).alias("first_end"),
        F.first("up_key").alias("up_key"), F.first("edge").alias("edge"), F.first("over").alias("over"),
    )
    points = stored(points, "points")
    children = points.filter("up_key IS NOT NULL").groupBy("up_key").agg(F.count("*").alias("n_children")).select("up_key.*", "n_children")
    points = points.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = points.filter("n_children > 0").select(F.struct(*KEY).alias("up_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    points = stored(hot_join(points, parents, "up_key", "n_children"), "points-with-parents")
    # the first point of a conversation that is its smallest member tells what it shares with smaller ones
    shares = points.filter("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select(F.col("conv_id").alias("conv"), F.col("over").alias("shares"))
    leaves = points.filter("n_children = 0").select(F.col("first_end").alias("conv"), F.lit(1).cast("long").alias("is_leaf"))
    whole = F.col("above") + F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c)
    told = blocks.filter("last").select("conv", (F.col("block") + 1).alias("n_blocks"), whole.alias("whole")).join(shares, "conv", "left").join(leaves, "conv", "left")
    told = stored(told.select("conv", "n_blocks", F.coalesce("shares", "whole").alias("shares"), F.coalesce("is_leaf", F.lit(0)).alias("is_leaf")), "shares")
    sums = hot_join(blocks, told, "conv", "n_blocks").groupBy("block", "s1", "s2", "content").agg(F.sum("shares").alias("shares"), F.sum("is_leaf").alias("n_leaves"), F.min("conv").alias("least"), F.min_by("shares", "conv").alias("own"))
    at_points = with_points(masked.drop("conv").join(sums, ["block", "s1", "s2", "content"]))
    summed = at_points.groupBy(*KEY).agg(F.sum("shares").alias("shares"), F.sum("n_leaves").alias("n_leaves"), F.min_by("own", "least").alias("own"))
    ends = blocks.filter("last").select(*(c.alias(k) for k, c in zip(KEY, key_of(F.floor(F.octet_length("content") / BYTES).cast("int")), strict=True)), "conv")
    points = points.join(summed, KEY).join(ends_digests(ends), KEY, "left")
    return expanded(points)


def expanded(points: DataFrame) -> DataFrame:
    """All nodes: those inside an edge have the members of the point below, one child, and save the rest of the edge more."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a + c)
    n = F.size("edge")
    rows = points.select("*", F.posexplode("edge").alias("k", "own_chars")).withColumn("bottom", F.col("k") == n - 1)
    above = F.col("over") + total(F.slice("edge", F.lit(1), n - 1))
    rest = total(F.slice("edge", F.col("k") + 1, n - 1 - F.col("k")))
    saved = F.col("shares") - F.col("own") + (F.col("n_convs") - 1) * (rest - above)
    parent = F.when(F.col("k") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    return rows.select(
        "conv_id", (F.col("depth") - (n - 1) + F.col("k")).cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", F.when(F.col("bottom"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves", saved.cast("long").alias("saved_tokens"), F.when(F.col("bottom"), F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, family: int = FAMILY, grafts: int = GRAFTS) -> DataFrame:
    """The trie of the conversations in rows, each started by turns of the first of its family."""
    ship(rows.sparkSession)
    return nodes(*grafted(turns_of(rows), family, grafts))


#: The same in SQL: every prefix is a node, and every node adds to all its prefixes. The checksum goes bit by bit.
TRIE_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS path, list(chars ORDER BY turn NULLS FIRST, digest) AS chars FROM turns GROUP BY conv_id),
taken AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % {GRAFTS} AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(f.path[1:c.h], []), c.path[c.h + 1:]) AS path, list_concat(coalesce(f.chars[1:c.h], []), c.chars[c.h + 1:]) AS chars
  FROM taken AS c LEFT JOIN own AS f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, path, chars, unnest(range(0, len(path) + 1)) AS depth FROM built),
told AS (SELECT conv_id, depth, array_to_string(path[1:depth], '') AS node, coalesce(chars[depth], 0) AS own_chars, len(path) = depth AS ends FROM prefixes),
trie AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(own_chars) AS own_chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM told GROUP BY node, depth),
children AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM trie WHERE depth > 0 GROUP BY 1),
full_trie AS (SELECT t.*, coalesce(c.n_children, 0) AS n_children FROM trie AS t LEFT JOIN children AS c ON c.node = t.node),
up AS (SELECT node, n_convs, own_chars, n_children, unnest(range(0, depth + 1)) AS d FROM full_trie),
sums AS (SELECT substr(node, 1, 32 * d) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own_chars) AS saved_tokens FROM up GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM full_trie AS t JOIN sums AS s ON s.node = t.node LEFT JOIN trie AS p ON t.depth > 0 AND p.depth = t.depth - 1 AND p.node = substr(t.node, 1, 32 * (t.depth - 1))"""
