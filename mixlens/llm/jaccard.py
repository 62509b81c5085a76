"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct shingles. Documents with the same set are one. Shingles are ordered
rare first, by a count-min sketch over all documents; sets that reach the wanted similarity share a shingle in their
prefixes. Sets of one size with the same prefix, and the same shingles for a stretch behind it, form a group.

1. Each group pairs its sets with one of them. Each prefix shingle names two pivots among its groups of about one size:
   that whose prefix has the most frequent shingles, as a text in the middle of many copies has, and one by a hash. A
   group pairs with the pivot that most of its shingles name. Pairs are verified on whole sets; links make components.
2. A set that a pivot is near to, linked or not, belongs to the family of one such pivot. Sets of a family are indexed by
   their differences from the pivot alone: two sets with differences of sizes c and d link only if they share at least
   (c + d - t) / 2 of these, t being the largest difference of two linked sets. So the rare differences in front find
   all links in a family without pairing it.
3. Of the rest, only pairs of groups of different families that share a prefix shingle, pass the size, position and
   signature filters and lie in different components can change the result. Those are expanded to their sets.

So copies that link to a pivot, and families that lie just below the limit, cost pairs in proportion to their number, and
no link between components is lost. Sets of so few shingles that only an equal one is similar enough take no part.

Null text, and text without a word, has an empty set and is linked with nothing. Text with fewer words than a shingle is
one shingle. Documents with the same doc_id are told apart by their sets; a null doc_id is never the smallest unless all
are null. No documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import Bitmap, drop_stored, release, ship, small, stored, trim, unused
from mixlens.llm.components import components
from mixlens.llm.hashing import batches_of, hashed_words, mixed, window_hashes

WIDTH = 3
PERCENT = 90
#: 64-bit words of a prefix's signature, in which each shingle sets a bit.
SIGNATURE = 8
MARKS = [f"s{k}" for k in range(SIGNATURE)]
#: The signature covers this many times the prefix: what a pair does not share is rare, and so lies in front.
STRETCH = 4
#: A set is of a pivot's family if it differs from it by at most so many times the difference of a link.
FAMILY = 3
#: Rows of the sketch, and bounds of the binary logarithm of a row's cells, which grow with the input's bytes.
ROWS = 2
LEAST_BITS, MOST_BITS, BYTES_A_CELL = 18, 22, 2048
_CHUNK = 1 << 14
#: A token is the logarithm of its count in this many bits, then a part of its hash.
_RANK = 56
_LOW = np.uint64((1 << _RANK) - 1)
_SIGN = np.uint64(1 << 63)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, in order, end to end, and the place of each text's first one."""
    hashes, first = hashed_words(texts, lower=True)
    words = np.diff(first)
    windows = window_hashes(hashes, width)
    sizes = np.where(words >= width, words - width + 1, words > 0)
    ends = np.cumsum(sizes)
    found = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for a, n, w, b in zip(first.tolist(), sizes.tolist(), words.tolist(), (ends - sizes).tolist(), strict=False):
        if w >= width:
            found[b : b + n] = np.sort(windows[a : a + n])
        elif w:
            found[b] = mixed(window_hashes(hashes[a : a + w], w) + np.uint64(w))[0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(sizes)))])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run, modulo 2**64; of an empty one 0."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _fingerprints(found: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [_sums(mixed(found + np.uint64(k)), first).view(np.int64) for k in (1, 2)]


def smallest(percent: int) -> int:
    """Size of the smallest set that can be similar enough to another one: percent of one shingle more."""
    return -(-percent // (100 - percent))


def sketch_bits(docs: DataFrame) -> int:
    """Binary logarithm of a row's cells, from the bytes that Spark takes the input to have."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BYTES_A_CELL)))))


def _cell(found: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((found >> np.uint64(64 - bits * (row + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sketcher(width: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros((ROWS, 1 << bits), np.int32)
        for batch in batches_of(batches, "text"):
            found, _ = shingles(batch.column(0), width)
            for row in range(ROWS):
                at, times = np.unique(_cell(found, row, bits), return_counts=True)
                counts[row, at] += times.astype(np.int32)
        pieces = counts.reshape(-1, _CHUNK)
        used = np.flatnonzero(pieces.any(axis=1))
        for k in used:
            kind = "<u1" if pieces[k].max() < 256 else "<i8"  # told apart by their length
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pieces[k].astype(kind).tobytes()])], ["place", "counts"])

    return run


def _ranker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each place, as logarithms: eight steps for each doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(counts.as_buffer(), "<u1" if len(counts.as_buffer()) == _CHUNK else "<i8").astype(np.int64)
            sums[place] = sums[place] + more if place in sums else more
    for place, counts in sums.items():
        ranks = np.minimum(255, np.floor(8 * np.log2(counts + 1.0))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([ranks.tobytes()]), pa.array([int(counts.sum())])], ["place", "ranks", "n"])


def shingle_ranks(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """For each cell of each row the logarithm of its count, and the largest rank of a rare shingle.

    The driver gets a byte for each cell, 8 MB at most. A rare shingle has at most 4,096 or 16 times as many documents as
    a mean cell has entries: this bounds the rows of its key.
    """
    bits = sketch_bits(docs)
    parts = docs.select("text").mapInArrow(_sketcher(width, bits), "place long, counts binary")
    rows = parts.repartition("place").mapInArrow(_ranker, "place long, ranks binary, n long").collect()
    ranks = np.zeros((ROWS << bits) // _CHUNK * _CHUNK, np.uint8)
    for row in rows:
        ranks[row.place * _CHUNK : (row.place + 1) * _CHUNK] = np.frombuffer(row.ranks, np.uint8)
    mean = sum(r.n for r in rows) / (ROWS << bits)
    return ranks.reshape(ROWS, 1 << bits), min(255, int(8 * math.log2(max(4096, 16 * mean))))


SETS = "doc_id {id}, row long, n_shingles long, weight int, p long, q long, front_p long, front_q long, prefix array<long>, last long, far long, " + ", ".join(f"{c} long" for c in MARKS)


def _setter(shared, width: int, percent: int) -> Callable:  # noqa: ANN001  a broadcast of the ranks
    """Size, weight, two fingerprints of the set, two of the front part, the prefix, rare shingles first, its last one, the last of the front part and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ranks = shared.value
        bits = ranks.shape[1].bit_length() - 1
        for batch in batches_of(batches, "text"):
            found, first = shingles(batch.column("text"), width)
            n = np.diff(first)
            rank = np.minimum.reduce([ranks[row][_cell(found, row, bits)] for row in range(ROWS)])
            keys = (rank.astype(np.uint64) << np.uint64(_RANK)) | (found & _LOW)
            large = n >= smallest(percent)
            size = np.where(large, n + (-n * percent) // 100 + 1, 0)
            front = np.minimum(n, STRETCH * size)
            picked = []
            for a, m, k in zip(first.tolist(), n.tolist(), front.tolist(), strict=False):
                if k:
                    part = keys[a : a + m]
                    picked.append(np.sort(np.partition(part, k - 1)[:k] if k < m else part))
            fronts = np.concatenate([np.empty(0, np.uint64), *picked])
            at = np.concatenate([[0], np.cumsum(front)])
            owner = np.repeat(np.arange(len(n)), front)
            inside = np.arange(len(fronts)) - at[owner] < size[owner]
            bit = mixed(fronts) % np.uint64(64 * SIGNATURE)
            marks = np.zeros(len(n) * SIGNATURE, np.uint64)
            np.bitwise_or.at(marks, owner * SIGNATURE + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            ends = []
            for behind in (size, front):  # signed numbers in the order of the keys
                value = np.zeros(len(n), np.uint64)
                value[large] = fronts[(at[:-1] + behind - 1)[large]] ^ _SIGN
                ends.append(value.view(np.int64))
            # mean rank of the prefix
            weight = (_sums((fronts >> np.uint64(_RANK)) * inside, at) // np.maximum(size, 1).astype(np.uint64)).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(fronts[inside].view(np.int64)))
            columns = [n, weight, *_fingerprints(found, first), *_fingerprints(fronts, at), prefixes, *ends, *marks.reshape(-1, SIGNATURE).T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *map(pa.array, columns)], [c.split()[0] for c in SETS.split(", ")])
        trim()

    return run


def row_of(text: Column) -> Column:
    """What tells texts under one doc_id apart."""
    return F.xxhash64(text)


def document_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, int]:
    """For each document its doc_id, row, set size, fingerprints, prefix and signature; stored. With it the largest rank of a rare shingle."""
    spark = docs.sparkSession
    ship(spark)
    ranks, rare = shingle_ranks(docs, width)
    shared = spark.sparkContext.broadcast(ranks)
    texts = docs.select("doc_id", row_of(F.col("text")).alias("row"), "text")
    return stored(texts.mapInArrow(_setter(shared, width, percent), SETS.format(id=docs.schema["doc_id"].dataType.simpleString())), "sets"), rare


def _unpacked(place: Column) -> tuple[Column, Column]:
    """Size of a set, and the place of a shingle in its prefix, which a posting holds in one number."""
    return F.shiftright(place, 32), place.bitwiseAND(F.lit((1 << 32) - 1))


def _pair_filter(one: Callable[[str], Column], two: Callable[[str], Column], percent: int) -> Column:
    """Whether two sets can be similar enough, from the places of a common shingle and their sizes.

    The overlap must reach percent / (100 + percent) of both sizes together; it is at most what follows the shingle in
    either set, if that is their first in common.
    """
    n1, n2 = one("n"), two("n")
    rest = F.least(n1 - one("at"), n2 - two("at"))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (rest * (100 + percent) >= percent * (n1 + n2))


def _signature_filter(one: Callable[[str], Column], two: Callable[[str], Column], percent: int, times: int = 1) -> Column:
    """Whether two sets can differ by at most so many times the difference of a link, from their signatures.

    The front part that ends first is known to both: its shingles that the other front part lacks are not in the other
    set, and bits that only its signature has count some of them.
    """

    def alone(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        total = F.lit(0)
        for c in MARKS:
            total = total + F.bit_count(x(c).bitwiseAND(F.bitwise_not(y(c))))
        return total

    both = one("n") + two("n")
    most = F.when(one("far") <= two("far"), one("n") - alone(one, two)).otherwise(two("n") - alone(two, one))
    return (both - 2 * most) * (100 + percent) <= times * (100 - percent) * both


CHECKED = "a long, b long, linked boolean, differ long, n long, differences array<long>"


def _verifier(width: int, percent: int) -> Callable:
    """Whether a and b link, how many shingles only one of them has, and which these are if few; from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches_of(batches, "text_a", rows=256):
            linked, differ, size, listed = [], [], [], []
            (one, at), (two, to) = (shingles(batch.column(c), width) for c in ("text_a", "text_b"))
            for k in range(batch.num_rows):
                x, y = one[at[k] : at[k + 1]], two[to[k] : to[k + 1]]
                mine = ~np.isin(x, y, assume_unique=True, kind="sort")
                both = len(x) - int(mine.sum())
                d = len(x) + len(y) - 2 * both
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                differ.append(d)
                size.append(len(x))
                near = d * (100 + percent) <= FAMILY * (100 - percent) * (len(x) + len(y))
                listed.append(np.concatenate([x[mine], y[~np.isin(y, x, assume_unique=True, kind="sort")]]).view(np.int64).tolist() if near else None)
            columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(differ, pa.int64()), pa.array(size, pa.int64()), pa.array(listed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHECKED.split(", ")])
        trim()

    return run


class WholeTexts:
    """Texts of the sets asked for so far, kept as tables; shuffled text takes half the bytes of the set's hashes."""

    def __init__(self, docs: DataFrame, members: DataFrame, width: int, percent: int) -> None:
        self.docs = docs.select("doc_id", row_of(F.col("text")).alias("row"), "text")
        self.members, self.width, self.percent = members, width, percent
        self.known: list[DataFrame] = []

    def _all(self) -> DataFrame:
        every = self.known[0]
        for k in self.known[1:]:
            every = every.unionByName(k)
        return every

    def fetch(self, pairs: DataFrame) -> None:
        asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        if self.known:
            asked = asked.join(self._all().select("id"), "id", "left_anti")
        needed = stored(self.members.join(asked, "id").select("id", F.col("doc_id").alias("_doc"), F.col("row").alias("_row")), "needed")
        if count := needed.count():
            possible = Bitmap(needed, ["_row"], count).marked(self.docs, ["row"], "_maybe").filter("_maybe")
            made = stored(possible.join(small(needed, count), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))).select("id", "text"), "whole-texts")
            if made.count() > count:  # repeated rows
                every, made = made, stored(made.dropDuplicates(["id"]), "whole-texts")
                drop_stored(every)
            self.known.append(made)
        drop_stored(needed)

    def checked(self, pairs: DataFrame) -> DataFrame:
        """What _verifier tells of pairs (a, b) of sets; stored."""
        pairs = stored(pairs, "pairs")
        self.fetch(pairs)
        if not self.known:
            return pairs.sparkSession.createDataFrame([], CHECKED)
        count = pairs.count()
        one = self._all().select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        two = Bitmap(pairs, ["b"], count).marked(self._all(), ["id"], "asked").filter("asked").select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = one.join(small(pairs, count), "a").join(two, "b").select("a", "b", "text_a", "text_b")
        found = stored(both.mapInArrow(_verifier(self.width, self.percent), CHECKED), "checked-pairs")
        drop_stored(pairs)
        return found


def _repeated(percent: int) -> Callable:
    """The rows whose token another row of about the same size has; rows come in order of the token, then of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last = False  # whether the held row is kept for one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
            tokens, sizes = whole.column("token").to_numpy(), whole.column("place").to_numpy() >> 32
            near = (tokens[1:] == tokens[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
            keep = np.zeros(len(tokens), bool)
            keep[1:] |= near
            keep[:-1] |= near
            keep[0] |= last
            last = bool(keep[-1])
            held = whole.slice(len(tokens) - 1)
            yield whole.slice(0, len(tokens) - 1).filter(pa.array(keep[:-1]))
        if held is not None and last:
            yield held

    return run


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, row and set (p, q, n_shingles) of each document; and of each distinct set its root, one value for a component. Both stored."""
    sets, rare = document_sets(docs, width, percent)
    # a third of all rows may be one set: summed before the shuffle
    same = ["front_p", "front_q", "prefix", "last", "far", *MARKS]
    # the least id has the largest weight; of the number there are 55 bits, which serve 4 million tasks
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 55) - 1)).bitwiseOR(F.call_function("shiftleft", (F.lit(255) - F.col("weight")).cast("long"), F.lit(55)))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("one")
    distinct = sets.filter("n_shingles > 0").groupBy("p", "q", "n_shingles").agg(one, F.first("weight").alias("weight"), *(F.first(c).alias(c) for c in same))
    ids = stored(distinct.select("p", "q", "n_shingles", "one.doc_id", "one.row", *same, number.alias("id")), "set-ids")
    wide, sets = sets, stored(sets.select("doc_id", "row", "n_shingles", "p", "q"), "document-sets")
    drop_stored(wide)
    large = ids.filter(F.col("n_shingles") >= smallest(percent))
    key = ["front_p", "front_q", "n_shingles"]
    groups = large.groupBy(*key).agg(F.min("id").alias("group"), F.count("*").alias("size"))
    members = stored(large.select("id", "doc_id", "row", *key).join(groups, key).select("id", "group", "size", "doc_id", "row"), "group-members")
    # the least set stands for its group
    heads = large.join(members.filter("id <> group").select("id"), "id", "left_anti").withColumnsRenamed({"id": "group", "n_shingles": "n"})
    size = F.call_function("shiftleft", F.col("n").cast("long"), F.lit(32))
    postings = heads.select("group", size.alias("size"), F.posexplode("prefix").alias("at", "token")).select("group", F.col("size").bitwiseOR(F.col("at").cast("long")).alias("place"), "token")
    rank = F.shiftrightunsigned("token", _RANK)
    few = postings.filter(rank <= rare).repartition("token").sortWithinPartitions("token", "place").mapInArrow(_repeated(percent), postings.schema)
    shared = stored(few.unionByName(postings.filter(rank > rare)), "shared-postings")

    signed = stored(heads.select("group", "n", "far", *MARKS), "signatures")
    wide, ids = ids, stored(ids.select("p", "q", "n_shingles", "id"), "set-ids")
    drop_stored(wide)

    texts = WholeTexts(docs, members, width, percent)
    inner = members.filter("id <> group").select(F.col("id").alias("a"), F.col("group").alias("b"))
    # 1: pairs with pivots
    x, y = (signed.toDF(*(f"{c}_{k}" for c in signed.columns)) for k in (1, 2))
    of_1, of_2 = (lambda c: F.col(f"{c}_1")), (lambda c: F.col(f"{c}_2"))
    named = _pivot_pairs(shared, percent)
    named = named.join(x, named["a"] == x["group_1"]).join(y, named["b"] == y["group_2"]).filter(_signature_filter(of_1, of_2, percent, FAMILY)).select("a", "b")
    first = texts.checked(inner.unionByName(named))
    star = components(_links(first), "components")
    rooted = stored(members.join(star, members["id"] == star["vertex"], "left").select("id", "group", "size", F.coalesce("root", "id").alias("root")), "roots")

    # 2 and 3: what is left across components, in families and between them
    family = stored(_families(first, members), "families")
    near = stored(_family_rows(family, rooted, percent), "family-rows")
    x, y = (near.select("pivot", "token", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "n", "d", "at"))) for k in (1, 2))
    needed = (100 + percent) * (F.col("d_1") + F.col("d_2")) - (100 - percent) * (F.col("n_1") + F.col("n_2"))
    rest = F.least(F.col("d_1") - F.col("at_1"), F.col("d_2") - F.col("at_2"))
    alike = 100 * F.least("n_1", "n_2") >= percent * F.greatest("n_1", "n_2")
    within = x.join(y, ["pivot", "token"]).filter((F.col("root_1") < F.col("root_2")) & alike & (2 * (100 + percent) * rest >= needed))
    within = within.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).distinct()

    left = stored(_open_rows(shared, rooted, family).join(signed.drop("n"), "group"), "open-postings")
    drop_stored(shared)
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("group", "place", "root", "pivot", "far", *MARKS))) for k in (1, 2))
    sizes = [_unpacked(F.col(f"place_{k}")) for k in (1, 2)]
    of_1, of_2 = ((lambda c, k=k: sizes[k - 1][("n", "at").index(c)] if c in ("n", "at") else F.col(f"{c}_{k}")) for k in (1, 2))
    fits = (F.col("root_1") < F.col("root_2")) & (F.col("pivot_1") != F.col("pivot_2")) & _pair_filter(of_1, of_2, percent) & _signature_filter(of_1, of_2, percent)
    across = x.join(y, "token").filter(fits).select("group_1", "root_1", "group_2", "root_2").distinct()
    a, b = (rooted.select(F.col("group").alias(f"group_{k}"), F.col("root").alias(f"root_{k}"), F.col("id").alias(c)) for k, c in ((1, "a"), (2, "b")))
    second = across.join(a, ["group_1", "root_1"]).join(b, ["group_2", "root_2"]).select("a", "b")
    last = texts.checked(within.unionByName(second))
    final = components(_links(last).unionByName(star.select(F.col("vertex").alias("a"), F.col("root").alias("b"))), "components")
    roots = stored(ids.select("p", "q", "n_shingles", "id").join(final, ids["id"] == final["vertex"], "left").select("p", "q", "n_shingles", F.coalesce("root", "id").alias("root")), "set-roots")
    drop_stored(ids, members, signed, rooted, star, final, family, near, left, first, last, *texts.known)
    return sets, roots


def _links(checked: DataFrame) -> DataFrame:
    return checked.filter("linked").select("a", "b")


def _open_rows(shared: DataFrame, rooted: DataFrame, family: DataFrame) -> DataFrame:
    """Postings of shingles whose groups lie in several components and families: a row for each component of a group.

    A set without a family is one by itself, and so are the sets of a component and group of several.
    """
    parts = rooted.groupBy("group", "root").agg(F.min("id").alias("id"), F.max("size").alias("size"))
    # most groups are a set that links with nothing, for which there is nothing to look up
    known = parts.join(family.select("id", "pivot"), "id", "left").filter("size > 1 OR root <> group OR pivot IS NOT NULL")
    known = stored(known.select("group", "root", F.coalesce("pivot", "id").alias("pivot")), "parts")
    spread = shared.join(small(known, known.count()), "group", "left").withColumns({c: F.coalesce(c, F.col("group")) for c in ("root", "pivot")})
    apart = (F.min("root") < F.max("root")) & (F.min("pivot") < F.max("pivot"))
    tokens = spread.groupBy("token").agg(apart.alias("open")).filter("open").select("token")
    return spread.join(tokens, "token")


def _pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (group, pivot) of each group with one pivot of its shingles, of about its size: that which most of them name."""
    size = _unpacked(F.col("place"))[0]
    banded = rows.withColumn("band", F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / percent))))
    drawn = [F.min(F.struct(h.alias("h"), "group", "place")) for h in (F.lit(0).cast("long"), F.xxhash64("group"))]
    pivots = banded.groupBy("token", "band").agg(F.count("*").alias("k"), F.array(*drawn).alias("drawn")).filter("k > 1").select("token", "band", F.explode("drawn").alias("v"))
    one, two = (dict(zip(("n", "at"), _unpacked(F.col(c)), strict=True)) for c in ("place", "v.place"))
    near = _pair_filter(one.get, two.get, percent) & (F.col("group") != F.col("v.group"))
    met = banded.join(pivots, ["token", "band"]).filter(near).groupBy("group", F.col("v.group").alias("pivot")).agg(F.count("*").alias("k"))
    best = met.groupBy("group").agg(F.min(F.struct((-F.col("k")).alias("k"), "pivot")).alias("best"))
    return best.select(F.col("group").alias("a"), F.col("best.pivot").alias("b"))


def _families(checked: DataFrame, members: DataFrame) -> DataFrame:
    """id, pivot, d, n and differences of sets near to a pivot: that of the least hash, so that near sets share it.

    Only groups of one set take part, so that what their families do not hold is compared by groups. A pivot that is not
    of another's family is of its own, without differences.
    """
    alone = members.filter("size = 1").select("id")
    near = checked.filter("differences IS NOT NULL").select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.col("differ").alias("d"), "n", "differences")
    near = near.join(alone, "id").join(alone.select(F.col("id").alias("pivot")), "pivot").withColumn("h", F.xxhash64("pivot"))
    own = near.select("pivot", "h").distinct().select(F.col("pivot").alias("id"), "pivot", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("differences"), "h")
    best = F.min(F.struct("h", "pivot", "d", "n", "differences")).alias("best")
    return near.unionByName(own, allowMissingColumns=True).select("id", "pivot", "d", "n", "differences", "h").groupBy("id").agg(best).select("id", "best.pivot", "best.d", "best.n", "best.differences")


def _family_rows(family: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    """A row for each difference in a set's front part that another set of the family shares, of families in several components.

    Two sets with differences of sizes c and d link only if they share (c + d - t) / 2 of them, t being the greatest
    difference of two linked sets. Differences that few sets of the family have come first.
    """
    placed = family.filter("pivot <> id").join(rooted.select("id", "root"), "id")
    several = placed.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("d").alias("least")).filter("lo < hi")
    # a pivot may have a third of all sets: its family is not gathered for this
    several = stored(several.select("pivot", "least"), "several-families")
    known = small(several, several.count())
    # of a partner, at most 100 / percent times as large, t is at most this and its differences at least d less that
    most = F.col("n") * (100 - percent) / percent
    share = F.greatest(F.lit(1), F.ceil((F.col("d") + F.greatest(F.col("least").cast("double"), F.col("d") - most) - most) / 2 - 1e-6))
    every = placed.join(known, "pivot").select("pivot", "id", "root", "n", "d", (F.col("d") - share + 1).alias("front"), F.explode("differences").alias("token"))
    counts = every.groupBy("pivot", "token").agg(F.count("*").alias("k"))
    order = Window.partitionBy("pivot", "id").orderBy("k", "token")
    ranked = every.join(counts, ["pivot", "token"]).withColumn("at", F.row_number().over(order) - 1)
    return ranked.filter((F.col("at") < F.col("front")) & (F.col("k") > 1)).drop("front", "k")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    sets, roots = similar_sets(docs, width, percent)
    rows = sets.select("doc_id", "n_shingles", "p", "q")
    linked = rows.filter("n_shingles > 0").join(roots, ["p", "q", "n_shingles"])
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = linked.join(least, "root").select("doc_id", "n_shingles", "component_id")
    result = stored(found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "near-copies")
    drop_stored(sets, roots)
    return result


def one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of docs without near copies: of each component that of the smallest doc_id; rows without a word stay.

    Rows of the same doc_id and text are copies, too. Where a component has no doc_id but null, one row of that stays.
    """
    sets, roots = similar_sets(docs, width, percent)
    rows = sets.filter("n_shingles > 0").select("doc_id", "row", "p", "q", "n_shingles").join(roots, ["p", "q", "n_shingles"]).withColumn("null", F.col("doc_id").isNull())
    # ties of the doc_id, that is other texts under it in one component, fall to the least hash of the text
    first = F.min(F.struct("null", "doc_id", "row")).alias("first")
    kept = rows.groupBy("root").agg(first).select("root", "first.null", "first.doc_id", "first.row", F.lit(True).alias("kept"))
    judged = rows.join(kept, (rows["root"] == kept["root"]) & rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["row"] == kept["row"]), "left").select(rows["doc_id"], rows["row"], "kept")
    # of a doc_id and text: gone, or kept once though it comes more often
    keys = judged.groupBy("doc_id", "row").agg(F.count("*").alias("times"), F.first("kept").alias("kept")).filter("kept IS NULL OR times > 1")
    found = stored(keys.select("doc_id", "row", F.col("kept").isNull().alias("gone")), "copies")
    drop_stored(sets, roots)
    row, maybe, doc, other, gone = unused(docs, "row", "maybe", "doc", "other", "gone")
    keyed = Bitmap(found, ["row"], found.count()).marked(docs.withColumn(row, row_of(F.col("text"))), [row], maybe)
    named = found.toDF(doc, other, gone)
    met = keyed.filter(maybe).join(named, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(other)), "left")
    clear = keyed.filter(~F.col(maybe)).select(*docs.columns)
    single = met.filter(F.col(gone).isNull()).select(*docs.columns)
    several = met.filter(~F.col(gone)).dropDuplicates(["doc_id", row]).select(*docs.columns)
    return clear.unionByName(single).unionByName(several)
