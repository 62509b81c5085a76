"""Conversation trie, token counts and vector codes against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mixlens.llm import common, queries, token_counts, tries, vector_codes

BPE = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def with_more(df, names):
    """The rows with more columns, named as the operators name theirs."""
    return df.withColumns({c: F.lit("own") for c in names.split()})


# ------------------------------------------------------------------ op 11


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], (r, x)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - int(math.fmod(c, 100)), [])[:h] + path[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
    ids = lambda n: ",".join(map(str, sorted(ends.get(n, []))))
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ids(n).encode()).hexdigest()) for n, m in members.items()]


def same_trie(df):
    key = lambda r: [(x is not None, x) for x in r]
    found = tries.conversation_trie(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got, wanted = sorted((tuple(r) for r in found.collect()), key=key), sorted(plain_trie(rows), key=key)
    assert got == wanted
    return got


def made_turns(rng, n, longest, ids, texts):
    out = []
    for _ in range(n):
        c = rng.choice(ids)
        out += [(c, rng.choice([t, t, t, None]), rng.choice([None, "", "user"]), texts(t)) for t in range(rng.choice([1, 2, 5, longest]))]
    return out


def test_trie_of_short_conversations(spark):
    rng = random.Random(1)
    rows = made_turns(rng, 150, 9, range(400), lambda t: rng.choice([None, "", "a", "bé", "x"]))
    assert len(same_trie(with_more(spark.createDataFrame(rows, TURNS), "conv depth digest chars place part n key k1 k2 block content"))) > 100


def test_trie_of_long_conversations_over_many_ranges(spark, monkeypatch):
    """Paths of many blocks that part late, ranges of a few blocks, and runs of two blocks."""
    monkeypatch.setattr(tries, "RUN", 2)
    monkeypatch.setattr(tries, "ROWS_A_PART", 5)
    monkeypatch.setattr(tries, "PIECE_IDS", 2)
    rng = random.Random(5)
    rows = made_turns(rng, 50, 300, [*range(-5, 20), 100, 101, 107, 205], lambda t: "x" * (t % 3) if rng.random() > 0.005 else "other")
    rows += [(k, t, "user", f"same {t}") for k in range(1000, 1040) for t in range(40)]
    assert max(r[1] for r in same_trie(spark.createDataFrame(rows, TURNS))) >= 300


def test_trie_of_one_conversation_that_spans_partitions(spark):
    rows = [(7, t, "user", str(t % 3)) for t in range(4000)] + [(c, t, "user", "hi") for c in (8, 9, 100) for t in range(3)]
    assert same_trie(spark.createDataFrame(rows, TURNS).repartition(4))


def test_trie_odd(spark):
    assert same_trie(spark.createDataFrame([], TURNS)) == []
    # 105 takes turns of 100, which is absent, and keeps none or all of its own
    rows = [(None, 1, "a", "b"), (7, None, None, None), (5, 1, "a", "b"), (5, 1, "a", "b"), (5, 1, "a", "c"), (105, 1, "a", "long " * 50_000), (3, 2, "", "x"), (4, 2, None, "x")]
    same_trie(spark.createDataFrame(rows, TURNS))


def test_trie_beside_its_sql(spark, data):
    from compare import of_spark, of_sql

    assert of_spark(queries.QUERIES["op11_conversation_trie"](spark, data)) == of_sql(queries.ORACLES["op11_conversation_trie"], data)


# ------------------------------------------------------------------ op 12


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_counts_of_a_table(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op12_token_counts"](spark, data).collect()}
    tokens = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert got == {k: (len(t.encode()), tokens[k], tokens[k] > 1024) for k, t in texts.items()}


def test_counts_of_odd_texts(counter, library):
    rng = random.Random(1)
    bits = ["a", "e", "t", " ", " ", "\n", "\t", "'s", "'", "é", "ß", "中", "文", "١", "😀", "́", "\xa0", "　", "\x1c", "\x85", "1", "99", "!!", "<|endoftext|>", "<|endof", "_", "՘", "\U000323b0", " the", "ing", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["", " ", "a" * 5000, "ab" * 3001, " " * 3000, "x" * token_counts.LONG, "x" * (token_counts.LONG + 1), "".join(rng.choice("etaoin") for _ in range(600)), "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))]
    assert counter(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter([None]) == [0]


def test_counts_do_not_depend_on_cuts(counter, monkeypatch):
    text = "The quick  brown\n fox, it's 12 o'clock <|endoftext|> and\tso on. " * 50
    whole = counter([text])
    counter.known.clear()
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "MERGED_BYTES", 5)
    monkeypatch.setattr(token_counts, "KNOWN", 3)
    assert counter([text, "", text]) == [whole[0], 0, whole[0]]


def test_long_and_short_pieces_merge_alike(counter):
    rng = random.Random(2)
    for _ in range(300):
        data = np.array([rng.choice(b"aeiou nrst") for _ in range(rng.randrange(1, 60))], np.uint8)
        assert counter.merges.long_count(data) == counter.merges.counts(data, np.array([len(data)]))[0]


def test_text_without_blanks_takes_no_quadratic_time(counter):
    import time

    rng = random.Random(3)
    began = time.process_time()
    assert counter(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500_000))])[0] > 100_000
    assert time.process_time() - began < 20


def test_counts_odd(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "w " * 3000)], "doc_id long, text string")
    got = token_counts.count_tokens(with_more(docs, "n_bytes known parts total"), BPE)
    assert got.columns == ["doc_id", "text", "known", "parts", "total", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect())
    assert rows == [(0, 0, 0, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 6000, 3001, True)]
    assert token_counts.count_tokens(docs.limit(0), BPE).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


# ------------------------------------------------------------------ op 13


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(v, [math.floor(256 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e) and e and len(e) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = lambda e: [tuple(e[p * size : (p + 1) * size]) for p in range(parts)]
    books = [[cut(e)[p] for _, e, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda piece, book: min(range(len(book)), key=lambda k: (far(piece, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, e, _ in kept:
                groups[near(cut(e)[p], books[p])].append(cut(e)[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if groups[k] else old for k, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    told = []
    for v, e, label in kept:
        at = [near(piece, books[p]) for p, piece in enumerate(cut(e))]
        told.append((v, "".join(f"{k:02x}" for k in at), sum(far(piece, books[p][k]) for p, (piece, k) in enumerate(zip(cut(e), at, strict=True))), label))
    return [(v, code, error, sum(t[2] for t in told if t[3] == label), digest) for v, code, error, label in told]


def same_codes(df):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got, wanted = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=key), sorted(plain_codes(rows), key=key)
    assert got == wanted
    return got


def test_codes_beside_their_sql(spark, data):
    from compare import of_spark, of_sql

    assert of_spark(queries.QUERIES["op13_vector_codes"](spark, data)) == of_sql(queries.ORACLES["op13_vector_codes"], data)


def test_codes_odd(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(3, rows[3][1], 1), (4, rows[9][1], None), (None, rows[5][1], None), (200, None, 1), (201, [None] * 32, 1), (202, [math.nan] * 32, 1), (203, [math.inf] + [0.0] * 31, 1), (204, [], 1), (205, [1.0] * 16, 2), (206, [1.0] * 15, 2)]
    assert len(same_codes(with_more(spark.createDataFrame(rows, VECTORS), "code error part entry n sums left hot cold label_error"))) == 153
    assert len(same_codes(spark.createDataFrame([(9, [0.5] * 16, None)] * 3, VECTORS))) == 3
    assert same_codes(spark.createDataFrame([], VECTORS)) == []
    assert same_codes(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], VECTORS)) == []


def test_filter_gives_the_nearest_entries():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, d, k, reach = int(rng.integers(1, 300)), int(rng.integers(1, 5)), int(rng.integers(1, 20)), int(rng.choice([2, 5, 50, 1000]))
        points, entries = rng.integers(-reach, reach, (n, d)), rng.integers(-reach, reach, (k, d))
        wanted = vector_codes.nearest(points, entries)
        assert (vector_codes.block_codes(points, entries) == wanted).all()
        sums, counts = vector_codes.block_sums(points, entries)
        plain = np.zeros_like(entries)
        np.add.at(plain, wanted, points)
        assert (sums == plain).all()
        assert (counts == np.bincount(wanted, minlength=k)).all()


def test_whole_nodes_are_taken():
    """Points in tight groups go to their entries without a distance for each."""
    rng = np.random.default_rng(4)
    entries = np.array([[0, 0], [1000, 0], [0, 1000]])
    points = entries[rng.integers(0, 3, 5000)] + rng.integers(-9, 9, (5000, 2))
    whole = []
    vector_codes.filtered(points, entries, lambda to, places, sums: whole.append((places[:, 1] - places[:, 0]).sum()) if sums is not None else None)
    assert sum(whole) > 4900


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)] + [(None, k) for k in range(100, 130)], "key int, v int")
    side = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    got = common.hot_join(rows, side.filter("key IS NULL OR key <> 95"), "key", "n").collect()
    totals = {r.key: r.total for r in side.collect()}
    assert len(got) == 130
    assert all(r.total == (None if r.key == 95 else totals[r.key]) for r in got)
