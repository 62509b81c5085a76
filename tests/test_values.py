"""Rounding, common subsequences, the lexicon, formats and embeddings beside plain versions."""

import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixlens.functions import numbers, rouge, text
from mixlens.functions import vocabulary as V
from mixlens.operators import constraints, providers, rewrite

# ------------------------------------------------------------------ rounding


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.5, 1.5, 2.5, 0.25, 0.125, 0.375, -0.125, -2.675, 0.0, math.nan, math.inf, -math.inf, 1e300, 5e-324, 1e-9, None, 0.00005, -0.00001, 1e11 + 0.00005, 2.0**52, 2.0**53 + 2]
    xs += [rng.uniform(-2, 2) for _ in range(3000)] + [rng.randrange(10**7) / 10**5 for _ in range(6000)] + [(2 * rng.randrange(10**6) + 1) / 2 ** rng.randrange(1, 20) for _ in range(3000)]
    return spark.createDataFrame([(x,) for x in xs], "x double").cache()


@pytest.mark.parametrize("places", [0, 1, 2, 4, 6])
def test_rounding_is_that_of_python(values, places):
    for r in values.select("x", numbers.rounded("x", places).alias("y"), numbers.rounded(F.col("x") + 0, places).alias("z")).collect():
        wanted = r.x if r.x is None or not math.isfinite(r.x) else round(r.x, places)
        assert str(r.y) == str(r.z) == str(wanted), r.x


def test_known_cases(spark):
    df = spark.createDataFrame([(2.675, 1.005)], "a double, b double")
    assert tuple(df.select(numbers.rounded("a", 2), numbers.rounded("b", 2)).first()) == (2.67, 1.0)


# ------------------------------------------------------------------ common subsequences


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = here
    return row[-1]


@pytest.mark.parametrize("together", [0, 1, 3, 24])
def test_common_subsequences(monkeypatch, together):
    """Rows of one word and of several, few pairs and many, empty sides, and arrays that are slices."""
    monkeypatch.setattr(rouge, "TOGETHER", together)
    rng = random.Random(together)
    for _ in range(12):
        words = [f"w{k}" for k in range(rng.choice([2, 5, 40]))]
        pairs = [([rng.choice(words) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))], [rng.choice([*words, "z"]) for _ in range(rng.choice([0, 1, 5, 64, 65, 140]))]) for _ in range(rng.choice([1, 12, 30]))]
        a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1))
        wanted = [plain_lcs(x, y) for x, y in pairs]
        assert rouge.lcs_lengths(a, b).tolist() == wanted == rouge.lcs_lengths(b, a).tolist()
        assert rouge.lcs_lengths(a.slice(1), b.slice(1)).tolist() == wanted[1:]


def test_rouge_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(rouge, "BATCH_BYTES", 40)
    rng = random.Random(3)
    bits = ["The", "the", "cat", "SAT", "é", "x1", "--", "İ", "\n", "don't", "42"]
    texts = [None, "", " ", "...", "a"] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(90))) for _ in range(60)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", rouge.rouge_l(F.col("a"), F.col("b")).alias("f")).collect()
    cut = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    for r in rows:
        one, two = cut(r.a), cut(r.b)
        common = plain_lcs(one, two)
        assert r.f == (0.0 if not common else pytest.approx(2 * common / (len(one) + len(two)), rel=1e-12))


# ------------------------------------------------------------------ lexicon


def test_one_pass_is_the_cascade(spark):
    rng = random.Random(3)
    words = [a for a, _ in V.LEXICON] + [b for _, b in V.LEXICON] + ["the", "ini", "É"]
    changes = [str, str, str, str.upper, str.title, lambda w: w.replace("k", "K").replace("s", "ſ"), lambda w: w.replace("i", "İ"), lambda w: w.replace("i", "ı"), lambda w: w + "_", lambda w: w + "é", lambda w: w + "́", lambda w: w + "‍"]
    ends = [" ", ",", ". ", "\n", "-", "́", "‍", "!!", "\U0001f600", " ", ":", "_"]
    texts = ["".join(rng.choice(changes)(rng.choice(words)) + rng.choice(ends) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", None, " ", "dengan"]
    rows, t = spark.createDataFrame(list(enumerate(texts)), "k long, t string"), F.col("t")
    drawn = rewrite.draws(F.col("k"), 7, 0.45, len(V.LEXICON))
    for accepted in (None, drawn, [(True, False, x)[k % 3] for k, x in enumerate(drawn)], [False] * len(drawn)):
        both = rows.select(rewrite.lexicon_rewrite(t, accepted).alias("x"), rewrite.cascade(t, accepted, V.LEXICON).alias("y"))
        assert both.filter(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


def test_chains_loops_and_repeated_entries(spark):
    lexicon = [("a", "b"), ("b", "c"), ("a", "d"), ("c", "a"), ("c", "e"), ("d", "B"), ("b", "f")]
    rng = random.Random(1)
    rows, t = spark.createDataFrame([(k, " ".join(rng.choice("abcdBCA") for _ in range(6))) for k in range(400)], "k long, t string"), F.col("t")
    drawn = rewrite.draws(F.col("k"), 1, 0.5, len(lexicon))
    for accepted, entries in ((drawn, lexicon), (None, lexicon), (None, [("a b", "x$y"), ("c.", "z\\")]), (None, [])):
        both = rows.select(rewrite.lexicon_rewrite(t, accepted, entries).alias("x"), rewrite.cascade(t, accepted, entries).alias("y"))
        assert both.filter(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


# ------------------------------------------------------------------ formats


def test_own_pattern_decides(spark):
    texts = ["1. a\n2. b", "- a", "x\n- a", "| a | b |", '{"a": 1}', "[1, 2", "see {", '```json\n{"a": [1]}\n```', "NaN", '"s"', "nothing", "answer\nend"]
    kinds = ["json", "numbered_list", "bullet_list", "table", "other"]
    own = [None, "", r"^- ", r"answer.*end", r"a.b", r"\d+\."] + [p for _, p in V.FORMATS.values()]
    flags = {"json": re.DOTALL, "numbered_list": re.MULTILINE, "bullet_list": re.MULTILINE}

    def parses(t):
        t = t.strip()
        fence = re.search(r"```(?:json)?\s*([\s\S]*?)```", t)
        try:
            json.loads(fence.group(1).strip() if fence else t)
            return True
        except ValueError:
            return False

    def plain(t, kind, pattern):
        pattern = pattern or (V.FORMATS[kind][1] if kind in V.FORMATS else "")
        found = bool(pattern) and bool(re.search(pattern, t, flags.get(kind, 0)))
        return found or kind == "json" and parses(t)

    rows = [(t, k, p) for t in texts for k in kinds for p in own]
    for r in spark.createDataFrame(rows, "t string, k string, p string").select("*", constraints.check_format(F.col("t"), F.col("k"), F.col("p")).alias("passed")).collect():
        assert r.passed == plain(r.t, r.k, r.p), r


def test_json_with_more_behind_it(spark):
    values = ["12", "-1.5e3", '"s"', "null", "[1, 2]", '{"a": [1]}', "[]", "{}", "01", "+1", "[1,]", '"a\nb"', ""]
    behind = ["", " ", " Anouor onble", ", 1", ', "b": 2', " ]", "]", " }", "}", "] [", "} {", "], [1", '}, {"": 1', ",", ":", " 2", "\n{}", " //", '"']
    texts = [v + b for v in values for b in behind] + [f"```json\n{v}{b}\n```" for v in values for b in behind]

    def parses(t):
        t = t.strip()
        fence = re.search(r"```(?:json)?\s*([\s\S]*?)```", t)
        try:
            json.loads(fence.group(1).strip() if fence else t)
            return True
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.parses_as_json(F.col("t")).alias("ok")).collect()
    assert [(r.t, r.ok) for r in got] == [(t, parses(t)) for t in texts]


# ------------------------------------------------------------------ embeddings


class Counting(providers.HashEmbedder):
    asked: list = []

    def embed_batch(self, texts):
        Counting.asked.append(list(texts))
        return super().embed_batch(texts)


def test_embeddings_by_batches_with_kept_references():
    Counting.asked = []
    rng = random.Random(1)
    golds = [" ".join(f"g{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    frames = [([rng.choice(golds) for _ in range(100)], [" ".join(f"g{rng.randrange(9)}" for _ in range(rng.randrange(0, 30))) for _ in range(100)]) for _ in range(5)]
    plain = providers.HashEmbedder()
    for bound in (10**9, 0):
        Counting.asked = []
        found = providers.Embeddings(Counting(), 64, bound)
        for references, others in frames:
            wanted = [providers.greedy_f1(plain.embed(a), plain.embed(b)) for a, b in zip(references, others, strict=True)]
            assert found.scores(references, others) == wanted
        texts = [t for batch in Counting.asked for t in batch]
        assert len(Counting.asked) < 30 and all(len(b) <= 64 and b == sorted(b, key=len) for b in Counting.asked)  # 1000 calls one by one
        if bound:
            assert sum(t in set(golds) for t in texts) <= 20 + 5  # a reference is asked for once
        else:
            assert not found.known and found.numbers == 0


def test_embedding_column(spark):
    rows = spark.createDataFrame([("a b c", "c b a"), (None, "a"), ("a", None), ("", "")] * 30, "x string, y string")
    plain = providers.HashEmbedder()
    for r in providers.embedding_f1(rows, providers.HashEmbedder, "x", "y", batch=3).collect():
        assert r.bert_f1 == pytest.approx(providers.greedy_f1(plain.embed(r.x or ""), plain.embed(r.y or "")))
