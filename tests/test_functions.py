import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixlens.functions import text as T
from mixlens.functions.rouge import lcs_length, rouge_l
from mixlens.operators import classify
from mixlens.operators import constraints as C
from mixlens.operators import evaluate as E
from mixlens.operators import providers, rewrite, selection

ODD = ["a b c　d", "\x1cx\x85y ", "", "  ", "one\n two\tthree", " z"]


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_words_and_strip_follow_python(spark):
    assert column(spark, ODD, T.word_count) == [len(t.split()) for t in ODD]
    assert column(spark, ODD, T.strip) == [t.strip() for t in ODD]


def is_json(text):
    bare = text.strip()
    if found := re.search(r"```(?:json)?\s*([\s\S]*?)```", bare):
        bare = found[1].strip()
    try:
        json.loads(bare)
        return True
    except ValueError:
        return bool(re.search(r"\{[\s\S]*\}|\[[\s\S]*\]", text))


def test_json_like(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(["1", "e5", ".2", "-", '"', "\\", "a", "{", "}", "[", "]", "null", "NaN", " ", "\n", "```", "json"]) for _ in range(r.randint(0, 7))) for _ in range(1500)]
    texts += ["12", "NaN", "```json\n12\n```", "{a:1}", '"' + "x" * 60_000 + '"']
    assert column(spark, texts, T.is_json) == [is_json(t) for t in texts]


def test_small_text_functions(spark):
    assert column(spark, ['"hi"', "'a", ' "x" '], T.without_quotes) == ["hi", "'a", "x"]
    assert column(spark, ["a, b,,", " , "], T.split_list) == [["a", "b"], None]
    assert column(spark, ["aaaa", "aXa"], lambda c: T.occurrences(c, F.lit("aa"))) == [2, 0]
    assert column(spark, ["漢字 x", "y" * 300], T.chart_cell) == ["[…] x", "y" * 259 + "…"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_lcs(one, two):
    table = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(one, two) == table[-1][-1] == lcs_length(two, one)


def test_rouge(spark):
    df = spark.createDataFrame([("The cat sat", "the CAT, sat down"), ("", "x"), ("a", None)], "r string, c string")
    got = [x.f for x in df.select(rouge_l(F.col("r"), F.col("c")).alias("f")).collect()]
    assert got == pytest.approx([2 * 0.75 / 1.75, 0.0, 0.0])


def test_checks(spark):
    row = lambda **k: {"constraint_type": None, "requirement": None, "verification_regex": None, "keywords": None, "min_words": None, "max_words": None, "format_id": None} | k
    cases = [
        ("Madrid\nSpanyol", row(constraint_type="keyword", keywords=["madrid", "spanyol"]), True),
        ("Madrid", row(constraint_type="keyword", keywords=["madrid", "spanyol"]), False),
        (" ".join("x" * 10), row(constraint_type="length", min_words=1, max_words=10), True),
        ("intro\n1. x", row(constraint_type="format", format_id="numbered_list"), True),
        ("x 1. y", row(constraint_type="format", format_id="numbered_list"), False),
        ("12", row(constraint_type="format", format_id="json"), True),
        ("a|b", row(constraint_type="format", format_id="table"), False),
        ("a|b|", row(constraint_type="format", format_id="table"), True),
        ("abc", row(constraint_type="format", format_id="own", verification_regex="b."), True),
        ("abc", row(constraint_type="mood"), False),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, r string, c {C.CONSTRAINT}")
    got = [x.ok for x in df.select("k", C.check(F.col("r"), F.col("c"))["passed"].alias("ok")).orderBy("k").collect()]
    assert got == [c[2] for c in cases]
    empty = spark.range(1).select(C.pass_rate(F.array().cast("array<struct<type:string,passed:boolean,details:string>>")).alias("x"))
    assert empty.first().x == 1.0


def test_length_ranges(spark):
    got = spark.createDataFrame([(10,), (4,), (90,)], "n long").select(*C.length_range(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(8, 30), (3, 13), (62, 117)]


def test_targets():
    assert list(classify.targets(750).values()) == [188, 150, 150, 150, 112]


def test_classify_ties_and_patterns(spark):
    texts = ["jika kode", "hitung 3 total", "2 + 2", "import x", "halo"]
    assert column(spark, texts, classify.classify) == ["logical_reasoning", "mathematical_reasoning", "mathematical_reasoning", "coding", "logical_reasoning"]


def test_lexicon_cascades(spark):
    assert column(spark, ["Dengan dia", "mengapa", "sedengan"], rewrite.lexicon_rewrite) == ["sm dia", "knp", "sedengan"]


def test_enforced_lines(spark):
    needs = F.array(F.lit("Jawab dalam 5-9 kata."), F.lit("Gunakan format poin-poin."))
    texts = ["Isi. jwb dlm 5-9 kata deh", "Isi\nGunakan format poin-poin.\nJawab dalam 1-2 kata.", "jwb dlm 3 kata"]
    tail = "\nJawab dalam 5-9 kata.\nGunakan format poin-poin."
    got = column(spark, texts, lambda c: rewrite.enforce_lines(c, needs))
    assert got == ["Isi." + tail, "Isi" + tail, "jwb dlm 3 kata" + tail]
    assert column(spark, got, lambda c: rewrite.enforce_lines(c, needs)) == got


def test_rewriting_is_the_same_for_the_same_key(spark):
    rows = spark.createDataFrame([(k, "Saya tidak tahu. Apa itu? Baik sekali.") for k in range(40)], "k long, t string")
    one = providers.rewrite_levels(rows, "t", "k").orderBy("k").collect()
    assert one == providers.rewrite_levels(rows.repartition(7), "t", "k").orderBy("k").collect()
    assert len({r.level_3_adversarial for r in one}) > 5


def test_provider_rows(spark):
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("429 slow down")

    waits = []
    assert providers.call(Failing(), "x", 3, waits.append)[-1] == "rate_limit" and waits == [5.0, 10.0]
    df = spark.createDataFrame([("a b",), (" ",)], "prompt string")
    got = providers.infer(df, providers.EchoGenerator, retries=1).orderBy("prompt").collect()
    assert [(r.success, r.error_type) for r in got] == [(False, "empty_completion"), (True, None)]


def test_greedy_match():
    e = providers.HashEmbedder()
    assert providers.greedy_f1(e.embed("a b c"), e.embed("c b a")) == pytest.approx(1.0)
    assert providers.greedy_f1(e.embed("a"), e.embed("")) <= 1.0


def test_error_types(spark):
    texts = ["Timed out", "empty completion", "HTTP 429", "rate_limit", "boom"]
    assert column(spark, texts, E.error_type) == [providers.error_kind(t) for t in texts] == ["timeout", "empty_completion", "rate_limit", "rate_limit", "api_error"]


def test_models_and_credentials(spark):
    models = spark.createDataFrame([("a", "x/a")], "name string, model_id string")
    assert {tuple(r) for r in selection.select_models(models, add=["b=x/b", "c"], exclude=["x/a"]).collect()} == {("b", "x/b"), ("c", "c")}
    with pytest.raises(ValueError):
        selection.select_models(models, include=["nope"])
    with pytest.raises(ValueError):
        selection.resolve_credentials({"base_url": "https://o.example.org"}, "https://d.example.com", "k", {})
    assert selection.resolve_credentials({"base_url": "http://localhost:1"}, "https://d.example.com", "k", {})[1] == "local"
    assert math.isclose(len(selection.resolve_credentials({}, "https://d.example.com", "k", {})), 3)
