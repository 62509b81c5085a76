"""All queries of the engine by name, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.functions import numbers as N
from mixlens.functions import text as T
from mixlens.functions import vocabulary as V
from mixlens.functions.rouge import rouge_l
from mixlens.operators import analysis as A
from mixlens.operators import build, classify, providers, rewrite, selection, validation
from mixlens.operators import constraints as C
from mixlens.operators import evaluate as E
from mixlens.plans import adapters as P
from mixlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return N.rounded(c, 6)


s6 = lambda e: P.rounded(e, 6)
s4 = lambda e: P.rounded(e, 4)

# ---------------------------------------------------------------- analysis


@query(f"""WITH {P.NUMERIC}, w AS (SELECT model, {s4("min(combined_score)")} AS worst_level_robustness, {s4("avg(combined_score)")} AS mean_level_score FROM lv GROUP BY model)
SELECT row_number() OVER (ORDER BY worst_level_robustness DESC, first_ord) AS rank, model, worst_level_robustness, mean_level_score FROM w JOIN first USING (model)""")
def wlr_ranking(spark: SparkSession, d: str) -> DataFrame:
    return A.wlr_ranking(P.numeric_rows(spark, d))


@query(f"""WITH {P.SCALE}, w AS (SELECT model, {s4("min(combined_score)")} AS worst_level_robustness, {s4("avg(combined_score)")} AS mean_level_score FROM lv GROUP BY model)
SELECT row_number() OVER (ORDER BY worst_level_robustness DESC, first_ord) AS rank, model, worst_level_robustness, mean_level_score FROM w JOIN first USING (model)""")
def wlr_ranking_scale(spark: SparkSession, d: str) -> DataFrame:
    return A.wlr_ranking(P.scale_rows(spark, d))


@query(f"WITH {P.NUMERIC} SELECT model, level, {s6('constraint_pass_rate')} AS constraint_pass_rate, {s6('semantic_score')} AS semantic_score, {s6('combined_score')} AS combined_score FROM lv")
def level_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.level_scores(P.numeric_rows(spark, d)).select("model", "level", *(r6(m).alias(m) for m in V.METRICS))


@query(f"WITH {P.NUMERIC} SELECT model, metric, level, {s6('baseline')} AS baseline, {s6('perturbed')} AS perturbed, pdr FROM pd")
def pdr_details(spark: SparkSession, d: str) -> DataFrame:
    found = A.pdr_details(A.level_scores(P.numeric_rows(spark, d)))
    return found.withColumns({c: r6(c) for c in ("baseline", "perturbed")})


@query(f"WITH {P.NUMERIC} SELECT model, level, {s6('avg(pdr)')} AS pdr FROM pd GROUP BY model, level")
def pdr_by_level(spark: SparkSession, d: str) -> DataFrame:
    return A.pdr_by_level(A.pdr_details(A.level_scores(P.numeric_rows(spark, d)))).withColumn("pdr", r6("pdr"))


@query(f"WITH {P.NUMERIC} SELECT model, level, {s6('avg(pdr)')} AS pdr FROM pd WHERE metric = 'combined_score' GROUP BY model, level")
def pdr_by_level_composite(spark: SparkSession, d: str) -> DataFrame:
    return A.pdr_by_level(A.pdr_details(A.level_scores(P.numeric_rows(spark, d)), metric="combined_score")).withColumn("pdr", r6("pdr"))


_ROBUST = f"rb AS (SELECT model, {s6('greatest(0, 100 - coalesce(avg(pdr), 0))')} AS robustness_score FROM (SELECT DISTINCT model FROM lv) LEFT JOIN pd USING (model) GROUP BY model)"


@query(f"WITH {P.NUMERIC}, {_ROBUST} SELECT * FROM rb")
def robustness_score(spark: SparkSession, d: str) -> DataFrame:
    levels = A.level_scores(P.numeric_rows(spark, d))
    return A.robustness(levels, A.pdr_details(levels)).withColumn("robustness_score", r6("robustness_score"))


@query(f"WITH {P.NUMERIC}, {_ROBUST} SELECT row_number() OVER (ORDER BY robustness_score DESC, first_ord) AS rank, model, robustness_score FROM rb JOIN first USING (model)")
def pdr_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = P.numeric_rows(spark, d)
    return A.ranked(robustness_score(spark, d), rows, "robustness_score").select("rank", "model", "robustness_score")


@query(f"WITH {P.NUMERIC} SELECT model, level, type, {s6('avg(passed::INT)')} AS compliance FROM x GROUP BY ALL")
def cpr_by_type_level(spark: SparkSession, d: str) -> DataFrame:
    return A.compliance_by_level(P.numeric_rows(spark, d)).withColumn("compliance", r6("compliance"))


@query(f"WITH {P.NUMERIC}, c AS (SELECT model, level, type, avg(passed::INT) AS v FROM x GROUP BY ALL) SELECT model, type, {s4('avg(v)')} AS compliance FROM c GROUP BY ALL")
def cpr_by_type_overall(spark: SparkSession, d: str) -> DataFrame:
    return A.compliance_overall(A.compliance_by_level(P.numeric_rows(spark, d)))


@query(f"WITH {P.NUMERIC}, c AS (SELECT model, level, type, avg(passed::INT) AS v FROM x GROUP BY ALL) SELECT model, type, {P.rounded('avg(v) * 100', 2)} AS percent FROM c GROUP BY ALL")
def constraint_breakdown(spark: SparkSession, d: str) -> DataFrame:
    by_type = A.compliance_by_level(P.numeric_rows(spark, d)).groupBy("model", "type").agg(F.avg("compliance").alias("v"))
    return by_type.select("model", "type", N.rounded(F.col("v") * 100, 2).alias("percent"))


@query(f"""WITH {P.NUMERIC}, w AS (SELECT model, {s4("min(combined_score)")} AS worst_level_robustness, {s4("avg(combined_score)")} AS mean_level_score FROM lv GROUP BY model),
k AS (SELECT row_number() OVER (ORDER BY worst_level_robustness DESC, first_ord) AS rank, model, worst_level_robustness, mean_level_score FROM w JOIN first USING (model)),
b AS (SELECT model, level, printf('%.4f', {s4("avg(pdr)")}) AS drop_ FROM pd GROUP BY ALL)
SELECT rank, model, worst_level_robustness, mean_level_score, string_agg(level || ':' || drop_, ',' ORDER BY level) AS drops FROM k JOIN b USING (model) GROUP BY ALL""")
def robustness_chart(spark: SparkSession, d: str) -> DataFrame:
    rows = P.numeric_rows(spark, d)
    found = A.robustness_chart(A.wlr_ranking(rows), A.pdr_by_level(A.pdr_details(A.level_scores(rows))))
    told = F.transform("drops", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), F.format_string("%.4f", N.rounded(x["pdr"], 4))))
    return found.withColumn("drops", F.array_join(told, ","))


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {P.NUMERIC}, g AS (SELECT DISTINCT model, unnest({list(_EVENT_TYPES)}) AS category FROM n)
SELECT g.model, g.category, {s6('coalesce(avg(composite), 0)')} AS score FROM g LEFT JOIN n USING (model, category) GROUP BY ALL""")
def skill_profile_category(spark: SparkSession, d: str) -> DataFrame:
    return A.category_profile(P.numeric_rows(spark, d), _EVENT_TYPES).withColumn("score", r6("score"))


@query(f"WITH {P.NUMERIC} SELECT model, type, {s6('avg(passed::INT)')} AS score FROM x WHERE type IN ('keyword', 'length') GROUP BY ALL")
def skill_profile_constraint(spark: SparkSession, d: str) -> DataFrame:
    return A.constraint_profile(P.numeric_rows(spark, d)).withColumn("score", r6("score"))


@query(f"""WITH {P.NUMERIC}, g AS (SELECT DISTINCT model, unnest([0, 1, 2, 3]) AS level FROM n)
SELECT g.model, g.level, {s6('coalesce(avg(composite), 0)')} AS score FROM g LEFT JOIN n USING (model, level) GROUP BY ALL""")
def skill_profile_level(spark: SparkSession, d: str) -> DataFrame:
    return A.level_profile(P.numeric_rows(spark, d)).withColumn("score", r6("score"))


@query(f"""WITH {P.NUMERIC}, s AS (SELECT model, category, printf('%.4f', {s4('avg(composite)')}) AS score FROM n GROUP BY ALL)
SELECT model, '{",".join(_EVENT_TYPES)}' AS labels, string_agg(score, ',' ORDER BY category) AS scores FROM s GROUP BY model""")
def radar_arrays(spark: SparkSession, d: str) -> DataFrame:
    found = A.radar(A.category_profile(P.numeric_rows(spark, d), _EVENT_TYPES), _EVENT_TYPES)
    shown = F.transform("values", lambda v: F.format_string("%.4f", N.rounded(v, 4)))
    return found.select("model", F.array_join("labels", ",").alias("labels"), F.array_join(shown, ",").alias("scores"))


@query(f"WITH {P.NUMERIC} SELECT (SELECT count(*) FROM n) AS total_samples, string_agg(model, ',' ORDER BY first_ord) AS models_evaluated FROM first")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(P.numeric_rows(spark, d))


@query(f"WITH {P.NUMERIC} SELECT model, " + ", ".join(f"{s4(f'coalesce(max(constraint_pass_rate) FILTER (level = {k}), 0) * 100')} AS level_{k}" for k in range(4)) + " FROM lv GROUP BY model")
def heatmap_pivot(spark: SparkSession, d: str) -> DataFrame:
    found = A.heatmap(A.level_scores(P.numeric_rows(spark, d)))
    return found.select("model", *(N.rounded(f"level_{k}", 4).alias(f"level_{k}") for k in range(4)))


@query(f"WITH {P.NUMERIC} SELECT model, level, {s4('combined_score * 100')} AS score FROM lv")
def trend_series(spark: SparkSession, d: str) -> DataFrame:
    return A.trend(A.level_scores(P.numeric_rows(spark, d))).withColumn("score", N.rounded("score", 4))


# ---------------------------------------------------------------- checking and scoring


_TERMS = P.sql_candidates("gold") + "[:2]"


@query(f"""WITH {P.TEXT}, t AS (SELECT doc_id, lower(response) AS response, {_TERMS} AS terms FROM e)
SELECT doc_id, array_to_string(terms, ',') AS terms, array_to_string(list_filter(terms, lambda w: contains(response, w)), ',') AS found,
  len(list_filter(terms, lambda w: contains(response, w))) = len(terms) AS passed FROM t""")
def keyword_check(spark: SparkSession, d: str) -> DataFrame:
    rows = P.text_rows(spark, d).withColumn("terms", F.slice(C.keyword_candidates(F.col("gold")), 1, 2))
    found = C.keywords_found(F.col("response"), F.col("terms"))
    return rows.select("doc_id", F.array_join("terms", ",").alias("terms"), F.array_join(found, ",").alias("found"), C.check_keywords(F.col("response"), F.col("terms")).alias("passed"))


def _sql_range(n: str) -> tuple[str, str]:
    low = f"CASE WHEN {n} <= 10 THEN greatest(1, trunc({n} * 0.8::DOUBLE))::BIGINT ELSE greatest(10, trunc({n} * 0.7::DOUBLE))::BIGINT END"
    return low, f"greatest({low} + 10, CASE WHEN {n} <= 10 THEN {n} * 3 ELSE trunc({n} * 1.3::DOUBLE)::BIGINT END)::BIGINT"


@query(f"""WITH {P.TEXT}, w AS (SELECT doc_id, {P.sql_word_count("gold")} AS g, {P.sql_word_count("response")} AS n_words FROM e),
b AS (SELECT doc_id, n_words, {_sql_range("g")[0]} AS least, {_sql_range("g")[1]} AS most FROM w) SELECT *, n_words BETWEEN least AND most AS passed FROM b""")
def length_check(spark: SparkSession, d: str) -> DataFrame:
    least, most = C.length_range(T.word_count(F.col("gold")))
    rows = P.text_rows(spark, d).withColumns({"least": least.cast("long"), "most": most.cast("long")})
    return rows.select("doc_id", T.word_count(F.col("response")).alias("n_words"), "least", "most", C.check_length(F.col("response"), F.col("least"), F.col("most")).alias("passed"))


_FORMAT_OF = ["json", "numbered_list", "bullet_list", "table"]
_FENCED = "regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1)"


@query(f"""WITH {P.TEXT}, f AS (SELECT doc_id, {P.SQL_FORMATTED} AS t, (doc_id // 5) % 4 AS k FROM e)
SELECT doc_id, CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'numbered_list' WHEN 2 THEN 'bullet_list' ELSE 'table' END AS format_id,
  CASE k WHEN 0 THEN regexp_matches(t, '\\{{[\\s\\S]*\\}}|\\[[\\s\\S]*\\]') OR regexp_matches({P.sql_strip("t")}, '^(?:-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity|"(?:[^"\\\\\\x00-\\x1f]|\\\\(?:["\\\\/bfnrt]|u[0-9a-fA-F]{{4}}))*")$')
    WHEN 1 THEN regexp_matches(t, '(?m)^[{P.SQL_SPACE}]*\\p{{Nd}}+[.)]') WHEN 2 THEN regexp_matches(t, '(?m)^[{P.SQL_SPACE}]*[-•*]') ELSE regexp_matches(t, '\\|[^\\n]+\\|') END AS passed FROM f""")
def format_check(spark: SparkSession, d: str) -> DataFrame:
    rows = P.text_rows(spark, d).withColumn("t", P.formatted_response(F.col("response"), F.col("doc_id")))
    kind = F.element_at(F.array(*map(F.lit, _FORMAT_OF)), (F.expr("doc_id div 5") % 4 + 1).cast("int"))
    return rows.select("doc_id", kind.alias("format_id"), C.check_format(F.col("t"), kind).alias("passed"))


@query(f"""WITH {P.TEXT}, f AS (SELECT doc_id, {P.SQL_FORMATTED} AS t, (doc_id // 5) % 5 AS k FROM e)
SELECT doc_id, CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'numbered_list' WHEN 2 THEN 'bullet_list' WHEN 3 THEN 'table' ELSE 'other' END AS format_id,
  CASE k WHEN 0 THEN regexp_matches(t, '(?s)de.*la') OR json_valid(t) WHEN 1 THEN regexp_matches(t, '(?m)^- ') WHEN 2 THEN regexp_matches(t, '(?m)^[{P.SQL_SPACE}]*1\\.')
    WHEN 3 THEN regexp_matches(t, '\\|[^\\n]+\\|') ELSE regexp_matches(t, '\\p{{Nd}}+\\.') END AS passed FROM f""")
def format_regex_check(spark: SparkSession, d: str) -> DataFrame:
    """Format constraints with a pattern of their own, which decides in place of the format's; a table without one."""
    rows = P.text_rows(spark, d).withColumn("t", P.formatted_response(F.col("response"), F.col("doc_id")))
    kinds = {"json": "de.*la", "numbered_list": "^- ", "bullet_list": r"^\s*1\.", "table": "", "other": r"\d+\."}
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.expr("doc_id div 5") % 5 + 1).cast("int"))
    return rows.select("doc_id", pick(kinds).alias("format_id"), C.check_format(F.col("t"), pick(kinds), pick(kinds.values())).alias("passed"))


_BASIC = f"{P.TEXT}, t0 AS (SELECT *, {_TERMS} AS terms, {P.sql_word_count('gold')} AS g, {P.sql_word_count('response')} AS n_words FROM e)"
_PASSED = f"(len(list_filter(terms, lambda w: contains(lower(response), w))) = len(terms))::INT + (n_words BETWEEN {_sql_range('g')[0]} AND {_sql_range('g')[1]})::INT + regexp_matches(response, '\\|[^\\n]+\\|')::INT"


def _checked(rows: DataFrame) -> DataFrame:
    """Rows with the three constraints of each: two keywords, the length range and a table."""
    least, most = C.length_range(T.word_count(F.col("gold")))
    none = {"requirement": F.lit(None).cast("string"), "verification_regex": F.lit(None).cast("string")}
    one = lambda kind, words, low, high, form: F.struct(F.lit(kind).alias("constraint_type"), none["requirement"].alias("requirement"), none["verification_regex"].alias("verification_regex"), words.alias("keywords"), low.cast("long").alias("min_words"), high.cast("long").alias("max_words"), F.lit(form).cast("string").alias("format_id"))
    nothing, zero = F.lit(None).cast("array<string>"), F.lit(None)
    every = F.array(one("keyword", F.slice(C.keyword_candidates(F.col("gold")), 1, 2), zero, zero, None), one("length", nothing, least, most, None), one("format", nothing, zero, zero, "table"))
    return rows.withColumn("constraint_results", C.check_all(F.col("response"), every))


@query(f"WITH {_BASIC} SELECT doc_id, {s4(f'({_PASSED}) / 3.0::DOUBLE')} AS cpr FROM t0")
def cpr_per_response(spark: SparkSession, d: str) -> DataFrame:
    return _checked(P.text_rows(spark, d)).select("doc_id", N.rounded(C.pass_rate(F.col("constraint_results")), 4).alias("cpr"))


_HELD = "lambda w: contains(lower(response), w)"


@query(f"""WITH {_BASIC}, b AS (SELECT doc_id, response, terms, n_words, {_sql_range("g")[0]} AS least, {_sql_range("g")[1]} AS most FROM t0)
SELECT doc_id, CASE WHEN len(list_filter(terms, {_HELD})) = len(terms) THEN 'All keywords found'
    ELSE 'Missing: [' || array_to_string(list_transform(list_filter(terms, lambda w: NOT contains(lower(response), w)), lambda w: chr(39) || w || chr(39)), ', ') || ']' END AS keyword,
  n_words || ' words (range ' || least || '-' || most || ')' AS length, 'Format ''table'': ' || CASE WHEN regexp_matches(response, '\\|[^\\n]+\\|') THEN 'pass' ELSE 'fail' END AS format FROM b""")
def constraint_details(spark: SparkSession, d: str) -> DataFrame:
    """What each check says of a response."""
    rows = _checked(P.text_rows(spark, d))
    return rows.select("doc_id", *(F.col("constraint_results")[k]["details"].alias(c) for k, c in enumerate(V.CONSTRAINT_TYPES)))


@query(f"""WITH {P.TEXT}, j AS (SELECT doc_id, model, level, coalesce(gold, '') AS gold, response FROM e)
SELECT doc_id, model, level, length(gold)::BIGINT AS gold_chars, length(response)::BIGINT AS response_chars FROM j""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Responses with the gold answer of their sample; the samples are indexed by id, the last row of an id counting."""
    items = table(spark, d, "benchmark")
    n = items.count()
    data = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("gold_response"), F.array().cast(f"array<{C.CONSTRAINT}>").alias("constraints"), F.col("item_id").alias("ord"))
    index = E.last_wins(data, ["id"], "ord")
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), (F.expr("doc_id div 20") % 4).cast("int").alias("level"), (F.expr("doc_id div 80") % n).cast("string").alias("sample_id"), F.col("text").alias("response"))
    return E.lookup(rows, index).select("doc_id", "model", "level", F.length("gold_response").cast("long").alias("gold_chars"), F.length("response").cast("long").alias("response_chars"))


@query(f"""WITH {P.TEXT} SELECT doc_id, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE length(gold) END::BIGINT AS gold_chars, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE 1 END AS n_constraints,
  CASE WHEN sample_id % 3 = 0 THEN 1.0 ELSE contains(lower(response), 'the')::INT END::DOUBLE AS cpr FROM e""")
def lookup_missing(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose sample may be missing: those have an empty answer, no constraint and so a pass rate of 1."""
    rows = P.text_rows(spark, d)
    word = F.struct(F.lit("keyword"), F.lit("").alias("r"), F.lit(None).cast("string").alias("x"), F.array(F.lit("the")), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("f"))
    data = rows.filter("sample_id % 3 <> 0").select(F.col("sample_id").alias("id"), F.col("gold").alias("gold_response"), F.array(word).cast(f"array<{C.CONSTRAINT}>").alias("constraints"))
    found = E.lookup(rows.select("doc_id", "sample_id", "response"), E.last_wins(data.withColumn("ord", F.lit(1)), ["id"], "ord"))
    cpr = C.pass_rate(C.check_all(F.col("response"), F.col("constraints")))
    return found.select("doc_id", F.length("gold_response").cast("long").alias("gold_chars"), F.size("constraints").alias("n_constraints"), cpr.alias("cpr"))


@query("SELECT doc_id, regexp_matches(text, '(?is)(the|der).*(and|und)') AS by_regex, contains(lower(text), 'that') AND contains(lower(text), 'this') AS by_words FROM documents")
def keyword_regex_check(spark: SparkSession, d: str) -> DataFrame:
    """Keyword constraints of a pattern without words, and of words whose pattern only asks for them."""
    text = F.col("text")
    terms = F.array(F.lit("that"), F.lit("this"))
    return table(spark, d, "documents").select("doc_id", C.check_keyword(text, F.lit(None).cast("array<string>"), F.lit("(the|der).*(and|und)")).alias("by_regex"), C.check_keyword(text, terms, C.keyword_regex(terms)).alias("by_words"))


@query()
def rouge_l_full(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rows(spark, d).select("doc_id", N.rounded(rouge_l(F.col("gold"), F.col("response")), 4).alias("rouge_l"))


@query()
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _checked(P.text_rows(spark, d)).withColumn("_r", rouge_l(F.col("gold"), F.col("response")))
    cpr, semantic = C.pass_rate(F.col("constraint_results")), F.col("_r") / 2
    return rows.select("doc_id", N.rounded(cpr, 4).alias("cpr"), N.rounded("_r", 4).alias("rouge_l"), N.rounded(E.composite(cpr, semantic), 4).alias("composite"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {s4("list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))")} AS cosine FROM w""")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each embedding with the next one, without a greedy match: what greedy_f1_single is where it is positive."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", N.rounded(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 4).alias("cosine"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {s4("greatest(0, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))")} AS f1 FROM w""")
def greedy_f1_single(spark: SparkSession, d: str) -> DataFrame:
    """Greedy match of texts of one token each, with the table's embeddings: their cosine, if positive."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return providers.vectors_f1(both, "a", "b").select("vec_id", N.rounded("f1", 4).alias("f1"))


@query(f"""WITH v AS (SELECT vec_id, vec_id // 6 AS t, vec_id % 6 AS k, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT t, max(k) AS top FROM v GROUP BY t),
u AS (SELECT t, k, e FROM v JOIN n USING (t) WHERE top < 2 OR (k > 0 AND k < top)),
s AS (SELECT a.t, a.k AS i, b.k AS j, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM u a JOIN u b ON b.t = a.t + 1),
r AS (SELECT t, avg(m) AS recall FROM (SELECT t, i, max(c) AS m FROM s GROUP BY ALL) GROUP BY t), p AS (SELECT t, avg(m) AS precision FROM (SELECT t, j, max(c) AS m FROM s GROUP BY ALL) GROUP BY t)
SELECT t AS text_id, {s4("CASE WHEN precision + recall > 0 THEN greatest(0, 2 * precision * recall / (precision + recall)) ELSE 0 END")} AS f1 FROM r JOIN p USING (t)""")
def greedy_f1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Greedy match of texts of six tokens with the table's embeddings; the first and last of a text do not count."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("text_id"), F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).alias("v"))
    texts = v.groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list("v")), lambda x: x["e"]).alias("a"))  # six vectors each
    both = texts.join(texts.select((F.col("text_id") - 1).alias("text_id"), F.col("a").alias("b")), "text_id")
    return providers.vectors_f1(both, "a", "b").select("text_id", N.rounded("f1", 4).alias("f1"))


@query()
def greedy_f1_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Greedy token match of benchmark texts with hash embeddings against the next item."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("reference").alias("response")), "item_id")
    return providers.embedding_f1(pairs, providers.HashEmbedder, "reference", "response").select("item_id", N.rounded("bert_f1", 4).alias("bert_f1"))


# ---------------------------------------------------------------- inference


@query(f"WITH {P.DIALOGUE} SELECT model_id, sample_id, level, length(response)::BIGINT AS n_chars FROM c WHERE success AND length(response) > 0 AND NOT (sample_id::BIGINT % 7 = 0)")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    rows = P.dialogue_rows(spark, d)
    done = rows.filter(F.col("sample_id").cast("long") % 7 == 0)
    return E.pending(rows, done).select(*E.KEY, F.length("response").cast("long").alias("n_chars"))


@query(f"WITH {P.DIALOGUE} SELECT model_id, sample_id, level FROM c WHERE sample_id::BIGINT % 7 <> 0")
def resume_keys(spark: SparkSession, d: str) -> DataFrame:
    """What inference still has to ask: failed records that are done are not asked again."""
    from mixlens.streaming.resume import remaining

    rows = P.dialogue_rows(spark, d)
    return remaining(rows, rows.filter(F.col("sample_id").cast("long") % 7 == 0)).select(*E.KEY)


_KINDS = "CASE WHEN contains(lower(error), 'timed out') THEN 'timeout' WHEN contains(lower(error), 'empty completion') THEN 'empty_completion' WHEN contains(error, '429') OR contains(lower(error), 'rate_limit') THEN 'rate_limit' ELSE 'api_error' END"


@query(f"WITH {P.DIALOGUE} SELECT CASE WHEN success THEN 'success' ELSE CASE WHEN error IS NULL THEN 'unknown' ELSE {_KINDS} END END AS outcome, count(*) AS n FROM c GROUP BY ALL")
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = P.dialogue_rows(spark, d).withColumn("error_type", F.when(F.col("error").isNotNull(), E.error_type(F.col("error"))))
    return E.tally(rows)


_MODELS = [("small", "org/small-1"), ("large", "org/large-2"), ("local", "local-3")]
_SQL_MODELS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MODELS) + ") m(model_name, model_id)"


@query(f"SELECT model_name, model_id, item_id, length(text)::BIGINT AS n_chars FROM {_SQL_MODELS} CROSS JOIN benchmark")
def models_x_prompts(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame(_MODELS, "name string, model_id string")
    found = E.model_prompts(models, table(spark, d, "benchmark"))
    return found.select("model_name", "model_id", "item_id", F.length("text").cast("long").alias("n_chars"))


_REGISTRY = "SELECT name, model_id FROM (SELECT s_name AS name, 'org/' || s_nationkey || '-' || s_suppkey AS model_id FROM supplier UNION ALL SELECT * FROM (VALUES ('extra', 'org/extra-9'), ('other', 'other')) t(name, model_id))"


@query(f"SELECT name, model_id FROM ({_REGISTRY}) WHERE name NOT IN ('Supplier#000000002', 'extra') AND model_id <> 'other'")
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a registry, with two models added and three excluded by name or id."""
    models = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("org/"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("model_id"))
    return selection.select_models(models, exclude=["Supplier#000000002", "org/extra-9", "other"], add=[" extra=org/extra-9", "other"])


@query(f"""WITH m AS ({_REGISTRY}), chosen AS (SELECT * FROM m WHERE name IN ('Supplier#000000001', 'Supplier#000000003', 'extra') OR model_id = 'other')
SELECT c.name, c.model_id, e.event_id % 10 AS kind, count(*) AS n FROM chosen c CROSS JOIN events e GROUP BY ALL""")
def included_models(spark: SparkSession, d: str) -> DataFrame:
    """Models kept by name or id, each with every event as a prompt, counted."""
    models = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("org/"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("model_id"))
    chosen = selection.select_models(models, include=["Supplier#000000001", "Supplier#000000003", "org/extra-9", "other"], add=["extra=org/extra-9", "other"])
    prompts = table(spark, d, "events").select((F.col("event_id") % 10).alias("kind"))
    return E.model_prompts(chosen, prompts).groupBy(F.col("model_name").alias("name"), "model_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT conv_id, turn, {P.sql_word_count('text')} AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, n > 0 AS success, n::INT AS tokens_used, CASE WHEN n = 0 THEN 'empty_completion' END AS error_type FROM t")
def infer_echo(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn through the offline generator."""
    prompts = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return providers.infer(prompts, providers.EchoGenerator).select("conv_id", "turn", "success", "tokens_used", "error_type")


# ---------------------------------------------------------------- classification and derivation


def _sql_has(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]){word}($|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])')::INT"


_SCORES = ", ".join(f"{' + '.join(_sql_has('t', w) for w in words)} AS {name}" for name, (_, words) in P.LANGUAGE_CATEGORIES.items())
_HEURISTIC = "CASE " + " ".join("WHEN regexp_matches(t, '" + pattern.replace(r"\d", r"\p{Nd}") + f"') THEN '{name}'" for pattern, name in V.HEURISTICS) + f" ELSE '{V.DEFAULT_CATEGORY}' END"
_BEST = "CASE greatest(english, german, french, spanish) WHEN 0 THEN " + _HEURISTIC + " WHEN english THEN 'english' WHEN german THEN 'german' WHEN french THEN 'french' ELSE 'spanish' END"
_CLASSIFIED = f"k0 AS (SELECT doc_id, lower(text) || ' ' AS t FROM documents), k1 AS (SELECT doc_id, t, {_SCORES} FROM k0), k AS (SELECT doc_id, {_BEST} AS category FROM k1)"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", classify.classify(F.col("text"), None, P.LANGUAGE_CATEGORIES).alias("category"))


_CUSTOM = classify.with_custom({"german": {"weight": 0.1, "keywords": ["und", "von"]}, "marks": {"keywords": ["de", "la"]}}, P.LANGUAGE_CATEGORIES)
_CUSTOM_SCORES = ", ".join(f"{' + '.join(_sql_has('t', w) for w in words)} AS {name}" for name, (_, words) in _CUSTOM.items())
_CUSTOM_BEST = f"CASE greatest({', '.join(_CUSTOM)}) WHEN 0 THEN {_HEURISTIC} " + " ".join(f"WHEN {name} THEN '{name}'" for name in _CUSTOM) + " END"


@query(f"WITH k0 AS (SELECT doc_id, lower(text) || ' ' AS t FROM documents), k1 AS (SELECT doc_id, t, {_CUSTOM_SCORES} FROM k0) SELECT doc_id, {_CUSTOM_BEST} AS category FROM k1")
def custom_categories(spark: SparkSession, d: str) -> DataFrame:
    """A category replaced whole, another added behind the others."""
    return table(spark, d, "documents").select("doc_id", classify.classify(F.col("text"), None, _CUSTOM).alias("category"))


@query(f"WITH {_CLASSIFIED} SELECT * FROM k")
def classify_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("doc_id", "category")


@query(f"WITH k0 AS (SELECT doc_id, lower(text) || ' = ' || (doc_id % 3) || CASE doc_id % 4 WHEN 0 THEN ' + ' WHEN 1 THEN ' import ' ELSE '' END AS t FROM documents) SELECT doc_id, {_HEURISTIC} AS category FROM k0")
def classify_heuristics(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("doc_id") % 4 == 0, " + ").when(F.col("doc_id") % 4 == 1, " import ").otherwise("")
    text = F.concat(F.lower("text"), F.lit(" = "), (F.col("doc_id") % 3).cast("string"), extra)
    return table(spark, d, "documents").select("doc_id", classify.by_pattern(text).alias("category"))


_WEIGHTS = "(VALUES " + ", ".join(f"({k}, '{name}', {weight}::DOUBLE)" for k, (name, (weight, _)) in enumerate(V.CATEGORIES.items())) + ") w(place, category, weight)"


@query(f"""WITH n AS (SELECT source, count(*) AS total FROM documents GROUP BY source), f AS (SELECT source, total, place, category, greatest(1, trunc(total * weight))::BIGINT AS base FROM n, {_WEIGHTS}),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY base DESC, place) AS nth, sum(base) OVER (PARTITION BY source) AS given FROM f)
SELECT source, category, (base + CASE WHEN nth = 1 THEN total - given ELSE 0 END)::BIGINT AS target FROM o""")
def category_targets(spark: SparkSession, d: str) -> DataFrame:
    """The quotas of a data set as large as each source."""
    return classify.targets_of(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total")), "total").select("source", "category", "target")


_QUOTA = classify.targets(200, P.LANGUAGE_CATEGORIES)
_SQL_QUOTA = "(VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in _QUOTA.items()) + ") q(category, target)"


@query(f"WITH {_CLASSIFIED}, o AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS place FROM k) SELECT doc_id, category, place FROM o JOIN {_SQL_QUOTA} USING (category) WHERE place <= target")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d).select("doc_id", "category")
    return selection.quota_sample(rows, classify.targets_table(spark, 200, P.LANGUAGE_CATEGORIES), ["doc_id"])


@query(f"WITH {_CLASSIFIED}, o AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS place FROM k) SELECT doc_id, category, place FROM o WHERE place > 10 AND place <= 60")
def round_slice(spark: SparkSession, d: str) -> DataFrame:
    return selection.round_slice(_classified(spark, d).select("doc_id", "category"), ["doc_id"], 40, cursor=10)


@query(f"WITH {_CLASSIFIED}, o AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS nth FROM k WHERE doc_id % 3 <> 0) SELECT doc_id, category FROM o JOIN {_SQL_QUOTA} USING (category) WHERE nth <= target")
def filled_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Quotas filled in rounds where a third of the candidates fails."""
    placed = selection.with_place(_classified(spark, d).select("doc_id", "category"), ["doc_id"])
    fails = lambda batch: batch.withColumns({"error": F.when(F.col("doc_id") % 3 == 0, "failed"), "error_type": F.when(F.col("doc_id") % 3 == 0, "api_error")})
    return build.fill(placed, _QUOTA, fails, max_rounds=20).rows.select("doc_id", "category")


@query(f"WITH {_CLASSIFIED}, g AS (SELECT category, count(*) AS got FROM k GROUP BY ALL) SELECT category, target, coalesce(got, 0) AS got, coalesce(got, 0) - target AS delta FROM {_SQL_QUOTA} LEFT JOIN g USING (category)")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return validation.category_distribution(_classified(spark, d), classify.targets_table(spark, 200, P.LANGUAGE_CATEGORIES))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE regexp_full_match(w, '[a-z]{{4,}}') AND w NOT IN ({", ".join(f"'{x}'" for x in V.STOP_WORDS)}) GROUP BY doc_id, w),
l AS (SELECT doc_id, string_agg(w, ',' ORDER BY i) AS candidates FROM f GROUP BY doc_id) SELECT doc_id, coalesce(candidates, '') AS candidates FROM documents LEFT JOIN l USING (doc_id)""")
def keyword_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(C.keyword_candidates(F.col("text")), ",").alias("candidates"))


@query(f"WITH w AS (SELECT doc_id, {P.sql_word_count('text')} AS n_words FROM documents) SELECT doc_id, n_words, {_sql_range('n_words')[0]} AS least, {_sql_range('n_words')[1]} AS most FROM w")
def length_range(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    least, most = C.length_range(F.col("n_words"))
    return rows.select("doc_id", "n_words", least.cast("long").alias("least"), most.cast("long").alias("most"))


_SQL_CHOICE = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}[doc_id % {len(v)} + 1]" for k, v in V.FORMAT_PREFERENCES.items()) + f" ELSE {list(V.FORMATS)}[doc_id % 4 + 1] END"


@query(f"WITH {P.TEXT} SELECT doc_id, category, {_SQL_CHOICE} AS format_id FROM e")
def format_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = P.text_rows(spark, d)
    return rows.select("doc_id", "category", C.format_choice(F.col("category"), F.col("doc_id")).alias("format_id"))


@query(f"""WITH {P.TEXT}, t AS (SELECT doc_id, gold, {_TERMS} AS terms, {P.sql_word_count("gold")} AS g FROM e)
SELECT doc_id, {P.sql_strip("gold")} || '\nPastikan jawaban mengandung kata: ' || array_to_string(terms, ', ') || '.\nJawab dalam ' || {_sql_range("g")[0]} || '-' || {_sql_range("g")[1]} || ' kata.' AS text FROM t""")
def embed_constraints(spark: SparkSession, d: str) -> DataFrame:
    least, most = C.length_range(T.word_count(F.col("gold")))
    needs = F.array(C.keyword_requirement(F.slice(C.keyword_candidates(F.col("gold")), 1, 2)), C.length_requirement(least, most))
    return P.text_rows(spark, d).select("doc_id", C.embed(F.col("gold"), needs).alias("text"))


@query()
def derived_constraints(spark: SparkSession, d: str) -> DataFrame:
    made = P.text_rows(spark, d).select("doc_id", F.explode(C.derive(F.col("gold"), F.col("gold"), F.col("category"), F.col("doc_id"))).alias("c"))
    return made.select("doc_id", "c.constraint_type", "c.requirement", "c.verification_regex")


# ---------------------------------------------------------------- datasets


@query(f"WITH {P.LEVELS_SQL} SELECT id, level::INT AS level, category, md5(t) AS text FROM (SELECT id, category, unnest([0, 1, 2, 3]) AS level, unnest([l0, l1, l2, l3]) AS t FROM p)")
def unpivot_levels(spark: SparkSession, d: str) -> DataFrame:
    return E.unpivot_levels(P.level_rows(spark, d), V.LEVELS).withColumn("text", F.md5("text"))


_SQL_JSON = " || ',' || ".join(
    f"'{{\"constraint_type\":\"{kind}\",\"requirement\":\"' || {part} || '\"{extra}}}'" for kind, part, extra in (("keyword", "word", ""), ("length", "length", ""), ("format", "layout", ',\"format_id\":\"table\"'))
)


@query(f"WITH {P.LEVELS_SQL} SELECT id, category, md5(text) AS original_instruction, '' AS original_input, md5(gold_response) AS gold_response, md5(l0) AS level_0_clean, md5(l1) AS level_1_mild, md5(l2) AS level_2_jaksel, md5(l3) AS level_3_adversarial, '[' || {_SQL_JSON} || ']' AS constraints FROM p")
def flatten_export(spark: SparkSession, d: str) -> DataFrame:
    flat = build.flatten_sample(_typed(P.level_rows(spark, d)))
    return flat.withColumns({c: F.md5(c) for c in ("original_instruction", "gold_response", *V.LEVELS)})


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= trunc(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return selection.train_test(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("""WITH u AS (SELECT DISTINCT lang AS category, text AS original_instruction FROM documents)
SELECT 'item_' || CASE WHEN n < 100000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS id, category, md5(original_instruction) AS instruction
FROM (SELECT *, row_number() OVER (ORDER BY category, original_instruction) - 1 AS n FROM u)""")
def finalize_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("text").alias("original_instruction")).distinct()
    return selection.finalize_ids(rows).select("id", "category", F.md5("original_instruction").alias("instruction"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return E.last_wins(rows.withColumn("ord", F.col("event_id")), ["user_id"], "ord").select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE length(text) >= 20 ORDER BY doc_id LIMIT 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(selection.long_enough(F.col("text")))
    return E.first_rows(rows.select("doc_id"), 100, "doc_id")


# ---------------------------------------------------------------- rewriting


@query(f"""WITH {P.LEVELS_SQL} SELECT doc_id, md5({P.sql_strip("text")} || CASE WHEN doc_id % 2 = 0 THEN ' plis benerly this is the way' ELSE ' sih' END || tail_) AS text
FROM (SELECT *, '\n' || word || '\n' || length || '\n' || layout AS tail_ FROM p)""")
def enforce_lines(spark: SparkSession, d: str) -> DataFrame:
    """The level-3 texts, some with a repeated requirement inside the last line, restored."""
    rows = P.level_rows(spark, d)
    return rows.select("doc_id", F.md5(rewrite.enforce_lines(F.col("level_3_adversarial"), F.array("word", "length", "layout"))).alias("text"))


_SEED_WORDS = " tidak dengan yang untuk karena mengapa"


def _sql_lexicon(text: str) -> str:
    for formal, colloquial in V.LEXICON:
        text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])(?i:{formal})\\b', '\\1{colloquial}', 'g')"
    return text


@query(f"SELECT doc_id, md5({_sql_lexicon('t')}) AS text FROM (SELECT doc_id, 'x' || doc_id || ' ' || source || '{_SEED_WORDS} sudah saya ' || lang AS t FROM documents)")
def lexicon_rewrite(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" "), "source", F.lit(f"{_SEED_WORDS} sudah saya "), "lang")
    return table(spark, d, "documents").select("doc_id", F.md5(rewrite.lexicon_rewrite(text)).alias("text"))


_SQL_PARTICLE = " OR ".join(_sql_has("lower(text)", w).removesuffix("::INT") for w in V.PARTICLES)
_SQL_WORDS = f"list_transform(regexp_extract_all(lower(text), '[^{P.SQL_SPACE}]+'), lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))"


@query(f"""SELECT doc_id, md5(CASE WHEN list_has_any({_SQL_WORDS}, {V.PARTICLES}) THEN text
  ELSE regexp_replace(regexp_replace(text, '[{P.SQL_SPACE}]+$', ''), '[.!?]$', '') || ' ' || {V.PARTICLES}[doc_id % 8 + 1] || '.' END) AS text FROM documents""")
def particle_l2(spark: SparkSession, d: str) -> DataFrame:
    made = rewrite.add_particle(F.col("text"), rewrite.particle_of(F.col("doc_id")), F.lit(True))
    return table(spark, d, "documents").select("doc_id", F.md5(made).alias("text"))


@query()
def sentence_case_l3(spark: SparkSession, d: str) -> DataFrame:
    made = rewrite.lower_sentences(F.col("text"), lambda k: (F.col("doc_id") + k) % 4 == 0)
    return table(spark, d, "documents").select("doc_id", F.md5(made).alias("text"))


@query()
def rewrite_levels(spark: SparkSession, d: str) -> DataFrame:
    made = providers.rewrite_levels(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return made.select("doc_id", *(F.md5(c).alias(c) for c in V.LEVELS))


# ---------------------------------------------------------------- validation and quality


def _typed(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    one = lambda kind, requirement, words, low, high, form: F.struct(F.lit(kind), requirement, none.cast("string"), words, low, high, form).cast(C.CONSTRAINT)
    every = F.array(
        one("keyword", F.col("word"), none.cast("array<string>"), none.cast("long"), none.cast("long"), none.cast("string")),
        one("length", F.col("length"), none.cast("array<string>"), none.cast("long"), none.cast("long"), none.cast("string")),
        one("format", F.col("layout"), none.cast("array<string>"), none.cast("long"), none.cast("long"), F.lit("table")),
    )
    return rows.withColumn("constraints", every)


_COUNT = lambda text, part: f"((length({text}) - length(replace({text}, {part}, ''))) // length({part}))"
_RULES = " UNION ALL ".join(
    f"SELECT id, 'error' AS severity, '{level} requirement {said}' AS rule FROM p WHERE {_COUNT(short, part)} {test}"
    for level, short in zip(V.LEVELS, ("l0", "l1", "l2", "l3"), strict=True)
    for part in ("word", "length", "layout")
    for said, test in (("not found", "= 0"), ("repeated", "> 1"))
)


@query(f"WITH {P.LEVELS_SQL} {_RULES} UNION ALL SELECT id, 'warning', 'keyword not in gold answer' FROM p WHERE NOT (contains(lower(gold_response), 'the') AND contains(lower(gold_response), 'that'))")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validation.violations(_typed(P.level_rows(spark, d)))


@query(f"WITH {P.LEVELS_SQL}, v AS ({_RULES} UNION ALL SELECT id, 'warning', 'keyword not in gold answer' FROM p WHERE NOT (contains(lower(gold_response), 'the') AND contains(lower(gold_response), 'that'))) SELECT severity, rule, count(*) AS n FROM v GROUP BY ALL")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validation.violations(_typed(P.level_rows(spark, d))).groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH {P.LEVELS_SQL}, v AS ({_RULES} UNION ALL SELECT id, 'warning', 'keyword not in gold answer' FROM p WHERE NOT (contains(lower(gold_response), 'the') AND contains(lower(gold_response), 'that'))
  UNION ALL SELECT NULL, 'error', k || ' duplicate original_instruction' FROM (SELECT count(*) AS k FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) WHERE k > 0
  UNION ALL SELECT NULL, 'error', 'ids are not contiguous' FROM (SELECT count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM documents) WHERE a <> 0 OR b <> n - 1
  UNION ALL SELECT NULL, 'warning', printf('levels 0 and 1 are equal in %.1f%%', r) FROM (SELECT 100.0::DOUBLE * count(*) FILTER (l0 = l1) / count(*) AS r FROM p) WHERE r >= 30)
SELECT severity, rule, count(*) AS n FROM v GROUP BY ALL""")
def validation_full(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong with a dataset, row by row and as a whole, counted by rule."""
    return validation.full_report(_typed(P.level_rows(spark, d))).groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS value, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_instructions(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicates(table(spark, d, "documents"), "text").withColumn("value", F.md5("value"))


@query("SELECT doc_id // 3 AS value, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicates(table(spark, d, "documents").select(F.expr("doc_id div 3").alias("id")), "id")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) = count(*) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AS contiguous FROM documents")
def id_contiguity(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.concat(F.lit("item_"), F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(5), F.length(F.col("doc_id").cast("string"))), F.lit("0"))).alias("id"))
    return validation.contiguous(ids, "id", "item_")


@query(f"WITH {P.LEVELS_SQL} SELECT count(*) FILTER (l0 = l1) AS same, count(*) AS n, {s4('count(*) FILTER (l0 = l1) * 100.0::DOUBLE / count(*)')} AS percent FROM p")
def identity_rate(spark: SparkSession, d: str) -> DataFrame:
    return validation.identity_rate(P.level_rows(spark, d), V.LEVELS[0], V.LEVELS[1]).withColumn("percent", N.rounded("percent", 4))


def _sql_listed(text: str, words: list[str]) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(lower({text}), '[^{P.SQL_SPACE}]+'), lambda w: regexp_replace(w, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g')), lambda w: w IN ({", ".join(f"'{w}'" for w in words)}))"""


_SUFFIXED = f"""list_filter(regexp_extract_all(l3, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: regexp_full_match(w, '(?i)[a-z]{{3,}}(?:ly|ness)') AND lower(w) NOT IN ({", ".join(f"'{w}'" for w in V.ENGLISH_SUFFIXED)}))"""
_CONNECTED = " OR ".join(f"contains(lower(l2), '{c}')" for c in V.CONNECTORS)


@query(f"""WITH {P.LEVELS_SQL}, m AS (SELECT {_CONNECTED} AS l2_connector, len({_sql_listed("l2", V.PARTICLES)}) > 0 AS l2_particle, len({_sql_listed("l3", V.RESPELLED)}) > 0 AS l3_respelling,
  len({_SUFFIXED}) > 0 AS l3_suffix, len({_sql_listed("l3", V.CLAUSE_WORDS)}) >= 3 AS l3_clause, len({_sql_listed("l3", V.PARTICLES)}) > 0 AS l3_particle FROM p)
SELECT count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS {c}" for c in "l2_connector l2_particle l3_respelling l3_suffix l3_clause l3_particle".split())}, count(*) FILTER (l3_respelling AND l3_suffix AND l3_clause) AS l3_all FROM m""")
def marker_coverage(spark: SparkSession, d: str) -> DataFrame:
    return validation.marker_coverage(P.level_rows(spark, d), V.LEVELS[2], V.LEVELS[3])


@query(f"WITH {P.LEVELS_SQL} SELECT " + ", ".join(f"{s4(f'avg({P.sql_word_count(short)})')} AS {level}" for level, short in zip(V.LEVELS, ("l0", "l1", "l2", "l3"), strict=True)) + " FROM p")
def avg_words_by_level(spark: SparkSession, d: str) -> DataFrame:
    found = validation.average_words(P.level_rows(spark, d))
    return found.select(*(N.rounded(c, 4).alias(c) for c in V.LEVELS))


@query("SELECT type, count(*) AS n FROM (SELECT unnest(['keyword', 'length', 'format']) AS type FROM documents) GROUP BY type")
def constraint_type_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = P.text_rows(spark, d).select(F.explode(C.derive(F.col("gold"), F.col("gold"), F.col("category"), F.col("doc_id"))).alias("c"))
    return rows.groupBy(F.col("c.constraint_type").alias("type")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- endpoints and charts


@query("""SELECT page_id, u AS url, regexp_extract(lower(u), '^[^:/?#]+://([^/?#:]*)', 1) IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') AS local
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://LocalHost:11434/v1/' WHEN 1 THEN 'http://127.0.0.1/' ELSE url END AS u FROM pages)""")
def local_url(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 5 == 0, "http://LocalHost:11434/v1/").when(F.col("page_id") % 5 == 1, "http://127.0.0.1/").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", url.alias("url"), selection.is_local_url(url).alias("local"))


_DEFAULT_URL = "https://api.example.com/v1/"
_OWN_URL = "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'http://localhost:1/v1' WHEN 2 THEN 'http://[::1]:9/v1' WHEN 3 THEN 'https://api.example.com/v1' ELSE url END"


@query(f"""WITH e AS (SELECT page_id, {_OWN_URL} AS base_url, CASE page_id % 3 WHEN 0 THEN 'KEY_' || page_id ELSE '' END AS key_name, CASE WHEN page_id % 2 = 0 THEN 'k' ELSE '' END AS key FROM pages),
l AS (SELECT *, page_id % 7 IN (1, 2) AS local, page_id % 7 IN (0, 3) OR rtrim(base_url, '/') = '{_DEFAULT_URL.rstrip("/")}' AS same FROM e)
SELECT page_id, CASE WHEN key_name <> '' THEN CASE WHEN key <> '' THEN 'env' WHEN local THEN 'local_unset' ELSE 'env_unset' END WHEN local THEN 'local' WHEN same THEN 'default' ELSE 'refused' END AS source FROM l""")
def credential_table(spark: SparkSession, d: str) -> DataFrame:
    """Where the key of each endpoint comes from, with the urls of pages as endpoints."""
    k = F.col("page_id")
    url = F.when(k % 7 == 0, "").when(k % 7 == 1, "http://localhost:1/v1").when(k % 7 == 2, "http://[::1]:9/v1").when(k % 7 == 3, "https://api.example.com/v1").otherwise(F.col("url"))
    name = F.when(k % 3 == 0, F.concat(F.lit("KEY_"), k.cast("string"))).otherwise("")
    return table(spark, d, "pages").select("page_id", selection.credential_source(url, name, F.when(k % 2 == 0, "k").otherwise(""), _DEFAULT_URL).alias("source"))


@query(f"""WITH f AS (SELECT doc_id, {P.sql_strip(f"regexp_replace(CASE WHEN text = '' THEN 'N/A' ELSE text END, '[{P.SQL_SPACE}]+', ' ', 'g')")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 260 THEN regexp_replace(substr(t, 1, 259), '[{P.SQL_SPACE}]+$', '') || '…' ELSE t END AS cell FROM f""")
def chart_cell_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.chart_cell(F.col("text")).alias("cell"))


@query()
def resume_stream(spark: SparkSession, d: str) -> DataFrame:
    """Dialogue records through the file stream, scored in batches."""
    from mixlens.sources.tables import INFERENCE, scratch_root, stored
    from mixlens.streaming.resume import evaluate_stream, read_responses

    import uuid

    folder = f"{scratch_root(spark)}/mixlens/stream-{uuid.uuid4().hex}"
    rows = P.dialogue_rows(spark, d)
    shaped = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.strip().split() for x in INFERENCE.split(","))))
    shaped.write.json(f"{folder}/in")
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("gold_response"), F.array().cast(f"array<{C.CONSTRAINT}>").alias("constraints"))
    evaluate_stream(read_responses(spark, f"{folder}/in"), stored(items, "stream-items"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*E.KEY, "cpr", "rouge_l", "composite")


@query()
def built_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The dataset build over all documents as instructions, with categories by function words."""
    docs = table(spark, d, "documents").select(F.col("text").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))
    return build.build(docs, 200, categories=P.LANGUAGE_CATEGORIES).select("id", "category", *(F.md5(c).alias(c) for c in V.LEVELS))
