"""The driver's tables as the engine's relations, in DataFrames and in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.functions import vocabulary as V
from mixlens.sources.tables import table

#: Categories by function words, to try custom categories on the documents.
LANGUAGE_CATEGORIES = {
    "english": (0.4, ["the", "that", "with", "this", "from"]),
    "german": (0.2, ["sich", "nicht", "eine", "der", "die"]),
    "french": (0.2, ["elle", "pour", "dans", "avec"]),
    "spanish": (0.2, ["para", "mente", "que"]),
}
BY_LANGUAGE = {"en": "logical_reasoning", "fr": "mathematical_reasoning", "de": "creative_writing", "es": "information_extraction"}


def half_up(expression: str, places: int) -> str:
    """SQL that rounds half up on the decimal value, as Spark does: for the figures that the queries start from."""
    return f"round(({expression})::DECIMAL(28, 12), {places})::DOUBLE"


def rounded(expression: str, places: int) -> str:
    """SQL that rounds by the exact binary value, ties to the even digit."""
    return f"printf('%.{places}f', ({expression})::DOUBLE)::DOUBLE"


def numeric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), (F.col("event_id") % 4).cast("int").alias("level"), F.col("event_type").alias("category"), F.col("event_id").alias("ord"), k.alias("k"), F.round(F.abs("value") - F.floor(F.abs("value")), 2).alias("semantic"))
    rows = rows.withColumn("cpr", F.round((F.col("k") % 4) / 3, 4))
    passed = {"keyword": F.col("k") % 2 == 0, "length": F.col("k") % 3 != 0, "format": F.col("k") % 5 < 4}
    return rows.withColumns({"composite": F.round(0.6 * F.col("cpr") + 0.4 * F.col("semantic"), 4), "results": F.array(*(F.struct(F.lit(t).alias("type"), p.alias("passed")) for t, p in passed.items()))})


NUMERIC = f"""n0 AS (
  SELECT 'm' || (user_id % 7) AS model, (event_id % 4)::INT AS level, event_type AS category, event_id AS ord,
    json_extract_string(props, '$.k')::INT AS k, {half_up("abs(value) - floor(abs(value))", 2)} AS semantic FROM events
), n1 AS (SELECT *, {half_up("(k % 4) / 3.0::DOUBLE", 4)} AS cpr FROM n0
), n AS (SELECT *, {half_up("0.6::DOUBLE * cpr + 0.4::DOUBLE * semantic", 4)} AS composite FROM n1
), lv AS (SELECT model, level, avg(cpr) AS constraint_pass_rate, avg(semantic) AS semantic_score, avg(composite) AS combined_score FROM n GROUP BY ALL
), x AS (
  SELECT model, level, ord, 'keyword' AS type, k % 2 = 0 AS passed FROM n UNION ALL SELECT model, level, ord, 'length', k % 3 <> 0 FROM n
  UNION ALL SELECT model, level, ord, 'format', k % 5 < 4 FROM n
), long AS (
  SELECT model, level, 'constraint_pass_rate' AS metric, constraint_pass_rate AS score FROM lv UNION ALL SELECT model, level, 'semantic_score', semantic_score FROM lv
  UNION ALL SELECT model, level, 'combined_score', combined_score FROM lv
), pd AS (
  SELECT p.model, p.metric, p.level, b.score AS baseline, p.score AS perturbed,
    CASE WHEN b.score = 0 THEN 0.0 ELSE {rounded("(b.score - p.score) / b.score * 100", 2)} END AS pdr
  FROM long p JOIN long b ON p.model = b.model AND p.metric = b.metric AND b.level = 0 WHERE p.level <> 0
), first AS (SELECT model, min(ord) AS first_ord FROM n GROUP BY model)"""


def scale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows from line items, for runs at size."""
    rows = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_linenumber") % 4).cast("int").alias("level"), F.col("l_returnflag").alias("category"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.round(F.col("l_discount") * 10, 4).alias("cpr"), F.round(F.col("l_tax") * 10, 4).alias("semantic"), F.col("l_quantity").alias("q"),
    )
    passed = {"keyword": F.col("q") > 5, "length": F.col("q") > 25, "format": F.col("q") < 45}
    return rows.withColumns({"composite": F.round(0.6 * F.col("cpr") + 0.4 * F.col("semantic"), 4), "results": F.array(*(F.struct(F.lit(t).alias("type"), p.alias("passed")) for t, p in passed.items()))})


SCALE = f"""n0 AS (
  SELECT l_returnflag || l_linestatus AS model, (l_linenumber % 4)::INT AS level, l_orderkey * 8 + l_linenumber AS ord,
    {half_up("l_discount * 10", 4)} AS cpr, {half_up("l_tax * 10", 4)} AS semantic FROM lineitem
), n AS (SELECT *, {half_up("0.6::DOUBLE * cpr + 0.4::DOUBLE * semantic", 4)} AS composite FROM n0
), lv AS (SELECT model, level, avg(composite) AS combined_score FROM n GROUP BY ALL
), first AS (SELECT model, min(ord) AS first_ord FROM n GROUP BY model)"""


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """Responses with gold answers: documents beside benchmark texts."""
    items = table(spark, d, "benchmark")
    n = items.count()
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), (F.expr("doc_id div 20") % 4).cast("int").alias("level"), F.expr("doc_id div 80").alias("sample_id"), "lang", F.col("text").alias("response"))
    gold = items.select(F.col("item_id").alias("_item"), F.col("text").alias("gold"))
    return docs.join(gold, F.col("sample_id") % n == F.col("_item"), "left").drop("_item").withColumn("category", category_of("lang"))


def category_of(lang: str) -> F.Column:
    found = F.lit("coding")
    for code, name in BY_LANGUAGE.items():
        found = F.when(F.col(lang) == code, name).otherwise(found)
    return found


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_LANGUAGE.items())
TEXT = f"""e AS (
  SELECT doc_id, source AS model, ((doc_id // 20) % 4)::INT AS level, doc_id // 80 AS sample_id, d.lang, d.text AS response, b.text AS gold,
    CASE d.lang {_CASES} ELSE 'coding' END AS category
  FROM documents d LEFT JOIN benchmark b ON b.item_id = (d.doc_id // 80) % (SELECT count(*) FROM benchmark)
)"""

#: SQL for Python's words, and for what separates them.
SQL_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"


def sql_word_count(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '[^{SQL_SPACE}]+')), 0)::BIGINT"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


#: Distinct words of four ASCII letters or more that are no stop words, in order.
def sql_candidates(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
    words = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND w NOT IN ({stop}))"
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


def formatted_response(text: F.Column, key: F.Column) -> F.Column:
    """Responses of which some are lists, tables or JSON, by the key."""
    forms = [F.concat(F.lit("intro\n1. "), text), F.concat(F.lit("- "), text), F.concat(F.lit("{"), text, F.lit("}")), F.concat(F.lit("| a | b |\n"), text)]
    out = text
    for k, form in enumerate(forms):
        out = F.when(key % 5 == k, form).otherwise(out)
    return out


SQL_FORMATTED = "CASE doc_id % 5 WHEN 0 THEN 'intro\n1. ' || response WHEN 1 THEN '- ' || response WHEN 2 THEN '{' || response || '}' WHEN 3 THEN '| a | b |\n' || response ELSE response END"


def dialogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Inference records: each user turn with the assistant turn after it; a blank answer is a failure."""
    turns = table(spark, d, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("prompt"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    pairs = asked.join(answers, ["conv_id", "turn"])
    bad = F.col("conv_id") % 6
    error = F.when(bad == 0, "request timed out after 120s").when(bad == 1, "HTTP 429 from server").when(bad == 2, "Empty completion").otherwise("connection reset")
    failed = (F.col("conv_id") + F.col("turn")) % 3 == 0
    return pairs.select(
        F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string")).alias("model_id"), F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").cast("int").alias("level"), "prompt",
        F.when(failed, "").otherwise(F.col("response")).alias("response"), (~failed & (F.trim("response") != "")).alias("success"), F.when(failed, error).alias("error"),
    )


DIALOGUE = """c0 AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer, (u.conv_id + u.turn) % 3 = 0 AS failed FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
), c AS (
  SELECT 'd' || (conv_id % 5) AS model_id, conv_id::VARCHAR AS sample_id, turn::INT AS level, prompt, CASE WHEN failed THEN '' ELSE answer END AS response,
    NOT failed AND trim(answer) <> '' AS success,
    CASE WHEN failed THEN CASE conv_id % 6 WHEN 0 THEN 'request timed out after 120s' WHEN 1 THEN 'HTTP 429 from server' WHEN 2 THEN 'Empty completion' ELSE 'connection reset' END END AS error
  FROM c0
)"""


def level_rows(spark: SparkSession, d: str) -> DataFrame:
    """Four level texts per document, with two requirement lines; some rows break a rule."""
    docs = table(spark, d, "documents").withColumn("category", category_of("lang"))
    word = "Pastikan jawaban mengandung kata: the, that."
    length = "Jawab dalam 10-40 kata."
    layout = V.FORMATS["table"][0]
    tail = f"\n{word}\n{length}\n{layout}"
    cut = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.lit(tail))
    twice = F.when(F.col("doc_id") % 13 == 0, F.lit(f" {length}")).otherwise(F.lit(""))
    return docs.select(
        "doc_id", F.format_string("item_%05d", "doc_id").alias("id"), "category", F.col("text").alias("original_instruction"), F.lit("").alias("original_input"), F.col("text").alias("gold_response"),
        F.concat("text", F.lit(tail)).alias("level_0_clean"),
        F.concat(F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit(" actually"))).otherwise(F.col("text")), F.lit(tail)).alias("level_1_mild"),
        F.concat("text", F.when(F.col("doc_id") % 3 == 0, " dong").otherwise(" because"), cut).alias("level_2_jaksel"),
        F.concat("text", F.when(F.col("doc_id") % 2 == 0, " plis benerly this is the way").otherwise(" sih"), F.lit(tail), twice).alias("level_3_adversarial"),
        F.lit(word).alias("word"), F.lit(length).alias("length"), F.lit(layout).alias("layout"),
    )


LEVELS_SQL = f"""r AS (SELECT 'Pastikan jawaban mengandung kata: the, that.' AS word, 'Jawab dalam 10-40 kata.' AS length, '{V.FORMATS["table"][0]}' AS layout
), p0 AS (SELECT *, '\n' || word || '\n' || length || '\n' || layout AS tail FROM documents, r
), p AS (
  SELECT doc_id, printf('item_%05d', doc_id) AS id, CASE lang {_CASES} ELSE 'coding' END AS category, text, word, length, layout, text AS gold_response,
    text || tail AS l0, CASE WHEN doc_id % 4 = 0 THEN text || ' actually' ELSE text END || tail AS l1,
    text || CASE WHEN doc_id % 3 = 0 THEN ' dong' ELSE ' because' END || CASE WHEN doc_id % 11 = 0 THEN '' ELSE tail END AS l2,
    text || CASE WHEN doc_id % 2 = 0 THEN ' plis benerly this is the way' ELSE ' sih' END || tail || CASE WHEN doc_id % 13 = 0 THEN ' ' || length ELSE '' END AS l3
  FROM p0
)"""
