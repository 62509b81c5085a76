"""Checks of a built dataset as violation rows, and a report on linguistic markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.functions import text as T
from mixlens.functions import vocabulary as V


def length_bounds(least: Column, most: Column, requirement: Column) -> tuple[Column, Column]:
    """Typed bounds, else those in the requirement's text, else null."""
    text = F.coalesce(requirement, F.lit(""))
    read = [F.regexp_extract(text, V.LENGTH_RANGE, k) for k in (1, 2)]
    typed = least.isNotNull() & most.isNotNull()
    return tuple(F.when(typed, given.cast("long")).otherwise(F.when(found != "", found.cast("long"))) for given, found in zip((least, most), read, strict=True))


def keyword_terms(requirement: Column) -> Column:
    inner = F.regexp_extract(F.coalesce(requirement, F.lit("")), "(?iu)" + V.KEYWORD_TERMS, 1)
    return F.filter(F.transform(F.split(inner, ","), T.strip), lambda t: t != "")


def _when(test: Column, severity: str, said: Column | str) -> Column:
    said = F.lit(said) if isinstance(said, str) else said
    return F.when(F.coalesce(test, F.lit(True)), F.struct(F.lit(severity).alias("severity"), said.alias("rule")))


def _wrong_counts(level: str, text: Column) -> Column:
    """A violation for each requirement that the level's text lacks, or has more than once."""
    asked = F.filter("constraints", lambda c: c["requirement"] != "")
    said = lambda what: F.struct(F.lit("error").alias("severity"), F.lit(f"{level} requirement {what}").alias("rule"))
    times = F.transform(asked, lambda c: T.occurrences(text, c["requirement"]))
    return F.transform(times, lambda n: F.when(n == 0, said("not found")).when(n > 1, said("repeated")))


def violations(rows: DataFrame, categories: tuple[str, ...] = tuple(V.CATEGORIES), levels: tuple[str, ...] = V.LEVELS) -> DataFrame:
    """id, severity and rule of each violation; rows have levels as columns and typed constraints."""
    found = [_when(F.col(c).isNull(), "error", f"missing {c}") for c in ("id", "category", "original_instruction", "gold_response")]
    found.append(_when(~F.col("category").isin(*categories), "error", "unknown category"))
    checks = []
    for level in levels:
        text = F.coalesce(F.col(level), F.lit(""))
        found.append(_when(T.strip(text) == "", "error", f"{level} empty"))
        checks.append(_wrong_counts(level, text))

    def of_one(c: Column) -> Column:
        low, high = length_bounds(c["min_words"], c["max_words"], c["requirement"])
        kind = c["constraint_type"]
        formats = [v[0] for v in V.FORMATS.values()]
        terms = F.coalesce(c["keywords"], keyword_terms(c["requirement"]))
        gold = F.lower(F.coalesce(F.col("gold_response"), F.lit("")))
        none = F.lit(None).cast("struct<severity:string,rule:string>")
        of_length = F.when(low.isNull() | high.isNull(), F.struct(F.lit("error").alias("severity"), F.lit("no length range").alias("rule"))).when(~((low > 0) & (low < high)), F.struct(F.lit("error").alias("severity"), F.lit("length range not sane").alias("rule")))
        of_format = _when(~F.coalesce(c["requirement"], F.lit("")).isin(*formats), "error", "unknown format")
        of_words = _when(~F.forall(terms, lambda w: F.contains(gold, F.lower(w))), "warning", "keyword not in gold answer")
        return F.when(kind == "length", of_length).when(kind == "format", of_format).when(kind == "keyword", of_words).otherwise(none)

    checks.append(F.transform("constraints", of_one))
    seen = F.transform("constraints", lambda c: c["constraint_type"])
    found += [_when(~F.array_contains(seen, t), "error", f"no {t} constraint") for t in V.CONSTRAINT_TYPES]
    every = F.filter(F.concat(F.array(*found), *checks), lambda x: x.isNotNull())
    return rows.select("id", F.explode(every).alias("v")).select("id", "v.severity", "v.rule")


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def id_format(value: Column, prefix: str = "item_") -> Column:
    """Whether it is a number of five digits behind the prefix, or of more from 100000 on, as ids are made."""
    return value.rlike(rf"^{prefix}(?:\d{{5}}|[1-9]\d{{5,}})$")


def contiguous(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: whether the sorted ids are prefix00000 to prefix(N-1): as many distinct numbers as rows, from 0 to N-1."""
    number = F.regexp_extract(F.col(column), rf"^{prefix}(\d+)$", 1)
    parsed = F.when(number != "", number.cast("long"))
    figures = rows.agg(F.count("*").alias("n"), F.count_distinct(parsed).alias("k"), F.min(parsed).alias("low"), F.max(parsed).alias("high"))
    return figures.select("n", F.coalesce((F.col("k") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1), F.col("n") == 0).alias("contiguous"))


def has_particle(text: Column) -> Column:
    return F.arrays_overlap(T.stripped_words(text), F.array(*map(F.lit, V.PARTICLES)))


def has_respelling(text: Column) -> Column:
    return F.arrays_overlap(T.stripped_words(text), F.array(*map(F.lit, V.RESPELLED)))


def has_connector(text: Column) -> Column:
    return T.holds_any(text, V.CONNECTORS)


def suffixed(text: Column) -> Column:
    """Words with an English suffix that are no plain English words."""
    plain = F.array(*map(F.lit, V.ENGLISH_SUFFIXED))
    return F.filter(F.regexp_extract_all(text, F.lit("(?iuU)" + V.SUFFIX_PATTERN), 0), lambda w: ~F.array_contains(plain, F.lower(w)))


def has_clause_switch(text: Column) -> Column:
    listed = F.array(*map(F.lit, V.CLAUSE_WORDS))
    return F.size(F.filter(T.stripped_words(text), lambda w: F.array_contains(listed, w))) >= 3


def marker_coverage(rows: DataFrame, level_2: str, level_3: str) -> DataFrame:
    """One row: how many texts have each marker, and how many level-3 texts all three mechanisms."""
    listed = lambda words: F.array(*map(F.lit, words))

    def marks(words: Column) -> Column:
        """What the words of a text hold, from one pass over it."""
        clause = F.size(F.filter(words, lambda w: F.array_contains(listed(V.CLAUSE_WORDS), w))) >= 3
        return F.struct(F.arrays_overlap(words, listed(V.RESPELLED)).alias("respelled"), clause.alias("clause"), F.arrays_overlap(words, listed(V.PARTICLES)).alias("particle"))

    two, three = F.col(level_2), F.col(level_3)
    told = rows.select(has_connector(two).alias("connector"), has_particle(two).alias("particle"), T.let(T.stripped_words(three), marks).alias("m"), (F.size(suffixed(three)) > 0).alias("suffix"))
    every = F.col("m.respelled") & F.col("suffix") & F.col("m.clause")
    figures = {"l2_connector": F.col("connector"), "l2_particle": F.col("particle"), "l3_respelling": F.col("m.respelled"), "l3_suffix": F.col("suffix"), "l3_clause": F.col("m.clause"), "l3_particle": F.col("m.particle"), "l3_all": every}
    return told.agg(F.count("*").alias("n"), *(F.count_if(test).alias(name) for name, test in figures.items()))


def average_words(rows: DataFrame, levels: tuple[str, ...] = V.LEVELS) -> DataFrame:
    return rows.agg(*(F.coalesce(F.avg(T.word_count(F.col(c))), F.lit(0.0)).alias(c) for c in levels))


#: Bands of the identity rate, in percent.
IDENTITY_BANDS = (10.0, 30.0)


def identity_band(percent: Column) -> Column:
    return F.when(percent < IDENTITY_BANDS[0], "ok").when(percent < IDENTITY_BANDS[1], "high").otherwise("too high")


def full_report(rows: DataFrame, prefix: str = "item_") -> DataFrame:
    """id, severity and rule of everything that is wrong: row by row, and of the dataset as a whole, there with a null id."""
    of_all = lambda df, severity, rule: df.select(F.lit(None).cast("string").alias("id"), F.lit(severity).alias("severity"), rule.alias("rule"))
    shaped = rows.filter(~F.coalesce(id_format(F.col("id"), prefix), F.lit(False))).select("id", F.lit("error").alias("severity"), F.lit("malformed id").alias("rule"))
    ids = duplicates(rows, "id").select(F.col("value").alias("id"), F.lit("error").alias("severity"), F.lit("duplicate id").alias("rule"))
    gaps = of_all(contiguous(rows, "id", prefix).filter("NOT contiguous"), "error", F.lit("ids are not contiguous"))
    twice = duplicates(rows, "original_instruction").agg(F.count("*").alias("n")).filter("n > 0")
    same = identity_rate(rows, V.LEVELS[0], V.LEVELS[1]).filter(F.col("percent") >= IDENTITY_BANDS[1])
    found = [shaped, ids, gaps, of_all(twice, "error", F.concat(F.col("n").cast("string"), F.lit(" duplicate original_instruction"))), of_all(same, "warning", F.format_string("levels 0 and 1 are equal in %.1f%%", "percent")), violations(rows)]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every


#: How many violations of each severity a report shows.
SHOWN = {"error": 60, "warning": 40}


def shown(report: DataFrame) -> DataFrame:
    """The first violations of each severity, by id and rule. The plain bound comes first: Spark keeps no more of a task's rows."""
    place = Window.partitionBy("severity").orderBy("id", "rule")
    most = F.when(F.col("severity") == "error", SHOWN["error"]).otherwise(SHOWN["warning"])
    return report.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= max(SHOWN.values())).filter(F.col("_n") <= most).drop("_n")


def identity_rate(rows: DataFrame, level_0: str, level_1: str) -> DataFrame:
    same = T.strip(F.col(level_0)) == T.strip(F.col(level_1))
    return rows.agg(F.count_if(same).alias("same"), F.count("*").alias("n")).withColumn("percent", F.when(F.col("n") > 0, F.col("same") / F.col("n") * 100).otherwise(0.0))


def category_distribution(rows: DataFrame, targets: DataFrame) -> DataFrame:
    counts = rows.groupBy("category").agg(F.count("*").alias("got"))
    return targets.join(counts, "category", "left").fillna(0, ["got"]).withColumn("delta", F.col("got") - F.col("target"))
