"""Deriving verifiable constraints from an instruction and its gold answer, and checking responses against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mixlens.functions import text as T
from mixlens.functions import vocabulary as V

CONSTRAINT = "struct<constraint_type:string,requirement:string,verification_regex:string,keywords:array<string>,min_words:bigint,max_words:bigint,format_id:string>"


def keyword_candidates(text: Column) -> Column:
    """Distinct words of four ASCII letters or more that are no stop words, in order of their first occurrence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-zA-Z]{4,}\b"), 0)
    stop = F.array(*map(F.lit, V.STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w)))


def pick_two(candidates: Column, seed: int, key: Column) -> Column:
    """Two of the candidates, the same for the same key; all if there are fewer."""
    drawn = F.array_sort(F.transform(candidates, lambda w: F.struct(F.xxhash64(F.lit(seed), key, w).alias("h"), w.alias("w"))))
    return F.transform(F.slice(drawn, 1, 2), lambda x: x["w"])


def keywords(gold: Column, instruction: Column, category: Column, key: Column, seed: int = 42) -> Column:
    """From the gold answer, else the instruction, else the category's words, else two defaults."""
    pools = F.lit(None).cast("array<string>")
    for name, pool in V.FALLBACK_KEYWORDS.items():
        pools = F.when(category == name, F.array(*map(F.lit, pool))).otherwise(pools)
    sources = [keyword_candidates(gold), keyword_candidates(instruction), pools]
    chosen = F.array(*map(F.lit, V.LAST_KEYWORDS))
    for source in reversed(sources):
        chosen = F.when(F.size(F.coalesce(source, F.array().cast("array<string>"))) > 0, pick_two(source, seed, key)).otherwise(chosen)
    return chosen


def length_range(n_words: Column) -> tuple[Column, Column]:
    """Least and most words for a gold answer of n_words; products are cut off as binary doubles."""
    short = n_words <= 10
    least = F.when(short, F.greatest(F.lit(1), (n_words * F.lit(0.8)).cast("long"))).otherwise(F.greatest(F.lit(10), (n_words * F.lit(0.7)).cast("long")))
    most = F.greatest(least + 10, F.when(short, n_words * 3).otherwise((n_words * F.lit(1.3)).cast("long")))
    return least, most


def format_choice(category: Column, ordinal: Column) -> Column:
    """The format at that ordinal of the category's preferences, wrapping around; any format for other categories."""
    chosen = F.element_at(F.array(*map(F.lit, V.FORMATS)), (F.pmod(ordinal, F.lit(len(V.FORMATS))) + 1).cast("int"))
    for name, given in V.FORMAT_PREFERENCES.items():
        chosen = F.when(category == name, F.element_at(F.array(*map(F.lit, given)), (F.pmod(ordinal, F.lit(len(given))) + 1).cast("int"))).otherwise(chosen)
    return chosen


def keyword_requirement(terms: Column) -> Column:
    head, tail = V.KEYWORD_REQUIREMENT.split("{}")
    return F.concat(F.lit(head), F.array_join(terms, ", "), F.lit(tail))


def length_requirement(least: Column, most: Column) -> Column:
    a, b, c = V.LENGTH_REQUIREMENT.split("{}")
    return F.concat(F.lit(a), least.cast("string"), F.lit(b), most.cast("string"), F.lit(c))


def format_requirement(format_id: Column) -> Column:
    return _by_format(format_id, 0)


def _by_format(format_id: Column, part: int) -> Column:
    found = F.lit(None).cast("string")
    for name, values in V.FORMATS.items():
        found = F.when(format_id == name, values[part]).otherwise(found)
    return found


def keyword_regex(terms: Column) -> Column:
    escaped = F.transform(terms, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.concat(F.lit("(?=.*"), F.array_join(escaped, ")(?=.*"), F.lit(")"))


def derive(instruction: Column, gold: Column, category: Column, key: Column, types: tuple[str, ...] = V.CONSTRAINT_TYPES, seed: int = 42) -> Column:
    """Array of constraints of the enabled types, in the order keyword, length, format."""
    gold = F.coalesce(gold, F.lit(""))
    terms = keywords(gold, instruction, category, key, seed)
    n = T.word_count(gold)
    drawn = [F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed + k), key), F.lit(3)) + 1).cast("int")).cast("long") for k, options in enumerate(((30, 50, 75), (20, 30, 50)))]
    low, high = length_range(n)
    least = F.when(gold != "", low).otherwise(drawn[0])
    most = F.when(gold != "", high).otherwise(drawn[0] + drawn[1])
    chosen = format_choice(category, F.pmod(F.xxhash64(F.lit(seed + 2), key), F.lit(1 << 20)))
    none = {"s": F.lit(None).cast("string"), "a": F.lit(None).cast("array<string>"), "n": F.lit(None).cast("long")}
    made = {
        "keyword": (keyword_requirement(terms), keyword_regex(terms), terms, none["n"], none["n"], none["s"]),
        "length": (length_requirement(least, most), none["s"], none["a"], least, most, none["s"]),
        "format": (format_requirement(chosen), _by_format(chosen, 1), none["a"], none["n"], none["n"], chosen),
    }
    return F.array(*(F.struct(F.lit(t), *made[t]).cast(CONSTRAINT) for t in V.CONSTRAINT_TYPES if t in types)).cast(f"array<{CONSTRAINT}>")


def embed(instruction: Column, requirements: Column) -> Column:
    return F.concat_ws("\n", F.array(T.strip(instruction)), requirements)


def keywords_found(response: Column, terms: Column) -> Column:
    low = F.lower(response)
    return F.filter(terms, lambda w: F.contains(low, F.lower(w)))


def check_keywords(response: Column, terms: Column) -> Column:
    low = F.lower(response)
    return F.forall(terms, lambda w: F.contains(low, F.lower(w)))


def check_keyword(response: Column, terms: Column, regex: Column) -> Column:
    """By the pattern, whatever the case and over lines; one that only asks for the terms, or none, by the terms themselves."""
    given = F.coalesce(regex, F.lit(""))
    by_terms = F.coalesce(check_keywords(response, terms), given == "")
    own = (given == "") | F.coalesce(given == keyword_regex(terms), F.lit(False))
    return F.when(own, by_terms).otherwise(F.rlike(response, F.concat(F.lit("(?isuU)"), given)))


def check_length(response: Column, least: Column, most: Column) -> Column:
    return T.word_count(response).between(least, most)


def check_format(response: Column, format_id: Column, own_regex: Column | None = None) -> Column:
    """By the constraint's own pattern where it has one, else by the format's; an unknown format without a pattern fails.

    Lists are looked for at the start of each line; a JSON text passes whatever its own pattern.
    """
    flags = {"json": "(?sdU)", "numbered_list": "(?mdU)", "bullet_list": "(?mdU)"}
    given = F.coalesce(own_regex, F.lit("")) if own_regex is not None else F.lit("")
    searched = lambda kind: F.rlike(response, F.concat(F.lit(flags.get(kind, "(?dU)")), given))
    passed = F.when(given != "", searched("")).otherwise(False)
    for name, (_, pattern) in V.FORMATS.items():
        # the format's own pattern stays a literal, which is compiled once
        fixed = T.is_json(response) if name == "json" else response.rlike(flags.get(name, "(?dU)") + pattern)
        if own_regex is not None:
            by_own = searched(name) | T.parses_as_json(response) if name == "json" else searched(name)
            fixed = F.when(given.isin("", pattern), fixed).otherwise(by_own)
        passed = F.when(format_id == name, fixed).otherwise(passed)
    return passed


def check(response: Column, constraint: Column) -> Column:
    """type, passed and details of one constraint; an unknown type fails."""
    kind = constraint["constraint_type"]
    terms = F.coalesce(constraint["keywords"], F.array().cast("array<string>"))
    of = lambda name, value: F.when(kind == name, value)

    def told(n_words: Column) -> Column:
        passed = of("keyword", check_keyword(response, constraint["keywords"], constraint["verification_regex"]))
        passed = F.coalesce(passed, of("length", n_words.between(constraint["min_words"], constraint["max_words"])))
        passed = F.coalesce(passed, of("format", check_format(response, constraint["format_id"], constraint["verification_regex"])), F.lit(False))
        return T.let(passed, lambda ok: F.struct(kind.alias("type"), ok.alias("passed"), details(n_words, ok).alias("details")))

    def details(n_words: Column, ok: Column) -> Column:
        low = F.lower(response)
        missing = F.transform(F.filter(terms, lambda w: ~F.contains(low, F.lower(w))), lambda w: F.concat(F.lit("'"), w, F.lit("'")))
        worded = F.when(ok, "All keywords found").otherwise(F.concat(F.lit("Missing: ["), F.array_join(missing, ", "), F.lit("]")))
        sized = F.format_string("%d words (range %d-%d)", n_words, constraint["min_words"], constraint["max_words"])
        shaped = F.concat(F.lit("Format '"), constraint["format_id"], F.lit("': "), F.when(ok, "pass").otherwise("fail"))
        return F.coalesce(of("keyword", worded), of("length", sized), of("format", shaped), F.concat(F.lit("Unknown type: "), kind))

    return T.let(of("length", T.word_count(response)), told)


def check_all(response: Column, constraints: Column) -> Column:
    return F.transform(constraints, lambda c: check(response, c))


def pass_rate(results: Column) -> Column:
    """Share of constraints passed; 1 if there is none."""
    n = F.size(F.coalesce(results, F.array().cast("array<struct<type:string,passed:boolean,details:string>>")))
    return F.when(n > 0, F.size(F.filter(results, lambda r: r["passed"])) / n).otherwise(1.0)
