"""Rewriting text at the four levels: lexicon, particles, sentence case, and restoring constraint lines.

Draws are columns given by the caller or uniform numbers of the key, never a running generator.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mixlens.functions import text as T
from mixlens.functions import vocabulary as V


#: Characters that meet an ASCII letter when case is ignored, and these letters.
_FOLDS = ("\u017f\u212a\u0130\u0131", "skii")
_BETWEEN = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def lexicon_rewrite(text: Column, accepted: Sequence[Column | bool] | None = None, lexicon: Sequence[tuple[str, str]] | None = None) -> Column:
    """Replace each accepted entry's word wherever it stands, in order: later entries see what earlier ones wrote.

    Where every entry is one word for another, the text is cut into words once, and each word that an entry names goes
    through the entries that it can meet, which are worked out beforehand. Other lexicons take a pass for each entry.
    """
    lexicon = V.LEXICON if lexicon is None else lexicon
    if not lexicon:
        return text
    if not all(re.fullmatch("[a-z0-9_]+", a) and re.fullmatch(r"\w+", b, re.ASCII) for a, b in lexicon):
        return cascade(text, accepted, lexicon)
    named = sorted({a for a, _ in lexicon})
    if accepted is None or all(isinstance(x, bool) for x in accepted):
        return _one_pass(text, lexicon, named, [True] * len(lexicon) if accepted is None else list(accepted))
    taken = F.array(*(F.lit(x) if isinstance(x, bool) else x for x in accepted))
    return T.let(taken, lambda t: _one_pass(text, lexicon, named, [F.element_at(t, k + 1) for k in range(len(lexicon))]))


def _one_pass(text: Column, lexicon: Sequence[tuple[str, str]], named: list[str], taken: list[Column | bool]) -> Column:
    def outcome(word: str, low: int, otherwise: Column) -> Column:
        """What becomes of a word from entry low on: that word itself, or what the next entry for it makes of it."""
        at = next((k for k in range(low, len(lexicon)) if lexicon[k][0] == word.lower()), None)
        if at is None:
            return otherwise
        after = outcome(lexicon[at][1], at + 1, F.lit(lexicon[at][1]))
        if isinstance(taken[at], bool):
            return after if taken[at] else outcome(word, at + 1, otherwise)
        return F.when(taken[at], after).otherwise(outcome(word, at + 1, otherwise))

    def replaced(token: Column) -> Column:
        key = F.lower(F.translate(token, *_FOLDS))

        def chosen(k: Column) -> Column:
            found = token
            for word in named:
                found = F.when(k == word, outcome(word, 0, token)).otherwise(found)
            return found

        return F.when(key.isin(*named), T.let(key, chosen)).otherwise(token)

    return F.array_join(F.transform(F.split(text, _BETWEEN), replaced), "")


def cascade(text: Column, accepted: Sequence[Column | bool] | None, lexicon: Sequence[tuple[str, str]]) -> Column:
    """The same for any lexicon, whose words may be patterns: a pass over the text for each entry."""
    for k, (formal, colloquial) in enumerate(lexicon):
        pattern = F.lit(rf"(?iuU)\b{formal}\b")
        take = True if accepted is None else accepted[k]
        if take is False:
            continue
        if take is not True:  # a pattern that never matches leaves the text as it is, and names it once only
            pattern = F.when(take, pattern).otherwise(r"(?!)")
        text = F.regexp_replace(text, pattern, F.lit(colloquial.replace("\\", r"\\").replace("$", r"\$")))
    return text


def draws(key: Column, seed: int, odds: float, count: int) -> list[Column]:
    return [T.uniform(seed + k, key) < odds for k in range(count)]


def has_particle(text: Column, marks: str = ".,!?;:") -> Column:
    return F.arrays_overlap(T.stripped_words(text, marks), F.array(*map(F.lit, V.PARTICLES)))


def add_particle(text: Column, particle: Column, accepted: Column) -> Column:
    """Append the particle and a full stop, in place of a closing mark, unless a particle is there."""


    def spoken(t: Column) -> Column:
        ended = F.concat(F.regexp_replace(T.rstrip(t), r"[.!?]\z", ""), F.lit(" "), particle, F.lit("."))
        return F.when(~F.coalesce(has_particle(t), F.lit(False)) & accepted, ended).otherwise(t)

    return T.let(text, spoken)


def particle_of(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, V.PARTICLES)), (F.pmod(ordinal, F.lit(len(V.PARTICLES))) + 1).cast("int"))


def lower_sentences(text: Column, accepted) -> Column:  # noqa: ANN001  a function from the sentence's place to a boolean column
    """Lower-case the first letter of accepted sentences after the first; sentences are joined by one blank."""
    parts = F.split(T.strip(text), rf"(?<=[.!?]){T.SPACE}+")
    made = F.transform(parts, lambda s, k: F.when((k > 0) & accepted(k), F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))).otherwise(s))
    return F.array_join(made, " ")


def level_2(text: Column, key: Column, seed: int = 42) -> Column:
    return add_particle(text, particle_of(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20))), T.uniform(seed + 1, key) < 0.65)


def level_3(text: Column, key: Column, seed: int = 42) -> Column:
    mixed = lexicon_rewrite(text, draws(key, seed + 100, 0.45, len(V.LEXICON)))
    spoken = add_particle(mixed, particle_of(F.pmod(F.xxhash64(F.lit(seed + 2), key), F.lit(1 << 20))), T.uniform(seed + 3, key) < 0.80)
    return lower_sentences(spoken, lambda k: T.uniform(seed + 4, key, k) < 0.25)


def enforce_lines(text: Column, requirements: Column) -> Column:
    """The text without its constraint lines and what follows an inline one, then each requirement on a line of its own."""
    kept = F.filter(T.lines(text), lambda line: ~T.strip(line).rlike("(?iuU)" + V.CONSTRAINT_LINE))
    opener = "(?iuU)" + V.CONSTRAINT_OPENER

    def cut(body: Column) -> Column:
        before = F.regexp_extract(body, "(?isuU)\\A(.*?)" + V.CONSTRAINT_OPENER, 1)
        return F.when(body.rlike(opener) & (T.strip(before) != ""), T.rstrip(before)).otherwise(body)

    body = T.let(T.strip(F.array_join(kept, "\n")), cut)
    return F.concat(body, F.array_join(F.transform(requirements, lambda r: F.concat(F.lit("\n"), r)), ""))
