"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A document, lower-cased and with one blank for whatever
is not a letter, is parsed into the fewest phrases that each occur in that text, by always taking the longest match;
phrases run on over words. A language's figure for a document is the number of phrases, times the binary logarithm of the
length of the language's text, over the document's letters: the cross-parsing estimate of entropy. The lowest figure
wins; on a tie, the language that sorts first. The score is the relative distance to the second.

The automata are flat tables, a row for each state. Pieces of PIECE characters of many documents take their steps side by
side, each as if a phrase began with it. Then each piece is parsed again from the state in which the one before ends, until
both parses are in one state, from where on they are the same; a piece in which they never meet passes its own end on. So
the phrases are those of the whole text. A letter that no sample holds is a phrase.

A table has a column for each of the most frequent letters. Where there are more than KINDS, the others are written as two
symbols, a first and a second half; a phrase that ends between the halves ends before the letter, which the table of a
state between halves knows, as all that leads to a state ends with one symbol.

The automata learn from a bounded sample: for each language, the first DOCUMENTS documents in the order of a hash of
their doc_id, of each as many characters from its start as make LETTERS in all, so that no long one takes the place of
others. Keys are ranked first, and no more is collected than those letters. Everything else covers whole texts. A worker
holds the tables of AT_ONCE languages; with more, the texts are read once for each so many.

Repeated rows are one document of the sample. Null text, and text without a letter, is ``und`` with score 0. With no labelled document every text is ``und``; with one
language the score is 1. Repeated rows are judged alike. No documents give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, held, small, stored, unused, with_python

#: Bound of the sample: documents and characters for each language.
DOCUMENTS = 48
LETTERS = 60_000
#: Characters of a piece, and pieces that take their steps at once.
PIECE = 1024
PIECES = 4096
#: Letters with a column of their own; the others have two symbols.
KINDS = 96
#: Languages whose tables a worker holds at once, up to 40 MB each.
AT_ONCE = 16
#: Pieces below which a parse goes symbol by symbol in place of all pieces at once.
FEW = 24
#: Characters of the documents that are parsed together.
BATCH = 2_000_000
UNKNOWN = "und"
#: Below this score, corpus_pipeline takes a document to be of no single language.
MIN_SCORE = 0.02
#: Letters from which on a document is rejected by its score; shorter ones may tie by chance.
MIN_LETTERS = 200


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text: from state 0, exactly its substrings can be read."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


def phrases(moves: list[dict[str, int]], text: str) -> int:
    """Longest matches, one after another; a character that the automaton's text lacks is a phrase. The plain form of Parser."""
    count, at, end = 0, 0, len(text)
    while at < end:
        state, start = 0, at
        while at < end:
            found = moves[state].get(text[at])
            if found is None:
                break
            state = found
            at += 1
        if at == start:
            at += 1
        count += 1
    return count


def samples(docs: DataFrame, documents: int = DOCUMENTS, letters: int = LETTERS) -> dict[str, str]:
    """Sample text of each language. No task sends more keys than documents for a language, and no text is moved before its place is known."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    key = ["lang", "_h", "doc_id", "_t"]
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "_t")
    # rank() gives repeated rows one place, so they are not more than one document
    ranked = stored(learn.select(*key).withColumn("_k", F.dense_rank().over(order)).filter(F.col("_k") <= documents).distinct(), "sample-keys")
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\P{L}+", " "))
    matches = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    chosen = learn.alias("a").join(small(ranked, ranked.count()).alias("b"), matches).groupBy("b.lang", "b._k").agg(F.min(F.substring(plain, 1, letters)).alias("text"))
    kept = stored(chosen, "language-sample")
    drop_stored(ranked)
    sizes: dict[str, list[int]] = {}
    for row in kept.select("lang", F.length("text").alias("n")).collect():  # a number for each document of the sample
        sizes.setdefault(row.lang, []).append(row.n)
    most = {lang: longest_share(n, letters) for lang, n in sizes.items()}
    limits = docs.sparkSession.createDataFrame(list(most.items()), "lang string, most int")
    cut = kept.join(limits, "lang").select("lang", "_k", F.expr("substring(text, 1, most - 1)").alias("text"), "most")
    found: dict[str, list[str]] = {}
    for row in sorted(cut.collect(), key=lambda r: (r.lang, r._k)):
        found.setdefault(row.lang, []).append(row.text)
    drop_stored(kept)
    return {k: v for k, v in sorted((k, shares(texts, letters)) for k, texts in found.items()) if v.strip()}


def longest_share(sizes: list[int], letters: int) -> int:
    """The largest limit, one more than a text's characters, that gives at most that many with a blank before and after each."""
    left, most = letters - 1, 0
    ordered = sorted(n + 1 for n in sizes)
    for k, size in enumerate(ordered):
        most = left // (len(ordered) - k)
        if size > most:
            break
        left, most = left - size, size
    return most


def shares(texts: list[str], letters: int) -> str:
    """The texts with blanks around, those longer than a limit cut to it, the largest limit that gives at most that many characters."""
    most = longest_share([len(t) for t in texts], letters)
    return " " + "".join(t[: most - 1] + " " for t in texts if t and most > 1)


class Alphabet:
    """Symbols of letters: 0 for all that is no letter, then the most frequent letters of the samples, first halves, second halves, and one for letters of no sample."""

    def __init__(self, texts: list[str]) -> None:
        times = Counter("".join(texts))
        times.pop(" ", None)
        ranked = sorted(times, key=lambda c: (-times[c], c))
        whole, rest = ranked[:KINDS], ranked[KINDS:]
        seconds = math.isqrt(len(rest) - 1) + 1 if rest else 0
        firsts = -(-len(rest) // seconds) if rest else 0
        self.first_halves = range(1 + len(whole), 1 + len(whole) + firsts)
        self.second_halves = range(self.first_halves.stop, self.first_halves.stop + seconds)
        self.size = self.second_halves.stop + 1
        every = "".join(map(chr, range(0x110000)))
        self.codes = np.fromiter(map(str.isalpha, every), np.uint16, len(every)) * np.uint16(self.size - 1)
        self.seconds = np.zeros(len(every) if rest else 0, np.uint16)
        for k, c in enumerate(whole):
            self.codes[ord(c)] = 1 + k
        for k, c in enumerate(rest):
            self.codes[ord(c)] = self.first_halves[k // seconds]
            self.seconds[ord(c)] = self.second_halves[k % seconds]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a text, and which of them begin a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.codes[points]
        if not len(self.seconds):
            return codes, np.ones(len(codes), bool)
        second = self.seconds[points]
        halved = second > 0
        if not halved.any():
            return codes, np.ones(len(codes), bool)
        at = np.arange(len(codes)) + np.cumsum(halved) - halved
        out = np.zeros(len(codes) + int(halved.sum()), np.uint16)
        out[at] = codes
        out[at[halved] + 1] = second[halved]
        begins = np.zeros(len(out), bool)
        begins[at] = True
        return out, begins


class Parser:
    """Phrases of many texts at once, in the automaton of one language.

    moves[state + symbol] is 4 * next state + the phrases that end there, with states numbered by their rows' places: a
    symbol that cannot follow ends a phrase and starts the next one, if the automaton's text holds it.
    """

    def __init__(self, text: str, alphabet: Alphabet) -> None:
        size = alphabet.size
        automat = automaton("".join(map(chr, alphabet.of(text)[0])))
        n = len(automat)
        rows = np.repeat(np.arange(n), [len(m) for m in automat])
        symbols = np.fromiter((ord(c) for m in automat for c in m), np.int64, len(rows))
        targets = np.fromiter((t for m in automat for t in m.values()), np.int64, len(rows)) * size
        root = np.full(size, -1, np.int64)
        root[symbols[rows == 0]] = targets[rows == 0]
        columns = np.arange(alphabet.second_halves.start, alphabet.second_halves.stop)
        root[columns] = -1  # no phrase begins with a second half
        # a first half that begins a phrase has a state of its own, as the one it leads to may have other beginnings
        begun = [(first, automat[0][chr(first)]) for first in alphabet.first_halves if chr(first) in automat[0]]
        for k, (first, _) in enumerate(begun):
            root[first] = (n + k) * size
        table = np.empty((n + len(begun), size), np.int32)
        table[:] = np.where(root >= 0, 4 * root + 1, 2)
        if len(columns):
            self._halves(table, automat, begun, columns, size)
        table[rows, symbols] = 4 * targets
        table[0] = np.where(root >= 0, 4 * root, 1)
        table[0, columns] = 0  # of a first half that the text lacks, which has been counted as the letter
        for k, (_, state) in enumerate(begun):
            for symbol, target in automat[state].items():
                table[n + k, ord(symbol)] = 4 * target * size
        self.moves = table.ravel()

    @staticmethod
    def _halves(table: np.ndarray, automat: list[dict[str, int]], begun: list[tuple[int, int]], columns: np.ndarray, size: int) -> None:
        """What a second half does that cannot follow: the phrase ended before its first half, and the letter starts one, or is one.

        Where the phrase began with the first half, the letter alone is one.
        """
        table[len(automat) :, columns] = 1
        letter = {first: np.array([automat[state].get(chr(c), -1) for c in columns]) for first, state in begun}
        for state, first in {t: ord(c) for m in automat for c, t in m.items() if ord(c) in letter}.items():
            table[state, columns] = np.where(letter[first] >= 0, 4 * letter[first] * size + 1, 2)

    def start(self, state: np.ndarray) -> None:
        n = len(state)
        self.state, self.count = state.astype(np.int64), np.zeros(n, np.int32)
        self.at, self.move, self.ended = np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n, np.int32)

    def step(self, symbols: np.ndarray) -> None:
        m = len(symbols)
        move, ended, state = self.move[:m], self.ended[:m], self.state[:m]
        np.add(state, symbols, out=self.at[:m])
        self.moves.take(self.at[:m], out=move, mode="clip")
        np.bitwise_and(move, 3, out=ended)
        self.count[:m] += ended
        np.right_shift(move, 2, out=state)

    def mended(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, follows: np.ndarray, state: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and counts of pieces parsed from where the one before ends. state and count: from a phrase's start, of each piece; follows: pieces that go on from the piece before."""
        fresh_state, fresh_count = state, count
        state, count = state.copy(), count.astype(np.int64)
        todo = np.flatnonzero(follows)
        todo = todo[state[todo - 1] > 0]
        while len(todo):
            before = state[todo]
            state[todo], count[todo] = self._until_met(codes, starts[todo], sizes[todo], state[todo - 1], fresh_state[todo], fresh_count[todo])
            # a piece whose end has changed is what the next one goes on from
            changed = todo[state[todo] != before] + 1
            todo = changed[(changed < len(follows))]
            todo = todo[follows[todo]]
        return state, count

    def _until_met(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, fresh_state: np.ndarray, fresh_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and counts of pieces from states of their own, beside the parse from a phrase's start."""
        n = len(starts)
        end, more = fresh_state.copy(), np.zeros(n, np.int64)
        left, one, two = np.arange(n), own.astype(np.int64), np.zeros(n, np.int64)
        k = 0
        while len(left) > FEW:
            symbols = codes[starts[left] + k]
            a, b = self.moves[one + symbols], self.moves[two + symbols]
            more[left] += (a & 3) - (b & 3)
            one, two = (a >> 2).astype(np.int64), (b >> 2).astype(np.int64)
            k += 1
            out = sizes[left] == k
            end[left[out]] = one[out]
            stays = (one != two) & ~out
            left, one, two = left[stays], one[stays], two[stays]
        moves = memoryview(self.moves)
        for piece, a, b in zip(left.tolist(), one.tolist(), two.tolist(), strict=True):
            difference = 0
            for symbol in codes[starts[piece] + k : starts[piece] + sizes[piece]].tolist():
                a, b = moves[a + symbol], moves[b + symbol]
                difference += (a & 3) - (b & 3)
                a, b = a >> 2, b >> 2
                if a == b:
                    break
            else:
                end[piece] = a
            more[piece] += difference
        return end, fresh_count + more


class Identifier:
    def __init__(self, texts: dict[str, str]) -> None:
        self.names = list(texts)
        self.alphabet = Alphabet(list(texts.values()))
        self.parsers = [Parser(t, self.alphabet) for t in texts.values()]
        self.factor = np.array([math.log2(len(t) + 1) for t in texts.values()])

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its phrases in each language's automaton."""
        low = [(t or "").lower() for t in texts]
        codes, is_letter = self.alphabet.of("\n" + "\n".join(low) + "\n")
        # of each character its first symbol, as a letter may have two
        at = np.append(np.flatnonzero(is_letter), len(codes))
        ends = np.cumsum([len(t) + 1 for t in low])
        begins = at[ends - [len(t) for t in low]]
        ends = at[ends]
        keep = codes > 0
        letters = np.concatenate([[0], np.cumsum(keep & is_letter)])
        total = letters[ends] - letters[begins]
        keep[1:] |= keep[:-1]
        keep[0] = True
        codes, kept = codes[keep], np.cumsum(keep)
        # each text with the blank before it and the one behind it; the start of each piece, those of long pieces first
        sizes = np.where(total > 0, kept[ends] - kept[begins - 1] + 1, 0)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(low)), pieces)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(PIECE, sizes[owner] - place)
        order = np.argsort(-length, kind="stable")
        starts = (kept[begins - 1] - 1)[owner] + place
        state, count = np.zeros((len(self.parsers), len(owner)), np.int64), np.zeros((len(self.parsers), len(owner)), np.int64)
        for low_piece in range(0, len(order), PIECES):
            some = order[low_piece : low_piece + PIECES]
            active = np.searchsorted(-length[some], -np.arange(int(length[some[0]])), "left")
            for p in self.parsers:
                p.start(np.zeros(len(some), np.int64))
            for k, m in enumerate(active.tolist()):
                symbols = codes.take(starts[some[:m]] + k)
                for p in self.parsers:
                    p.step(symbols)
            for k, p in enumerate(self.parsers):
                state[k, some], count[k, some] = p.state, p.count
        follows = place > 0
        last = np.append(~follows[1:], True) if len(owner) else follows
        found = np.zeros((len(self.names), len(low)), np.int64)
        for k, p in enumerate(self.parsers):
            state[k], count[k] = p.mended(codes, starts, length, follows, state[k], count[k])
            # a phrase that a text ends in counts, too
            found[k] = np.bincount(owner, count[k] + (last & (state[k] > 0)), len(low)).astype(np.int64)
        return total, found.T

    def __call__(self, texts: list[str | None]) -> list[list]:
        """Letters of each text, and its figure in each language."""
        totals, figures = [np.empty(0, np.int64)], [np.empty((0, len(self.names)))]
        sizes = np.cumsum([len(t or "") for t in texts])
        for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // BATCH)) + 1) if texts else []:
            total, found = self.counts([texts[k] for k in group])
            totals.append(total)
            figures.append(found * self.factor)
        return [np.concatenate(totals).tolist(), np.concatenate(figures).tolist()]


def verdict(letters: Column, figures: Column, names: list[str]) -> tuple[Column, Column]:
    """The language of the lowest figure, the first on a tie, and the relative distance to the second."""
    lowest = F.array_min(figures)
    place = F.array_position(figures, lowest).cast("int")
    second = F.element_at(F.array_sort(figures), 2)
    near = F.when(second > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lowest / second))).otherwise(0.0)
    score = F.lit(1.0) if len(names) == 1 else near
    return F.when(letters > 0, F.element_at(F.array(*map(F.lit, names)), place)).otherwise(UNKNOWN), F.when(letters > 0, score).otherwise(0.0)


def _maker(texts) -> Callable[[], Identifier]:  # noqa: ANN001  a broadcast of the samples
    key = uuid.uuid4().hex  # a worker that runs several tasks builds the automata once
    return lambda: held(key, lambda: Identifier(texts.value))


def identify(docs: DataFrame, texts: dict[str, str], keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score, under these names, in place of columns that have them; texts, from samples(), are bounded by LETTERS for each language."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    if not texts:
        return docs.select(*(f"`{c}`" for c in kept), F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    listed = sorted(texts)
    groups = [listed[k : k + AT_ONCE] for k in range(0, len(listed), AT_ONCE)]
    text, *columns = unused(docs, "text_", *(f"{c}{k}" for k in range(len(groups)) for c in ("letters", "figures")))
    found, carried = docs.select(*(f"`{c}`" for c in kept), F.col("text").alias(text)), []
    for k, group in enumerate(groups):
        shared = docs.sparkSession.sparkContext.broadcast({n: texts[n] for n in group})
        letters_, figures = columns[2 * k : 2 * k + 2]
        if k:  # a plan with two stages would hold both groups' tables at once
            found = stored(found, "languages")
        found = with_python(found, [text], [*kept, *carried, *([text] if k + 1 < len(groups) else [])], f"`{letters_}` long, `{figures}` array<double>", _maker(shared), rows=1024)
        carried += [letters_, figures]
    lang, score = verdict(F.col(columns[0]), F.concat(*(F.col(c) for c in columns[1::2])), listed)
    return found.select(*(f"`{c}`" for c in kept), lang.alias(names[0]), score.alias(names[1]))
