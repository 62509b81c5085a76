"""Secret scans: fixed patterns, and values in credential context that are costly to guess.

The cost of a value, in bits, is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks
and brute-force spans, found by dynamic programming over the whole value:

* a word costs the logarithm of its rank, and more for capitals and for digits in place of letters
* a date, and a year, cost the days of about 120 years
* a repeat of a unit of at most PERIOD characters, to any length, costs its unit by brute force and REPEAT_BITS
* a walk along a row of the keyboard, of three keys or more, costs WALK_BITS
* a brute-force span costs the characters of its kind: lower or upper case, both, or both with digits
* each segment but the first costs SEGMENT_BITS

Words are those of a public tokenizer's vocabulary, whose numbers follow their frequency, before them common passwords.
A value after a credential name that costs MIN_BITS or more is added as a span of kind ``guess`` unless it overlaps a
span of the patterns.

Null and empty text has no spans. Repeated rows are scanned alike. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from mixlens.llm.common import with_python

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 50.0
#: What each further segment costs: where it starts and which kind it is.
SEGMENT_BITS = 3.0
#: Days of about 120 years.
DATE_BITS = math.log2(365 * 120)
#: Longest unit of a repeat, and how often it comes.
PERIOD = 8
REPEAT_BITS = 6.0
#: A key of 47, a direction and a length.
WALK_BITS = math.log2(47 * 2 * 32)
WALK = 3
#: Bounds of a word's letters.
WORD_LETTERS = (3, 16)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_ONLY = bytes(ord("x") if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|secret|auth|signing)[ _-]?key|auth(?:orization)?|bearer|credentials?|login)["']?\s{0,8}[:=]{1,2}>?\s{0,8}["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
#: Common passwords and parts of passwords, most used first.
COMMON = """
password admin welcome qwerty login letmein dragon monkey football baseball master shadow sunshine princess superman batman
trustno iloveyou hello freedom whatever charlie michael jordan hunter ranger buster thomas robert soccer killer george
andrew michelle jessica pepper daniel access joshua maggie starwars silver william dallas yankees hockey secret test guest
root user default changeme summer winter spring autumn january february march april june july august september october
november december monday tuesday wednesday thursday friday saturday sunday love money computer internet server database
company office system service example sample demo token key pass null none true false string value your here
""".split()
#: Rows of a keyboard, and the alphabet and digits, read either way.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")

_LEET = str.maketrans("40@31!05$7", "aoaeiiosst")
_DATES = [
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
]
_PAIRS = {row[k : k + 2] for line in WALKS for row in (line, line[::-1]) for k in range(len(line) - 1)}
_WORD = re.compile(rf"\W?([a-z]{{{WORD_LETTERS[0]},{WORD_LETTERS[1]}}})$", re.A)


def word_ranks(vocabulary: str | None) -> dict[str, int]:
    """Ranks of words: common passwords, then the words of a tokenizer file in the order of their numbers.

    Its size is bounded by the vocabulary. Without a file there are the common passwords alone.
    """
    ranked = list(COMMON)
    if vocabulary:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(vocabulary).get_vocab()
        marked = ((k, _WORD.match(token.lower().encode("ascii", "replace").decode())) for token, k in found.items())
        ranked += [w for _, w in sorted((k, m[1]) for k, m in marked if m)]
    return {w: k + 1 for k, w in enumerate(dict.fromkeys(ranked))}


def _char_bits(c: str) -> float:
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log2(1000)


def _span_bits(c: str) -> tuple[float, ...]:
    """Bits of a character in brute-force spans of one case, lower or upper, of both, and of both with digits."""
    bits = _char_bits(c)
    if not (c.isascii() and c.isalnum()):
        return bits, bits, bits, bits
    both = math.inf if c.isdigit() else math.log2(52)
    return math.inf if c.isupper() else bits, math.inf if c.islower() else bits, both, math.log2(62)


def _words_at(value: str, low: str, plain: str, i: int, ranks: dict[str, int]) -> Iterator[tuple[int, float]]:
    """Ends and bits of the words that start at i, as written or with letters in place of digits and signs."""
    for end in range(i + WORD_LETTERS[0], min(i + WORD_LETTERS[1], len(value)) + 1):
        for form, extra in ((low[i:end], 0.0), (plain[i:end], 1.0)):
            if rank := ranks.get(form):
                capitals = sum(map(str.isupper, value[i:end]))
                yield end, math.log2(rank) + extra + (capitals and (1 if capitals in (1, end - i) else capitals + 1))


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest segmentation; linear in the value's length, as words, dates and units of repeats are bounded."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters are longer in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    bits = [_char_bits(c) for c in value]
    sums = [0.0, *accumulate(bits)]
    closed = [math.inf] * (n + 1)  # best cost up to i, with a segment's end there
    closed[0] = 0.0
    brute = [math.inf] * 4  # inside a span of each kind
    repeat = [math.inf] * (PERIOD + 1)  # inside a repeat of each period, its unit being over
    walk = math.inf  # inside a walk of WALK keys or more
    starts: list[float] = []
    for i in range(n):
        start = closed[i] + (SEGMENT_BITS if i else 0.0)
        starts.append(start)
        for end, cost in _words_at(value, low, plain, i, ranks):
            closed[end] = min(closed[end], start + cost)
        for date in _DATES:
            if found := date.match(value, i):
                closed[found.end()] = min(closed[found.end()], start + DATE_BITS)
        # what the character at i continues
        brute = [min(was, start) + more for was, more in zip(brute, _span_bits(value[i]), strict=True)]
        for p in range(1, min(PERIOD, i) + 1):
            if value[i] != value[i - p]:
                repeat[p] = math.inf
            else:
                repeat[p] = min(repeat[p], starts[i - p] + sums[i] - sums[i - p] + REPEAT_BITS)
        steps = [low[k - 1 : k + 1] in _PAIRS for k in range(max(1, i - WALK + 2), i + 1)]
        if not (steps and steps[-1]):
            walk = math.inf
        elif len(steps) == WALK - 1 and all(steps):
            walk = min(walk, starts[i - WALK + 1] + WALK_BITS)
        closed[i + 1] = min(closed[i + 1], walk, *brute, *repeat)
    return closed[n]


def _hex_spans(text: str) -> list[tuple[int, int]]:
    flat = text.encode("ascii", "replace").translate(_HEX_ONLY)  # a byte for each code point
    if b"x" * 24 not in flat:
        return []
    return [m.span() for m in _HEX.finditer(text) if m.end() - m.start() >= 24]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(a, 2, b) for a, b in _hex_spans(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, int], min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    """Values in credential context that cost min_bits or more; base is sorted."""
    if "=" not in text and ":" not in text:
        return []
    found = []
    starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    for m in _CONTEXT.finditer(text):
        a, b = m.span(1)
        value = text[a:b].rstrip(".)]}")
        b = a + len(value)
        before = bisect_left(starts, b)  # spans of the base that start before b; one of them may reach over a
        if len(value) >= 6 and not (before and reach[before - 1] > a) and guess_bits(value, ranks) >= min_bits:
            found.append((a, 3, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scanner(ranks: dict[str, int]):
    def scan_texts(texts: list[str | None]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for text in texts:
            base = base_spans(text or "")
            row = [sum(k == n for _, k, _ in base) for n in range(3)]
            row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + guessed_spans(text or "", base, ranks))]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return scan_texts


def scan(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to docs. vocabulary is the path of a tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(vocabulary))
    return with_python(docs, ["text"], docs.columns if keep is None else keep, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", lambda: _scanner(shared.value))
