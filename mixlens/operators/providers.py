"""Text generation and embedding behind two small interfaces, called for whole partitions with retry and rate limits."""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.functions import vocabulary as V
from mixlens.operators.calls import CONCURRENCY, INFERENCE, WRITING, Lane, Pace, Waits, error_kind, jitter_of, lanes
from mixlens.shipping import ship

#: Texts that an embedder gets at once, and numbers that a partition keeps of references.
EMBED_BATCH = 64
EMBED_NUMBERS = 20_000_000
RESULT = "response string, success boolean, tokens_used int, latency_ms long, error string, error_type string"


class Generator(Protocol):
    def generate(self, prompt: str) -> tuple[str, int]:
        """Text and number of tokens; raises on failure."""


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text a row of unit length for each token, special tokens included."""


class Rewriter(Protocol):
    def rewrite(self, level: int, instruction: str, prompt: str) -> str:
        """The instruction at a level; prompt is what a model is asked. Raises on failure."""


class GoldWriter(Protocol):
    def answer(self, instruction: str) -> str:
        """An answer that meets the instruction's constraints, at temperature 0; raises on failure."""


class EchoGenerator:
    """Offline stand-in: the prompt, unchanged."""

    def generate(self, prompt: str) -> tuple[str, int]:
        return prompt, len(prompt.split())


class HashEmbedder:
    """Offline stand-in: a unit vector for each token from its hash, between two special tokens."""

    def __init__(self, size: int = 16, most: int = 512) -> None:
        self.size, self.most = size, most

    def embed(self, text: str) -> np.ndarray:
        tokens = ["<s>", *text.lower().split()[: self.most - 2], "</s>"]
        rows = np.stack([np.frombuffer(hashlib.sha256(t.encode()).digest()[: self.size], np.uint8).astype(float) - 127.5 for t in tokens])
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [self.embed(t) for t in texts]


class Embeddings:
    """Vectors of texts from an embedder that is asked for batches of texts of like length.

    Those of references stay for later frames, as a sample's answer comes with every model and level; the ones that were
    asked for the longest ago go when there are more numbers than bound.
    """

    def __init__(self, embedder: Embedder, batch: int = EMBED_BATCH, bound: int = EMBED_NUMBERS) -> None:
        self.embedder, self.batch, self.bound = embedder, batch, bound
        self.known: OrderedDict[str, np.ndarray] = OrderedDict()
        self.numbers = 0

    def scores(self, references: list[str], others: list[str]) -> list[float]:
        """The greedy match of each pair. The others' vectors live as long as their batch."""
        wanted = dict.fromkeys(references)
        for text, found in self._embedded([t for t in wanted if t not in self.known]):
            self.known[text] = found
            self.numbers += found.size
        pairs: dict[str, list[int]] = {}
        for k, t in enumerate(others):
            pairs.setdefault(t, []).append(k)
        out = [0.0] * len(others)
        for text, found in self._embedded([t for t in pairs if t not in self.known]):
            for k in pairs[text]:
                out[k] = greedy_f1(self.known[references[k]], found)
        for text in pairs.keys() & self.known.keys():
            for k in pairs[text]:
                out[k] = greedy_f1(self.known[references[k]], self.known[text])
        for text in wanted:
            self.known.move_to_end(text)
        while self.numbers > self.bound and self.known:
            self.numbers -= self.known.popitem(last=False)[1].size
        return out

    def _embedded(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Each text with its vectors; a batch has texts of like length, so a model fills up little."""
        texts = sorted(texts, key=len)
        for low in range(0, len(texts), self.batch):
            part = texts[low : low + self.batch]
            yield from zip(part, self.embedder.embed_batch(part), strict=True)


def greedy_f1(reference: np.ndarray, candidate: np.ndarray) -> float:
    """F1 of best matches both ways; the first and last token do not count unless a text has no others."""
    one, two = (x[1:-1] if len(x) > 2 else x for x in (reference, candidate))
    if not len(one) or not len(two):
        return 0.0
    sims = one @ two.T
    recall, precision = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    return float(max(0.0, 2 * precision * recall / (precision + recall))) if precision + recall > 0 else 0.0


def call(generator: Generator, prompt: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[str, int], float] | None = None, pace: Pace | None = None, waits: Waits = INFERENCE) -> tuple:
    """One result row; failures become typed rows, never exceptions. jitter gives a number from 0 to 1 to a prompt and an attempt."""
    began, last = time.perf_counter(), ""
    for attempt in range(1, retries + 1):
        try:
            if pace is not None:
                pace.wait()
            text, tokens = generator.generate(prompt)
            if text.strip():
                return text, True, tokens, round((time.perf_counter() - began) * 1000), None, None
            last = "empty completion"
        except Exception as e:  # noqa: BLE001  whatever a provider raises is a failed call
            last = str(e)
        if attempt < retries:
            sleep(waits.seconds(error_kind(last), attempt, jitter(prompt, attempt) if jitter else 0.0))
    return "", False, 0, round((time.perf_counter() - began) * 1000), last, error_kind(last)


def infer(prompts: DataFrame, make: Callable[..., Generator], column: str = "prompt", partitions: int | None = None, per_minute: float | None = None, retries: int = 3, concurrency: int = CONCURRENCY, by: str | None = None) -> DataFrame:
    """Add the result columns.

    Each partition has so many calls under way at once, and its share of the rate limit holds for all of them, attempts
    again included. by names a column of models: make is then given its value.
    """
    ship(prompts.sparkSession)
    dealt, share = lanes(prompts, partitions, per_minute)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = Lane(make, concurrency, share)
        one = lambda prompt, *key: call(lane.connector(*key), prompt, retries, jitter=jitter_of, pace=lane.pace)
        for frame in frames:
            rows = list(lane.run(one, zip(frame[column], *([frame[by]] if by else []), strict=True)))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", " + RESULT
    return dealt.mapInPandas(run, schema)


def infer_into(prompts: DataFrame, make: Callable[..., Generator], path: str, key: list[str], partitions: int = 8, calls_per_task: int = 2 * CONCURRENCY, per_minute: float | None = None, **options: object) -> int:
    """Ask every prompt and append the answers to JSON lines at path, task by task; returns how many prompts there were.

    A task asks calls_per_task prompts, and its answers are in place as soon as it ends: a crash of executors or driver
    loses what the tasks under way have asked, never more, and a run over the prompts without a record asks the rest.
    Without a rate limit all tasks are one job. With one, rounds of as many tasks as share the rate follow each other, so
    that no cluster, however large, runs more of them at once.
    """
    from mixlens.sources.tables import append_lines, drop_stored, stored

    kept = stored(prompts, "prompts")
    total = kept.count()
    tasks = max(1, -(-total // calls_per_task))
    rounds = max(1, -(-tasks // partitions)) if per_minute else 1
    dealt = stored(kept.withColumn("_round", F.pmod(F.xxhash64(*key), F.lit(rounds))), "rounds", by="_round") if rounds > 1 else kept
    for k in range(rounds if total else 0):
        part = dealt.filter(F.col("_round") == k).drop("_round") if rounds > 1 else dealt
        append_lines(infer(part, make, partitions=partitions if per_minute else tasks, per_minute=per_minute, **options), path)
    drop_stored(kept)
    if rounds > 1:
        drop_stored(dealt)
    return total


def embedding_f1(pairs: DataFrame, make: Callable[[], Embedder], reference: str, response: str, name: str = "bert_f1", batch: int = EMBED_BATCH) -> DataFrame:
    """Add the greedy match F1 of two text columns, null being empty; texts go to the embedder in batches by length."""
    ship(pairs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embeddings = Embeddings(make(), batch)
        for frame in frames:
            yield frame.assign(**{name: embeddings.scores(frame[reference].fillna("").tolist(), frame[response].fillna("").tolist())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", {name} double"
    return pairs.mapInPandas(run, schema)


def vectors_f1(pairs: DataFrame, reference: str, response: str, name: str = "f1") -> DataFrame:
    """Add the greedy match F1 of two columns of vectors, whatever their length: one for each token, or one alone."""
    ship(pairs.sparkSession)

    def unit(x: np.ndarray) -> np.ndarray:
        rows = np.array([np.asarray(v, float) for v in x]) if len(x) and not np.isscalar(x[0]) else np.atleast_2d(np.asarray(x, float))
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(size > 0, size, 1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: [greedy_f1(unit(a), unit(b)) for a, b in zip(frame[reference], frame[response], strict=True)]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", {name} double"
    return pairs.mapInPandas(run, schema)


def attempt(ask: Callable[[], str], label: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep, pace: Pace | None = None, waits: Waits = WRITING) -> str:
    """The stripped and unquoted text of the first call that gives one; RuntimeError when all have failed."""
    last = ""
    for k in range(1, retries + 1):
        try:
            if pace is not None:
                pace.wait()
            text = ask().strip()
            if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
                text = text[1:-1].strip()
            if text:
                return text
            last = "empty completion"
        except Exception as e:  # noqa: BLE001  whatever a provider raises is a failed call
            last = str(e)
        if k < retries:
            sleep(waits.seconds(error_kind(last), k, jitter_of(label, k)))
    raise RuntimeError(f"{label} failed after {retries} attempts: {last}")


def filled(templates: dict | None, level: int, instruction: str) -> str:
    """What a model is asked: the level's template around the instruction, the shared rules before and after."""
    if templates is None:
        return instruction.strip()
    shared = templates.get("shared", {})
    user = templates[f"level_{level}"]["user"].format(instruction=instruction.strip())
    return "\n\n".join(x for x in (str(shared.get("system", "")).strip(), user, str(shared.get("output_format", "")).strip()) if x)


class RuleRewriter:
    """Offline stand-in for a model that meets what each level asks for, by fixed swaps.

    Level 1 borrows one noun; level 2 puts an affix to an English verb and adds a connector; level 3 adds a respelled
    word, an English clause and a root with an English suffix. Constraint lines stay as they are, at the end.
    """

    #: Words of an instruction and what stands for them, in the order they are tried.
    NOUNS = (("unduh", "download"), ("unggah", "upload"), ("surel", "email"), ("daring", "online"), ("berkas", "file"), ("peladen", "server"), ("luring", "offline"), ("pranala", "link"))
    VERBS = (("periksa", "direview"), ("unggah", "diupload"), ("tampilkan", "didisplay"), ("bagikan", "dishare"), ("hitung", "dicalculate"), ("tuliskan", "diwrite"), ("tulis", "diwrite"), ("jelaskan", "diexplain"), ("sebutkan", "dilist"), ("rangkum", "disummarize"), ("buat", "dicreate"))
    OPENERS = ("Cek", "Apdet", "Rili", "Litereli", "Oke", "Nais", "Rait", "Greit", "Meik sure")
    ROOTS = ("cepatly", "jelasly", "jujurly", "rapily", "lengkaply")
    CONNECTOR = "basically"
    CLAUSE = "so please make sure the answer is clear"

    @staticmethod
    def _swapped(text: str, pairs: tuple) -> str | None:
        for word, other in pairs:
            made, n = re.subn(rf"\b{word}\b", other, text, count=1, flags=re.IGNORECASE)
            if n:
                return made
        return None

    def rewrite(self, level: int, instruction: str, prompt: str) -> str:
        lines = instruction.strip().splitlines()
        tail = [x for x in lines if re.match(V.CONSTRAINT_LINE, x.strip(), re.IGNORECASE)]
        body = " ".join(x.strip() for x in lines if x.strip() and x not in tail)
        if level == 0:
            return "\n".join([body, *tail])
        if level == 1:
            return "\n".join([self._swapped(body, self.NOUNS) or body, *tail])
        fused = self._swapped(body, self.VERBS) or f"Tolong direview: {body}"
        head, comma, rest = fused.partition(", ")
        fused = f"{head}, {self.CONNECTOR} {rest}" if comma else f"{fused.rstrip('.')}, {self.CONNECTOR}."
        if level == 2:
            return "\n".join([fused, *tail])
        pick = int.from_bytes(hashlib.sha256(body.encode("utf-8", "surrogatepass")).digest()[:4], "little")
        spoken = f"{self.OPENERS[pick % len(self.OPENERS)]}, {fused[:1].lower()}{fused[1:]}".rstrip(".!?")
        return "\n".join([f"{spoken}, {self.ROOTS[pick // 16 % len(self.ROOTS)]}, {self.CLAUSE}.", *tail])


class KeywordGold:
    """Offline stand-in: the instruction's own words, with the keywords and the number of words that its constraints ask for."""

    def answer(self, instruction: str) -> str:
        lines = instruction.strip().splitlines()
        asked = [x for x in lines if re.match(V.CONSTRAINT_LINE, x.strip(), re.IGNORECASE)]
        words = [w for x in lines if x not in asked for w in x.split()] or ["jawaban"]
        terms, least = [], 1
        for x in asked:
            if found := re.search(V.KEYWORD_TERMS, x, re.IGNORECASE):
                terms = [t.strip() for t in found[1].split(",") if t.strip()]
            elif found := re.search(V.LENGTH_RANGE, x):
                least = int(found[1])
        body = [*terms, *words]
        return " ".join((body * (least // len(body) + 1))[: max(least, len(terms))])


class EndpointRewriter:
    """A model behind an endpoint; the prompt holds the level's template."""

    def __init__(self, endpoint: Generator) -> None:
        self.endpoint = endpoint

    def rewrite(self, level: int, instruction: str, prompt: str) -> str:
        return self.endpoint.generate(prompt)[0]


class EndpointGold:
    """Answers of a model behind an endpoint, which is to be asked at temperature 0."""

    def __init__(self, endpoint: Generator) -> None:
        self.endpoint = endpoint

    def answer(self, instruction: str) -> str:
        return self.endpoint.generate(instruction.strip())[0]


def rewrite_with(rows: DataFrame, make: Callable[[], Rewriter], text: str, templates: dict | None = None, retries: int = 3, partitions: int | None = None, per_minute: float | None = None, concurrency: int = CONCURRENCY) -> DataFrame:
    """Add the four levels, error and error_type, several rows of a partition at once.

    Levels 1 to 3 are written from level 0, which falls back to the input. Another level that fails leaves the row failed.
    """
    ship(rows.sparkSession)
    dealt, share = lanes(rows, partitions, per_minute)

    def one(lane: Lane, given: str) -> list[str | None]:
        levels: list[str | None] = []
        asked = lambda level, text: attempt(lambda: lane.connector().rewrite(level, text, filled(templates, level, text)), f"level {level}", retries, pace=lane.pace)
        try:
            levels.append(asked(0, given))
        except RuntimeError:
            levels.append(given.strip())
        try:
            for level in range(1, len(V.LEVELS)):
                levels.append(asked(level, levels[0]))
        except RuntimeError as e:
            return [*levels, *[None] * (len(V.LEVELS) - len(levels)), str(e), error_kind(str(e))]
        return [*levels, None, None]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = Lane(make, concurrency, share)
        for frame in frames:
            made = pd.DataFrame(list(lane.run(one, ((lane, t or "") for t in frame[text]))), columns=[*V.LEVELS, "error", "error_type"], dtype=object)
            yield pd.concat([frame.reset_index(drop=True), made], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", " + ", ".join(f"{c} string" for c in [*V.LEVELS, "error", "error_type"])
    return dealt.mapInPandas(run, schema)


def gold_with(rows: DataFrame, make: Callable[[], GoldWriter], text: str, name: str = "gold_response", retries: int = 3, partitions: int | None = None, per_minute: float | None = None, concurrency: int = CONCURRENCY) -> DataFrame:
    """Add an answer to each constrained instruction, with error and error_type, null where it succeeded."""
    ship(rows.sparkSession)
    dealt, share = lanes(rows, partitions, per_minute)

    def one(lane: Lane, given: str) -> list[str | None]:
        try:
            return [attempt(lambda: lane.connector().answer(given), "gold answer", retries, pace=lane.pace), None, None]
        except RuntimeError as e:
            return [None, str(e), error_kind(str(e))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = Lane(make, concurrency, share)
        for frame in frames:
            made = pd.DataFrame(list(lane.run(one, ((lane, t or "") for t in frame[text]))), columns=[name, "error", "error_type"], dtype=object)
            yield pd.concat([frame.reset_index(drop=True), made], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + f", {name} string, error string, error_type string"
    return dealt.mapInPandas(run, schema)


def rewrite_levels(rows: DataFrame, text: str, key: str, seed: int = 42, make: Callable[[], Rewriter] = RuleRewriter, templates: dict | None = None, **limits: float) -> DataFrame:
    """The four levels of each row: as the rewriter gives them, then particles, lexicon and sentence case on the last two."""
    from mixlens.operators import rewrite as R

    made = rewrite_with(rows, make, text, templates, **limits)
    return made.withColumns({V.LEVELS[2]: R.level_2(F.col(V.LEVELS[2]), F.col(key), seed), V.LEVELS[3]: R.level_3(F.col(V.LEVELS[3]), F.col(key), seed)})


def probe(models: DataFrame, make: Callable[[str], Generator], prompt: str = "ping", others: dict[str, Callable[[str], Generator]] | None = None) -> DataFrame:
    """name, model_id, api_format, ok, latency_ms and detail of one call to each model of a registry.

    A model whose api_format is in others is asked through that kind of endpoint, and through the first if that fails. An
    endpoint that answers is ok, also with an empty text; detail is the start of the text or of the error.
    """
    ship(models.sparkSession)
    kinds = dict(others or {})

    def asked(maker: Callable[[str], Generator], model: str) -> tuple[bool, int, str]:
        began = time.perf_counter()
        try:
            ok, said = True, maker(model).generate(prompt)[0]
        except Exception as e:  # noqa: BLE001  whatever a provider raises is a failed call
            ok, said = False, str(e)
        return ok, round((time.perf_counter() - began) * 1000), said.strip()[: 80 if ok else 120]

    def one(model: str, kind: str) -> tuple[bool, int, str]:
        found = asked(kinds[kind], model) if kind in kinds else None
        return found if found and found[0] else asked(make, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = Lane(make)
        for frame in frames:
            rows = list(lane.run(one, zip(frame["model_id"], frame["api_format"], strict=True)))
            yield frame.assign(ok=[r[0] for r in rows], latency_ms=[r[1] for r in rows], detail=[r[2] for r in rows])

    kind = F.col("api_format") if "api_format" in models.columns else F.lit("chat")
    return models.select("name", "model_id", F.coalesce(kind, F.lit("chat")).alias("api_format")).mapInPandas(run, "name string, model_id string, api_format string, ok boolean, latency_ms long, detail string")
