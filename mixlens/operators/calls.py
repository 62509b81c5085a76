"""Calls to models from inside partitions: how many at once, how often, how long to wait, and endpoints over HTTP."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

#: Calls of a partition that are under way at once.
CONCURRENCY = 20


def error_kind(message: str) -> str:
    low = message.lower()
    if "timed out" in low:
        return "timeout"
    if "empty completion" in low:
        return "empty_completion"
    return "rate_limit" if "429" in message or "rate_limit" in low else "api_error"


@dataclass(frozen=True)
class Waits:
    """Seconds before the next attempt. After a time-out they grow by the attempt; each connector has its own figures."""

    timeout: float = 10.0
    timeout_spread: float = 5.0
    limited: float = 5.0
    empty: float = 2.0
    other: float = 2.0
    spread: float = 2.0

    def seconds(self, kind: str, attempt: int, jitter: float = 0.0) -> float:
        """jitter, from 0 to 1, is the share of the spread; an empty answer waits the same time always."""
        if kind == "empty_completion":
            return self.empty
        if kind == "timeout":
            return self.timeout * attempt + jitter * self.timeout_spread
        return (self.limited * 2 ** (attempt - 1) if kind == "rate_limit" else self.other * attempt) + jitter * self.spread


INFERENCE = Waits()
WRITING = Waits(timeout=3.0, timeout_spread=3.0)


def jitter_of(prompt: str, attempt: int) -> float:
    """A number from 0 to 1 that hangs on the prompt and the attempt, so that a rerun waits alike."""
    return int.from_bytes(hashlib.sha256(f"{attempt}:{prompt}".encode("utf-8", "surrogatepass")).digest()[:4], "little") / 2**32


class Pace:
    """Lets calls of any thread begin no more often than per_minute; without a limit at once."""

    def __init__(self, per_minute: float | None = None) -> None:
        self.gap = 60.0 / per_minute if per_minute else 0.0
        self._lock, self._next = threading.Lock(), 0.0

    def wait(self) -> None:
        if not self.gap:
            return
        with self._lock:
            now = time.monotonic()
            begin = max(now, self._next)
            self._next = begin + self.gap
        time.sleep(begin - now)


class Lane:
    """The calls of one partition: a few threads, each with a connector of its own, and one pace for all of them."""

    def __init__(self, make: Callable[..., object], concurrency: int = CONCURRENCY, per_minute: float | None = None) -> None:
        self._make, self._own, self._concurrency, self.pace = make, threading.local(), concurrency, Pace(per_minute)

    def connector(self, *key: object) -> object:
        """This thread's connector for a key, made once."""
        known = self._own.__dict__.setdefault("known", {})
        if key not in known:
            known[key] = self._make(*key)
        return known[key]

    def run(self, work: Callable[..., object], items: Iterable[tuple]) -> Iterator[object]:
        """What work makes of each item, in their order, so many at once; the first that raises ends the others."""
        with ThreadPoolExecutor(self._concurrency) as pool:
            pending = [pool.submit(work, *x) for x in items]
            try:
                for p in pending:
                    yield p.result()
            finally:
                for p in pending:
                    p.cancel()


def lanes(df, partitions: int | None, per_minute: float | None) -> tuple:  # noqa: ANN001
    """df dealt to partitions, and each one's share of the rate. With a rate there must be a number that it is shared over."""
    if per_minute and not partitions:
        partitions = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(partitions) if partitions else df, per_minute / partitions if per_minute else None


class Endpoint:
    """A model behind an HTTP endpoint that takes and gives JSON. Errors raise with the status in the message."""

    def __init__(self, model: str, url: str, key: str = "", system: str = "", most_tokens: int = 1024, temperature: float = 0.0, timeout: float = 120.0) -> None:
        self.model, self.url, self.key, self.system = model, url.rstrip("/"), key, system
        self.most_tokens, self.temperature, self.timeout = most_tokens, temperature, timeout

    def asked(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/{path}", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e.code}: {e.read().decode('utf-8', 'replace')[:300]}") from e
        except TimeoutError as e:
            raise RuntimeError(f"timed out after {self.timeout:g}s") from e
        except urllib.error.URLError as e:
            late = isinstance(e.reason, TimeoutError)
            raise RuntimeError(f"timed out after {self.timeout:g}s" if late else str(e.reason)) from e

    def generate(self, prompt: str) -> tuple[str, int]:
        raise NotImplementedError


class ChatEndpoint(Endpoint):
    """Messages in, the first choice's message out."""

    def generate(self, prompt: str) -> tuple[str, int]:
        messages = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": prompt}]
        found = self.asked("chat/completions", {"model": self.model, "messages": messages, "max_tokens": self.most_tokens, "temperature": self.temperature})
        return (found["choices"][0]["message"].get("content") or "").strip(), (found.get("usage") or {}).get("total_tokens", 0)


class ResponsesEndpoint(Endpoint):
    """One input in, a list of outputs out, whose texts are joined."""

    def generate(self, prompt: str) -> tuple[str, int]:
        body = {"model": self.model, "input": prompt, "max_output_tokens": self.most_tokens} | ({"instructions": self.system} if self.system else {})
        found = self.asked("responses", body)
        texts = [part.get("text", "") for item in found.get("output", []) if item.get("type") == "message" for part in item.get("content", []) if part.get("type") == "output_text"]
        if not any(texts) and found.get("choices"):
            texts = [found["choices"][0].get("message", {}).get("content") or ""]
        return "".join(texts).strip(), (found.get("usage") or {}).get("total_tokens", 0)


ENDPOINTS = {"chat": ChatEndpoint, "responses": ResponsesEndpoint}
