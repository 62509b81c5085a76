"""Calls in flight, their pace and waits, answers that outlive a crash, and endpoints over HTTP."""

import json
import os
import signal
import subprocess
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from mixlens.cli import main
from mixlens.operators import calls, providers
from mixlens.sources import tables as S

PROMPTS = "model_name string, model_id string, sample_id string, level int, category string, prompt string"
KEY = ["model_id", "sample_id", "level"]


class Slow:
    """Takes a while, and counts how many calls are under way and when each began."""

    lock, now, most, begun = threading.Lock(), 0, 0, []

    def generate(self, prompt):
        with Slow.lock:
            Slow.now += 1
            Slow.most = max(Slow.most, Slow.now)
            Slow.begun.append(time.monotonic())
        time.sleep(0.05)
        with Slow.lock:
            Slow.now -= 1
        return prompt, 1


def lane_of(per_minute=None, concurrency=5):
    Slow.now, Slow.most, Slow.begun = 0, 0, []
    lane = calls.Lane(Slow, concurrency, per_minute)
    began = time.monotonic()
    rows = list(lane.run(lambda p: providers.call(lane.connector(), p, pace=lane.pace), ((str(k),) for k in range(40))))
    return rows, time.monotonic() - began


def test_calls_overlap_up_to_the_limit():
    rows, took = lane_of()
    assert [r[0] for r in rows] == [str(k) for k in range(40)]
    assert Slow.most == 5 and 40 / 5 * 0.05 <= took < 40 * 0.05 / 2


def test_one_pace_for_all_threads():
    _, took = lane_of(per_minute=60 * 50)
    gaps = [b - a for a, b in zip(sorted(Slow.begun), sorted(Slow.begun)[1:], strict=False)]
    assert took >= 39 / 50 and sum(gaps) >= 39 / 50 - 0.02


def test_attempts_count_against_the_pace(monkeypatch):
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("429")

    waited = []
    pace = calls.Pace(60)
    monkeypatch.setattr(pace, "wait", lambda: waited.append(1))
    assert providers.call(Failing(), "x", 4, lambda s: None, pace=pace)[-1] == "rate_limit" and len(waited) == 4


def test_a_schedule_for_each_connector():
    assert [calls.INFERENCE.seconds("timeout", 2, j) for j in (0.0, 1.0)] == [20.0, 25.0]
    assert [calls.WRITING.seconds("timeout", 2, j) for j in (0.0, 1.0)] == [6.0, 9.0]
    for waits in (calls.INFERENCE, calls.WRITING):
        assert [waits.seconds("rate_limit", k) for k in (1, 2, 3)] == [5.0, 10.0, 20.0]
        assert [waits.seconds("api_error", k, 1.0) for k in (1, 2)] == [4.0, 6.0]
        assert waits.seconds("empty_completion", 3, 1.0) == 2.0


def test_partitions_overlap_too(spark):
    """Rows of a partition wait side by side: 60 calls of 50 ms in two partitions."""

    class Sleeper:
        def generate(self, prompt):
            time.sleep(0.05)
            return prompt, 1

    rows = spark.range(60).selectExpr("cast(id as string) as prompt")
    providers.infer(rows, Sleeper, partitions=2).count()
    began = time.monotonic()
    assert {r.response for r in providers.infer(rows, Sleeper, partitions=2, concurrency=10).collect()} == {str(k) for k in range(60)}
    assert time.monotonic() - began < 60 * 0.05


def prompts(spark, n):
    return spark.createDataFrame([("m", f"x/{k % 2}", str(k), k % 4, "c", f"p{k}") for k in range(n)], PROMPTS)


def test_answers_by_rounds_and_models(spark, tmp_path):
    class Named:
        def __init__(self, model):
            self.model = model

        def generate(self, prompt):
            return f"{self.model} {prompt}", 1

    for name, limits in (("all", {}), ("rounds", {"per_minute": 60_000, "partitions": 2})):
        path = str(tmp_path / name)
        assert providers.infer_into(prompts(spark, 50), Named, path, KEY, calls_per_task=5, by="model_id", **limits) == 50
        got = spark.read.json(path).collect()
        assert sorted(r.response for r in got) == sorted(f"x/{k % 2} p{k}" for k in range(50))
    assert providers.infer_into(prompts(spark, 0), Named, str(tmp_path / "none"), KEY, by="model_id") == 0


CRASH = """
import os, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from mixlens.operators import providers

class Logged:
    def generate(self, prompt):
        time.sleep(0.05)
        fd = os.open({log!r}, os.O_APPEND | os.O_CREAT | os.O_WRONLY)
        os.write(fd, (prompt + "\\n").encode())
        os.close(fd)
        return prompt, 1

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {scratch!r}).getOrCreate()
rows = spark.createDataFrame([("m", "x", str(k), k % 4, "c", f"p{{k}}") for k in range(400)], {schema!r})
providers.infer_into(rows, Logged, {out!r}, {key!r}, calls_per_task=10, concurrency=2)
"""


def test_answers_outlive_a_killed_run(spark, tmp_path):
    """The run is killed half-way; what its ended tasks asked is there, and a second run asks only for the rest."""
    out, log = str(tmp_path / "records"), tmp_path / "log"
    code = CRASH.format(root=str(Path(__file__).resolve().parents[1]), log=str(log), scratch=str(tmp_path / "scratch"), schema=PROMPTS, out=out, key=KEY)
    run = subprocess.Popen([sys.executable, "-c", code], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    until = time.monotonic() + 120
    while time.monotonic() < until and not (log.exists() and log.read_text().count("\n") >= 150):
        time.sleep(0.1)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    asked = log.read_text().split()
    assert 150 <= len(asked) < 400
    done = S.read_lines(spark, out, S.INFERENCE, "resume")
    kept = [r.prompt for r in done.collect()]
    assert len(set(kept)) == len(kept) and len(asked) - len(kept) <= 2 * 10 + 2  # two tasks of ten calls were under way
    rest = spark.createDataFrame([("m", "x", str(k), k % 4, "c", f"p{k}") for k in range(400)], PROMPTS).join(done.select(*KEY), KEY, "left_anti")
    assert providers.infer_into(rest, providers.EchoGenerator, out, KEY) == 400 - len(kept)
    assert sorted(r.prompt for r in spark.read.schema(S.INFERENCE).json(out).collect()) == sorted(f"p{k}" for k in range(400))


def test_a_failed_job_keeps_the_tasks_that_ended(spark, tmp_path):
    class Broken:
        def generate(self, prompt):
            if prompt == "p399":
                time.sleep(3)
                raise SystemExit("the worker goes")
            return prompt, 1

    with pytest.raises(Exception, match="worker|Python|stage"):
        providers.infer_into(prompts(spark, 400), Broken, str(tmp_path / "records"), KEY, calls_per_task=10)
    assert S.read_lines(spark, str(tmp_path / "records"), S.INFERENCE, "resume").count() >= 300


class Server(BaseHTTPRequestHandler):
    """Both kinds of endpoint; a model named late is slow, one named gone is not there, and one named limited is refused."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.seen.append((self.path, body, self.headers.get("Authorization")))
        model, status = body["model"], 200
        if model == "late":
            time.sleep(1)
        if model == "gone" or model == "chat-only" and self.path.endswith("responses"):
            status, answer = 404, {"error": {"message": "no such model"}}
        elif model == "limited":
            status, answer = 429, {"error": {"message": "slow down"}}
        elif self.path == "/v1/chat/completions":
            answer = {"choices": [{"message": {"content": None if model == "empty" else f" said {body['messages'][-1]['content']} "}}], "usage": {"total_tokens": 7}}
        else:
            answer = {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "out "}, {"type": "output_text", "text": body["input"]}]}]}
        raw = json.dumps(answer).encode()
        try:
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)
        except BrokenPipeError:  # the caller gave up
            pass

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    found = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    Server.seen.clear()
    yield f"http://127.0.0.1:{found.server_port}/v1/"
    found.shutdown()


def test_endpoints(server):
    assert calls.ChatEndpoint("m", server, "k", system="s").generate("hi") == ("said hi", 7)
    path, body, key = Server.seen[-1]
    assert (path, key, [m["role"] for m in body["messages"]]) == ("/v1/chat/completions", "Bearer k", ["system", "user"])
    assert calls.ResponsesEndpoint("m", server).generate("hi") == ("out hi", 0)
    row = lambda model, **o: providers.call(calls.ChatEndpoint(model, server, **o), "x", 1)
    assert row("empty")[-2:] == ("empty completion", "empty_completion")
    assert row("limited")[-1] == "rate_limit" and row("gone")[-1] == "api_error" and row("gone")[-2].startswith("404")
    assert row("late", timeout=0.2)[-1] == "timeout"
    assert providers.call(calls.ChatEndpoint("m", "http://127.0.0.1:1/v1"), "x", 1)[-1] == "api_error"


def test_commands_over_http(spark, tmp_path, server, monkeypatch):
    at = {k: str(tmp_path / k) for k in "data records probe".split()}
    S.demo_dataset(spark, 3).write.parquet(at["data"])
    models = tmp_path / "models.json"
    listed = [{"name": "a", "model_id": "a"}, {"name": "b", "model_id": "b", "api_format": "responses"}, {"name": "c", "model_id": "chat-only", "api_format": "responses"}, {"name": "e", "model_id": "empty"}, {"name": "g", "model_id": "gone", "api_format": "responses"}]
    models.write_text(json.dumps({"models": listed}))
    assert main(["probe", str(models), at["probe"], "--url", server], spark) == 1
    told = {r.name: (r.ok, r.detail) for r in spark.read.json(at["probe"]).collect()}
    assert told["a"] == (True, "said ping") and told["b"] == (True, "out ping") and told["c"] == (True, "said ping") and told["e"][0] and not told["g"][0] and told["g"][1].startswith("404")
    assert main(["infer", at["data"], str(models), at["records"], "--url", server, "--include", "a", "b", "--calls", "4"], spark) == 0
    got = spark.read.schema(S.INFERENCE).json(at["records"]).collect()
    assert len(got) == 24 and all(r.response == ("said " if r.model_id == "a" else "out ") + r.prompt.strip() or r.response.startswith(("said", "out")) for r in got)
    n = len(Server.seen)
    assert main(["infer", at["data"], str(models), at["records"], "--url", server, "--include", "a", "b"], spark) == 0
    assert len(Server.seen) == n  # all was done
    monkeypatch.delenv("MIXLENS_API_KEY", raising=False)
    models.write_text(json.dumps({"models": [{"name": "a", "model_id": "a", "base_url": "https://models.example.com/v1", "api_key_env": "NO_SUCH_KEY"}]}))
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        main(["infer", at["data"], str(models), at["records"]], spark)


def test_build_over_http(spark, tmp_path, server):
    at = {k: str(tmp_path / k) for k in "source data".split()}
    S.write_lines(S.demo_rows(spark).selectExpr("instruction", "'' as input", "'' as output"), at["source"])
    assert main(["build", at["source"], at["data"], "--samples", "5", "--url", server, "--writer", "w"], spark) == 0
    rows = spark.read.parquet(at["data"]).collect()
    assert rows and all(r.level_0_clean.startswith("said") and r.gold_response.startswith("said") for r in rows)
    assert {body["temperature"] for _, body, _ in Server.seen} == {0.0, 0.7}


def test_writers_run_side_by_side(spark):
    class Writer:
        def rewrite(self, level, instruction, prompt):
            time.sleep(0.02)
            return f"{level}:{instruction}"

        def answer(self, instruction):
            time.sleep(0.02)
            return f"gold {instruction}"

    rows = spark.range(40).selectExpr("cast(id as string) as t").coalesce(1)
    began = time.monotonic()
    made = providers.rewrite_with(rows, Writer, "t", concurrency=10).collect()
    assert all(r.level_3_adversarial == f"3:0:{r.t}" for r in made)  # the other levels start from level 0
    assert {r.gold_response for r in providers.gold_with(rows, Writer, "t", concurrency=10).collect()} == {f"gold {k}" for k in range(40)}
    assert time.monotonic() - began < 40 * 5 * 0.02
