"""Calls under way at once: order, bounds, time-outs, retries; and the HTTP client against a local server."""

import asyncio
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from parasift.plans import calls, translate
from parasift.plans.calls import Calls, ChatTranslator, Window


def answers(call, asked, **more):
    window = Window(Calls(**({"pause": 0.01} | more)))
    try:
        return list(window.ordered((call, *a) for a in asked))
    finally:
        window.close()


def test_order_and_bound():
    busy, most, lock = 0, 0, threading.Lock()

    def slow(n):
        nonlocal busy, most
        with lock:
            busy, most = busy + 1, max(most, busy + 1)
        time.sleep(0.05 if n % 3 else 0.15)
        with lock:
            busy -= 1
        return n

    began = time.monotonic()
    assert [a.value for a in answers(slow, [(n,) for n in range(24)], window=6)] == list(range(24))
    assert most == 6 and time.monotonic() - began < 24 * 0.08 / 2


def test_no_further_than_the_window():
    read = []

    def asked():
        for n in range(50):
            read.append(n)
            yield (lambda n: n, n)

    window = Window(Calls(window=4))
    found = window.ordered(asked())
    assert next(found).value == 0 and len(read) <= 5
    window.close()


def test_calls_without_a_limit_stay_in_the_thread():
    tried = []

    def where(n):
        tried.append(n)
        if n == 1 and tried.count(1) < 3 or n == 2:
            raise ValueError("no")
        return threading.current_thread()

    found = answers(where, [(n,) for n in range(4)], timeout=None)
    own = threading.current_thread()
    assert [a.value for a in found] == [own, own, None, own] and found[2].error == "no"
    assert tried == [0, 1, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("kind", ["plain", "async"])
def test_a_hung_call_is_an_error(kind):
    async def waits(n):
        await asyncio.sleep(30 if n == 1 else 0)
        return n

    def hangs(n):
        if n == 1:
            time.sleep(30)
        return n

    began = time.monotonic()
    found = answers(waits if kind == "async" else hangs, [(0,), (1,), (2,)], window=2, timeout=0.2)
    assert [a.value for a in found] == [0, None, 2] and "0.2 s" in found[1].error and time.monotonic() - began < 5


def test_hung_threads_are_bounded(monkeypatch):
    monkeypatch.setattr(calls, "MOST_HUNG", 2)
    found = answers(lambda: time.sleep(20), [()] * 4, window=1, timeout=0.05, attempts=1)
    assert [a.error for a in found] == ["no answer in 0.05 s"] * 2 + ["2 calls hang"] * 2


def test_retries():
    tries = []

    def flaky(n):
        tries.append(n)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert answers(flaky, [(1,)])[0].value == "done" and len(tries) == 3
    assert answers(lambda: 1 / 0, [()])[0].error == "division by zero"


class Sleepy:
    """Answers late, and to one text not at all."""

    def translate(self, text, terms, instruction=""):
        time.sleep(60 if text == "t7" else 0.03 if text.endswith("3") else 0.01)
        return text.upper()

    def polish(self, text):
        return text


def test_rows_keep_their_order_and_hung_ones_their_text(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 60, 1, 2).selectExpr("id", "concat('t', id) as text")
        rows = translate.call_model(df, "text", Sleepy, "translate", {}, Calls(None, 5, timeout=1.5, attempts=1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.text for r in rows} == {n: "t7" if n == 7 else f"T{n}" for n in range(60)}
    assert [r.id for r in rows if r.model_error] == [7] and translate.call_model(df.where("false"), "text", Sleepy, "polish").collect() == []


class Endpoint(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, self.headers["Authorization"], asked))
        text = asked["messages"][1]["content"]
        if text == "hang":
            time.sleep(3)
        status = 503 if text == "busy" else 200
        body = json.dumps({"choices": [{"message": {"content": f" {text} in English "}}]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    found = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    found.seen, found.daemon_threads = [], True
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield found
    found.shutdown()


def test_chat_translator(server):
    model = ChatTranslator(f"http://127.0.0.1:{server.server_port}/v1", "secret", "m", timeout=0.5)
    assert model.translate("系统好", {"系统": "system", "没有": "none"}, "be brief") == "系统好 in English"
    path, key, asked = server.seen[0]
    told = asked["messages"][0]["content"]
    assert path == "/v1/chat/completions" and key == "Bearer secret" and "系统 → system" in told and "none" not in told and told.endswith("be brief")
    with pytest.raises(RuntimeError, match="503"):
        model.polish("busy")
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        model.polish("hang")
    assert time.monotonic() - began < 2


def test_no_connection_is_an_error_of_the_row():
    found = answers(ChatTranslator("http://127.0.0.1:9", "k", "m").polish, [("x",)], attempts=2)
    assert found[0].value is None and "refused" in found[0].error and "k" not in found[0].error.split()
