"""The chat source against a service in this process, and settings files of the three kinds."""

import base64
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from wayframe.operators import runner
from wayframe.sources import chat


class Service(BaseHTTPRequestHandler):
    """Answers by the user's text, and notes what it was asked and how many requests ran at once."""

    asked: list = []
    running = most = 0
    lock = threading.Lock()

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with Service.lock:
            Service.asked.append((self.path, self.headers["Authorization"], body))
            Service.running += 1
            Service.most = max(Service.most, Service.running)
        time.sleep(0.05)
        with Service.lock:
            Service.running -= 1
        content = body["messages"][-1]["content"]
        text = content if isinstance(content, str) else content[0]["text"]
        status = {"busy": 503, "denied": 401, "moved": 302}.get(text, 200)
        shape = {"choices": []} if text == "odd" else {"choices": [{"message": {"content": f" re {text} " if text != "blank" else " "}}]}
        raw = json.dumps(shape).encode() if status == 200 else b"token-of-the-test"
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "http://localhost:1/elsewhere")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def service(monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked, Service.running, Service.most = [], 0, 0
    monkeypatch.setenv("TEST_CHAT_KEY", "token-of-the-test")
    monkeypatch.setenv("TEST_CHAT_URL", f"http://127.0.0.1:{server.server_port}/v1/")
    monkeypatch.setenv("no_proxy", "127.0.0.1")
    yield chat.ChatService("m", "TEST_CHAT_KEY", "TEST_CHAT_URL", retries=1, first_wait=0.0, seed=7)
    server.shutdown()


def test_one_request(service):
    assert service("hello", "be brief", b"\x89PNG") == " re hello "
    path, token, body = Service.asked[0]
    assert path == "/v1/chat/completions" and token == "Bearer token-of-the-test"
    assert body["messages"][0] == {"role": "system", "content": "be brief"}
    assert body["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64," + base64.b64encode(b"\x89PNG").decode()
    assert (body["model"], body["temperature"], body["max_tokens"], body["seed"]) == ("m", 0.3, 4096, 7)
    assert service("x", " ") == " re x " and len(Service.asked[1][2]["messages"]) == 1


def test_failures_name_no_secret(service, monkeypatch):
    for text, requests, named in (("busy", 2, "ServiceError (HTTP 503)"), ("denied", 1, "ServiceError (HTTP 401)"), ("moved", 1, "ServiceError (HTTP 302)"), ("odd", 2, "ValueError"), ("blank", 2, "ValueError")):
        with pytest.raises(runner.RequestFailed) as e:
            runner.requested(service, text, service.retries, 0.0)
        assert str(e.value) == f"given up after {requests} requests: {named}" and e.value.attempts == requests
    monkeypatch.setenv("TEST_CHAT_URL", "file:///etc/hostname")
    with pytest.raises(runner.MissingSetting, match="TEST_CHAT_URL"):
        service("x")
    monkeypatch.delenv("TEST_CHAT_KEY")
    with pytest.raises(runner.MissingSetting, match="TEST_CHAT_KEY"):
        runner.requested(service, "x", 3)


def test_requests_at_once_keep_their_order(service):
    """The threads of one task, run here as the task runs them: no more at once than asked for, and rows in order."""
    import pandas as pd

    taken = {}

    class Records:
        columns = ["sample_id", "user_prompt", "system_prompt"]

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            taken["run"] = run

    chat.chat_completions(Records(), service, lambda raw: None, "again", concurrent=3)
    batch = pd.DataFrame({"sample_id": [str(i) for i in range(12)], "user_prompt": [f"q{i}" for i in range(12)], "system_prompt": None})
    (out,) = taken["run"](iter([batch]))
    assert list(out["raw_output"]) == [f"re q{i}" for i in range(12)] and list(out["sample_id"]) == list(batch["sample_id"])
    assert 1 < Service.most <= 3


@pytest.mark.parametrize("wrong", [{"model": " "}, {"model": "<MODEL>"}, {"api_key_env": "a b"}, {"base_url_env": "1x"}, {"temperature": float("nan")}, {"timeout": float("inf")}, {"timeout": 0.0}, {"max_tokens": 0}, {"retries": -1}, {"first_wait": 2.0, "longest_wait": 1.0}])
def test_settings_out_of_range(wrong):
    chat.ChatService("m")
    with pytest.raises(ValueError):
        chat.ChatService(**({"model": "m"} | wrong))


def test_section_of_a_file():
    made = chat.ChatService.of({"model": "m", "timeout_seconds": 5, "max_api_retries": 2, "initial_backoff_seconds": 0.5, "max_format_retries": 2})
    assert (made.timeout, made.retries, made.first_wait, made.api_key_env) == (5, 2, 0.5, "LLM_API_KEY")
    with pytest.raises(ValueError, match="remove Api_Key, token"):
        chat.ChatService.of({"model": "m", "token": "x", "Api_Key": "y"})


def test_a_job_of_requests(service, spark):
    """Through Spark: the tasks' Python workers read the environment, here that of this process if they start after it was set, so only failure by name is told apart."""
    rows = spark.createDataFrame([("0", None)], "sample_id string, user_prompt string")
    got = chat.chat_completions(rows, service, lambda raw: None, "again").first()
    assert (got["status"], got["error"], got["attempts"][0]["api_attempts"]) == ("api_error", "no prompt", 0)
    lacking = chat.ChatService("m", "TEST_CHAT_NO_SUCH_VARIABLE", None)
    with pytest.raises(Exception, match="TEST_CHAT_NO_SUCH_VARIABLE holds no credential"):
        chat.chat_completions(rows.fillna("x"), lacking, lambda raw: None, "again").count()
    with pytest.raises(ValueError, match="at least one"):
        chat.chat_completions(rows, service, lambda raw: None, "again", concurrent=0)
