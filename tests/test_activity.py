"""Jobs, frames, counters, HTTP providers, and bounded peers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from stratalens.functions.providers import HttpChat, HttpEmbeddings
from stratalens.operators import graph
from stratalens.plans.activity import Frames, Jobs, SearchCounters, StreamFrames
from stratalens.plans.helpers import asked_summary


class Recorder:
    """An engine that only notes what it is asked for."""

    def __init__(self, spark):
        self.spark, self.done, self.fails = spark, [], False

    def index(self, root, mode):
        if self.fails:
            raise RuntimeError("broken")
        self.done.append(("index", mode))

    def refresh(self, root, mode):
        if self.fails:
            raise RuntimeError("broken")
        self.done.append(("refresh", mode))


def test_jobs_queue_cancel_supersede_and_retry(spark):
    lines = []
    engine = Recorder(spark)
    jobs = Jobs(engine, "/src", Frames(lines.append))
    for call in (jobs.cancel_pending, jobs.supersede_pending, jobs.retry_last):
        with pytest.raises(LookupError):
            call()
    assert not jobs.enqueue() and not jobs.run()
    assert jobs.offer(["a.ts", "node_modules/x.js", "a.ts"]) == 1
    assert jobs.enqueue() and jobs.run()
    jobs.offer(["a.ts", "package.json"])
    assert jobs.supersede_pending()
    assert engine.done == [("refresh", "full"), ("index", "full")]
    jobs.retry_last()
    assert engine.done[-1] == ("index", "full")
    jobs.offer(["b.ts"])
    jobs.enqueue()
    jobs.offer(["c.ts"])
    assert jobs.cancel_pending() == ["b.ts", "c.ts"] and not jobs.run()
    states = [f["state"] for f in map(json.loads, lines) if f["kind"] == "job"]
    assert states == ["queued", "running", "completed", "queued", "running", "completed", "running", "completed", "queued", "canceled"]


def test_changes_of_a_failed_job_wait_for_the_next(spark):
    engine = Recorder(spark)
    jobs = Jobs(engine, "/src")
    jobs.offer(["a.ts"])
    jobs.enqueue()
    engine.fails = True
    with pytest.raises(RuntimeError):
        jobs.run()
    assert [*jobs.queued] == ["a.ts"] and not jobs.active and jobs.counts["failed"] == 1
    engine.fails = False
    assert jobs.run() and jobs.counts["completed"] == 1


def test_a_followed_stream_is_told_in_frames(spark, tmp_path):
    lines = []
    listener = StreamFrames(Frames(lines.append))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path": "a"}\n{"path": "b"}\n')
    ended = threading.Event()
    listener.frames.write = lambda line: (lines.append(line), '"enabled": false' in line and ended.set())
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("path string").json(str(tmp_path / "in"))
        rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).queryName("watch").start().awaitTermination(60)
        assert ended.wait(30)
    finally:
        spark.streams.removeListener(listener)
    frames = [*map(json.loads, lines)]
    assert [f["kind"] for f in frames] == ["watch-state", "watch-batch", "watch-state"]
    assert frames[1]["pendingChangeCount"] == 2


def test_counters():
    c = SearchCounters()
    for n in (3, 5):
        c.add("chunk", {"lexical_candidates": n, "reranked": n, "results": 1})
    assert c.report() == {"chunk": {"calls": 2, "lexical_candidates": 8, "reranked": 8, "results": 2, "last_lexical_candidates": 5, "last_reranked": 5, "last_results": 1}}
    c.reset()
    assert c.report() == {}


@pytest.fixture
def server():
    """Embeds a text as its length, takes two texts of 400 characters at once, and chats."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = body.get("input", [])
            if len(texts) > 2 or any(len(x) > 400 for x in texts):
                self.send_error(413)
                return
            if self.path.endswith("/chat/completions"):
                reply = {"choices": [{"message": {"content": '```json\n{"answer": " In a.ts. ", "files": ["a.ts", "invented.ts"],}\n```'}}]}
            elif self.path.endswith("/api/embed"):
                reply = {"embeddings": [[float(len(x))] for x in texts]}
            else:
                reply = {"data": [{"index": i, "embedding": [float(len(x))]} for i, x in reversed([*enumerate(texts)])]}
            out = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()
    s.server_close()


@pytest.mark.parametrize("kind", ["openai", "local"])
def test_http_embeddings_keep_order_and_split_what_is_too_large(server, kind):
    ask = HttpEmbeddings(server, "m", kind)
    assert ask(["a", "bb", "ccc", "", "d" * 500]) == [[1.0], [2.0], [3.0], [1.0], [375.0]]
    assert ask([]) == []


def test_summary_by_chat(server):
    hits = [{"path": "a.ts", "title": "f", "score": 1.0}]
    got = asked_summary(HttpChat(server, "m"), "where", hits, ["auth"], ["b.ts"])
    assert got == {"answer": "In a.ts.", "files": ["a.ts"], "hubs": ["auth"], "next": []}
    with pytest.raises(ValueError):
        asked_summary(lambda system, user: '{"answer": ""}', "where", hits, [], [])


def test_least_peers_are_those_of_all_pairs(spark):
    files = spark.createDataFrame([(f"{m}/{i:02d}", m) for m, n in (("a", 13), ("b", 3), ("c", 1)) for i in range(n)], "path string, module string")
    every = {}
    for r in graph.module_peers(files).collect():
        every.setdefault(r.path, []).append(r.peer)
    got = {}
    for r in graph.module_peers(files, 4).collect():
        got.setdefault(r.path, []).append(r.peer)
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v)[:4] for p, v in every.items()}
