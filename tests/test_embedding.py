import http.server
import json
import threading

import pyarrow as pa
import pytest

from graphloom.database import GraphDB
from graphloom.functions.embedding import EmbeddingError, HttpProvider, embed_cached
from graphloom.functions.vector import Chunked, mock_embedding


@pytest.fixture
def server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if "refuse" in json.dumps(body):
                self.send_response(400)
                self.end_headers()
                return
            if "input" in body:  # out of order, with their places
                out = {"data": [{"index": i, "embedding": [1.0 + i, 2.0]} for i in reversed(range(len(body["input"])))]}
            else:
                out = {"embeddings": [{"values": [1.0 + i, 2.0]} for i in range(len(body["requests"]))]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_http_forms_retries_and_errors(server):
    url, seen = server
    p = HttpProvider(url, "m", key="k", pause=0.01)
    assert p("text", 2) == [1.0, 2.0] and len(seen) == 2 and seen[1][0] == "/embeddings" and seen[1][2] == "Bearer k"
    g = HttpProvider(url, "m", form="gemini", pause=0.01)
    assert g("text", 2, role="query") == [1.0, 2.0] and seen[-1][1]["requests"][0]["taskType"] == "RETRIEVAL_QUERY"
    with pytest.raises(EmbeddingError):
        p("refuse", 2)
    with pytest.raises(EmbeddingError):
        HttpProvider("http://127.0.0.1:1", "m", retries=1, pause=0.01)("x", 2)
    assert "k'" not in repr(p)


def test_http_sends_several_texts_at_once(server):
    url, seen = server
    seen.append("no refusal")
    for form in ("openai", "gemini"):
        p, before = HttpProvider(url, "m", form=form, pause=0.01, batch=2), len(seen)
        assert Chunked(p).many(["a", "b", "c"], 2) == [[1.0, 2.0], [2.0, 2.0], [1.0, 2.0]] and len(seen) == before + 2


def test_cache_embeds_each_text_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    where = str(log)

    def provider(text, dim, role="document"):
        import os
        import uuid

        with open(os.path.join(where, uuid.uuid4().hex), "w") as f:
            f.write(text)
        return mock_embedding(text, dim)

    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(["a", "b", "a", None, "a"])] + [(9, "b", [0.0, 0.0], "x")], "id int, text string, v array<float>, hash string")
    cache = str(tmp_path / "cache")
    one = {r.id: r.v for r in embed_cached(df.drop("hash"), "text", "v", 2, provider, cache, "m").collect()}
    assert len(list(log.iterdir())) == 2 and one[3] is None and one[9] == [0.0, 0.0] and one[0] == one[2] == one[4] and len(one) == 6
    embed_cached(df.drop("hash"), "text", "v", 2, provider, cache, "m").count()
    assert len(list(log.iterdir())) == 2


def test_long_texts_are_averaged():
    v = Chunked()("word " * 1000, 8)
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-5


def test_arrow_and_json_results(spark):
    db = GraphDB.in_memory(spark, "node P { k: I64 @key }")
    db.load('{"type":"P","data":{"k":9007199254740993}}')
    q = "query q() { match { $p: P } return { $p.k } }"
    assert pa.ipc.open_stream(db.run_arrow(q)).read_all().to_pydict() == {"k": [9007199254740993]}
    assert db.run_json(q) == [{"k": "9007199254740993"}]
    assert db.embed(dry_run=True) == 0
    db.close()
