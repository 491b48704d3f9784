"""Embedding providers: requests, their failures and pace, and the cache."""

import json
import logging
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexweft import AlignmentEngine, Config
from lexweft.operators.embed import FAILURES, CachedProvider, HashingProvider, HttpProvider, Pace, decode_response, hashed, outcome, read_response


@pytest.mark.parametrize("body, want", [('[{"embedding": [[1, 2]]}]', None), ("[]", "empty_response"), ("{", "json"), ("null", "json"), ("{}", "json"), ('[{"other": 1}]', "no_field"), ("[3]", "no_field"), ('[{"embedding": 3}]', "no_list"), ('[{"embedding": []}]', "empty_list"), ('[{"embedding": [["x"]]}]', "values"), ('[{"embedding": [3]}]', "values"), ('[{"embedding": [[true]]}]', "values")])
def test_responses(body, want):
    assert read_response(body)[1] == want and (want is None or want in FAILURES)
    assert decode_response(body, 3) == ([1.0, 2.0] if want is None else [0.0] * 3)


def test_pace():
    now, slept = [0.0], []
    pace = Pace(4, lambda: now[0], slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == [0.25, 0.5]
    pace.hold(10)
    pace.wait()
    assert slept[-1] == 10.0


@pytest.fixture
def service():
    """Answers by text; counts what it is asked."""
    asked = Counter()
    bodies = {"nojson": "{", "empty": "[]", "nofield": '[{"x": 1}]', "nolist": '[{"embedding": 7}]', "emptylist": '[{"embedding": []}]', "words": '[{"embedding": [["x"]]}]'}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["content"].removeprefix("search_query: ")
            asked[text] += 1
            status = {"teapot": 418, "gone": 500, "busy": 429 if asked[text] < 3 else 200, "down": 503 if asked[text] < 2 else 200}.get(text, 200)
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(bodies.get(text, json.dumps([{"embedding": [[len(text), 1]]}])).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_requests_by_kind_of_failure(spark, service):
    """Each distinct text is asked once, only what may pass is tried again, and one pass counts outcomes by kind."""
    url, asked = service
    texts = ["fine", "fine", "teapot", "gone", "busy", "down", "nojson", "empty", "nofield", "nolist", "emptylist", "words", None]
    seen = Observation()
    made = HttpProvider(url, dim=2, retries=2, pause=0.01).answer(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3), "query")
    out = {r.i: (list(r.vec), r.failure) for r in made.observe(seen, *outcome()).collect()}
    fine = lambda t: ([float(len(t)), 1.0], None)
    want = ["fine", "fine", "status", "status", "busy", "down", "json", "empty_response", "no_field", "no_list", "empty_list", "values", "no_text"]
    assert out == {i: fine(w) if w in ("fine", "busy", "down") else ([0.0, 0.0], w) for i, w in enumerate(want)}
    assert asked == {"fine": 1, "teapot": 1, "gone": 3, "busy": 3, "down": 2, **{t: 1 for t in texts[6:12]}}
    counts = {k: v for k, v in seen.get.items() if v}
    assert counts == {"n": 13, "n_ok": 4, "n_failed": 9, "status": 2, **{k: 1 for k in ("json", "empty_response", "no_field", "no_list", "empty_list", "values", "no_text")}}
    nothing = HttpProvider("http://127.0.0.1:9", dim=2, retries=0).answer(spark.createDataFrame([("x",)], "text string"), "query").first()
    assert (list(nothing.vec), nothing.failure) == ([0.0, 0.0], "request")


class Counting(HashingProvider):
    """Notes which texts it is asked for; fails while it is down."""

    down = False

    def __init__(self, dim):
        super().__init__(dim)
        self.asked = []

    def ask(self, df, role, text="text"):
        self.asked += [r[0] for r in df.select(text).collect()]
        out = self.answer(df, role, text)
        return out.withColumns({"vec": F.transform("vec", lambda x: x * 0), "failure": F.lit("status")}) if self.down else out


def test_cache_is_by_content(spark, tmp_path):
    inner = Counting(8)
    cached = CachedProvider(inner, str(tmp_path / "c"))
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (5, None)], "i int, text string")
    first = {r.i: (list(r.vec), r.failure) for r in cached.answer(df, "document").collect()}
    assert cached.seen["n"] == 2 and first[5] == ([0.0] * 8, "no_text")
    again = {r.i: list(r.vec) for r in cached.embed(df.where("i > 1").union(spark.createDataFrame([(4, "d")], "i int, text string")), "document").collect()}
    assert sorted(inner.asked) == ["a b", "c", "d"] and first[1] == first[2] == (again[2], None) and again[4] == pytest.approx(list(hashed("d", 8)))
    cached.embed(df, "query").collect()
    assert sorted(inner.asked) == ["a b", "a b", "c", "c", "d"]  # another role
    assert cached.embed(df.where("false"), "document").count() == 0 and cached.embed(df.where("i = 5"), "document").count() == 1
    cached.clear(spark)
    assert cached.read(spark, "document", list(range(64))) is None


def test_cache_asks_failures_again_and_sets_broken_files_aside(spark, tmp_path, caplog):
    inner = Counting(4)
    cached, df = CachedProvider(inner, str(tmp_path / "c")), spark.createDataFrame([("a b",), ("c",)], "text string")

    def counts():
        rows = cached.answer(df, "document").collect()
        return sum(r.failure is None for r in rows), {r.failure for r in rows if r.failure}

    inner.down = True
    assert counts() == (0, {"status"}) and cached.seen["status"] == 2
    inner.down = False
    assert counts() == (2, set()) and len(inner.asked) == 4
    assert counts() == (2, set()) and len(inner.asked) == 4 and cached.unreadable == 0
    files = [*(tmp_path / "c").rglob("part-*.parquet")]
    for f in files:
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink()
    with caplog.at_level(logging.WARNING):
        assert counts() == (2, set()) and len(inner.asked) == 6
    assert cached.unreadable == len(files) == len([*(tmp_path / "c" / "_unreadable").glob("[!.]*")]) and f"{len(files)} files can't be read" in caplog.text
    assert counts() == (2, set()) and len(inner.asked) == 6


def test_lookup_reads_its_own_buckets(spark, tmp_path):
    cached = CachedProvider(Counting(4), str(tmp_path / "c"))
    df = spark.range(300).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    cached.embed(df, "document").collect()
    held = len({f.parent for f in (tmp_path / "c").rglob("part-*.parquet")})
    key = df.where("text = 'word 7'").select(F.sha2("text", 256).alias("k"), cached._bucket(F.sha2("text", 256)).alias("b")).first()
    read = cached.read(spark, "document", [key.b], [key.k])
    assert held > 50 and {os.path.basename(os.path.dirname(f)) for f in read.inputFiles()} == {f"bucket={key.b}"} and read.count() == 1
    asked = len(cached.inner.asked)
    assert cached.embed(df.where("text = 'word 7'"), "document").count() == 1 and len(cached.inner.asked) == asked


def test_compaction(spark, tmp_path):
    cached = CachedProvider(Counting(4), str(tmp_path / "c"))
    cached.BUCKETS = 2
    df = spark.range(12).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), "id")
    for n in range(0, 12, 3):
        cached.embed(df.where(F.col("id").between(n, n + 2)), "document").collect()
    before = {r.text: list(r.vec) for r in cached.embed(df, "document").collect()}
    files = lambda: [*(tmp_path / "c").rglob("part-*.parquet")]
    assert len(files()) > 4 and cached.compact(spark, "document", 1) == 2 and len(files()) == 2
    assert {r.text: list(r.vec) for r in cached.embed(df, "document").collect()} == before and len(cached.inner.asked) == 12


def test_engine_logs_outcomes_and_sizes(spark, caplog):
    engine = AlignmentEngine(spark, Config(dim=8))
    df = spark.createDataFrame([("q", 0, "b0", "a b"), ("q", 1, "b1", ""), ("q", 2, "b2", "été"), ("none", None, None, None)], "query_id string, pos int, block_id string, text string")
    with caplog.at_level(logging.INFO):
        rows = {(r.query_id, r.pos): r.vec for r in engine.prepared(df, "query", "blocks").collect()}
    assert rows["none", None] is None and len(rows) == 4
    assert "blocks: 2 embedded, 1 failed, no_words 1" in caplog.text and "text sizes from 0 to 5 bytes, median 3" in caplog.text
    engine.release()
    assert engine.prepared(df.where("false"), "query", "blocks").count() == 0
    engine.release()
