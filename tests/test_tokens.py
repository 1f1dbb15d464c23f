"""Paged sources against a local server; broken markup; layout of small pages."""

import http.server
import json
import threading
from collections import Counter
from urllib.parse import parse_qs, urlparse

import pytest

from folioscope.sources import readers
from folioscope.sources.tokens import Pages, TokenSource

PAGES = {"a": 5, "b": 1, "none": 1, "ü x": 3}


@pytest.fixture
def server():
    """Pages of two records; every page but those of query b fails once."""
    asked: Counter = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query, keep_blank_values=True)
            query, token = q["q"][0], q["t"][0]
            asked[query, token] += 1
            if asked[query, token] == 1 and query != "b":
                self.send_error(503)
                return
            if query not in PAGES:
                self.send_error(404)
                return
            page = int(token.removeprefix("t/") or 0)
            records = [] if query == "none" else [{"id": f"{query}{page}{i}"} for i in "xy"]
            body = json.dumps({"hits": records, "more": f"t/{page + 1}" if page + 1 < PAGES[query] else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            return

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/?q={{query}}&t={{token}}", asked
    s.shutdown()


def options(url, **more):
    return {"url": url, "queries": ",".join(PAGES), "records": "hits", "next": "more", "pause": "0.01"} | more


def wanted():
    return sorted((q, f"t/{p}" if p else "", f"{q}{p}{i}") for q, n in PAGES.items() for p in range(n) for i in "xy" if q != "none")


def found(rows):
    return sorted((r.query, r.token, json.loads(r.value)["id"]) for r in rows)


def test_a_batch_follows_every_query_to_its_end(spark, server):
    url, asked = server
    spark.dataSource.register(TokenSource)
    assert found(spark.read.format("token_pages").options(**options(url)).load().collect()) == wanted()
    assert max(asked.values()) == 2 and asked["b", ""] == 1  # one failure each, then the page


def test_what_does_not_pass_is_an_error(server):
    url, asked = server
    pages = Pages(options(url))
    with pytest.raises(Exception, match="404"):
        pages.fetch("unknown", "")
    with pytest.raises(Exception, match="503"):
        Pages(options(url, retries="0")).fetch("a", "t/4")


def test_a_stream_goes_on_after_a_failure_and_asks_for_no_finished_page(spark, server, tmp_path):
    url, asked = server
    spark.dataSource.register(TokenSource)
    fail = {2}

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number in fail:
            fail.remove(number)
            raise RuntimeError("the sink is gone")

    def start():
        stream = spark.readStream.format("token_pages").options(**options(url, pages="1")).load()
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/mark").start()

    q = start()
    with pytest.raises(Exception, match="sink is gone"):
        q.processAllAvailable()
    q.stop()
    before = Counter(asked)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert found(spark.read.parquet(f"{tmp_path}/out").collect()) == wanted()
    again = {k for k in before if asked[k] > before[k]}
    assert again <= {("a", "t/2"), ("a", "t/3"), ("ü x", "t/2")}  # the batch that was not finished, and the one read ahead


def test_broken_articles_are_kept_apart(spark):
    good = "<article><article-meta><article-title>A  b</article-title><pub-date><year>2001</year></pub-date></article-meta></article>"
    rows = [(1, good), (2, good.replace("</year>", "")), (3, "no markup"), (4, None), (5, "<article/>")]
    got = {r.k: r for r in readers.article_record(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert (got[1].title, got[1].year, got[1].corrupt) == ("A b", "2001", None)
    assert got[2].title is None and got[2].corrupt == rows[1][1] and got[3].corrupt == "no markup"
    assert got[4].corrupt is None and got[4].title is None and got[5].corrupt is None


def test_only_the_first_bytes_of_a_file_are_read(spark, tmp_path):
    """Two sparse files of five gigabytes, which no row could hold, and files that are short or of another kind."""
    heads = {"a.bin": b"#mdl#2#15545\nrest", "b.bin": b"#mdl#1#7 " + b"x" * 99, "c.bin": b"#", "d d.bin": b"other"}
    for name, head in heads.items():
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            if name < "c":
                f.truncate(5 << 30)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r["count"]) for r in readers.read_model_headers(spark, str(tmp_path)).collect()}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {"a.bin": ("2", "15545"), "b.bin": ("1", "7"), "c.bin": ("", ""), "d d.bin": ("", "")}
