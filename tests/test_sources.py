import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import blocks, files, search

PAPERS = [{"paperId": f"p{i}", "title": f"t{i}", "venue": f"v{i % 4}", "year": 2015 + i % 9, "citationCount": i * 7 % 50} for i in range(120)]
PAGE = 7


def over_http():
    """A function of its own, which tasks get by value."""

    def transport(url):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url) as r:
                return r.status, r.read().decode()
        except HTTPError as e:
            if e.code == 400:
                raise RuntimeError("the task is lost") from None
            return e.code, ""

    return transport


@pytest.fixture
def index():
    """A local index: asked keeps every request, fail makes some page fail."""

    class Index(BaseHTTPRequestHandler):
        asked, fail = [], set()

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            Index.asked.append(q)
            low, _, high = q.get("year", "-").partition("-")
            ok = [p for p in PAPERS if q.get("venue") in (None, p["venue"]) and p["year"] >= int(low or 0) and p["year"] <= int(high or 9999) and p["citationCount"] >= int(q.get("minCitationCount", 0))]
            at = int(q.get("token", 0))
            self.send_response(400 if at in Index.fail else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": ok[at : at + PAGE], "token": str(at + PAGE) if at + PAGE < len(ok) else ""}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Index.url = f"http://127.0.0.1:{server.server_port}/bulk"
    yield Index
    server.shutdown()


def test_filters_reach_the_search(spark, index, tmp_path, capsys):
    d = search.search(spark, index.url, over_http(), spacing=0.0, folder=f"file://{tmp_path}/a")
    some = d.where(F.col("venue").isin("v1", "v3") & (F.col("year") >= 2016) & (F.col("year") < 2020) & (F.col("citationCount") > 10) & F.col("title").endswith("1"))
    want = [p["paperId"] for p in PAPERS if p["venue"] in ("v1", "v3") and 2016 <= p["year"] < 2020 and p["citationCount"] > 10 and p["title"].endswith("1")]
    assert sorted(r.paperId for r in some.collect()) == sorted(want)
    assert {(q["venue"], q["year"], q["minCitationCount"]) for q in index.asked} == {("v1", "2016-2019", "11"), ("v3", "2016-2019", "11")}
    some.explain()
    plan = capsys.readouterr().out
    assert "venue" not in plan.split("BatchScan")[0].split("Filter")[-1]
    assert some.rdd.getNumPartitions() == 2


def test_pages_survive_a_lost_task(spark, index, tmp_path):
    """A task fails on its third page; when it is repeated, the first two come from the shared folder."""
    d = search.search(spark, index.url, over_http(), spacing=0.0, folder=f"file://{tmp_path}/b").where("venue = 'v2'")
    index.fail.add(2 * PAGE)
    with pytest.raises(Exception, match="the task is lost"):
        d.collect()
    first = [q.get("token", "0") for q in index.asked]
    assert first[:3] == ["0", str(PAGE), str(2 * PAGE)]
    index.fail.clear()
    index.asked.clear()
    assert sorted(r.paperId for r in d.collect()) == sorted(p["paperId"] for p in PAPERS if p["venue"] == "v2")
    assert [q["token"] for q in index.asked] == [str(2 * PAGE), str(3 * PAGE), str(4 * PAGE)]
    index.asked.clear()
    assert d.count() == 30 and not index.asked


def test_heads_read_few_bytes_and_digests_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    for i in range(5):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([65 + i]) * (3_000_000 if i == 0 else i - 1))
    names = files.listed(spark, str(tmp_path))
    read = []
    opened = blocks.opened

    class Watched:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read(self, n):
            read.append(len(b := self.f.read(n)))
            return b

        def read_at(self, n, at):
            read.append(len(b := self.f.read_at(n, at)))
            return b

    monkeypatch.setattr(blocks, "opened", lambda uri: Watched(opened(uri)))
    reader = blocks.BlockReader({"files": json.dumps(names), "first": "500"})
    assert [(r[1], len(r[2])) for p in reader.partitions() for r in reader.read(p)] == [(3_000_000, 500), (0, 0), (1, 1), (2, 2), (3, 3)] and sum(read) == 506
    read.clear()
    reader = blocks.BlockReader({"files": json.dumps(names)})
    want = {n: hashlib.sha256((tmp_path / n.rsplit("/", 1)[1]).read_bytes()).hexdigest() for n in names}
    assert {r[0]: r[3] for p in reader.partitions() for r in reader.read(p)} == want and max(read) == blocks.BLOCK
    monkeypatch.setattr(blocks, "OPENS", ())  # what only Spark can open
    assert {r.path: r.sha256 for r in blocks.blocks(spark, names).collect()} == want
    assert {r.path: bytes(r.head) for r in blocks.blocks(spark, names, 2).collect()}[names[0]] == b"AA" and blocks.blocks(spark, []).count() == 0
