"""The map data source against a stub server."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lanemesh.operators import graph
from lanemesh.sources import tiles


@pytest.fixture
def server():
    seen, fail = [], {"left": 0}
    nodes = [{"type": "node", "id": i, "lat": 21.0 + i / 100, "lon": 105.0 + i / 100} for i in range(10)]
    ways = [{"type": "way", "id": 100 + i, "nodes": [i, i + 1], "tags": {"highway": "primary" if i % 2 else "residential"}} for i in range(9)]

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            if fail["left"] > 0:
                fail["left"] -= 1
                self.send_response(504)
                self.end_headers()
                return
            seen.append(query)
            box = [float(x) for x in query.split("](")[1].split(");")[0].split(",")]
            kinds = query.split('~"^(')[1].split(")$")[0].split("|")
            inside = lambda n: box[0] <= n["lat"] <= box[2] and box[1] <= n["lon"] <= box[3]
            own = [w for w in ways if w["tags"]["highway"] in kinds and any(inside(nodes[k]) for k in w["nodes"])]
            body = json.dumps({"elements": own + [nodes[k] for k in sorted({k for w in own for k in w["nodes"]})]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/", seen, fail
    http.shutdown()


BOX = (21.0, 105.0, 21.1, 105.1)


def test_tiles_cover_the_box():
    assert len(tiles.tiles(BOX, 0.05)) == 4 and len(tiles.tiles((21.01, 105.01, 21.01, 105.01), 0.05)) == 1
    name, box = tiles.tiles((-0.01, 105.0, 0.01, 105.05), 0.05)[0]
    assert name == "-1_2100" and box == (-0.05, 105.0, 0.0, 105.05)


def test_filters_reach_the_server(spark, server):
    url, seen, _ = server
    rows = tiles.load(spark, url, BOX, wait=0.01)
    got = rows.where("highway = 'primary' and type = 'way'").select("id").distinct()
    assert {r.id for r in got.collect()} == {101, 103, 105, 107}
    assert len(seen) == 4 and all('"^(primary)$"' in q for q in seen)
    seen.clear()
    near = rows.where(F.col("lat") <= 21.04).where(F.col("lon") <= 105.04)
    assert {r.id for r in near.select("id").distinct().collect()} == {0, 1, 2, 3, 4} and len(seen) == 1
    assert "maptiles" in near._jdf.queryExecution().executedPlan().toString()


def test_answers_are_landed_and_tried_again(spark, server, tmp_path):
    url, seen, fail = server
    fail["left"] = 2
    at = str(tmp_path / "land")
    data = tiles.land(spark, url, (21.0, 105.0, 21.05, 105.05), at, wait=0.01)
    assert {r.id for r in data.ways.collect()} == {100, 101, 102, 103, 104, 105} and len(seen) == 1
    data = tiles.land(spark, url, BOX, at, wait=0.01)
    before = len(seen)
    assert {r.id for r in data.ways.collect()} == set(range(100, 109)) and data.ways.count() == 9 and data.nodes.count() == 10
    assert graph.build_raw_graph(data).edges.count() == 18
    again = tiles.land(spark, url, BOX, at, wait=0.01)
    empty = sum(n not in tiles.landed(spark, at) for n, _ in tiles.tiles(BOX))
    assert again.ways.count() == 9 and len(seen) == before + empty
    fail["left"] = 99
    with pytest.raises(Exception, match="no answer in 2 tries"):
        tiles.load(spark, url, BOX, wait=0.01, tries=2).count()
