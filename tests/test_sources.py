import http.server
import threading

import pytest

from pagewright.plans import catalog
from pagewright.sources import seeds
from pagewright.sources.http_pages import HttpPages
from pyspark.sql import functions as F


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        target = {"/loop": "/loop", **{f"/hop{i}": f"/hop{i + 1}" for i in range(5)}}.get(self.path)
        if target:
            self.send_response(302)
            self.send_header("Location", target)
            self.end_headers()
            return
        body = {
            "/": b"Tide table", "/big": b"a" * (2 * 1024 * 1024 + 100), "/bad": b"\xff\xfe", "/hop5": b"end", "/private/x": b"seen",
            "/robots.txt": b"User-agent: *\nDisallow: /private\n",
        }.get(self.path)
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *args):
        pass


def fetched(spark, paths, **options):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpPages)
    rows = spark.read.format("http_pages").option("urls", " ".join(at + p for p in paths)).options(timeout="5", **options).load().collect()
    server.shutdown()
    return {r["url"].removeprefix(at): r for r in rows}


def test_http_pages(spark):
    found = fetched(spark, ("/", "/big", "/bad", "/none", "/loop", "/hop0", "/hop2", "/private/x"))
    assert found["/"]["html"] == "Tide table" and found["/"]["fetch_error"] == ""
    assert len(found["/big"]["html"]) == 2 * 1024 * 1024
    assert found["/bad"]["fetch_error"] == "invalid UTF-8" and found["/none"]["fetch_error"] == "status 404"
    assert found["/loop"]["fetch_error"] == "redirect loop" and found["/hop0"]["fetch_error"] == "too many redirects"
    assert found["/hop2"]["html"] == "end" and found["/private/x"]["html"] == "seen"


def test_http_pages_obey_robots(spark):
    found = fetched(spark, ("/", "/private/x"), robots="true")
    assert found["/"]["html"] == "Tide table"
    assert (found["/private/x"]["html"], found["/private/x"]["fetch_error"]) == (None, "crawling disallowed")


def test_text_seeds_keep_their_order(spark, tmp_path):
    """Two files, and splits smaller than a file."""
    lines = [f"http://h{i}/" + "x" * (i % 7) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[2500:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = seeds.seed_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["seq"], r["url"]) for r in found] == [(i + 1, x) for i, x in enumerate(lines)]
    few = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, url string")
    assert sorted(tuple(r) for r in seeds.cycled(few, 3).collect()) == [(i, "ab"[(i - 1) % 2]) for i in range(1, 7)]
    assert seeds.cycled(few, 0).count() == 0 and seeds.cycled(few.limit(0), 3).count() == 0


def test_progress_is_kept(spark, tmp_path):
    at = f"{tmp_path}/progress"
    assert seeds.load_progress(spark, at) == 0
    for n in (7, 12345678901):
        seeds.save_progress(spark, at, n)
        assert seeds.load_progress(spark, at) == n
    for text in ("", "many\n"):
        (tmp_path / "odd").write_text(text)
        assert seeds.load_progress(spark, f"{tmp_path}/odd") == 0


def test_agents_are_drawn_by_weight(spark):
    agents = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("never", 0.0), (None, 9.0)], "ua string, pct double")
    urls = spark.range(4000).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    even = dict(seeds.pick_agents(urls, agents).groupBy("ua").count().collect())
    weighted = dict(seeds.pick_agents(urls, agents, weighted=True).groupBy("ua").count().collect())
    assert set(even) == {"a", "b", "never"} and max(even.values()) < 1.2 * min(even.values())
    assert set(weighted) == {"a", "b"} and 2.6 < weighted["a"] / weighted["b"] < 3.4
    for wrong in (agents.limit(0), agents.where("ua IS NULL")):
        with pytest.raises(ValueError):
            seeds.pick_agents(urls, wrong)
    with pytest.raises(ValueError):
        seeds.pick_agents(urls, agents, most=2)


def test_seeds_are_numbered_by_their_order(spark, tmp_path):
    """Ids with gaps, repeats, a null and another first id."""
    ids = [7, 9, 9, 40, *range(100, 1000, 3), None]
    rows = [(x, f"http://h{i}/", "") for i, x in enumerate(ids)]
    spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    found = [(r["seq"], r["url"]) for r in catalog.QUERIES["seed_scan"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert found == [(i + 1, r[1]) for i, r in enumerate(rows)]
    rest = [(r["seq"], r["url"]) for r in catalog.QUERIES["seed_resume"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert rest == found[100:]


def test_named_stream_goes_on_and_repeats_no_batch(spark, tmp_path):
    import uuid

    from pagewright.streaming import visited

    rows = lambda *ids: spark.createDataFrame([(i, f"https://h/{i}") for i in ids], "page_id long, url string")
    rows(1, 2).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    name, schema = f"test-{uuid.uuid4().hex}", "page_id long, url string"
    stream = lambda: visited.first_sights(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    assert sorted(r["page_id"] for r in visited.drained(stream(), "append", name).collect()) == [1, 2]
    rows(2, 3).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert sorted(r["page_id"] for r in visited.drained(stream(), "append", name).collect()) == [1, 2, 3]
    assert sorted(r["page_id"] for r in visited.drained(stream(), "append", name).collect()) == [1, 2, 3]
