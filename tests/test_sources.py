"""Feeds, pages and logs."""

import json
import os

from pyspark.sql import functions as F

from postmill.sources import feeds


def test_feeds(spark):
    green = json.dumps({"jobs": [{"title": "PM", "absolute_url": "u", "updated_at": "2024-05-01T10:00:00Z", "content": "<p>Hi&nbsp;there</p><script>x()</script>", "location": {"name": "Remote - US"}}]})
    lever = json.dumps([{"text": "TPM", "hostedUrl": "v", "createdAt": 1714557600000, "additionalPlain": "a\n$100 - $200 \n$3", "categories": {"location": "Paris"}}])
    ok = json.dumps([{"legal": "note"}, {"position": "Dev", "company": "C", "salary_min": 1000, "salary_max": 200000, "tags": ["a"]}])
    raw = lambda body: spark.createDataFrame([("big-co", body), ("broken", "{"), ("none", None)], "slug string, body string")
    rows = {r.source: r for r in feeds.ingest([feeds.from_greenhouse(raw(green)), feeds.from_lever(raw(lever)), feeds.from_remoteok(raw(ok))]).collect()}
    g, v, r = rows["greenhouse:big-co"], rows["lever:big-co"], rows["remoteok"]
    assert (g.company, g.remote, g.description, g.posted_date.year) == ("Big Co", "remote", "Hi there", 2024)
    assert (v.salary_text, v.remote) == ("$100 - $200", "unknown") and (r.salary_text, r.technologies) == ("$1,000-$200,000", ["a"])
    assert len(rows) == 3


def test_pages(spark):
    html = '<nav><a href="/n">Nav</a></nav><p>One &amp; two</p>\n\n\n\nREQ12345<div>x<br>y</div><a href="/job">Job</a>'
    pages = spark.createDataFrame([(1, "http://a.com/x", html), (2, None, None), (3, "http://b.com", "<p")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in feeds.clean_pages(pages).collect()}
    assert "One & two" in got[1] and "Nav" not in got[1] and got[2] == ""
    assert {(r.href, r.label) for r in feeds.page_links(pages).collect()} == {("http://a.com/n", "Nav"), ("http://a.com/job", "Job")}


def test_logs(spark):
    lines = ["noise", "2024-01-01 10:00:00,1 [INFO] app.x: hello", "  more", "2024-01-01 10:00:01,1 [ERROR] app.y: bad"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no int, value string")
    got = sorted(tuple(r) for r in feeds.read_logs(df).collect())
    assert [g[5] for g in got] == ["hello\n  more", "bad"] and [g[3] for g in got] == ["INFO", "ERROR"]


def test_cards(spark):
    html = '<li class="job new">A <b>x</b><a href="/j/1">go</a><br>B<script>no</script></li><li class="old">C</li><li class="job">D<ul><li>in</li></ul></li>'
    other = '<div data-id="1">one</div><div data-id="2"><a href="http://z.com/2">two</a></div><a href="x/jobs/results?1">three</a>'
    pages = spark.createDataFrame([(1, "http://a.com/x", html), (2, None, other), (3, "http://b.com", None), (4, "http://b.com", "<p>none")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.card_index, " ".join(r.text.split()), r.url_hint) for r in feeds.cards_from_html(pages, ("li.job", "[data-id]", "a[href*='jobs/results']")).collect())
    assert got == [(1, 0, "A xgo B", "http://a.com/j/1"), (1, 1, "Din", None), (2, 0, "one", None), (2, 1, "two", "http://z.com/2")]
    assert [r.url_hint for r in feeds.cards_from_html(pages, ("a[href*='jobs/results']",)).collect()] == ["x/jobs/results?1"]


def test_long_logs_are_counted_in_blocks(spark, monkeypatch):
    lines = [f"2024-01-01 10:00:00,1 [INFO] app: r{i // 3}" if i % 3 == 0 else f"more {i}" for i in range(40)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)] + [("g", 0, "noise")], "file string, line_no int, value string")
    want = sorted(map(tuple, feeds.read_logs(df).collect()))
    monkeypatch.setattr(feeds, "LOG_BLOCK", 4)
    assert sorted(map(tuple, feeds.read_logs(df).collect())) == want and len(want) == 14


def test_more_feeds(spark):
    body = lambda b: spark.createDataFrame([("big-co", 0, b), ("broken", 1, "{"), ("none", 2, None)], "slug string, page int, body string")
    ashby = {"jobs": [{"id": "7", "title": "Senior PM", "location": {"name": "Remote"}, "department": "Core", "descriptionPlain": "x"}, {"title": "PM", "location": "Rome", "jobUrl": "u"}]}
    a = sorted(feeds.from_ashby(body(json.dumps(ashby))).collect(), key=lambda r: r.title)
    assert [(r.location, r.remote, r.url, r.seniority) for r in a] == [("Rome", "unknown", "u", "mid"), ("Remote", "remote", "https://jobs.ashbyhq.com/big-co/7", "senior")]
    amazon = {"jobs": [{"title": "T", "job_path": "/p", "posted_date": "May 3, 2024", "basic_qualifications": "needs"}, {"title": "T", "job_path": "/p"}]}
    (r,) = feeds.from_amazon(body(json.dumps(amazon))).collect()
    assert (r.url, r.technologies, r.posted_date.day) == ("https://www.amazon.jobs/p", ["needs"], 3)
    (r,) = feeds.from_jobicy(body(json.dumps({"jobs": [{"jobTitle": "T", "annualSalaryMin": "1000", "annualSalaryMax": "20000", "jobType": ["full-time"]}]}))).collect()
    assert (r.salary_text, r.location, r.job_type) == ("$1,000-$20,000", "Remote", "full-time")
    (r,) = feeds.from_remotive(body(json.dumps({"jobs": [{"title": "T", "salary": " $5 ", "publication_date": "2024-05-01T01:02:03", "tags": ["a"]}]}))).collect()
    assert (r.salary_text, r.posted_date.hour, r.technologies) == ("$5", 0, ["a"])


def test_workday_keeps_cards_without_details(spark):
    cards = json.dumps({"jobPostings": [{"title": " PM ", "externalPath": "/job/1", "locationsText": "Remote, US"}, {"title": "X", "externalPath": "/job/2"}]})
    c = spark.createDataFrame([("acme", "wd1", "board", cards)], "tenant string, region string, board string, body string")
    d = spark.createDataFrame([("acme", "job/1", json.dumps({"jobPostingInfo": {"jobDescription": "<p>Hi</p>"}})), ("acme", "job/9", None)], "tenant string, path string, body string")
    got = {r.title: r for r in feeds.from_workday(c, d).collect()}
    assert (got["PM"].description, got["PM"].remote, got["PM"].url) == ("Hi", "remote", "https://acme.wd1.myworkdayjobs.com/board/job/1")
    assert set(got) == {"PM", "X"} and not got["X"].description
    done = {r.title: r.signature for r in feeds.finalize(feeds.from_workday(c, d).withColumns({"salary_min": F.lit(None).cast("long"), "salary_max": F.lit(None).cast("long")})).collect()}
    assert done["PM"] == "PM | @ Acme | (mid; remote; Remote, US) | Hi"


def test_trimmed_descriptions(spark):
    html = "<p>About</p><h2>Responsibilities:</h2><ul><li>do</li></ul><h2>Perks</h2><p>no</p><p><strong>Requirements</strong></p><p>have &amp; hold</p>"
    long = "<h3>Your role</h3><p>" + "x" * 900 + "</p>"
    rows = spark.createDataFrame([(1, html), (2, "<p>plain</p>"), (3, None), (4, long), (5, "")], "page_id long, html string")
    got = {r.page_id: r.html for r in feeds.trim_descriptions(rows).collect()}
    assert got[1] == "<h2>Responsibilities:</h2>\n<ul><li>do</li></ul>\n<p><strong>Requirements</strong></p>\n<p>have &amp; hold</p>"
    assert got[2] == "<p>plain</p>" and got[3] is None and got[5] == "" and got[4] == "<h3>Your role</h3>\n<p>… more in full description</p>"


def test_log_tail_and_snapshots(spark, tmp_path):
    rows = [("f", i, level) for i, level in enumerate(["INFO", "ERROR", "DEBUG", "WARNING"])]
    df = spark.createDataFrame(rows, "file string, record int, level string")
    assert [r.record for r in feeds.tail_logs(df, 1, "WARNING").collect()] == [3] and feeds.tail_logs(df, 9, "WARNING").count() == 2
    for i, t in enumerate(['{"n": 1}', "{bad", '{"n": 3}']):
        (tmp_path / f"{i}.json").write_text(t)
        os.utime(tmp_path / f"{i}.json", (1000 + i, 1000 + i))
    assert sorted(r.n for r in feeds.read_snapshots(spark, str(tmp_path), "n int").collect()) == [1, 3]
    assert [r.n for r in feeds.read_snapshots(spark, str(tmp_path), "n int", 1).collect()] == [3]


def test_pages_are_parsed_in_pieces_of_bounded_bytes():
    import pyarrow as pa

    html = ["x" * 400, None, "y" * 500, "z" * 3000, "", "w" * 900, "v" * 101]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(7)), "html": pa.array(html, pa.string())})
    got = [p.column("page_id").to_pylist() for p in feeds.pieces([batch, batch.slice(0, 0)], "html", 1000)]
    assert got == [[0, 1, 2], [3], [4, 5], [6]]
