"""robots rules against the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

from pagemill.operators import robots

AGENT = "PageMill/1.0 (+x)"
LINES = [
    "User-agent: *", "User-agent: pagemill", "user-agent : MILL", "User-agent: other", "User-agent:", "Disallow:",
    "Disallow: /", "Disallow: /a", "Allow: /a/b", "Allow: /", "Disallow: *", "Disallow: /%61", "Disallow: /a%2fb # c",
    "Disallow: /c?q=1", "disallow:/é", "Allow: /%C3%A9", "Crawl-delay: 5", "Crawl-delay: x", "Request-rate: 1/5", "Sitemap: http://x/s",
    "", "", " ", "# note", "nonsense", "Disallow: /100%", "Disallow: /a+b", "Disallow: //x", "Disallow: /;p", "Noindex: /",
]
PATHS = ["", "/", "/a", "/a/b", "/%61/x", "/é", "/%C3%A9", "/c?q=1", "/c", "/100%", "/a+b", "/a%20b", "/*", "//x/y", "/;p", "/a%2Fb"]


def test_random_bodies(spark):
    rnd = random.Random(7)
    bodies, urls, want = [], [], {}
    for i in range(400):
        end = rnd.choice(["\n", "\r\n", "\r"])
        body = end.join(rnd.choice(LINES) for _ in range(rnd.randint(0, 12)))
        origin = f"http://h{i}.x"
        bodies.append((origin, 200, body))
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for path in rnd.sample(PATHS, 6):
            urls.append((origin + path,))
            want[origin + path] = parser.can_fetch(AGENT, origin + path)
    table = robots.robots_table(spark.createDataFrame(bodies, "origin string, http_status int, body string"), AGENT)
    got = robots.robots_verdicts(spark.createDataFrame(urls, "url string"), table)
    rows = got.collect()
    assert len(rows) == len(urls)
    assert [r for r in rows if r.allowed != want[r.url]] == []
    assert sum(not r.allowed for r in rows) > 100


def test_policy(spark):
    cases = [(200, "x", "rules"), (200, None, "allow_all"), (401, None, "deny_all"), (403, None, "deny_all"),
             (404, None, "allow_all"), (500, None, "deny_all"), (None, None, "allow_all")]
    rows = [(f"http://h{i}", s, b) for i, (s, b, _) in enumerate(cases)]
    got = robots.robots_policy(spark.createDataFrame(rows, "origin string, http_status int, body string"))
    assert {r.origin: r.policy for r in got.collect()} == {f"http://h{i}": c[2] for i, c in enumerate(cases)}


def test_unknown_origin_is_allowed(spark):
    table = robots.robots_table(spark.createDataFrame([("http://a", 500, None)], "origin string, http_status int, body string"))
    got = robots.robots_verdicts(spark.createDataFrame([("http://a/x",), ("http://b/x",)], "url string"), table)
    assert {r.url: r.allowed for r in got.collect()} == {"http://a/x": False, "http://b/x": True}


def test_prefix_join_on_an_origin_of_many_rules(spark):
    """The join form judges like the array form, and needs no array of an origin's rules."""
    lines = ["User-agent: other", "Disallow: /", "", "User-agent: *"]
    lines += [f"{'Allow' if k % 3 == 0 else 'Disallow'}: /p/{k:x}" for k in range(20_000)] + ["Disallow: /q"]
    bodies = spark.createDataFrame(
        [("http://h", 200, "\n".join(lines)), ("http://g", 403, None), ("http://k", None, None), ("http://m", 200, "User-agent: *\nDisallow: /")],
        "origin string, http_status int, body string",
    )
    urls = [f"http://{h}/{p}/{k * 37:x}/x" for h in "hgkmn" for p in "pqr" for k in range(150)] + ["http://h", None, "http://h/p/ff", "http://h/p/ff"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "n long, url string")
    array = robots.robots_verdicts(frame, robots.robots_table(bodies))
    paths = robots.agent_paths(robots.parse_robots(bodies))
    joined = robots.robots_verdicts_by_prefix(frame, robots.robots_policy(bodies), paths)
    assert {tuple(r) for r in array.select("n", "url", "allowed").collect()} == {tuple(r) for r in joined.select("n", "url", "allowed").collect()}
    assert joined.count() == len(urls) and {r.allowed for r in joined.collect()} == {True, False}
