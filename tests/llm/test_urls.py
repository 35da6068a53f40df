import random
import re

from docrecon.llm import urls
from docrecon.llm.queries import SITES

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    parts = path.split("/")[1:]
    return host, path, None, "block" if any(s in parts for s in ("cgi-bin", "wp-login.php", "wp-admin", "adserver")) else "allow"


def test_equals_trying_every_rule(spark):
    draw = random.Random(1)
    bits = ["example", "EXAMPLE", "org", "com", ".", "/", "?", "#", "es", "en", "de", "fr", "1", "123", "é", "cgi-bin", "\n", "://", "x"]
    made = [None, "", "no scheme", "http://", "https://Example.ORG", "http://a.example.org/en/123?x=/es/", "http://org/",
            "http://xorg/", "http://x.com/fr/", "http://x.com/a/cgi-bin", "http://x.com/a/cgi-binary", "u://com/de/?/"]
    made += ["http://" + "".join(draw.choice(bits) for _ in range(draw.randint(1, 9))) for _ in range(4000)]
    made += ["http://" + draw.choice(["", "m.", "a.b."]) + draw.choice(["example.org", "example.com", "org", "shop.com"])
             + "/" + "".join(draw.choice(["es/", "en/", "de/", "fr/", "1", "12/", "q"]) for _ in range(3)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    for r in urls.judge_urls(df, SITES + urls.GENERIC).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(made[r.page_id]), made[r.page_id]


def test_awkward_rows(spark, awkward, nothing):
    df = awkward.selectExpr("doc_id AS page_id", "text AS url", "'h' AS host", "'v' AS verdict", "id")
    rows = urls.judge_urls(df, SITES).collect()
    assert len(rows) == awkward.count() and {r.verdict for r in rows} == {"allow"}
    assert urls.judge_urls(df.where("false"), SITES).count() == 0
    assert urls.judge_urls(df, []).count() == len(rows)
