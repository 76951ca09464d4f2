"""Footer names, robots rules on sampled links, encoded urls, and that an audit looks at the pages that matter."""

from urllib.parse import quote

from pyspark.sql import functions as F

from pagewright import capture_queries as Q
from pagewright.functions import text as T
from pagewright.operators import captures as W
from pagewright.operators import robots as R


def test_footer_names(spark):
    got = {r["page_id"]: r["name"] for r in Q.footer_name(spark, "").collect()}
    assert got == {1: "Acme Widgets Inc", 2: "Second Name GmbH", 3: None, 4: None, 5: None}


def test_sampled_links_are_allowed_by_robots(spark):
    robots = R.robots_rows(spark.createDataFrame([("a", "User-agent: *\nDisallow: /private\nAllow: /")], "site_id string, body string"))
    every = {r["url"] for r in W.link_rot_sample(Q.LINKS.frame(spark), Q.SEEN.frame(spark), Q.HOSTS.frame(spark), most=99).collect()}
    some = {r["url"] for r in W.link_rot_sample(Q.LINKS.frame(spark), Q.SEEN.frame(spark), Q.HOSTS.frame(spark), robots, most=99).collect()}
    assert every - some == {"http://a.example/private/1"}


def test_encoded_urls_by_the_library(spark):
    safe = ":/?#[]@!$&'()*+,;=%~-._"
    urls = ["https://a.example/é", "https://x/日本?q=ü", "a b\t\"<>\\^`{|}", "%zz%E0", "ÿ", "😀"]
    frame = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    want = {}
    for i, u in enumerate(urls):
        try:
            want[i] = quote(u.encode("latin-1"), safe=safe)
        except UnicodeEncodeError:
            want[i] = quote(u.encode(), safe=safe)
    assert {r["i"]: r["e"] for r in frame.select("i", T.pct_encode_url(F.col("url")).alias("e")).collect()} == want
