"""Quality rules, URL filters and secret scans: by SQL, by brute force, and on odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import jaccard_join, quality_rules, secret_scan, url_filters
from pagewright.llm.components import components

ODD = [(1, None, None, None, 0, "x"), (2, "", "en", None, 0, "x"), (3, "a " * 30, "en", "s", 60, "y"), (3, "a " * 30, "en", "s", 60, "y"), (None, "words " + "é" * 50, None, "s", 56, None)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string"


def duck(df, name, sql):
    con = duckdb.connect()
    con.register(name, df.toPandas())
    return con.sql(sql).df()


def same(a, b):
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert key(a) == key(b)


def test_quality_rules_by_sql(spark):
    text = "one two three four five six seven eight nine ten eleven twelve\n"
    rows = [(i, text * (1 + i % 4) + "###" * (i % 3), "en", f"s{i % 2}", 0, None) for i in range(40)] + [(100, "$$$ %%% " * 40, "en", "s0", 0, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    same(quality_rules.quality_rules(docs).toPandas(), duck(docs, "documents", quality_rules.oracle()))


def test_thresholds_follow_their_source(spark):
    """The same text passes where its like is usual and goes where it is not; a small source leans on its language."""
    plain, marked = "plain words of some text that goes on and on " * 8, "*marked* words & more | of some text that goes on " * 8
    rows = [(i, plain, "en", "prose", 0, None) for i in range(3000)] + [(5000 + i, marked, "en", "wiki", 0, None) for i in range(1000)]
    rows += [(9000, marked, "en", "prose", 0, None), (9001, plain, "en", "wiki", 0, None), (9002, plain, "en", "tiny", 0, None), (9003, "$#" * 90 + plain, "en", "tiny", 0, None)]
    rows = [(i, f"{t} {i} end of it all", *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, COLUMNS)
    wide = quality_rules.quality_rules(docs, repeat_percent=100).toPandas().set_index("doc_id")
    assert wide.loc[5000:5999, "kept"].all() and wide.loc[0:2999, "kept"].all()
    assert not wide.loc[9000, "kept"] and wide.loc[9001, "kept"] and wide.loc[9002, "kept"] and not wide.loc[9003, "kept"]


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)})


@pytest.mark.parametrize("text", ["a " * 9, "a " * 8, "a b c d e f g h i " * 2, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8", "", "a\x0bb\x1cc"])
def test_repeat_words(spark, text):
    row = quality_rules.measures(spark.createDataFrame([(1, text, "en", "s", 0, "")], COLUMNS)).first()
    assert row["n_repeat_words"] == brute_repeats(text) and row["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_rules_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == 5 and all(r["base_failed"] for r in got) and not any(r["kept"] for r in got)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


PAGES = [
    (1, "http://a.example.com/en/7", '<link rel="canonical" href="http://b.example.com/fr/1">'), (2, "http://b.example.com/fr/1", None), (3, "http://x.com/en/1", "<link rel=canonical href=/zz>"),
    (4, "http://X.com/zz", '<meta http-equiv="refresh" content="0; url=//y.org/q">'), (5, "https://y.org/q#f", ""), (6, None, "x"), (7, "nohost", None), (8, "http://notexample.com/en/7", ""), (8, "http://notexample.com/en/7", ""), (9, "http://n.example.net/de/81", None), (10, "http://o.org/es", None),
]


def test_url_filters(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = url_filters.url_filter(pages)
    verdicts = {(r["page_id"], r["rule"]): r["verdict"] for r in got.collect()}
    assert verdicts[2, None] == "allow" and verdicts[4, None] == "block" and verdicts[5, None] == "block" and verdicts[6, None] == "allow"
    assert verdicts[1, "example.com/en/7"] == "allow" and verdicts[8, "com/en/"] == "block" and verdicts[9, "example.net/de/8"] == "block" and verdicts[10, None] == "allow"
    assert url_filters.url_filter(pages.limit(0)).count() == 0
    extra = spark.createDataFrame([("http://o.org/es", "http://x.com/en/5")], "from_url string, to_url string")
    assert {r["verdict"] for r in url_filters.url_filter(pages, extra).where("page_id = 10").collect()} == {"block"}


def test_links_of_every_form(spark):
    link = lambda href, rel="canonical": f"<link rel={rel} href={href}>"
    forms = {
        "relative": ("http://h.org/a/b/p", link("../../es/2"), "h.org/es/2"),
        "relative to the base": ("http://h.org/a", '<base href="http://k.org/x/y">' + link("./es/./3"), "k.org/x/es/3"),
        "entity": ("http://h.org/a", link('"http://k.org/es?x=1&amp;y=&#38;z"'), "k.org/es?x=1&y=&z"),
        "second": ("http://h.org/a", link("/one") + link("'/es/4'"), "h.org/es/4"),
        "port": ("http://h.org/a", link("https://k.org:443/es/5"), "k.org/es/5"),
        "other port": ("http://h.org/a", link("http://k.org:443/es/5"), "k.org:443/es/5"),
        "href first": ("http://h.org/a", '<LINK data-rel="x" HREF="//k.org/es/6" REL="alternate Canonical" />', "k.org/es/6"),
        "refresh": ("https://h.org/a", """<meta content="5; URL='/es/7'" http-equiv='Refresh'>""", "h.org/es/7"),
        "query": ("http://h.org/a?z", link("?q"), "h.org/a?q"),
        "comment": ("http://h.org/a", "<!-- " + link("/es/8") + " -->", None),
        "script": ("http://h.org/a", "<script>'" + link("/es/9") + "'</script>", None),
        "another relation": ("http://h.org/a", link("/es/10", "alternate"), None),
        "no url": ("http://h.org/a", link("mailto:x@y.org"), None),
        "fragment": ("http://h.org/a", link("#top"), None),
    }
    pages = spark.createDataFrame([(i, url, html) for i, (url, html, _) in enumerate(forms.values())], "page_id long, url string, html string")
    for i, (form, (_, _, want)) in enumerate(forms.items()):
        got = {r["v"] for r in url_filters.alias_edges(pages.where(f"page_id = {i}")).collect()} - {None}
        assert (want in got) if want else not got, (form, got)
    same(url_filters.url_filter(pages).toPandas(), duck(pages, "pages", url_filters.oracle()))
    same(url_filters.url_filter(spark.createDataFrame(PAGES, pages.schema)).toPandas(), duck(spark.createDataFrame(PAGES, pages.schema), "pages", url_filters.oracle()))


def test_components_by_brute_force(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 1)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) >= {x for x in root if find(x) != x}


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 6]
    for kind, rx, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rx, text or "") if len(m[0]) >= least]
    return sorted(out)


SECRETS = [
    'é TOKEN: "abcdef" password=xyz secret =  token=longvalue', "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + "😀AKIAAKIA" + "C" * 30, "0" * 23 + "g" + "a1" * 12 + "\npasswd='0123456789abcdef01234567'", None, "", "api_key:x apikey = 123456 api__key=123456",
]


def test_secret_base(spark):
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(SECRETS)], "doc_id long, text string, spans string")
    for r in secret_scan.secret_scan(docs).collect():
        want = brute_spans(SECRETS[r["doc_id"]])
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_random_tokens_are_added_and_words_are_not(spark):
    import random

    random.seed(5)
    alphabet = secret_scan.ENCODINGS[2][2]
    token = lambda: "".join(random.choice(alphabet) for _ in range(40))
    rows = [(i, f"see {token()} here") for i in range(60)] + [(100 + i, f"section1and2of{'thelongwordthatgoeson' * 2}{i}") for i in range(40)]
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 50 and sum(got[100 + i] for i in range(40)) <= 4


def test_random_tokens_of_every_encoding_are_added(spark):
    import random
    import string

    random.seed(6)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    sets = {"base32": lower + "234567", "base36": lower + digits, "BASE36": upper + digits, "base62": upper + lower + digits, "base64": upper + lower + digits + "+/"}
    few = lambda t: sum(c in digits for c in t) < 2
    rows, kinds = [], {}
    for name, symbols in sets.items():
        for _ in range(80):
            kinds[len(rows)] = name
            rows.append((len(rows), "".join(random.choice(symbols) for _ in range(30))))
    while sum(k == "few digits" for k in kinds.values()) < 80:
        token = "".join(random.choice(sets["base64"]) for _ in range(30))
        if few(token):
            kinds[len(rows)] = "few digits"
            rows.append((len(rows), token))
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for name in set(kinds.values()):
        assert sum(got[i] for i, k in kinds.items() if k == name) >= 66, name


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef0123456789abcdef01 end", 36), (2, "plain", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.masked(docs, docs.columns).collect()}
    assert got == {1: ("é [secret] end", 14), 2: ("plain", 5), 3: (None, None)}


def test_clashing_names_and_repeated_rows(spark):
    names = ["doc_id", "text", "base", "cand", "added", "row", "n_chars", "none", "new_text", "a.b", "gone"]
    rows = [(1, "token=abcdef123456", *"xyzw", 18, *"pqrs"), (1, "token=abcdef123456", *"xyzw", 18, *"pqrs"), (2, None, *"xyzw", None, *"pqrs")]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    got = secret_scan.masked(docs, docs.columns)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted([(1, "[secret]", *"xyzw", 8, *"pqrs")] * 2 + [(2, None, *"xyzw", None, *"pqrs")])
    assert [r["n_assign"] for r in secret_scan.secret_scan(docs).collect()] == [1, 1, 0]
    assert [r["text"] for r in jaccard_join.one_of_each(docs, docs.columns).orderBy("doc_id").collect()] == ["token=abcdef123456", None]


def test_running(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(i, [rng.randrange(-9, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 63, 64, 65, 128, 129, 1000))]
    got = spark.createDataFrame(rows, "i int, v array<int>").select("i", secret_scan.running(F.col("v"), lambda a, b: a + b).alias("s"), secret_scan.running(F.col("v"), F.greatest).alias("m")).collect()
    assert [(r["s"], r["m"]) for r in sorted(got)] == [(list(itertools.accumulate(v)), list(itertools.accumulate(v, max))) for _, v in rows]


def test_many_spans_of_one_long_text(spark):
    import random
    import time

    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["é", "word", "😀", "x=1"]) for _ in range(n))
    text = " ".join(f"{words(rng.randrange(4))} {''.join(rng.choice('0123456789abcdef') for _ in range(24))} {'password: ' + 'k' * 7 if rng.random() < 0.2 else ''}" for _ in range(16000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began, want = time.time(), brute_spans(text)
    row = secret_scan.secret_scan(docs).first()
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    out, at = [], 0
    for a, _, b in want:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    assert secret_scan.masked(docs, docs.columns).first()["text"] == "".join(out) + text[at:]
    assert time.time() - began < 60
