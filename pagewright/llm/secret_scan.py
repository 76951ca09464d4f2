"""Secret scans: fixed patterns, then a randomness test battery that adds spans.

Base kinds are assign, access and hex. The battery looks at every other long token: it infers the token's encoding (hex, base32
or base36 of one case, base62, base64 or base64url) from its alphabet and tests it as a draw of independent, uniform symbols:
chi-squared over the alphabet in classes, a runs test about the alphabet's middle, and the lag-one serial correlation. The three p-values are combined by
Fisher's method. Random tokens spread evenly over [0, 1], language and structured tokens pile up near 0, so, for every band
of token lengths, the histogram of all p-values of the corpus estimates how many tokens above a cut are not random, and the
cut is the least one that holds this false-discovery share at `alpha`. Only the histogram (bands times bins) leaves the
executors.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty result; other
columns are not read. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import laid_down, let, quoted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of these characters is the leftmost match; shorter runs hold no longer one, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "random")
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: (encoding, pattern of its tokens, symbols in order); the first that fits is taken.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "^[A-Za-z0-9+/]*[+/][A-Za-z0-9+/]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]*[_-][A-Za-z0-9_-]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base32 in lower case", "^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base36 in lower case", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
)
CLASSES = 8
#: Values that running() runs through at once, and characters of a chunk of text.
STRETCH, CHUNK = 64, 4096
BANDS = (24, 32, 48, 64)
BINS = 50
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def running(values: Column, step) -> Column:
    """The values with all before them taken in by step: sums or maxima. Stretches are run through by themselves and what came before
    each is added, so that n values cost n times a stretch, not n times n."""

    def grown(xs: Column) -> Column:
        first = F.slice(xs, 1, 1)
        return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), first, lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))

    def joined_up(xs: Column) -> Column:
        def with_ends(parts: Column) -> Column:
            ends = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: step(F.get(e, i - 1), v))))))

        places = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int"))
        return let(F.transform(places, lambda j: grown(F.slice(xs, j * STRETCH + 1, STRETCH))), with_ends)

    return F.when(F.size(values) > 0, let(values, joined_up)).otherwise(values)


def matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches: what lies between them and they themselves give the positions."""

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
        steps = let(gaps, lambda g: F.transform(found, lambda x, i: F.get(g, i) + F.length(x)))
        span = lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.lit(None).cast("double").alias("p"), x.alias("text"))
        return let(running(steps, lambda a, b: a + b), lambda e: F.transform(found, lambda x, i: span(x, F.get(e, i))))

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    out = F.when(text.rlike(pattern), let(found, located)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,p:double,text:string>>"))
    return F.filter(out, keep) if keep else out


def apart(base: Column, others: Column) -> Column:
    """Of the other spans, whose kind is greater, those that share no place with a base span."""

    def sifted(spans: Column) -> Column:
        of_base = lambda s, value, rest: F.when(s["kind"] < 3, value).otherwise(F.lit(rest))
        reached = running(F.transform(spans, lambda s: of_base(s, s["end"], -1)), F.greatest)
        coming = F.reverse(running(F.reverse(F.transform(spans, lambda s: of_base(s, s["start"], 2**31 - 1))), F.least))
        return let(F.struct(reached.alias("r"), coming.alias("c")), lambda x: F.filter(spans, lambda s, i: (s["kind"] == 3) & (F.get(x["r"], i) <= s["start"]) & (F.get(x["c"], i) >= s["end"])))

    return F.when(F.size(base) == 0, others).when(F.size(others) == 0, others).otherwise(let(F.array_sort(F.concat(base, others)), sifted))


def normal_tail(z: Column) -> Column:
    """P(Z > z), to about 2e-4, by the logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def chi_tail(x: Column, df: float) -> Column:
    """P(chi-squared > x), by Wilson and Hilferty."""
    s = 2 / (9 * df)
    return normal_tail((F.pow(x / df, 1 / 3) - (1 - s)) / s**0.5)


def randomness(token: Column) -> Column:
    """The combined p-value of a token under "independent uniform symbols of its encoding"; null for an unknown alphabet."""
    body = F.regexp_replace(token, "=+$", "")
    symbols = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        symbols = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(symbols)

    def battery(pair: Column) -> Column:
        codes, k = pair["codes"], pair["k"]
        n = F.size(codes).cast("double")
        width = k / CLASSES
        cells = F.transform(codes, lambda c: F.floor(c / width).cast("int"))
        counts = let(cells, lambda cs: F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda j: F.size(F.filter(cs, lambda c: c == j)).cast("double")))
        add = lambda a, v: a + v
        zero = F.lit(0.0)
        # a class of an alphabet that CLASSES does not divide holds a symbol more or less
        mean_of = lambda j: n * (F.ceil((j + 1) * width) - F.ceil(j * width)) / k
        chi = F.aggregate(F.transform(counts, lambda c, j: F.pow(c - mean_of(j), 2) / mean_of(j)), zero, add)
        p_chi = chi_tail(chi, CLASSES - 1)
        high = F.transform(codes, lambda c: (c >= k / 2).cast("double"))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, zero, add)
            n2 = n - n1
            r = 1 + F.aggregate(F.transform(h, lambda v, i: F.when((i > 0) & (v != F.get(h, i - 1)), 1.0).otherwise(0.0)), zero, add)
            mean = 2 * n1 * n2 / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when((n1 > 0) & (n2 > 0) & (var > 0), 2 * normal_tail(F.abs(r - mean) / F.sqrt(var))).otherwise(F.lit(1e-12))

        mid = (k - 1) / 2
        dev = F.transform(codes, lambda c: c - mid)

        def serial(d: Column) -> Column:
            den = F.aggregate(F.transform(d, lambda v: v * v), zero, add)
            num = F.aggregate(F.transform(d, lambda v, i: F.coalesce(v * F.get(d, i + 1), zero)), zero, add)
            return F.when(den > 0, 2 * normal_tail(F.abs(num / den) * F.sqrt(n))).otherwise(F.lit(1e-12))

        fisher = -2 * (F.log(F.greatest(p_chi, F.lit(1e-12))) + F.log(F.greatest(let(high, runs), F.lit(1e-12))) + F.log(F.greatest(let(dev, serial), F.lit(1e-12))))
        return chi_tail(fisher, 6)

    folded = F.when(body.rlike("^[0-9A-F]+$"), F.lower(body)).otherwise(body)

    def coded(x: Column) -> Column:
        # the alphabet is bound once; looked for in every step it would be found anew for each character
        codes = F.transform(F.split(x["folded"], ""), lambda c: F.instr(x["symbols"], c).cast("double") - 1)
        return let(F.struct(codes.alias("codes"), F.length(x["symbols"]).cast("double").alias("k")), battery)

    return F.when(symbols.isNotNull(), let(F.struct(symbols.alias("symbols"), folded.alias("folded")), coded))


def candidates(text: Column) -> Column:
    """Spans of long tokens; which of them are random is left to the tests."""
    return matches(text, TOKEN, 3)


def band_of(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(length < BANDS[i], i).otherwise(out)
    return out


def cuts(tested: DataFrame, alpha: float) -> dict[int, float]:
    """For each length band the least p-value whose takers hold at most alpha tokens that are not random, by the histogram of all p-values."""
    hist: dict[int, list[int]] = {}
    for band, b, n in tested.groupBy("band", F.least(F.floor(F.col("p") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin")).agg(F.count("*")).collect():
        hist.setdefault(band, [0] * BINS)[b] = n
    out = {}
    for band, h in hist.items():
        uniform = sum(h[BINS // 2 :]) / (BINS - BINS // 2)
        out[band] = 2.0
        for b in range(BINS):
            taken = sum(h[b:])
            # the first bin holds what is not random; the estimate asks for some evidence above it
            if b and taken and max(0.0, taken - uniform * (BINS - b)) <= alpha * taken:
                out[band] = b / BINS
                break
    return out


def scan(docs: DataFrame, keep: list[str], alpha: float = 0.1) -> DataFrame:
    """row (a struct of the kept columns), base (spans) and added (spans that the battery finds, none over a base span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = F.regexp_extract
    base = F.concat(
        matches(text, ASSIGN, 0, lambda x: F.length(value(x["text"], ASSIGN, 2)) >= ASSIGN_LEAST),
        matches(text, ACCESS, 1),
        matches(text, HEX, 2),
    )
    rows = docs.select(F.struct(*quoted(keep)).alias("row"), base.alias("base"), candidates(text).alias("cand"))
    rows = rows.select("row", F.transform("base", _span).alias("base"), apart(F.col("base"), F.col("cand")).alias("cand"))
    tested = F.filter(F.transform("cand", lambda c: F.struct(c["start"], c["kind"], c["end"], randomness(c["text"]).alias("p"))), lambda c: c["p"].isNotNull())
    rows = laid_down(rows.select("row", "base", tested.cast(SPAN).alias("cand")))
    flat = rows.select(F.explode("cand").alias("c")).select(band_of(F.col("c.end") - F.col("c.start")).alias("band"), F.col("c.p").alias("p"))
    limits = cuts(flat, alpha)
    least = lambda c: F.coalesce(F.get(F.array(*[F.lit(limits.get(b, 2.0)) for b in range(len(BANDS) + 1)]), band_of(c["end"] - c["start"])), F.lit(2.0))
    return rows.select("row", "base", F.filter("cand", lambda c: c["p"] >= least(c)).alias("added"))


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["p"].alias("p"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = scan(docs, ["doc_id"], alpha)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def masked(docs: DataFrame, columns: list[str], mask: str = "[secret]", alpha: float = 0.1) -> DataFrame:
    """docs with every span replaced by mask and n_chars set anew; overlapping spans are one. Columns may have any names."""
    rows = scan(docs, columns, alpha)
    text = F.col("row.text")

    def redacted(spans: Column) -> Column:
        # a text in chunks, so that a piece is cut from a few of them and not looked for from the text's beginning
        def cut_up(chunks: Column) -> Column:
            def piece(start: Column, end: Column) -> Column:
                first = F.floor(start / CHUNK).cast("int")
                some = F.slice(chunks, first + 1, F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int") - first + 1)
                return F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)

            def pieces(reached: Column) -> Column:
                before = lambda i: F.when(i == 0, 0).otherwise(F.get(reached, i - 1))
                parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), F.lit(mask))).otherwise(F.lit("")))
                return F.concat(F.array_join(parts, ""), piece(F.element_at(reached, -1), F.length(text)))

            return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), pieces)

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), cut_up)

    none = F.size("base") + F.size("added") == 0
    new_text = F.when(none, text).otherwise(let(F.array_sort(F.concat("base", "added")), redacted))
    rows = rows.select("row", none.alias("none"), new_text.alias("new_text"))
    made = {"text": F.col("new_text"), "n_chars": F.when(F.col("none"), F.col("row.n_chars")).otherwise(F.length("new_text").cast("long")) if "n_chars" in columns else None}
    return rows.select(*[(F.col("row").getField(c) if c not in made else made[c]).alias(c) for c in columns])
