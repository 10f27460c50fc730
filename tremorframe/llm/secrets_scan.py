"""Secret scans: known forms, and a randomness test battery with false-discovery control.

Known forms (kinds assign, access, hex) are regular expressions. Beside them, candidates are
runs of at least MIN_LENGTH characters of ``[A-Za-z0-9+/_-]``, with up to two ``=`` at the end, that hold a digit; so
of ``NAME=value`` the value is tested by itself. A candidate's encoding is
the smallest alphabet that holds it (hex, base32, base62, base64; letters alone are taken for
words, digits alone for numbers). Three tests ask whether its symbols are uniform: chi-squared over BINS bins
of the alphabet, runs above and below the alphabet's middle, and lag-1 serial correlation.
Fisher's method combines them to one p-value.

For strata of encoding and length the corpus's p-values show how many candidates are random:
those are uniform, others pile up near 0, so twice the number above 1/2 estimates the random
ones. In each stratum, the lowest threshold at which the rest is at most FDR of what
passes is taken; candidates that pass, and touch no known form, are kind ``random``.

Everything is built-in functions on columns; positions come from splitting a text at a pattern and adding
up lengths. One pass reads texts and leaves a table of spans and candidates (no text); thresholds (one row a
stratum) and the result come from that. A stratum of under LEAST candidates also counts those of the nearest lengths of its encoding
until there are LEAST, or no more.

Edge cases: a null text is empty; repeated rows and rows of equal doc_id give a row each; a null doc_id is carried along;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

# The patterns of the known forms, by kind in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH, BINS, FDR, P_STEPS, LEAST = 20, 8, 0.05, 100, 50
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+={{0,2}}"
# Alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SPAN = "struct<start: int, kind: int, end: int, value: string>"


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of spans of a pattern's matches, leftmost and not overlapping, in code points; ``value`` is ``group``."""
    p = F.lit(pattern)
    # Without a match the text is scanned once; with one, split and extract run the same search.
    hits = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["match"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull() & (F.char_length(x["value"]) >= least), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(hits, zero, step)["spans"]).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def above(z: Column) -> Column:
    """Upper tail of the standard normal distribution (error under 2e-4)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def p_value(v: Column, k: Column) -> Column:
    """Combined p-value of the battery for an array of symbol values below ``k``."""
    n = F.size(v).cast("double")
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.struct(F.size(F.filter(v, lambda x: F.floor(x * BINS / k) == b)).alias("seen"), (n * (F.ceil((b + 1) * k / BINS) - F.ceil(b * k / BINS)) / k).alias("due")))
    chi = F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.pow(b["seen"] - b["due"], 2) / b["due"])
    df = BINS - 1
    uniform = above((F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    high = F.transform(v, lambda x: (2 * x >= k).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
    pairs = F.zip_with(F.slice(high, 1, F.size(v) - 1), F.slice(high, 2, F.size(v) - 1), lambda a, b: (a != b).cast("int"))
    runs = 1 + F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
    two = 2 * n1 * (n - n1)
    spread = two * (two - n) / (n * n * (n - 1))
    ordered = F.when(spread > 0, 2 * above(F.abs(runs - (two / n + 1)) / F.sqrt(spread))).otherwise(F.lit(1e-12))
    mid, var = (k - 1) / 2.0, (k * k - 1) / 12.0
    products = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - mid) * (b - mid))
    serial = 2 * above(F.abs(F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / (var * F.sqrt(n - 1))))
    half = -sum(F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in (uniform, ordered, serial))
    return F.exp(-half) * (1 + half + half * half / 2)  # Fisher: chi-squared of six degrees of freedom


def candidates(text: Column) -> Column:
    """Array of (start, end, encoding, band, p) of a text's candidates; band is the length's power of two, in halves."""
    tokens = F.filter(found(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]"))

    def coded(s: Column) -> Column:
        bare = F.regexp_replace(F.translate(s["value"], "-_", "+/"), "=+$", "")
        kind = (
            F.when(bare.rlike("^[0-9]+$") | ~bare.rlike("^[A-Za-z0-9+/]+$"), F.lit(""))
            .when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
            .when(bare.rlike("^[A-Z2-7]+$"), F.lit("base32"))
            .when(bare.rlike("^[A-Za-z0-9]+$"), F.lit("base62"))
            .otherwise(F.lit("base64"))
        )
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("encoding"), F.when(kind == "hex", F.lower(bare)).otherwise(bare).alias("bare"))

    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    known = F.filter(F.transform(tokens, coded), lambda s: (s["encoding"] != "") & (F.char_length(s["bare"]) >= MIN_LENGTH))
    with_values = F.transform(known, lambda s: F.struct(s["start"], s["end"], s["encoding"], F.transform(F.split(s["bare"], F.lit("")), lambda c: F.position(c, alphabet[s["encoding"]]) - 1).alias("v"), F.char_length(alphabet[s["encoding"]]).cast("double").alias("k")))
    return F.transform(with_values, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), F.floor(2 * F.log2(F.size(s["v"]).cast("double"))).cast("int").alias("band"), p_value(s["v"], s["k"]).alias("p")))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(found(text, ASSIGN, 0, 2, 8), found(text, ACCESS, 1), found(text, HEX, 2))
    bare = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", F.sort_array(bare).alias("base"), candidates(text).alias("candidates"))


def thresholds(scans: DataFrame, fdr: float = FDR) -> DataFrame:
    """(encoding, band, least): the p-value from which a stratum's candidates count as random."""
    each = scans.select(F.explode("candidates").alias("c")).select("c.*")
    bins = each.groupBy("encoding", "band", F.least(F.floor(F.col("p") * P_STEPS), F.lit(P_STEPS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    # At most P_STEPS rows a stratum, and a few dozen strata: a pair for two bands of an encoding.
    strata = bins.groupBy("encoding", "band").agg(F.sum("n").alias("all"))
    other = strata.select("encoding", F.col("band").alias("from"), F.col("all").alias("more"))
    pairs = strata.join(other, "encoding").withColumn("off", F.abs(F.col("band") - F.col("from")))
    nearer = Window.partitionBy("encoding", "band").orderBy("off").rangeBetween(Window.unboundedPreceding, -1)
    pool = pairs.withColumn("nearer", F.coalesce(F.sum("more").over(nearer), F.lit(0))).where(F.col("nearer") < LEAST).select("encoding", "band", "from")
    bins = bins.withColumnRenamed("band", "from").join(pool, ["encoding", "from"]).groupBy("encoding", "band", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("encoding", "band").orderBy(F.desc("bin"))
    tail = bins.withColumn("passing", F.sum("n").over(w)).withColumn("sure", F.max(F.when(F.col("bin") >= P_STEPS // 2, F.col("passing"))).over(Window.partitionBy("encoding", "band")))
    other = F.col("passing") - 2 * F.col("sure") * (1 - F.col("bin") / P_STEPS)
    return tail.where(F.col("sure").isNotNull()).where((other <= fdr * F.col("passing")) & (F.col("bin") > 0)).groupBy("encoding", "band").agg((F.min("bin") / P_STEPS).alias("least"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every text."""
    scans = store.written(scanned(docs), "scans")
    least = thresholds(scans).collect()  # a few encodings and length bands
    limit = F.create_map(*[F.lit(x) for r in least for x in (f"{r.encoding}:{r.band}", float(r.least))]) if least else F.expr("map('', 2.0D)")
    random = F.filter("candidates", lambda c: (c["p"] >= F.coalesce(F.try_element_at(limit, F.concat_ws(":", c["encoding"], c["band"].cast("string"))), F.lit(2.0))) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    extra = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.sort_array(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_random"),
    )
