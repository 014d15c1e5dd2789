"""Secret scans: patterns plus a randomness test battery, natively.

Base spans come from fixed patterns. The battery looks at every maximal run of
``[A-Za-z0-9+/_=-]`` that is long enough and fits an encoding (hex, base32 or base36 in one case,
base64/62), and tests the hypothesis "these symbols are uniform and independent":
a chi-squared test of the symbol counts over groups of the encoding's alphabet (frequent and other
letters of either case, low and other digits), a runs test of how often neighbours are of one
class, and a lag-1 serial correlation test. Fisher's method combines the three.

Both errors are controlled per encoding and length band. Benjamini-Hochberg over all candidates
decides which runs are structured (identifiers, paths, numbers), so that few random ones are among
those dismissed. The p-values of random runs are even, so the upper half of them tells how many
random runs there are; if the runs above the threshold are more than that, beyond the share ``q``
and two standard errors, structured ones are among them and the threshold rises until they are
not. The runs left are secrets. Runs of under 20 symbols carry too little evidence and are not
looked at, nor are runs outside these alphabets (plain numbers, one-case words with signs).

Everything is a Spark expression. Per document only its few matches are handled; over the
corpus only a histogram of p-values (encoding x band x bin, a fixed number of rows) is
aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.llm.common import Scratch

# Fixed by the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"   # AKIA[A-Z0-9]+ of 16 and more: the run ends the same, so shorter ones never start one
HEX = r"[0-9a-f]{32,}"          # [0-9a-f]+ of 32 and more: a maximal run either way
MIN_VALUE = 8

KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Alphabets, by encoding; one-case runs are tested in lower case, URL-safe signs as + and /.
HEX_ALPHABET = "0123456789abcdef"
B32_ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"
B36_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
B64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ALPHABETS = (HEX_ALPHABET, B32_ALPHABET, B36_ALPHABET, B64_ALPHABET)
# Letters that are frequent in ordinary words; the groups of the chi-squared test and the classes of
# the runs test follow from them.
FREQUENT = "etaoinsrhl"
VOWELS = "aeiou"
BANDS = (20, 32, 48, 96)
BINS = 400
BIN_WIDTH = 0.05  # of -log10(p)
EVEN_BINS = 6     # bins of p above a half, where structured runs are rare


def symbol_groups(alphabet: str) -> list[str]:
    """Groups of the chi-squared test: every symbol of hex; else frequent and other letters by case,
    the digits 0 and 1, and the other digits with the signs."""
    if alphabet == HEX_ALPHABET:
        return list(alphabet)
    kinds = (lambda c: c in FREQUENT, lambda c: c.islower() and c not in FREQUENT, lambda c: c.isupper() and c.lower() in FREQUENT,
             lambda c: c.isupper() and c.lower() not in FREQUENT, lambda c: c in "01", lambda c: not c.isalpha() and c not in "01")
    groups = ["".join(filter(kind, alphabet)) for kind in kinds]
    return [g for g in groups if g]


def symbol_classes(alphabet: str) -> list[str]:
    """Classes of the runs test: digits (with signs) and, in mixed case, upper and lower letters, else
    vowels and consonants; hex has digits and letters."""
    digits, letters = "".join(c for c in alphabet if not c.isalpha()), "".join(c for c in alphabet if c.isalpha())
    if alphabet == HEX_ALPHABET:
        return [digits, letters]
    if alphabet == B64_ALPHABET:
        return [digits, letters.upper()[:26], letters.lower()[:26]]
    return [digits, VOWELS, "".join(c for c in letters if c not in VOWELS)]


def _prefix_sums(lengths: Column, block: int = 512) -> Column:
    """Exclusive prefix sums of an int array, in two levels so that long arrays stay cheap."""
    def run(items: Column, start: Column) -> Column:
        init = F.struct(start.cast("long").alias("t"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(items, init, lambda a, x: F.struct(
            (a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"])).alias("o")), lambda a: a["o"])

    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                         lambda i: F.slice(lengths, i * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, run(sums, F.lit(0)), run))


def _spans(pieces: Column, matches: Column) -> Column:
    """(start, end, match) of every match, from the texts between and in the matches."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches,
                       lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    starts = _prefix_sums(F.transform(steps, lambda s: s["p"] + s["m"]))
    return F.zip_with(F.zip_with(starts, F.transform(steps, lambda s: s["p"]), lambda t, p: t + p), matches,
                      lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


_FOUND = "array<struct<start:bigint,end:bigint,match:string>>"


def _find(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Column ``name``: all leftmost non-overlapping matches with code point positions. The
    text is split only where something matched."""
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    found = F.when(F.size("_m") > 0, _spans(F.col("_p"), F.col("_m"))).otherwise(_empty(_FOUND))
    return df.withColumn(name, found).drop("_m", "_p")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _upper_normal(z: Column) -> Column:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    def tail(z: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(z))
        up = _let(t, lambda t: t * (0.319381530 + t * (-0.356563782 + t * (
            1.781477937 + t * (-1.821255978 + t * 1.330274429))))) * F.exp(-z * z / 2) / F.lit(2.5066282746310002)
        return F.when(z >= 0, up).otherwise(1 - up)
    return _let(z, tail)


def _counts_z(run: Column, n: Column, alphabet: str) -> Column:
    """Chi-squared statistic of the counts of the symbol groups, as a normal score (Wilson-Hilferty)."""
    groups = symbol_groups(alphabet)
    df = len(groups) - 1

    def part(g: str) -> Column:
        expected = n * (len(g) / len(alphabet))
        return F.pow(n - F.length(F.translate(run, g, "")) - expected, F.lit(2)) / expected

    chi = sum((part(g) for g in groups), F.lit(0.0))
    return (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5


def _runs_z(run: Column, n: Column, alphabet: str) -> Column:
    """Runs test: how many neighbours are of one class, against what independent symbols give."""
    classes = symbol_classes(alphabet)
    shares = [len(c) / len(alphabet) for c in classes]
    two, three = sum(f ** 2 for f in shares), sum(f ** 3 for f in shares)
    marks = "".join(str(i) * len(c) for i, c in enumerate(classes))
    own = F.translate(run, "".join(classes), marks)

    def score(v: Column) -> Column:
        turns = sum((F.length(v) - F.length(F.replace(v, F.lit(f"{i}{j}"))) for i in range(len(classes))
                     for j in range(len(classes)) if i != j), F.lit(0)) / 2
        spread = (n - 1) * (two * (1 - two)) + 2 * (n - 2) * (three - two ** 2)
        return (n - 1 - turns - (n - 1) * two) / F.sqrt(spread)

    return _let(own, score)


def _corr_z(run: Column, n: Column, alphabet: str) -> Column:
    """Lag-1 serial correlation of the symbol codes."""
    def sums(codes: Column) -> Column:
        init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("g"), F.lit(0.0).alias("last"))
        return F.aggregate(codes, init, lambda a, x: F.struct(
            (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["g"] + a["last"] * x).alias("g"), x.alias("last")),
            lambda a: F.struct(a["s"].alias("s"), a["q"].alias("q"), a["g"].alias("g"),
                               (codes[0] + a["last"]).alias("ends"), (a["s"] / n).alias("mu")))

    def score(v: Column) -> Column:
        spread = v["q"] - n * v["mu"] * v["mu"]
        cross = v["g"] - 2 * v["mu"] * v["s"] + v["mu"] * v["ends"] + (n - 1) * v["mu"] * v["mu"]
        return F.when(spread > 1e-6, (cross / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))

    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    return _let(codes, lambda c: _let(sums(c), score))


def _battery(run: Column, alphabet: str) -> Column:
    """Combined p-value of "uniform and independent symbols" for one run."""
    n = F.length(run).cast("double")
    sides = [_upper_normal(_counts_z(run, n, alphabet)),
             2 * _upper_normal(F.abs(_runs_z(run, n, alphabet))),
             2 * _upper_normal(F.abs(_corr_z(run, n, alphabet)))]
    # half of Fisher's statistic, which has 6 degrees of freedom
    x = sum((-F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in sides), F.lit(0.0))
    return _let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def _tested(match: Column, start: Column, end: Column) -> Column:
    """Encoding, length band, p-value and its bin of one run; p is NULL without an encoding. The signs
    at the end (padding) are not tested."""
    def test(body: Column) -> Column:
        hexed = body.rlike("^([0-9a-f]+|[0-9A-F]+)$") & body.rlike("[a-fA-F]")
        b32 = body.rlike("^([A-Z2-7]+|[a-z2-7]+)$") & body.rlike("[A-Za-z]")
        b36 = body.rlike("^([A-Z0-9]+|[a-z0-9]+)$") & body.rlike("[A-Za-z]")
        b64 = body.rlike("[a-z]") & body.rlike("[A-Z]")
        enc = F.when(hexed, 0).when(b32, 1).when(b36, 2).when(b64, 3)
        # the URL-safe signs are taken as + and /
        plain = F.when(enc == 3, F.translate(body, "-_", "+/")).otherwise(F.lower(body))
        p = _let(plain, lambda r: F.coalesce(*[F.when(enc == i, _battery(r, a)) for i, a in enumerate(ALPHABETS)]))
        band = sum((F.when(F.length(body) >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
        return _let(p, lambda p: F.struct(
            start.alias("start"), end.alias("end"), (enc * len(BANDS) + band).alias("stratum"),
            F.least(F.floor(-F.log10(p) / BIN_WIDTH), F.lit(BINS)).cast("int").alias("bin"), p.alias("p")))
    return _let(F.rtrim(match, F.lit("=")), test)


def find_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base``: (start, kind, end), in order, of the fixed patterns, and ``_cand``:
    (start, end, stratum, bin, p) of the tested runs outside them."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = _find(df, "_t", "_assign", ASSIGN)
    df = _find(df, "_t", "_access", ACCESS)
    df = _find(df, "_t", "_hex", HEX)
    df = _find(df, "_t", "_runs", CANDIDATE).drop("_t")
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= MIN_VALUE
    kind = lambda i: (lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
    base = F.concat(F.transform(F.filter("_assign", value), kind(0)), F.transform("_access", kind(1)),
                    F.transform("_hex", kind(2)))
    df = df.withColumn("_base", F.array_sort(base)).drop("_assign", "_access", "_hex")
    long_runs = F.filter("_runs", lambda s: F.length(F.rtrim(s["match"], F.lit("="))) >= MIN_RUN)
    outside = F.filter(long_runs, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.withColumn("_long", outside).drop("_runs")
    tested = F.filter(F.transform("_long", lambda s: _tested(s["match"], s["start"], s["end"])), lambda s: s["p"].isNotNull())
    return df.withColumn("_cand", F.when(F.size("_long") > 0, tested)).drop("_long")


def thresholds(found: DataFrame, q: float) -> DataFrame:
    """Per stratum the first bin whose runs are structured; at most strata x bins rows are handled.

    By Benjamini-Hochberg at ``q``, the smallest bin b such that the runs in bins >= b number at least
    p(b) * m / q, with p(b) the largest p-value of the bin. Then the largest bin up to it such that the
    runs before it are at most ``q`` of them, and two standard errors, more than an even spread
    of the p-values above a half would give."""
    hist = (found.select(F.explode("_cand").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count(F.lit(1)).alias("n")))
    own = W.partitionBy("stratum")
    hist = (hist.withColumn("tail", F.sum("n").over(own.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(own))
            .withColumn("even", F.sum(F.when(F.col("bin") < EVEN_BINS, F.col("n")).otherwise(0)).over(own)
                        / (1 - 10 ** (-EVEN_BINS * BIN_WIDTH))))
    top = F.pow(F.lit(10.0), -F.col("bin") * BIN_WIDTH)
    structured = hist.where(top * F.col("m") <= q * F.col("tail")).groupBy("stratum").agg(F.min("bin").alias("first_bin"))
    # bins that runs are reported up to: each bin's end is a possible threshold
    limit = F.coalesce("first_bin", F.lit(BINS + 1))
    some = hist.join(structured, "stratum", "left").where(F.col("bin") < limit)
    upto = F.sum("n").over(own.orderBy("bin"))
    some = (some.withColumn("upto", upto).withColumn("next", F.lead("bin").over(own.orderBy("bin")))
            .withColumn("end", F.least(F.coalesce("next", limit), limit)))
    random = F.col("even") * (1 - F.pow(F.lit(10.0), -(F.col("bin") + 1) * BIN_WIDTH))
    fits = (F.col("bin") < EVEN_BINS) | (F.col("upto") - random <= q * F.col("upto") + 2 * F.sqrt("upto"))
    kept = some.where(fits).groupBy("stratum").agg(F.max("end").alias("end"))
    # a stratum without a bin to keep reports nothing
    return (hist.select("stratum").distinct().join(kept, "stratum", "left")
            .select("stratum", F.coalesce("end", F.lit(0)).cast("int").alias("first_bin")))


def flagged(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """``_spans``: base spans and the runs not told from random, in order. ``cuts`` travels as
    one map (at most one entry per stratum) through a scalar subquery."""
    as_map = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "first_bin"))).alias("m"))
    found = found.withColumn("_cuts", as_map.scalar())
    random = F.filter(F.coalesce("_cand", _empty("array<struct<start:bigint,end:bigint,stratum:int,bin:int,p:double>>")),
                      lambda s: s["bin"] < F.coalesce(F.try_element_at("_cuts", s["stratum"]), F.lit(BINS + 1)))
    spans = F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    return found.withColumn("_spans", F.array_sort(F.concat("_base", spans))).drop("_cand", "_cuts")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = 0.01) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans`` (``kind:start:end``, code points, end exclusive, in order).

    Defined cases: NULL and empty texts have no spans (empty ``spans``); a NULL key stays NULL;
    repeated rows give repeated results; matches at one start are ordered by kind; an empty
    table gives an empty result; other columns are not read. ``q`` bounds, per encoding and
    length band, the share of random runs among those dismissed as structured, and the share that
    reported runs may exceed the number of random ones by.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = find_spans(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).drop("text")
    found = scratch.save(found, "found")  # a few positions per document; the texts are read once
    out = flagged(found, thresholds(found, q))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return out.select(F.col("id").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"),
                      count(2).alias("n_hex"), F.sha2(_joined("_base"), 256).alias("base_sha256"),
                      _joined("_spans").alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", q: float = 0.01,
                   mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one mark) and
    ``n_chars`` renewed where something was replaced. Columns and rows stay as they are: NULL and
    empty texts, NULL ids and repeated rows too; an empty table gives an empty result."""
    own = docs.columns
    scratch = Scratch(docs.sparkSession, "secrets")
    # the row travels as one struct, so its columns cannot clash with the working ones
    found = find_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{text}`").alias("_text")),
                       "_text")
    cuts = scratch.save(thresholds(scratch.save(found.select("_cand"), "cand"), q), "cuts")
    out = flagged(found, cuts)
    # the text between the merged spans: each gap runs from the furthest end so far to the next start
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["end"], a["parts"]).otherwise(F.concat(a["parts"], F.array(
            F.struct(a["end"].alias("from"), s["start"].alias("to"))))).alias("parts"),
        F.greatest(a["end"], s["end"]).alias("end"))
    init = F.struct(F.array().cast("array<struct<from:bigint,to:bigint>>").alias("parts"), F.lit(0).cast("long").alias("end"))
    size = F.length("_text").cast("long")
    gaps = F.aggregate("_spans", init, step, lambda a: F.concat(a["parts"], F.array(F.struct(
        a["end"].alias("from"), size.alias("to")))))
    clean = F.array_join(F.transform(gaps, lambda g: F.substring(F.col("_text"), (g["from"] + 1).cast("int"),
                                                                  (g["to"] - g["from"]).cast("int"))), mark)
    hit = F.size("_spans") > 0
    out = out.withColumn("_new", F.when(hit, clean).otherwise(F.col("_text"))).withColumn("_hit", hit)

    def field(c: str) -> Column:
        old = F.col("_row")[c]
        if c == text:
            return F.col("_new").alias(c)
        if c == n_chars:
            return F.when(F.col("_hit"), F.length("_new").cast("long")).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*[field(c) for c in own])
