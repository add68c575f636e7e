"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control. SQL functions only.

Base patterns (``PATTERNS``) are found leftmost and without overlaps; matches that are too short are dropped.
Besides, every run of 20 or more characters of the base64 alphabets is a candidate. The smallest encoding that
holds its characters (hex, base32, base36, base62, base64) gives each character a number, and three tests ask
whether the numbers look like uniform draws:

* chi-squared of the character counts against a uniform alphabet, as a standard score (exact mean and variance,
  so it holds for tokens shorter than the alphabet), only its upper side;
* Wald-Wolfowitz runs of numbers in the upper and lower half of the alphabet;
* serial correlation of neighbouring numbers.

The sum of the squared scores is the token's distance from randomness, about chi-squared with three degrees of
freedom for a random token. Tokens that mix digits and letters are candidates; words of letters alone are decoys:
they show how often ordinary text of that length comes as near. A candidate is a secret if the tests do not reject
randomness at ``LEAST_P`` and the decoys' share at its distance puts the false-discovery rate of its length class
at ``FALSE_RATE`` or lower. Both counts are a histogram of at most ``LENGTHS * DISTANCES`` rows over the corpus.

Defined results: a null or empty text has no spans; repeated rows are scanned each by itself; an empty table gives no
rows; a token of any length is one candidate; other columns pass through under any name (one named ``secrets``
gives way to the result). Spans of a text take time by their number to the power of 1.5 at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusgraph.runtime import materialise

#: Fixed patterns, in the order of their kinds: (kind, pattern, group whose length counts, least length).
PATTERNS = (
    (
        "assign",
        "(?:(?i)(?:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1, 12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # runs are maximal, so the least length may stand in the pattern
)
KINDS = (*[p[0] for p in PATTERNS], "random")
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
LEAST_P = 0.01
FALSE_RATE = 0.05
LENGTHS = 8
DISTANCES = 64
#: Alphabets by encoding, from the smallest.
ENCODINGS = (
    ("0123456789abcdef", "^[0-9a-f]+$"),
    ("0123456789ABCDEF", "^[0-9A-F]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
)
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SPAN = "struct<start:bigint,end:bigint,token:string,size:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(n: Column, body: Callable[[Column, Column], Column]) -> Column:
    """An array for each of about sqrt(n) blocks of ``n`` places: ``body`` of the first place and the places of a block."""
    return _let(F.ceil(F.sqrt(n)).cast("int"), lambda size: F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: body(k * size, size)))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of bigints, 0 and all values before it joined (a sum, a maximum). ``aggregate`` copies
    the array that it grows in every step, so blocks of about sqrt(n) values are joined, then the values of each."""
    zero = F.lit(0).cast("bigint")

    def before(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, first, lambda acc, v: F.struct(
            join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def in_blocks(all_values: Column) -> Column:
        parts = _blocks(F.size(all_values), lambda lo, size: F.slice(all_values, lo + 1, size))
        return _let(parts, lambda p: F.flatten(F.zip_with(
            p, before(F.transform(p, lambda part: F.aggregate(part, zero, lambda a, v: join(a, v))), zero), before)))

    return _let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as (start, end, token, size) in code points; ``size`` is the length of ``group``. What stands
    between matches gives the positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("token"), sizes.alias("size"))

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda m: m["gap"] + F.length(m["token"])), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), (at + m["gap"] + F.length(m["token"])).alias("end"),
            m["token"].alias("token"), m["size"].alias("size")))

    return F.when(text.rlike(pattern), _let(rows, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _chi_squared(numbers: Column, n: Column, k: Column) -> Column:
    """Standard score of chi-squared against a uniform alphabet of ``k`` characters, not below 0."""
    squares = F.aggregate(
        F.array_distinct(numbers), F.lit(0.0),
        lambda acc, c: acc + F.pow(F.size(F.filter(numbers, lambda x: x == c)).cast("double"), 2.0),
    )
    value = squares * k / n - n
    return F.greatest(F.lit(0.0), (value - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))


def _runs(numbers: Column, n: Column, k: Column) -> Column:
    """Standard score of the number of runs above and below the middle of the alphabet."""

    def split(sides: Column) -> Column:
        high = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)
        changed = F.zip_with(F.slice(sides, 2, 1 << 30), sides, lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        changes = F.aggregate(changed, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        mean = 2 * high * (n - high) / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        # On one side only: as far off as the binomial odds of that, n halvings.
        return F.when(variance > 0, (changes + 1 - mean) / F.sqrt(variance)).otherwise(F.sqrt(n))

    return _let(F.transform(numbers, lambda x: (x * 2 >= k).cast("double")), split)


def _serial(numbers: Column, n: Column) -> Column:
    """Standard score of the correlation of neighbours."""

    def around(mean: Column) -> Column:
        spread = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        products = F.zip_with(F.slice(numbers, 2, 1 << 30), numbers, lambda a, b: (a - mean) * (b - mean))
        along = F.aggregate(products, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        return F.when(spread > 0, along / spread * F.sqrt(n)).otherwise(F.sqrt(n))

    return _let(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / n, around)


def distance(token: Column) -> Column:
    """Sum of the squared scores of the three tests in the token's inferred encoding."""
    alphabet = F.lit(_BASE64)
    for letters, form in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(form), F.lit(letters)).otherwise(alphabet)
    def score(letters: Column) -> Column:
        k = F.when(letters == _BASE64, F.lit(64)).otherwise(F.length(letters)).cast("double")
        n = F.length(token).cast("double")
        # + and -, / and _ close the two base64 alphabets.
        numbers = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.when(
            F.instr(letters, c) > 0, F.instr(letters, c) - 1).when(c.isin("+", "-"), 62).otherwise(63).cast("double"))
        return _let(numbers, lambda x: (
            F.pow(_chi_squared(x, n, k), 2.0) + F.pow(_runs(x, n, k), 2.0) + F.pow(_serial(x, n), 2.0)))

    return _let(alphabet, score)


def random_p(distance: Column) -> Column:
    """Upper tail of chi-squared with three degrees of freedom: erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2), with the
    rational approximation of erfc (error below 2e-7)."""
    x = F.sqrt(distance / 2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (series + 2 * x / F.sqrt(F.lit(3.141592653589793))) * F.exp(-distance / 2)


def _length_class(token: Column) -> Column:
    """20-24, 25-31, 32-47 and on by halves of octaves; the last class is open."""
    return F.least(F.floor(F.log2(F.length(token) / 20.0) * 2), F.lit(LENGTHS - 1)).cast("int")


def _at_least(size: int):
    return lambda m: m["size"] >= size


def _as_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def scan_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents as the struct ``row`` (no name of theirs meets an inner one), with ``found``: base spans as
    (start, kind, end), and the candidates and decoys of the tests."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = []
    for number, (_, pattern, group, least) in enumerate(PATTERNS):
        base.append(_as_kind(F.filter(matches(body, pattern, group), _at_least(least)), number))
    tokens = F.transform(matches(body, CANDIDATE), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        (m["token"].rlike("[0-9]") & m["token"].rlike("[A-Za-z]")).alias("mixed"),
        m["token"].rlike("^[A-Za-z]+$").alias("decoy"),
        _length_class(m["token"]).alias("length"), distance(m["token"]).alias("distance"),
    ))
    tested = F.filter(tokens, lambda t: t["mixed"] | t["decoy"])
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    return documents.select(row.alias("row"), F.struct(F.concat(*base).alias("base"), tested.alias("tokens")).alias("found"))


def discoveries(scanned: DataFrame) -> DataFrame:
    """(length, level): in each class of lengths, the distance up to which candidates are secrets."""
    token = F.explode("found.tokens").alias("t")
    near = F.least(F.floor(F.col("t.distance") * 4), F.lit(DISTANCES)).cast("int")
    counts = scanned.select(token).groupBy(F.col("t.length").alias("length"), near.alias("near")).agg(
        F.count_if("t.mixed").alias("mixed"), F.count_if("t.decoy").alias("decoys")
    )
    # At most LENGTHS * (DISTANCES + 1) rows from here on.
    upto = W.partitionBy("length").orderBy("near").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = W.partitionBy("length")
    share = F.sum("decoys").over(upto) / F.greatest(F.sum("decoys").over(within), F.lit(1))
    rate = share * F.sum("mixed").over(within) / F.greatest(F.sum("mixed").over(upto), F.lit(1))
    return (
        counts.withColumn("rate", rate).filter((F.col("rate") <= FALSE_RATE) & (F.col("near") < DISTANCES))
        .groupBy("length").agg(((F.max("near") + 1) / 4.0).alias("level"))
    )


def outside(tokens: Column, base: Column) -> Column:
    """The spans of ``tokens`` that no span of ``base`` holds: the base spans that start no later end before them."""
    spans = F.array_sort(F.concat(base, tokens))  # by start, then kind: base spans stand before tokens of their start

    def judged(s: Column) -> Column:
        ends = F.transform(s, lambda x: F.when(x["kind"] < len(PATTERNS), x["end"]).otherwise(F.lit(0).cast("bigint")))
        held = F.zip_with(s, running(ends, F.greatest), lambda x, end: F.struct(x.alias("span"), (end >= x["end"]).alias("held")))
        return F.transform(F.filter(held, lambda h: (h["span"]["kind"] == len(PATTERNS)) & ~h["held"]), lambda h: h["span"])

    return F.when(F.size(tokens) > 0, _let(spans, judged)).otherwise(tokens)


def judge(scanned: DataFrame) -> DataFrame:
    """What ``scan_texts`` gave, as the documents with ``secrets``: all spans (start, kind, end) in order, and the
    base spans alone."""
    levels = discoveries(scanned).agg(F.map_from_entries(F.collect_list(F.struct("length", "level")))).first()[0]
    base = F.array_sort(F.col("found.base"))

    def is_secret(t: Column) -> Column:
        limit = F.lit(-1.0)  # at most LENGTHS levels
        for length, value in sorted(levels.items()):
            limit = F.when(t["length"] == int(length), F.lit(float(value))).otherwise(limit)
        return t["mixed"] & (t["distance"] <= limit) & (random_p(t["distance"]) >= LEAST_P)

    likely = _as_kind(F.filter(F.col("found.tokens"), is_secret), len(PATTERNS))
    added = _let(likely, lambda t: outside(t, F.col("found.base")))
    spans = F.array_sort(F.concat(F.col("found.base"), added))
    secrets = F.struct(base.alias("base"), spans.alias("spans")).alias("secrets")
    names = [f.name for f in scanned.schema["row"].dataType.fields]
    # In two steps, lest a name of theirs be taken for an inner one.
    return scanned.select("row", secrets).select(*[F.col("row").getField(c).alias(c) for c in names if c != "secrets"], "secrets")


def find_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``secrets.spans`` and ``secrets.base``: (start, kind, end) in code points, ``kind`` an
    index into ``KINDS``."""
    return judge(materialise(scan_texts(documents, text), "secret-candidates"))


def n_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    bounds = "array<struct<start:bigint,end:bigint>>"

    def cuts(s: Column) -> Column:
        """What stays, as (start, end): from the greatest end so far to each span beyond it, and the rest."""
        upto = F.zip_with(running(F.transform(s, lambda x: x["end"]), F.greatest), s, lambda at, x: F.struct(
            at.alias("start"), x["start"].alias("end")))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        rest = F.array(F.struct(last.alias("start"), F.length(text).cast("bigint").alias("end")))
        return F.concat(F.filter(upto, lambda c: c["start"] <= c["end"]).cast(bounds), rest.cast(bounds))

    def piece(whole: Column, start: Column, end: Column) -> Column:
        return F.substring(whole, (start + 1).cast("int"), (end - start).cast("int"))

    def pieces(part: Column) -> Column:
        """A substring is found from the front of its string, so a block is cut out of the text first."""
        first, last = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"]
        return _let(piece(text, first, last), lambda block: _let(first, lambda start: F.transform(
            part, lambda c: piece(block, c["start"] - start, c["end"] - start))))

    def kept(c: Column) -> Column:
        return F.flatten(_blocks(F.size(c), lambda lo, size: _let(F.slice(c, lo + 1, size), pieces)))

    return F.when(F.size(spans) > 0, F.array_join(_let(_let(spans, cuts), kept), mark)).otherwise(text)
