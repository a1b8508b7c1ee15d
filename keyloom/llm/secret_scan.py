"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns (leftmost, non-overlapping, each kind on its own): ``assign``, ``access``, ``hex``.

Battery, kind ``random``: candidates are runs of at least ``least`` base-64 characters (and runs of the URL alphabet
that hold - or _) in what the pattern spans leave of the text, if they mix digits, cases or letters as words don't;
letters of one case alone are words. Each gets the smallest alphabet (encoding) that holds it. Four statistics say how
far it is from ordinary tokens of its encoding (names, paths, slugs, numbered words, numbers), each as a normal deviate under that encoding's figures:
chi-squared against a uniform alphabet (ordinary characters are uneven), runs of one character class (ordinary tokens keep to a
class; a capital before a small letter counts as small), runs of vowels and consonants (in words they take turns), and
serial correlation at lag one of positions in the alphabet (ordinary neighbours are alike). Their weighted sum, scaled
by its own deviation, gives a p-value that the token is ordinary; a token whose characters are as uneven as ordinary ones stays ordinary.

Short tokens can't be told from words as surely as long ones, so the false-discovery rate is held by
Benjamini and Hochberg's rule in each encoding and length band (powers of two) on its own, over all
candidates of the corpus: one pass counts p-values in bins of a twentieth of a decade, which are a few
hundred rows for each band, and the resulting limit for each band (a few dozen numbers) goes into the
expressions of the second pass. All is built-in functions: no Python runs on the executors and no text is
shuffled.

Spans and masks take time linear in the text: sums over matches run in blocks of ``BLOCK``, and pieces of text are cut
from chunks of ``CHUNK`` characters.

Offsets are code points, ends exclusive. Defined results: a null text is empty and has no spans; letter case
is ASCII; repeated rows count as candidates each; other columns are kept by scan() (one of the
result's name is replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What every passing assign match holds; it is looked for first, as it seldom begins to match.
ASSIGN_TAIL = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = DIGITS + UPPER + LOWER + "+/"
CLASSES = "0" * 10 + "A" * 26 + "a" * 26 + "+" * 2
SOUNDS = "0" * 10 + "".join("v" if c in "AEIOUY" else "c" for c in UPPER) * 2 + "00"
#: What tokens are looked for, the fewest characters left open.
RUNS = (r"[A-Za-z0-9+/]{%d,}", r"[A-Za-z0-9_-]{%d,}")
#: Size of the alphabet and what a token of that encoding matches, the narrowest first; 65 is the URL alphabet of 64.
ENCODINGS = ((16, r"^[0-9A-F]+$"), (32, r"^[A-Z2-7]+$"), (36, r"^([0-9a-z]+|[0-9A-Z]+)$"), (62, r"^[0-9A-Za-z]+$"), (65, r"[-_]"), (64, r""))
#: A capital after a small letter; anchored, so that it takes one pass.
CAMEL = r"^[^a-z]*[a-z][^A-Z]*[A-Z]"
#: Ordinary tokens of each encoding, for each statistic its mean, its deviation times the root of the length, and its weight:
#: the chance that two characters are equal, the rate at which the class changes, that at which vowels and consonants
#: take turns, the serial correlation. Measured on generated names, paths, slugs and numbers; deviations are rounded up.
ORDINARY = {
    16: ((0.14, 0.30, 0.5), (0.09, 0.36, 1.0), (0.50, 0.60, 0.0), (0.05, 1.30, 0.0)),
    32: ((0.055, 0.09, 0.7), (0.14, 0.30, 1.0), (0.62, 0.47, 1.0), (0.00, 1.00, 0.0)),
    36: ((0.050, 0.09, 0.7), (0.13, 0.30, 1.0), (0.62, 0.47, 0.7), (0.32, 1.30, 0.3)),
    62: ((0.048, 0.09, 0.7), (0.08, 0.30, 1.0), (0.62, 0.47, 0.7), (0.06, 1.30, 0.0)),
    64: ((0.050, 0.10, 0.7), (0.17, 0.52, 1.0), (0.62, 0.47, 1.0), (0.20, 1.60, 0.2)),
    65: ((0.050, 0.10, 0.7), (0.20, 0.52, 1.0), (0.62, 0.47, 1.0), (0.20, 1.60, 0.2)),
}
#: Deviation of the weighted sum over ordinary tokens, as a share of that of independent statistics. Measured 0.3 to 0.5 on the
#: same tokens, as the statistics offset each other (a token of many parts changes class often, but its parts are words).
TOGETHER = 0.75
BINS_A_DECADE, TOP_BIN = 20, 400
#: Matches summed together; characters of a chunk.
BLOCK, CHUNK = 256, 1024
#: Stands for masked characters; no pattern takes it.
HIDDEN = "\x01"


def _let(value: Column, body) -> Column:
    """body of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, combine) -> Column:
    """For each of some integers, what combine makes of 0 and all before it; two levels, so that no array grows value by value."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def scan(some: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(some, start, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        firsts = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero)
        return F.flatten(F.zip_with(blocks, firsts, scan))

    cut = lambda v: F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut(v), joined)).otherwise(none))


def _spans(text: Column, pattern: str, kind: int, found: Column, group: int = 0) -> Column:
    """Structs (start, kind, end, s, k) of the pattern's matches, k being the given group; found: whether to look at all."""
    kept = "array<struct<start:int,kind:int,end:int,s:string,k:string>>"

    def placed(x: Column) -> Column:
        gaps = F.slice(x["gap"], 1, F.size(x["match"]))
        sizes = F.zip_with(gaps, x["match"], lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        before = lambda z: _before(F.transform(z, lambda y: y["g"] + y["m"]), lambda a, b: a + b)
        whole = lambda z: F.arrays_zip(z.alias("z"), before(z).alias("at"), x["match"].alias("s"), x["key"].alias("k"))
        start = lambda y: y["at"] + y["z"]["g"]
        one = lambda y: F.struct(start(y).alias("start"), F.lit(kind).alias("kind"), (start(y) + y["z"]["m"]).alias("end"), y["s"].alias("s"), y["k"].alias("k"))
        return F.transform(_let(sizes, whole), one)

    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    key = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    return F.when(found, _let(F.struct(match.alias("match"), F.split(text, pattern).alias("gap"), key.alias("key")), placed).cast(kept)).otherwise(F.array().cast(kept))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All pattern spans, by start and then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, text.rlike(ASSIGN_TAIL), 2), lambda s: F.length(s["k"]) >= 12)
    access = _spans(text, ACCESS, 1, text.contains("AKIA"))
    return F.sort_array(F.concat(_bare(assign), _bare(access), _bare(_spans(text, HEX, 2, text.rlike(HEX)))))


def _replaced(text: Column, spans: Column, filler) -> Column:
    """The text with filler(span, end of all spans before it) for each span; spans are sorted by start."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b, cut from the chunks that hold them."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        head, offset = F.element_at(chunks, first + 1), (a - first * CHUNK + 1).cast("int")
        within = F.substr(head, offset, (b - a).cast("int"))
        across = F.concat(F.substr(head, offset, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substr(F.element_at(chunks, last + 1), F.lit(1), (b - last * CHUNK).cast("int")))
        return F.when(b <= a, "").when(first == last, within).otherwise(across)

    def joined(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        rows = F.arrays_zip(x["spans"].alias("s"), _before(ends, lambda a, b: F.greatest(a, b)).alias("at"))
        parts = F.transform(rows, lambda r: F.concat(piece(x["chunks"], r["at"], r["s"]["start"]), filler(r["s"], r["at"])))
        return F.concat(F.array_join(parts, ""), piece(x["chunks"], F.array_max(ends), x["n"]))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(chunks.alias("chunks"), spans.alias("spans"), F.length(text).alias("n")), joined)).otherwise(text)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _lower_tail(a: Column) -> Column:
    """-log10 of the normal distribution's tail below -a, for a of 0 at least (a rational approximation, within 0.02)."""
    # Coefficients of Abramowitz and Stegun 26.2.17.
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    return a * a / 2 / F.lit(2.302585092994046) + F.lit(0.3990899342) - F.log10(poly)


def candidates(text: Column, base: Column, least: int) -> Column:
    """Structs (start, kind, end, size, band, bin) of what the battery tests."""
    mixed = lambda s: (s.rlike("[0-9]") & s.rlike("[A-Za-z]")) | s.rlike(CAMEL)
    hide = lambda s, at: F.repeat(F.lit(HIDDEN), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))

    def runs(left: Column) -> Column:
        plain, url = (_spans(left, p % least, 3, left.rlike(p % least)) for p in RUNS)
        return F.concat(F.filter(plain, lambda c: mixed(c["s"])), F.filter(url, lambda c: c["s"].rlike("[-_]") & mixed(c["s"])))

    raw = _let(_replaced(text, base, hide), runs)

    def stage(c: Column, kept: str, **more: Column) -> Column:
        return F.struct(*(c[k].alias(k) for k in ["start", "kind", "end", *kept.split()]), *(v.alias(k) for k, v in more.items()))

    def counted(c: Column) -> Column:
        size = F.lit(ENCODINGS[-1][0])
        for k, p in reversed(ENCODINGS[:-1]):
            size = F.when(c["s"].rlike(p), k).otherwise(size)
        s = F.translate(c["s"], "-_", "+/")
        n = F.length(s)
        chars = F.filter(F.split(s, ""), lambda x: x != "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc + F.pow((n - F.length(F.replace(s, x, F.lit("")))).cast("double"), F.lit(2.0)))
        turns = F.length(F.regexp_replace(F.translate(F.regexp_replace(s, "[A-Z](?=[a-z])", "a"), ALPHABET, CLASSES), r"0+|A+|a+|\++", "r")) - 1
        sounds = F.translate(s, ALPHABET, SOUNDS)
        letters = lambda x: F.length(F.translate(x, "0", ""))
        words = letters(F.regexp_replace(sounds, "[vc]+", "s"))
        swaps = letters(F.regexp_replace(F.regexp_replace(sounds, "v+", "v"), "c+", "c")) - words
        places = F.transform(chars, lambda x: F.instr(F.lit(ALPHABET), x).cast("double"))
        double = {k: v.cast("double") for k, v in {"n": n, "turns": turns, "swaps": swaps, "beside": letters(sounds) - words}.items()}
        return stage(c, "", size=size, squares=squares, v=places, **double)

    def averaged(c: Column) -> Column:
        # a step of its own: within the next one's lambda it would be summed anew for every character
        return stage(c, "size n squares turns swaps beside v", mean=_sum(c["v"]) / c["n"])

    def centred(c: Column) -> Column:
        return stage(c, "size n squares turns swaps beside", v=F.transform(c["v"], lambda x: x - c["mean"]))

    def correlated(c: Column) -> Column:
        v = c["v"]
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: x * y)
        return stage(c, "size n squares turns swaps beside", whole=_sum(F.transform(v, lambda x: x * x)), lag=_sum(pairs))

    def summed(c: Column) -> Column:
        n = c["n"]
        serial = F.when(c["whole"] > 0, c["lag"] / c["whole"]).otherwise(1.0)
        found = (c["squares"] - n) / (n * (n - 1)), c["turns"] / (n - 1), F.when(c["beside"] > 0, c["swaps"] / c["beside"]).otherwise(1.0), serial
        signs, counts = (-1, 1, -1, -1), (n, n, F.greatest(c["beside"], F.lit(1.0)), n)
        z1 = z = F.lit(0.0)
        for size, figures in ORDINARY.items():
            far = [sign * (x - mean) * F.sqrt(m) / spread for x, m, sign, (mean, spread, _) in zip(found, counts, signs, figures, strict=True)]
            weights = [w for *_, w in figures]
            scale = TOGETHER * sum(w * w for w in weights) ** 0.5
            whole = sum((w * x for w, x in zip(weights, far, strict=True) if w), F.lit(0.0)) / scale
            z1, z = F.when(c["size"] == size, far[0]).otherwise(z1), F.when(c["size"] == size, whole).otherwise(z)
        return stage(c, "size", band=F.floor(F.log2(n)).cast("int"), z1=z1, z=z)

    def placed(c: Column) -> Column:
        # characters as uneven as ordinary ones (a repeated pattern, say) aren't random in whatever order
        far = F.when(c["z1"] > 0, F.least(F.greatest(c["z"], F.lit(0.0)), F.lit(30.0))).otherwise(0.0)
        return stage(c, "size band", a=far)

    def binned(c: Column) -> Column:
        return stage(c, "size band", bin=F.least(F.lit(TOP_BIN), F.floor(_lower_tail(c["a"]) * BINS_A_DECADE).cast("int")))

    for step in (counted, averaged, centred, correlated, summed, placed, binned):
        raw = F.transform(raw, step)
    return raw


def limits(docs: DataFrame, rate: float, least: int) -> dict[tuple[int, int], int]:
    """For each encoding and length band, the least bin at which tokens are discoveries: a few dozen rows."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows without a candidate go before the base spans are looked for
    text = text.where(F.col("text").rlike(rf"[A-Za-z0-9+/_-]{{{least},}}")).withColumn("base", base_spans(F.col("text")))
    bins = text.select(F.explode(candidates(F.col("text"), F.col("base"), least)).alias("c")).groupBy("c.size", "c.band", "c.bin").agg(F.count("*").alias("n"))
    band = Window.partitionBy("size", "band")
    summed = bins.withColumns({"m": F.sum("n").over(band), "k": F.sum("n").over(band.orderBy(F.col("bin").desc()))})
    passed = summed.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) * F.col("m") <= rate * F.col("k"))
    return {(r["size"], r["band"]): r["bin"] for r in passed.groupBy("size", "band").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, rate: float = 0.01, least: int = 20, name: str = "spans") -> DataFrame:
    """docs with a column of that name: array of (start, kind, end), by start and kind; kind counts in KINDS."""
    found = limits(docs, rate, least)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(name, base_spans(text))
    if not found:
        return out
    limit = F.create_map(*(F.lit(x) for (size, band), b in sorted(found.items()) for x in (f"{size}:{band}", b)))
    chosen = F.filter(candidates(text, F.col(name), least), lambda c: c["bin"] >= F.coalesce(F.try_element_at(limit, F.concat_ws(":", c["size"], c["band"])), F.lit(TOP_BIN + 1)))
    return out.withColumn(name, F.sort_array(F.concat(name, _bare(chosen))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask; spans as scan() sorts them."""
    return _replaced(text, spans, lambda s, at: F.when(s["start"] >= at, mask).otherwise(""))
