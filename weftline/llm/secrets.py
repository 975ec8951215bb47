"""Operator 7: secrets in texts, in DataFrame functions only.

Three patterns give the base spans. Beyond them, long runs of letters, digits and a few signs are scored by two Markov
models of neighbouring characters, one of random strings and one of ordinary identifiers: a part of a run whose
log-likelihood ratio reaches the threshold is a secret, with the rest of the words that it touches. Spans are in code points, ends exclusive. No row is shuffled: the models are a
table of 67 * 67 numbers, counted from labelled samples and put into the plan as a constant. A long text is searched in pieces that
no match crosses, so its time grows with its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table

#: The base patterns and the least length of the whole match (access, hex) or of the value (assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
#: A run of the class that is long enough: the same matches as of the open pattern with a length test after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SIDE = len(ALPHABET) + 1

#: A part of so many characters is judged by itself, a shorter one with the rest of its words, so many together.
LEAST_PART = 16
#: Words of a run lie between these signs; + belongs to them.
_WORD = r"^[A-Za-z0-9+]*"

#: Least log-likelihood ratio, in nats: of a part, and of each pair on average.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.6
#: Ratio of every pair with a sign. Prose has few joined words to learn from, and words joined by signs are no secret for it.
SIGN_RATIO = -4.5

_SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"
KINDS = ("assign", "access", "hex", "markov")

#: A piece of a text: 2000 code points and those up to the next cut, the last one what is left. It ends with a character that no pattern has, or
#: with blanks that neither follow nor precede a sign of an assignment, so no match lies across.
PIECE = r"""(?s).{2000,}?(?:[^A-Za-z0-9+/_.=:"'\x20-]|[^:="'\x20]\x20+(?![:="'\x20]))|.+"""


def _once(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _starts(sizes: Column) -> Column:
    """Sums of the sizes before each; made in groups of 500, then over the groups, so that arrays that grow stay short."""

    def summed(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def laid(groups: Column) -> Column:
        above = summed(F.transform(groups, lambda g: F.element_at(g, -1)))
        return _once(above, lambda at: F.flatten(F.transform(groups, lambda g, i: F.transform(F.slice(g, 1, F.size(g) - 1), lambda x: x + F.get(at, i)))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 500).cast("int")), lambda i: F.slice(sizes, i * 500 + 1, 500))
    return F.when(F.size(sizes) > 0, _once(F.transform(cut, summed), laid)).otherwise(F.array().cast("array<int>"))


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _matches(text: Column, pattern: str) -> Column:
    """(start, hit) of a pattern's leftmost matches that do not overlap."""

    def laid(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda h, i: F.char_length(F.get(x["gaps"], i)) + F.char_length(h))
        return _once(_starts(steps), lambda at: F.transform(x["hits"], lambda h, i: F.struct((F.get(at, i) + F.char_length(F.get(x["gaps"], i))).alias("start"), h.alias("hit"))))

    # split and extract walk the same matches, so gaps and hits lie in turn
    return _once(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), laid)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Arrays of the base spans: assign, access, hex. Texts without the pattern's signs are not searched further."""

    def spans(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: _span(x["start"], x["start"] + F.char_length(x["hit"]), kind))

    none = F.array().cast(_SPAN)
    long_enough = F.filter(_matches(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= LEAST_VALUE)
    assign = F.when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), spans(long_enough, "assign"))
    access = F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), spans(_matches(text, ACCESS), "access"))
    hexes = F.when(text.rlike(HEX), spans(_matches(text, HEX), "hex"))
    return tuple(F.coalesce(x, none) for x in (assign, access, hexes))


def _codes(run: Column) -> Column:
    """Places of a run's characters in the alphabet, from 1; 0: elsewhere."""
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(sample, secret): random strings in three alphabets, made from digests of numbers, and ordinary identifiers.

    Ordinary are the runs of 6 signs of the alphabet and more, but for those of 16 and more with a digit, in all documents,
    and long decimal numbers.
    """
    spark = docs.sparkSession
    numbers = spark.range(3000, numPartitions=2)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(digest)), 1, 24), "+/=abcdef", "234567XYZ"))
    random = numbers.select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), upper)).alias("sample"), F.lit(1).alias("secret"))
    decimals = numbers.select(F.regexp_replace(F.conv(F.substring(digest, 1, 15), 16, 10), "^", "9").alias("sample"), F.lit(0).alias("secret"))
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("sample"), F.lit(0).alias("secret"))
    return random.union(decimals).union(words.where(r"not (length(sample) >= 16 and sample rlike '[0-9]')"))


def pair_ratios(samples: DataFrame) -> list[float]:
    """For each pair of characters the log of its conditional likelihood in secrets over that in ordinary samples.

    Counts of 0.5 are added to every pair. A class without samples is even. Null samples do not count. Pairs with a sign
    (+ / _ = -) have SIGN_RATIO.
    """
    distinct = samples.where("sample is not null").groupBy("secret", "sample").count()
    codes = distinct.select("secret", F.col("count").alias("n"), _codes(F.col("sample")).alias("c"))
    pairs = codes.select("secret", "n", F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))).alias("b"))).alias("p"))
    counted = pairs.where("p.b is not null").groupBy("secret", "p.a", "p.b").agg(F.sum("n")).collect()  # 2 * 67 * 67 rows at most
    tables = [[0.5] * (_SIDE * _SIDE) for _ in range(2)]
    for secret, a, b, n in counted:
        tables[secret][a * _SIDE + b] += n
    rows = [[sum(t[a * _SIDE : (a + 1) * _SIDE]) for a in range(_SIDE)] for t in tables]
    signs = {i + 1 for i, c in enumerate(ALPHABET) if not c.isalnum()}
    return [
        SIGN_RATIO if signs & {*divmod(i, _SIDE)} else math.log(tables[1][i] / rows[1][i // _SIDE]) - math.log(tables[0][i] / rows[0][i // _SIDE])
        for i in range(_SIDE * _SIDE)
    ]


def _masked(text: Column, spans: Column) -> Column:
    """The text with a blank for each character of a span."""

    def add(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    blank = F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, blank).otherwise(text)


def _parts(run: Column, ratios: list[float], least_total: float, least_mean: float) -> Column:
    """(a, b) of every part of a run that is a secret: code points from a to b, exclusive.

    A part begins where the sum of the ratios over neighbouring characters leaves 0 and ends at its peak, when the sum falls back to 0
    or by least_total below the peak. It is taken if it has least_total, and least_mean a pair either over LEAST_PART
    characters or over the whole words (between signs) that it touches. Those words are the part.
    """
    constant = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def found(acc: Column) -> Column:
        a = acc["first"] - F.char_length(F.regexp_extract(F.reverse(F.left(run, acc["first"])), _WORD, 0))
        b = acc["last"] + F.char_length(F.regexp_extract(F.substring(run, acc["last"] + 1, F.char_length(run)), _WORD, 0))
        n = acc["last"] - acc["first"]
        one = F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
        fits = _once(one, lambda x: ((n >= LEAST_PART) & (acc["peak"] >= least_mean * (n - 1))) | ((x["b"] - x["a"] >= LEAST_PART) & (acc["peak"] >= least_mean * (x["b"] - x["a"] - 1))))
        return F.when(acc["peak"] < least_total, acc["parts"]).when(fits, F.concat(acc["parts"], F.array(one))).otherwise(acc["parts"])

    def walked(c: Column) -> Column:
        def state(total: Column, peak: Column, first: Column, last: Column, parts: Column, i: Column) -> Column:
            return F.struct(total.alias("sum"), peak.alias("peak"), first.alias("first"), last.alias("last"), parts.alias("parts"), i.alias("i"))

        def step(acc: Column, x: Column) -> Column:
            total, i = acc["sum"] + x, acc["i"] + 1
            closed = (total <= 0) | (total < acc["peak"] - least_total)
            grown = F.when(total > acc["peak"], state(total, total, acc["first"], i + 1, acc["parts"], i)).otherwise(state(total, acc["peak"], acc["first"], acc["last"], acc["parts"], i))
            return F.when(closed, state(F.lit(0.0), F.lit(0.0), i, i, found(acc), i)).otherwise(grown)

        pairs = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(constant, F.get(c, i - 1) * _SIDE + F.get(c, i)))
        return F.aggregate(pairs, state(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), none, F.lit(0)), step, found)

    def merged(parts: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            before = F.element_at(acc, -1)
            grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(before["a"].alias("a"), F.greatest(before["b"], x["b"]).alias("b"))))
            return F.when(F.size(acc) == 0, F.array(x)).when(x["a"] < before["b"], grown).otherwise(F.concat(acc, F.array(x)))

        return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(parts, none, add))

    return _once(_once(_codes(run), walked), merged)


def found_secrets(text: Column, ratios: list[float], mark: str | None = None, least_total: float = LEAST_TOTAL, least_mean: float = LEAST_MEAN) -> Column:
    """A struct of the spans of each kind: assign, access, hex and markov, and with a mark also clean, the text with the mark for each secret.

    A markov span overlaps no base span: runs are sought beside them. A null text is the empty one.
    """

    def of_piece(piece: Column) -> Column:
        def beside(base: Column) -> Column:
            every = F.array_sort(F.concat(base["assign"], base["access"], base["hex"]))
            masked = _masked(piece, every)

            def judged(x: Column) -> Column:
                return F.transform(_parts(x["hit"], ratios, least_total, least_mean), lambda p: _span(x["start"] + p["a"], x["start"] + p["b"], "markov"))

            runs = F.when(masked.rlike(CANDIDATE), F.flatten(F.transform(_matches(masked, CANDIDATE), judged)))
            kinds = F.struct(base["assign"].alias("assign"), base["access"].alias("access"), base["hex"].alias("hex"), F.coalesce(runs, F.array()).cast(_SPAN).alias("markov"))
            if mark is None:
                return kinds
            clean = lambda k: redacted(piece, F.array_sort(F.concat(*(k[x] for x in KINDS))), mark)
            return _once(kinds, lambda k: F.struct(*(k[x].alias(x) for x in KINDS), clean(k).alias("clean")))

        return _once(F.struct(*(x.alias(k) for x, k in zip(base_spans(piece), KINDS, strict=False))), beside)

    def whole(x: Column) -> Column:
        def moved(kind: str) -> Column:
            at = lambda spans, i: F.transform(spans, lambda s: _span(s["start"] + F.get(x["at"], i), s["end"] + F.get(x["at"], i), kind))
            return F.flatten(F.transform(x["found"], lambda f, i: F.when(F.size(f[kind]) > 0, at(f[kind], i)).otherwise(f[kind])))

        clean = [] if mark is None else [F.array_join(F.transform(x["found"], lambda f: f["clean"]), "").alias("clean")]
        return F.struct(*(moved(k).alias(k) for k in KINDS), *clean)

    def of_pieces(pieces: Column) -> Column:
        at = _starts(F.transform(pieces, F.char_length))
        return _once(F.struct(at.alias("at"), F.transform(pieces, of_piece).alias("found")), whole)

    return _once(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(PIECE), F.lit(0)), of_pieces)


def secret_spans(docs: DataFrame, ratios: list[float], text_col: str = "text", least_total: float = LEAST_TOTAL, least_mean: float = LEAST_MEAN) -> DataFrame:
    """The rows with columns assign, access, hex, markov, base and spans: arrays of (start, place, kind, end) by start, then kind.

    base has the first three kinds, spans all; of spans that begin together the kinds' order decides. A null or empty text has none. Repeated rows stay, an empty
    table gives an empty one. A very long text is searched piece by piece; only one without any cut (see PIECE) is a single piece. Columns of
    these names are replaced.
    """
    prepared(docs.sparkSession)
    held = "_found"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, found_secrets(F.col(text_col), ratios, None, least_total, least_mean))
    out = out.withColumns({k: F.col(f"{held}.{k}") for k in KINDS}).drop(held)
    out = out.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    return out.withColumn("spans", F.array_sort(F.concat("base", "markov")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mark."""

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, between).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_spans of all documents, with the ordinary model counted over all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, pair_ratios(labelled_samples(docs)))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
