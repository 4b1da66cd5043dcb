"""Secret scanning with DataFrame functions only.

Base kinds are patterns: ``assign`` (a secret's name and a value), ``access``
(key ids) and ``hex`` (long hexadecimal runs).

The method adds ``random``: long tokens that look drawn at random.  The
encoding of a token is inferred from its alphabet, and a battery tests it
against uniform draws from that alphabet: a chi-squared test of symbol counts,
a runs test around the middle of the alphabet, and a lag-1 serial correlation.
A token that fails the battery is no random string.  Passing is not enough, as
short text passes too: so each token gets the probability that ordinary text of
its length in its encoding shows symbols as evenly spread (from the chance that
two symbols agree).  Those probabilities go through a Benjamini-Hochberg
procedure over all tokens of the corpus, in strata of encoding and length, so
that the expected share of ordinary tokens among those reported is at most
``FALSE_SHARE`` in each stratum.

The corpus counts behind that are a bounded histogram; there is no shuffle of
texts and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import refuse_clash, staged, text_of

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6

#: A token of the battery: a whole run of these, of 20 or more.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: pattern, alphabet in order, chance that two symbols of ordinary text agree.  The first that fits counts.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", 0.10),
    ("hex upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.10),
    ("lower", "^[a-z]+$", _LOWER, 0.0667),
    ("upper", "^[A-Z]+$", _UPPER, 0.0667),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 0.055),
    ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER, 0.055),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER, 0.050),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 0.050),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.050),
    ("mixed", "^.+$", _UPPER + _LOWER + _DIGITS + "+/-_=", 0.050),
)
#: In ordinary text, the chance that three symbols agree is this times the square of that of two
#: (1.28 for letters of English); it widens the spread of the count of pairs that agree.
THREE = 1.3
#: Share of ordinary tokens tolerated among those reported, and the level of the battery.
FALSE_SHARE, BATTERY_LEVEL = 0.01, 0.001
#: Steps of a tenth in -log10 of the probability, the last for all beyond.
STEPS = 300

_FOUND = "array<struct<start:int,end:int,kind:int,value:int,token:string>>"


#: Elements that are folded with a growing array at once.
_BLOCK = 256


def _running(values: Column, merge) -> Column:
    """For each element of an array of integers, the fold of all before it, from zero.

    A fold that appends to an array copies it at every step, so blocks are folded
    by themselves, from where the blocks before them end.
    """
    ints = "array<int>"

    def before(array: Column, start: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(start.alias("at"), F.array().cast(ints).alias("out")),
            lambda d, x: F.struct(merge(d["at"], x).alias("at"), F.concat(d["out"], F.array(d["at"])).alias("out")),
            lambda d: d["out"],
        )

    size = F.size(values)
    many = F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int"))
    blocks = F.when(size > 0, F.transform(many, lambda k: F.slice(values, k * _BLOCK + 1, _BLOCK))).otherwise(F.array().cast(f"array<{ints}>"))

    def laid(blocks: Column) -> Column:
        starts = before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), merge)), F.lit(0))
        return F.flatten(F.zip_with(blocks, starts, before))

    return _with(blocks, laid)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though it is used often."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, kind: int, least_value: int = 0) -> Column:
    """All matches, from left to right, as spans in code points with the text matched."""
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, regex, F.lit(2)) if least_value else found

    def laid(found: Column) -> Column:
        rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("token"), values.alias("value"))
        sizes = F.transform(
            rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["token"]).alias("size"), F.length(x["value"]).alias("value"), x["token"].alias("token"))
        )
        return _with(sizes, placed)

    def placed(sizes: Column) -> Column:
        starts = _running(F.transform(sizes, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        out = F.zip_with(
            sizes,
            starts,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["token"].alias("token")
            ),
        )
        return F.filter(out, lambda x: x["value"] >= least_value) if least_value else out

    return F.when(text.rlike(pattern), _with(found, laid)).otherwise(F.array().cast(_FOUND))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _below(z: Column) -> Column:
    """The normal distribution function; in the lower tail by its continued fraction."""
    size = F.abs(z)
    density = F.exp(-size * size / 2) / 2.5066282746310002
    t = 1 / (1 + 0.2316419 * size)  # a few dozen operations on one number, as z is a value here
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    fraction = size
    for k in range(12, 0, -1):
        fraction = size + k / fraction
    upper = F.when(size > 2.5, density / fraction).otherwise(near)
    return F.when(z < 0, upper).otherwise(1 - upper)


def _battery(token: Column) -> Column:
    """Encoding, length, the battery's p-value and -log10 of ordinary text's, of one token."""
    alphabets = F.array(*[F.lit(e[2]) for e in ENCODINGS])

    def fitting(body: Column) -> Column:
        chosen = F.lit(len(ENCODINGS) - 1)
        for k in reversed(range(len(ENCODINGS) - 1)):
            chosen = F.when(body.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(chosen)
        return F.struct(body.alias("body"), chosen.alias("encoding"))

    agreeing = F.array(*[F.lit(e[3]) for e in ENCODINGS])

    # each step is worked out once and handed on: inside a lambda nothing is shared
    def of(x: Column) -> Column:
        """x: body, encoding."""
        letters, n = alphabets[x["encoding"]], F.length(x["body"]).cast("double")
        squares = F.aggregate(
            F.split(letters, ""),
            F.lit(0.0),
            lambda total, c: total + F.pow((F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        ranks = F.transform(F.split(x["body"], ""), lambda c: F.position(c, letters).cast("double"))
        size = F.length(letters).cast("double")
        return F.struct(x["encoding"].alias("encoding"), n.alias("n"), size.alias("size"), squares.alias("squares"), ranks.alias("ranks"), agreeing[x["encoding"]].alias("agree"))

    def centred(x: Column) -> Column:
        n, middle = x["n"], (x["size"] + 1) / 2
        mean = F.aggregate(x["ranks"], F.lit(0.0), lambda t, r: t + r) / n
        high = F.aggregate(x["ranks"], F.lit(0.0), lambda t, r: t + F.when(r > middle, 1.0).otherwise(0.0))
        pairs = F.zip_with(F.slice(x["ranks"], 1, F.size(x["ranks"]) - 1), F.slice(x["ranks"], 2, F.size(x["ranks"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(x.alias("x"), middle.alias("middle"), mean.alias("mean"), (2 * high * (n - high)).alias("both"), pairs.alias("pairs"))

    def scores(c: Column) -> Column:
        x, both, mean, middle = c["x"], c["both"], c["mean"], c["middle"]
        n, df = x["n"], x["size"] - 1
        chi = x["squares"] * x["size"] / n - n
        z_chi = (F.pow(F.greatest(chi / df, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        runs = F.aggregate(c["pairs"], F.lit(1.0), lambda t, p: t + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
        z_runs = (runs - (both / n + 1)) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        spread = F.aggregate(x["ranks"], F.lit(0.0), lambda t, r: t + (r - mean) * (r - mean))
        lagged = F.aggregate(c["pairs"], F.lit(0.0), lambda t, p: t + (p["a"] - mean) * (p["b"] - mean))
        z_serial = (lagged / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        agree = (x["squares"] - n) / (n * (n - 1))
        three = THREE * x["agree"] * x["agree"]
        spread_text = 2 * x["agree"] * (1 - x["agree"]) / (n * (n - 1)) + 4 * (n - 2) * (three - x["agree"] * x["agree"]) / (n * (n - 1))
        z_text = (agree - x["agree"]) / F.sqrt(spread_text)
        return F.struct(x["encoding"].alias("encoding"), n.alias("n"), (-z_chi).alias("chi"), (-F.abs(z_runs)).alias("runs"), (-F.abs(z_serial)).alias("serial"), z_text.alias("text"))

    def chances(z: Column) -> Column:
        least = F.least(_below(z["chi"]), 2 * _below(z["runs"]), 2 * _below(z["serial"]))
        strength = -F.log10(F.greatest(_below(z["text"]), F.lit(1e-30)))
        return F.struct(
            z["encoding"].alias("encoding"),
            F.floor(F.log2(z["n"]) * 2).cast("int").alias("band"),
            F.least(F.floor(strength * 10), F.lit(STEPS)).cast("int").alias("step"),
            F.least(3 * least, F.lit(1.0)).alias("p_random"),
        )

    out = F.array(F.regexp_replace(token, "=+$", ""))
    for step in (fitting, of, centred, scores, chances):
        out = F.transform(out, step)
    return out[0]


def _scan(text: Column) -> tuple[Column, Column]:
    base = F.concat(_plain(_spans(text, ASSIGN, 0, MIN_VALUE)), _plain(_spans(text, ACCESS, 1)), _plain(_spans(text, HEX, 2)))
    found = F.filter(
        _spans(text, TOKEN, 3),
        lambda s: s["token"].rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]|^[a-z]+$|^[A-Z]+$") & (F.length(F.regexp_replace(s["token"], "=+$", "")) > 2),
    )
    return base, found


def _cuts(tokens: DataFrame, false_share: float) -> dict[tuple[int, int], int]:
    """Benjamini-Hochberg by stratum: the least step that is reported.

    The histogram has a row for each encoding, length band and step that occurs,
    a few thousand at most whatever the input.
    """
    rows = tokens.groupBy("t.encoding", "t.band", "t.step").count().collect()
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for encoding, band, step, n in rows:
        strata.setdefault((encoding, band), {})[step] = n
    cuts = {}
    for stratum, counts in strata.items():
        tested, above = sum(counts.values()), 0
        for step in sorted(counts, reverse=True):
            above += counts[step]
            if 10 ** (-step / 10) * tested <= false_share * above:
                cuts[stratum] = step
    return cuts


def scan(
    documents: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    false_share: float = FALSE_SHARE,
    level: float = BATTERY_LEVEL,
) -> DataFrame:
    """A row per document: the carried columns and ``spans``, an array of (start,
    end, kind) in code points, ends exclusive, by start and then kind; kind is
    the index in ``KINDS``.  Spans of ``random`` overlap no base span.

    A null text has no spans, as an empty one.  Repeated rows and null ids are
    scanned row by row; repeated tokens count as often as they occur in the
    false-discovery procedure.  Columns that are not named are not read; a
    carried column may not be named ``spans`` or begin with two underscores
    (``ValueError``).
    """
    refuse_clash(carry, ("spans",))
    text = F.col("__text")
    base, found = _scan(text)
    rows = documents.select(*[documents[c] for c in carry], text_of(documents, text_column).alias("__text"))
    rows = rows.select(*carry, base.alias("__base"), found.alias("__found"))
    rows = rows.withColumn(
        "__found", F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s["token"]).alias("t")))
    )
    rows = staged(rows, "secrets")
    cuts = _cuts(rows.select(F.explode("__found.t").alias("t")), false_share)
    shape = F.map_from_arrays(
        F.array(*[F.lit(e * 1000 + b) for e, b in cuts]).cast("array<int>"), F.array(*[F.lit(c) for c in cuts.values()]).cast("array<int>")
    )
    added = F.filter(
        "__found",
        lambda s: (F.coalesce(F.element_at(shape, s["t"]["encoding"] * 1000 + s["t"]["band"]), F.lit(STEPS + 1)) <= s["t"]["step"]) & (s["t"]["p_random"] >= level),
    )
    added = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(3).alias("kind")))
    ordered = F.array_sort(F.transform(F.concat("__base", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select(*carry, _plain(_with(ordered, _apart)).alias("spans"))


def _apart(ordered: Column) -> Column:
    """Spans by start and kind, without those of ``random`` that a base span overlaps."""
    far = 2**31 - 1
    reach = _running(F.transform(ordered, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
    back = F.reverse(ordered)
    following = F.reverse(_running(F.transform(back, lambda s: F.when(s["kind"] < 3, far - s["start"]).otherwise(0)), lambda a, b: F.greatest(a, b)))
    free = F.zip_with(reach, following, lambda a, b: F.struct(a.alias("reach"), (far - b).alias("next")))
    both = F.zip_with(ordered, free, lambda s, f: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), ((f["reach"] <= s["start"]) & (f["next"] >= s["end"])).alias("free")))
    return F.filter(both, lambda s: (s["kind"] < 3) | s["free"])


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark.

    Pieces are cut from the text in four bytes a code point, where a place needs no
    counting, and joined once.
    """

    def cut(x: Column) -> Column:
        reach = _running(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        piece = lambda a, n: F.decode(F.substring(x["wide"], 4 * a + 1, 4 * n), "UTF-32")
        pieces = F.zip_with(x["spans"], reach, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), piece(end, F.length(x["wide"])))

    whole = _with(F.struct(spans.alias("spans"), F.encode(text, "UTF-32").alias("wide")), cut)
    return F.when(F.size(spans) > 0, whole).otherwise(text)
