r"""Secret scans [native]: fixed patterns plus sliding-window entropy.

Base kinds, leftmost and non-overlapping within a kind: ``assign``,
``access`` and ``hex``. The method adds ``entropy`` spans: over every
candidate string (20 or more characters of the key alphabet, outside base
spans) a window of ``WINDOW`` characters slides. Its sum of c * log2(c) over
the counts of its characters changes by two terms a step, for the character
that enters and the one that leaves; their counts are those in the window
between. Each character class has a threshold of its own, and every
candidate belongs to a class. A candidate that matches the allow list is
suppressed. The span runs from the first to the last window at or above the
threshold.

Positions are code points, end exclusive. A null or empty text has no
spans; very long texts are scanned whole, and a candidate costs in
proportion to its length; of base spans that start together the one whose
kind is listed first comes first; repeated rows give repeated results; an
empty table gives no rows; columns called secrets, or like the operator's
own (``__text``, ``__base``), are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

# The contract's patterns, as Java regular expressions.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of fewer than 20 characters in all fail, and no run starts again inside one
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (pattern, bits from which a window is suspect) by character class; the first that fits counts. Words of one case are held to
#: more than their usual 2.5 to 3.5 bits, hexadecimal digits to less than the 3.4 of random ones.
CLASSES = {"digits": ("^[0-9]+$", 3.0), "hexadecimal": ("^[0-9a-fA-F]+$", 3.0), "word": ("^(?:[A-Z]?[a-z]+|[A-Z]+)$", 3.65), "mixed": ("", 3.75)}
#: Allow list: identifiers, counting runs and fillers that look random but are not secret.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|0123456789|1234567890|abcdefghij|example|sample|placeholder|changeme|dummy|lorem"
    r"|^(.{1,8})\1+.{0,7}$|^[A-Za-z]+(?:[-_/][A-Za-z]+)+[0-9]{0,4}$|^(?-i:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})+)$"
)

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches: their starts follow from the lengths of matches and of the gaps between them."""
    none = F.array().cast(SPANS)

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
        spans = let(ends, lambda e: F.zip_with(found, e, lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("match"))))
        kept = F.filter(spans, lambda s: keep(s["match"])) if keep else spans
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def _hot_range(word: Column, least: Column) -> Column:
    """struct(first, last): starts of the first and last suspect window of ``word``, or -1."""
    c_log_c = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    f = lambda c: F.element_at(c_log_c, c + 1)
    count = lambda within, one: F.length(within) - F.length(F.replace(within, one, F.lit("")))

    def slide(acc: Column, i: Column) -> Column:
        full = i > WINDOW
        between = F.substring(word, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i - 1, F.lit(WINDOW - 1)))
        stay = count(between, F.substring(word, i, F.lit(1)))
        left = count(between, F.substring(word, i - WINDOW, F.lit(1)))
        change = let(stay, lambda n: f(n + 1) - f(n)) - F.when(full, let(left, lambda n: f(n + 1) - f(n))).otherwise(0.0)
        return let(acc["total"] + change, lambda total: let((i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least), lambda suspect: F.struct(
            total.alias("total"),
            F.when(suspect & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"),
            F.when(suspect, i - WINDOW).otherwise(acc["last"]).alias("last"),
        )))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _outside(p: Column, base: Column) -> Column:
    """Parts of the candidate ``p`` that no base span covers and that hold a window: array<struct<start, word>>."""
    whole = F.array(F.struct(p["start"].alias("start"), p["word"].alias("word")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    over = F.array_sort(F.filter(base, lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])))
    piece = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    parts = F.aggregate(
        over, F.struct(p["start"].alias("at"), none.alias("parts")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["parts"], piece(acc["at"], b["start"])).alias("parts")),
        lambda acc: F.concat(acc["parts"], piece(acc["at"], p["end"])),
    )
    cut = F.transform(F.filter(parts, lambda x: x["end"] - x["start"] >= WINDOW), lambda x: F.struct(
        x["start"].alias("start"), F.substring(p["word"], (x["start"] - p["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).alias("word")))
    return F.when(F.exists(base, lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])), cut).otherwise(whole)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Suspect windows of candidates outside base spans."""
    none = F.array().cast(SPANS)

    def least(word: Column) -> Column:
        named = [(F.lit(True) if not pattern else word.rlike(pattern), bits) for pattern, bits in CLASSES.values()]
        return F.coalesce(*[F.when(fits, F.lit(bits)) for fits, bits in named])

    def located(found: Column) -> Column:
        gaps = F.split(text, CANDIDATE, -1)
        ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
        placed = let(ends, lambda e: F.zip_with(found, e, lambda m, end: F.struct((end - F.length(m)).alias("start"), m.alias("word"), end.alias("end"))))
        free = F.filter(F.flatten(F.transform(placed, lambda p: _outside(p, base))), lambda p: ~p["word"].rlike(ALLOWED))

        def judge(p: Column) -> Column:
            hot = let(least(p["word"]), lambda bits: _hot_range(p["word"], bits))
            return let(hot, lambda h: F.when(h["first"] >= 0, F.struct(
                (p["start"] + h["first"]).alias("start"), F.lit(3).alias("kind"), (p["start"] + h["last"] + WINDOW).alias("end"))))

        return F.filter(F.transform(free, judge), lambda s: s.isNotNull())

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: array<struct<start, kind, end>> in order of start, then kind (its place in KINDS)."""
    whole = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    t = F.col("__text")
    based = whole.withColumn("__base", F.concat(_spans(t, ASSIGN, 0, long_enough), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    found = based.withColumn("secrets", F.array_sort(F.concat(F.col("__base"), _entropy_spans(t, F.col("__base")))))
    return found.drop("__text", "__base")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scanned table."""
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"), count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every found span of ``text`` by ``mask``; overlapping spans become one."""
    scanned = scan(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    cut = F.aggregate(
        "secrets", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(
                F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                         F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise("")).alias("out"), s["end"].alias("at")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))),
    )
    return scanned.withColumn(text, F.when(F.size("secrets") > 0, cut).otherwise(F.col(text))).drop("secrets")
