r"""Document fingerprints by winnowing [native].

Tokens are runs of characters other than ASCII white space, cut after
``PIECE`` characters so that text without spaces has tokens too. Every
``K`` neighbouring tokens are a k-gram; a text of fewer is one k-gram. Of
every ``W`` neighbouring k-gram hashes the smallest is chosen, the
rightmost of equal ones. A run of at least W + K - 1 tokens that two texts
share is thus sure to leave a common hash. Each chosen hash keeps the
position of its k-gram.

A hash and its position are packed into one bigint, 32 bits of hash above
31 bits that fall as the position grows, so the smallest bigint of a window
is the smallest hash with ties to the right.

A run of characters without white space, as Chinese or base64 may be, is
cut from its start, so two texts that share a passage of such a run at
places that differ by anything but a multiple of ``PIECE`` share no k-gram
up to the next white space: the guarantee is one of tokens.

Edge cases: null and empty text have an empty fingerprint, and two empty
fingerprints are alike (1.0); equal texts have equal fingerprints; texts of
any length are taken whole; rows of null doc_id come first, and repeated
rows follow each other; an empty table gives no rows; of ``docs`` only
doc_id and text are used, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, steps

K = 5
W = 16
PIECE = 24
_LAST = (1 << 31) - 1


def chosen(text: Column, k: int = K, w: int = W) -> Column:
    """array<bigint> of packed (hash, position), in order of position."""
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    packed = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), 31).bitwiseOR((F.lit(_LAST) - i).cast("bigint"))

    def grams(h: Column) -> Column:
        few = packed(F.xxhash64(F.array_join(h.cast("array<string>"), ",")), F.lit(0))
        many = F.transform(steps(F.size(h) - (k - 1)), lambda i: packed(F.xxhash64(*[F.element_at(h, i + 1 + j) for j in range(k)]), i))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(few)).otherwise(many)

    def winnow(g: Column) -> Column:
        windows = F.transform(steps(F.greatest(F.size(g) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i + 1, F.lit(w))))
        return F.when(F.size(g) == 0, g).otherwise(F.array_distinct(windows))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: let(grams(h), winnow))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, 31)))


def written(packed: Column) -> Column:
    """hash:position pairs, space-joined; the hash has 8 hex digits."""
    one = lambda p: F.concat(F.lpad(F.lower(F.hex(F.shiftright(p, 31))), 8, "0"), F.lit(":"), F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST).cast("bigint")))
    return F.array_join(F.transform(packed, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets."""
    def ratio(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))

    return let(F.size(F.array_intersect(a, b)), ratio)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Add ``fingerprint``, array<bigint> of packed (hash, position); no shuffle."""
    return docs.withColumn("fingerprint", chosen(F.coalesce(F.col(text), F.lit("")), k, w))


#: Ranges at most: their bounds and first ids pass through the driver.
MOST_RANGES = 10_000


def with_next(docs: DataFrame, per_range: int = 4096, k: int = K, w: int = W) -> DataFrame:
    """Add fingerprint, next_text and next_fingerprint: those of the next row in order of doc_id, text; after the last row, the first's.

    Rows are dealt to ranges of doc_id of about ``per_range`` rows, or to
    ``MOST_RANGES`` larger ones, bounded by approximate quantiles, so ids
    may lie however unevenly. Within a range the next row is the following
    one; the last row of a range takes the first row of the next range that
    has any. Null ids come first. Needs the columns doc_id (a number) and
    text.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = min(max(1, -(-n // per_range)), MOST_RANGES)
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges)).first()[0] if ranges > 1 else []
    # As doubles they keep their order, which is all that a range needs.
    splits = sorted({float(b) for b in bounds or []})
    span = F.lit(0)
    dealt = docs.select("doc_id", "text")
    if splits:
        dealt = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__id", outputCol="__span", handleInvalid="keep").transform(
            dealt.withColumn("__id", F.col("doc_id").cast("double"))).drop("__id")
        span = F.col("__span").cast("int")
    dealt = dealt.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(span).alias("span"))
    order = Window.partitionBy("span").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    led = fingerprint(dealt, "text", k, w).withColumns({
        "next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order), "is_last": F.lead(F.lit(False), 1, True).over(order),
    })
    firsts = sorted(tuple(r) for r in dealt.groupBy("span").agg(F.min("doc_id")).collect())  # at most MOST_RANGES + 2
    turns = [(s, first, firsts[i - 1][0]) for i, (s, first) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(turns, f"of int, first_id {docs.schema['doc_id'].dataType.simpleString()}, last_of int"))
    # The texts of the few first rows are read again, before fingerprints are made, rather than making all of them twice.
    first_text = dealt.join(heads, (F.col("span") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    first_row = fingerprint(first_text.groupBy("last_of").agg(F.min("text").alias("text")), "text", k, w).select("last_of", F.struct("text", "fingerprint").alias("head"))
    return led.join(first_row, (F.col("span") == F.col("last_of")) & F.col("is_last"), "left").select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "head.text").alias("next_text"),
        F.when(F.col("is_last"), F.col("head.fingerprint")).otherwise(F.col("next_fingerprint")).alias("next_fingerprint"),
    )


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """The contract's columns: every document, its edited text, and the next document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, t = F.length("text"), F.col("text")
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = with_next(own).withColumn("edited", F.concat(F.substring(t, F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    marked = edited.withColumns({"edited_fp": chosen(F.col("edited")), "h": hashes(F.col("fingerprint"))})
    return marked.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fingerprint")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("h"), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(F.col("h"), hashes(F.col("next_fingerprint"))).alias("near_next"),
    )
