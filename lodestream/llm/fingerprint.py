"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's tokens are its runs of up to ``PIECE`` characters without white space, lower-cased. Every ``GRAM``
consecutive tokens have a rolling polynomial hash; of every ``WINDOW`` consecutive hashes the smallest is kept, the
rightmost of equal ones, with its position. Any passage of GRAM + WINDOW - 1 tokens that two texts share thus leaves
the same hash in both. Hash and position are packed in one integer so that a plain minimum picks the rightmost tie:
the hash above, 2**32 - 1 minus the position below. Both the rolling hash and the sliding minimum are built by
combining an array with itself shifted.

Defined cases: a null or blank text has an empty fingerprint; a text of fewer than GRAM tokens has one hash of all
of them; two empty fingerprints are alike (1.0), an empty and another are not (0.0). Texts are used whole.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.llm.common import partitions, read

PIECE, GRAM, WINDOW = 12, 3, 4
PRIME, BASE, LOW = 2**31 - 1, 1_000_003, 2**32 - 1
LEAST_ID = -(2**63)
BUCKET_ROWS, MOST_BUCKETS = 1000, 20_000


def _shifted(column: str, by: int) -> Column:
    return F.slice(column, by + 1, F.greatest(F.size(column), F.lit(1)))


def _joined(a: Column, b: Column) -> Column:
    return (a * BASE + b) % PRIME


def fingerprints(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the text's selected (hash, position) pairs, packed, by position."""
    t = {x: f"_{out}_{x}" for x in ("h1", "h2", "h3", "p", "m2", "m4")}
    df = df.withColumn(t["h1"], F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    df = df.withColumn(t["h2"], F.zip_with(t["h1"], _shifted(t["h1"], 1), _joined))
    df = df.withColumn(t["h3"], F.zip_with(t["h2"], _shifted(t["h1"], 2), _joined))
    n = F.size(t["h1"])
    grams = F.when(n >= GRAM, F.slice(t["h3"], 1, F.greatest(n - GRAM + 1, F.lit(1)))).when(n == 2, F.slice(t["h2"], 1, 1)).otherwise(F.col(t["h1"]))
    df = df.withColumn(t["p"], F.transform(grams, lambda h, i: F.shiftleft(h, 32) + (F.lit(LOW) - i)))
    df = df.withColumn(t["m2"], F.zip_with(t["p"], _shifted(t["p"], 1), lambda a, b: F.least(a, b)))
    df = df.withColumn(t["m4"], F.zip_with(t["m2"], _shifted(t["m2"], 2), lambda a, b: F.least(a, b)))
    kept = F.slice(t["m4"], 1, F.greatest(F.size(t["p"]) - WINDOW + 1, F.lit(1)))
    return df.withColumn(out, F.array_distinct(kept)).drop(*t.values())


def hashes(packed: Column | str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 32)))


def written_out(packed: Column | str) -> Column:
    """A fingerprint as text: hash:position, separated by blanks."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).cast("double")


def _bounds(df: DataFrame, key: str) -> tuple[int | None, list[int]]:
    """The least key, and keys that cut the rows into ranges of about BUCKET_ROWS rows: at most MOST_BUCKETS numbers."""
    n = df.count()
    cuts = min(MOST_BUCKETS, max(2 * partitions(df.sparkSession), n // BUCKET_ROWS), max(n, 1))
    least, found = df.agg(F.min(key), F.percentile_approx(key, [i / cuts for i in range(1, cuts)] or [0.5], F.lit(max(10_000, 4 * cuts)))).first()
    return least, sorted({x for x in found or [] if x > least})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    firsts, every = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (bounds[::step], bounds))
    block = F.size(F.filter(firsts, lambda x: x <= key))
    start = F.greatest(block - 1, F.lit(0)) * step
    return F.when(block == 0, 0).otherwise(start + F.size(F.filter(F.slice(every, start + 1, F.lit(step)), lambda x: x <= key))).cast("int")


def in_ranges(df: DataFrame, key: str) -> tuple[DataFrame, W]:
    """``df`` dealt out by ranges of ``key``, and the window in which lead() is the row that follows by ``key``; after
    the last comes the first. ``df`` has a column _tie that orders rows of equal keys; null keys come first.

    The first row of each range is copied to the end of the range before it (_copy is not 0), so that no task needs
    more than its range, and the number of ranges grows with the rows."""
    keyed = df.withColumn("_key", F.coalesce(F.col(key), F.lit(LEAST_ID)))
    least, bounds = _bounds(keyed.select("_key"), "_key")
    own = _range_of(F.col("_key"), bounds)
    places = F.filter(
        F.array(
            F.struct(F.col("_own").alias("range"), F.lit(0).alias("copy")),
            F.when((F.col("_own") > 0) & F.col("_first"), F.struct((F.col("_own") - 1).alias("range"), F.lit(1).alias("copy"))),
            F.when(F.col("_key") == F.lit(least), F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("copy"))),
        ),
        lambda x: x.isNotNull(),
    )
    placed = keyed.withColumn("_own", own).withColumn("_first", F.col("_key").isin(bounds)).withColumn("_at", F.explode(places))
    placed = placed.withColumns({"_range": F.col("_at.range"), "_copy": F.col("_at.copy")}).drop("_own", "_first", "_at")
    return placed.repartition(partitions(df.sparkSession), "_range"), W.partitionBy("_range").orderBy("_copy", "_key", "_tie")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last quarter is the start of the next document's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    placed, window = in_ranges(rows.withColumn("_tie", F.xxhash64("text")), "doc_id")
    placed = fingerprints(placed, "text", "fp").withColumn("own", hashes("fp"))
    after = placed.withColumns({"_next": F.lead("text").over(window), "_next_own": F.lead("own").over(window)}).where("_copy = 0")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("_next", F.lit(1), cut))
    after = fingerprints(after.withColumn("edited", edited), "edited", "edited_fp").withColumn("edited_own", hashes("edited_fp"))
    return after.select(
        "doc_id", "n_chars", "text", "edited", "fp", "edited_fp",
        likeness("own", "edited_own").alias("near_edited"), likeness("own", "_next_own").alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts."""
    return compared(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out("fp").alias("fingerprint"), written_out("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
    )


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
