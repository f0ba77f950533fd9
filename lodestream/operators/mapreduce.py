"""Key/value jobs. A job is a flat-map to columns k and v, a grouping by k and one or more reducers; the shuffle, the
map-side combining and the merge of sorted runs are Spark's. Reducers are expressions, so partial aggregation always
applies and is exact also for averages and counts."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.functions.text import strip, tokens, url_domain


def money(value: str | Column) -> Column:
    """A two-place decimal, so that sums do not depend on the order of rows."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")


#: Reducers by name, as functions of the value column.
REDUCERS = {
    "sum": lambda v: F.sum(money(v)).cast("double"),
    "max": F.max,
    "min": F.min,
    "avg": lambda v: F.sum(money(v)).cast("double") / F.count(v),
    "count": lambda v: F.count(F.lit(1)),
}


def lines(text: DataFrame, column: str = "value") -> DataFrame:
    """Text lines without surrounding white space; blank ones are skipped."""
    return text.select(strip(F.col(column)).alias("line")).where("line <> ''")


def word_pairs(df: DataFrame, text: str = "line") -> DataFrame:
    """(k = word, v = 1) for every word."""
    return df.select(F.explode(tokens(F.col(text))).alias("k"), F.lit(1).alias("v"))


def index_pairs(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(k = word, v = document) for every word of every document."""
    return df.select(F.explode(tokens(F.col(text))).alias("k"), F.col(doc).alias("v"))


def tabbed(df: DataFrame, line: str = "line") -> DataFrame:
    """doc_id and content of lines ``doc_id TAB content``; lines without a tab give no rows."""
    at = F.instr(line, "\t")
    return df.where(at > 0).select(F.substring(F.col(line), F.lit(1), at - 1).alias("doc_id"), F.substring(F.col(line), at + 1, F.length(line)).alias("content"))


def url_pairs(df: DataFrame, json_line: str) -> DataFrame:
    """(k = domain, v = 1) of JSON lines with a url; malformed lines and urls without :// give no rows."""
    parsed = F.from_json(F.col(json_line), "url string", {"mode": "PERMISSIVE"})
    return df.select(url_domain(parsed.url).alias("k"), F.lit(1).alias("v")).where("k is not null")


def reduce_by_key(pairs: DataFrame, reducers: Mapping[str, Column]) -> DataFrame:
    """One row per key with all reducers in a single pass."""
    return pairs.groupBy("k").agg(*[r.alias(name) for name, r in reducers.items()])


def named_outputs(reduced: DataFrame, names: list[str]) -> DataFrame:
    """(reducer, k, v): a row for each reducer of each key, as separate output files would hold."""
    parts = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return reduced.selectExpr("k", f"stack({len(names)}, {parts}) as (reducer, v)")


def top_n(pairs: DataFrame, n: int, by: list[Column]) -> DataFrame:
    """The n first rows of each key by ``by``, with their place. Spark keeps only n rows per key and task before the shuffle."""
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(*by))).where(F.col("place") <= n)


def secondary_sort(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Rows of each group in the order of ``by``, with their place."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*by)))


def distinct_list(pairs: DataFrame) -> DataFrame:
    """Distinct values of each key in order, joined by commas. For keys of few values; else use distinct rows."""
    return pairs.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set(F.col("v").cast("string"))), ",").alias("vs"))


def partition_of(key: Column, n: int) -> Column:
    """md5(key) modulo n, as an unsigned 128-bit number, in four steps of 32 bits."""
    digest, left = F.md5(key.cast("binary")), F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        left = F.pmod(left * ((1 << 32) % n) + F.pmod(part, F.lit(n)), F.lit(n))
    return left.cast("int")
