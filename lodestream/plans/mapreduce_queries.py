"""Map/reduce jobs over the driver's tables."""

from pyspark.sql import functions as F

from lodestream.operators import mapreduce as mr
from lodestream.tables import table

SQL_TOKENS = r"""list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+'),
    lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> '')"""


def _sold(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"))


def mr_word_count(spark, sf_dir):
    """Occurrences of every word of all documents."""
    pairs = mr.word_pairs(table(spark, sf_dir, "documents"), "text")
    return pairs.groupBy(F.col("k").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def mr_inverted_index(spark, sf_dir):
    """Postings: how often each document has each word."""
    pairs = mr.index_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.groupBy(F.col("k").alias("word"), F.col("v").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


def mr_tabbed_index(spark, sf_dir):
    """Words of ``doc_id TAB content`` lines of all documents; a line without a tab gives none."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("text", F.lit(""))).alias("line"))
    rows = rows.union(spark.createDataFrame([("no tab here",)], "line string"))
    pairs = mr.index_pairs(mr.tabbed(rows), "doc_id", "content")
    return pairs.groupBy(F.col("k").alias("word")).agg(F.countDistinct("v").alias("docs"))


def mr_url_domain_count(spark, sf_dir):
    """Pages by domain, from JSON lines."""
    rows = table(spark, sf_dir, "pages").select(F.to_json(F.struct("url")).alias("line"))
    return mr.url_pairs(rows, "line").groupBy(F.col("k").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def _reducer(name):
    def query(spark, sf_dir):
        return mr.reduce_by_key(_sold(spark, sf_dir), {"v": mr.REDUCERS[name]("v")})

    query.__doc__ = f"{name} of the prices of each supplier."
    return query


def mr_combined_reducers(spark, sf_dir):
    """Several reducers in one pass, a row per reducer and key."""
    names = list(mr.REDUCERS)
    return mr.named_outputs(mr.reduce_by_key(_sold(spark, sf_dir), {n: mr.REDUCERS[n]("v") for n in names}), names)


def mr_combiner_pairs(spark, sf_dir):
    """Two-level combining: by order first, then by supplier; equal to one grouping since sums and counts associate."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum(mr.money("l_quantity")).alias("s"), F.count(F.lit(1)).alias("c"))
    return rows.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("s").cast("double").alias("quantity"), F.sum("c").alias("n"))


def mr_distinct_list(spark, sf_dir):
    """The nations of each market segment."""
    return mr.distinct_list(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_nationkey").alias("v")))


def mr_top_n(spark, sf_dir):
    """The three dearest lines of each supplier."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"), "l_orderkey", "l_linenumber")
    return mr.top_n(rows, 3, [F.desc("v"), F.asc("l_orderkey"), F.asc("l_linenumber")])


def mr_top_n_global(spark, sf_dir):
    """The ten dearest parts."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


def mr_secondary_sort(spark, sf_dir):
    """Turns of each conversation in order."""
    return mr.secondary_sort(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"]).select("conv_id", "place", "turn", "role", F.length("text").alias("chars"))


def mr_sorted_groups(spark, sf_dir):
    """Totals by order priority, in the order of the key."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.sum(mr.money("o_totalprice")).cast("double").alias("total"))
    return rows.orderBy("k")


def mr_chained_job(spark, sf_dir):
    """The output of the word count as JSON lines is the input of a count of counts."""
    lines = mr_word_count(spark, sf_dir).select(F.to_json(F.struct(F.col("word").alias("k"), F.col("n").alias("v"))).alias("line"))
    parsed = lines.select(F.from_json("line", "k string, v long").alias("r"))
    return parsed.groupBy(F.col("r.v").alias("occurrences")).agg(F.count(F.lit(1)).alias("words"))


def mr_partition(spark, sf_dir):
    """Rows of each of seven md5 partitions of the order keys."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return keys.groupBy(mr.partition_of(F.col("key"), 7).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def sql_md5_mod(key: str, n: int) -> str:
    out = "0::BIGINT"
    for i in range(4):
        out = f"(({out}) * {(1 << 32) % n} + ('0x' || substr(md5({key}), {8 * i + 1}, 8))::BIGINT % {n}) % {n}"
    return f"({out})::INT"


SOLD = "(SELECT l_suppkey AS k, l_extendedprice AS v FROM lineitem)"
SQL_REDUCERS = {"sum": "sum(v::DECIMAL(18,2))::DOUBLE", "max": "max(v)", "min": "min(v)", "avg": "sum(v::DECIMAL(18,2))::DOUBLE / count(v)", "count": "count(*)"}
QUERIES = {f.__name__: f for f in (mr_word_count, mr_inverted_index, mr_tabbed_index, mr_url_domain_count, mr_combined_reducers, mr_combiner_pairs, mr_distinct_list, mr_top_n, mr_top_n_global, mr_secondary_sort, mr_sorted_groups, mr_chained_job, mr_partition)}
QUERIES |= {f"mr_{name}": _reducer(name) for name in mr.REDUCERS}
ORACLES = {
    "mr_word_count": f"SELECT word, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS word FROM documents) GROUP BY word",
    "mr_inverted_index": f"SELECT word, doc_id, count(*) AS n FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS word FROM documents) GROUP BY word, doc_id",
    "mr_tabbed_index": f"SELECT word, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS word FROM documents) GROUP BY word",
    "mr_url_domain_count": "SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, count(*) AS n FROM pages WHERE contains(url, '://') GROUP BY 1",
    "mr_combined_reducers": " UNION ALL ".join(f"SELECT k, '{n}' AS reducer, ({e})::DOUBLE AS v FROM {SOLD} GROUP BY k" for n, e in SQL_REDUCERS.items()),
    "mr_combiner_pairs": "SELECT l_suppkey AS k, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(*) AS n FROM lineitem GROUP BY 1",
    "mr_distinct_list": "SELECT c_mktsegment AS k, array_to_string(list_sort(list(DISTINCT c_nationkey::VARCHAR)), ',') AS vs FROM customer GROUP BY 1",
    "mr_top_n": "SELECT l_suppkey AS k, l_extendedprice AS v, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS place FROM lineitem QUALIFY place <= 3",
    "mr_top_n_global": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "mr_secondary_sort": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INT AS place, turn, role, length(text)::INT AS chars FROM conversations",
    "mr_sorted_groups": "SELECT o_orderpriority AS k, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY 1",
    "mr_chained_job": f"SELECT n AS occurrences, count(*) AS words FROM (SELECT word, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS word FROM documents) GROUP BY word) GROUP BY n",
    "mr_partition": f"SELECT {sql_md5_mod('o_orderkey::VARCHAR', 7)} AS part, count(*) AS n FROM orders GROUP BY 1",
} | {f"mr_{n}": f"SELECT k, {e} AS v FROM {SOLD} GROUP BY k" for n, e in SQL_REDUCERS.items()}
