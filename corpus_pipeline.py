"""A corpus from raw documents to packed sequences: quality, near duplicates, contamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import written
from lodestream.llm.decontaminate import decontamination_stage
from lodestream.llm.jaccard import jaccard_stage
from lodestream.llm.packing import packed
from lodestream.llm.pii import personal_data_stage
from lodestream.llm.quality import quality_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with the sequence and the place that it is packed to."""
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: No SQL for run(): a fitted classifier, random walks, a fitted field and tokenised packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
