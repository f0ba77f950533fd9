"""Connected components of links between long ids, by contraction.

Every round each end of a link points to the least of itself and its neighbours, pointers are followed to their ends by
jumping (chains shorten by half each time), and links are rewritten by them: those inside of a class go, and those that
become the same are one. So a link is walked once if its class closes in one round, however many links a class has.
Labels are tables in the shared folder; nothing but a count comes to the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import written


def _between(a, b) -> list:
    """Columns of a link with its lesser end first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _roots(ends: DataFrame) -> DataFrame:
    """(node, label) per end of a link: where its pointers lead to."""
    both = ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", small=True)
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = written(labels.join(jump, "label").select("node", F.col("label").alias("was"), F.col("further").alias("label")), "labels", small=True)
        labels = stepped.select("node", "label")
        if not stepped.where("label <> was").limit(1).count():
            return labels


def _moved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels`` with each label's own root."""
    further = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """From (a, b) a row (node, label) per node that has a link; label is the component's smallest node."""
    ends = written(links.where("a <> b").select(*_between("a", "b")).distinct(), "links", small=True)
    labels = None
    while True:
        roots = _roots(ends)
        labels = roots if labels is None else written(_moved(labels, roots), "labels", small=True)
        of_a, of_b = roots.select(F.col("node").alias("a"), F.col("label").alias("la")), roots.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        ends = written(ends.join(of_a, "a").join(of_b, "b").where("la <> lb").select(*_between("la", "lb")).distinct(), "links", small=True)
        if not ends.limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after more links (a, b); only those between classes are walked."""
    of_a, of_b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    roots = components(links.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    return written(_moved(labels, roots).union(roots.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels", small=True)
