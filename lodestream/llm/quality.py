"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: logistic regression over words that tell the classes apart (present or not) and bands of
shape features, with a head for quality and one for toxicity. It is fitted on at most ``sample`` labelled documents, those with the smallest
hash of their id; everything after that covers all documents.

Sites: the expected number of good (toxic) documents is summed by host and by path (what follows the first slash of
the source, up to the next) over all documents. Host rates are shrunk towards the global rate and path rates towards
their host's, with a prior strength for each level found by the method of moments, so that a site with few documents
stays near its parent. A document is left out of its own site's sums. Its posterior odds are its own odds times the
site's odds over the global odds. Texts are scored once; the scores are written and read again for the sites.

A document is kept if it is more probably good than not and less probably toxic than not.

Defined cases: a text without any letter or digit (null and empty ones too) is no evidence of quality and is rejected;
a null source is a host of its own; repeated rows are scored alike and count as often as they occur; labels that
disagree about a document all count; with no labels at all every other text is kept; the input's own columns are kept
as they are, and the scores' names win over equal ones in the result of ``assess``.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import kept, read, ship, written
from lodestream.llm.words import ALNUM, Words, bytes_of, filled, words

SAMPLE, MOST_SITES = 12_000, 50_000
#: A word is a feature if its share of good and bad (toxic and other) sample documents differs by so many standard errors.
LEAST_Z, LEAST_DOCS = 5.0, 4
#: Shape features and the upper edges of their bands.
BANDS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SHAPES = 6
SHAPE_FEATURES = SHAPES * (len(BANDS) + 1)
FILTER_BITS = 20
HEADS = ("quality", "toxic")


@dataclass
class Model:
    """Sorted hashes of the words that are features; weights of shape bands, then of words, then the bias, by head."""

    vocabulary: np.ndarray
    weights: np.ndarray


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


SYMBOLS, UPPER, DIGITS, BARS = _flags(b"#$%&*!@^~<>{}=_\\"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58))), _flags(b"|")


def features(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of all texts, and the numbers of their shape bands (a row per text)."""
    w = words(pc.utf8_lower(texts), ALNUM, lower=False)
    raw, starts = bytes_of(texts)
    doc = w.text_of_word
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    size = np.maximum(np.diff(starts), 1)
    share = [per_text(t[raw], starts) / size for t in (SYMBOLS, UPPER, DIGITS, BARS)]
    share += [np.bincount(doc, same, len(texts)) / np.maximum(np.diff(w.first), 1), np.minimum(np.log10(size) / 6, 1)]
    return w, np.stack([np.searchsorted(BANDS, x) + k * (len(BANDS) + 1) for k, x in enumerate(share)], 1)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the texts."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[starts[1:]] - sums[starts[:-1]]


def _logistic(doc: np.ndarray, ids: np.ndarray, y: np.ndarray, n_features: int, steps: int = 150, ridge: float = 0.5) -> np.ndarray:
    """Weights and bias of one head by Adam over the whole sample, both classes weighted alike."""
    n, rate = len(y), y.mean()
    out = np.zeros(n_features + 1)
    if rate in (0.0, 1.0):
        out[-1] = 20.0 if rate else -20.0
        return out
    balance = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, out[ids], n) + out[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.append(np.bincount(ids, miss[doc], n_features) + ridge * out[:-1], miss.sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        out = out - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return out


def telling_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that tell the classes apart, from rows (hashes, quality, toxic). Words are counted by
    class on the cluster; what comes to the driver are the chosen ones."""
    sizes = rows.agg(*[F.count_if(F.col(h) == k).alias(f"{h}{k}") for h in HEADS for k in (0, 1)]).first()
    counts = [F.count_if(F.col(h) == k).alias(f"{h}{k}") for h in HEADS for k in (0, 1)]
    words_ = rows.select(F.explode("hashes").alias("word"), *HEADS).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), *counts).where(F.col("docs") >= LEAST_DOCS)
    chosen = F.lit(False)
    for h in HEADS:
        n1, n0 = sizes[f"{h}1"], sizes[f"{h}0"]
        if n1 and n0:
            c1, c0 = F.col(f"{h}1"), F.col(f"{h}0")
            p1, p0, p = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1), (c1 + c0 + 0.5) / (n1 + n0 + 1)
            chosen |= F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) > LEAST_Z
    return np.sort(words_.where(chosen).select("word").toArrow().column(0).to_numpy().view(np.uint64))


def fit(doc: np.ndarray, word: np.ndarray, bands: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray) -> Model:
    """A model from the (document, number of the word in the vocabulary) pairs, the shape bands and the labels (nan: unknown)."""
    n = len(labels)
    doc_all = np.concatenate((np.repeat(np.arange(n), SHAPES), doc))
    ids_all = np.concatenate((bands.ravel(), word + SHAPE_FEATURES))
    weights = np.zeros((SHAPE_FEATURES + len(vocabulary) + 1, labels.shape[1]))
    weights[-1] = (20.0, -20.0)  # with no labels everything is kept
    for head in range(labels.shape[1]):
        known = ~np.isnan(labels[:, head])
        if known.any():
            place, here = np.cumsum(known) - 1, known[doc_all]
            weights[:, head] = _logistic(place[doc_all[here]], ids_all[here], labels[known, head], len(weights) - 1)
    return Model(vocabulary, weights)


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """Of each text and head; not a number for texts without any letter or digit."""
    w, bands = features(texts)
    low = np.uint64((1 << FILTER_BITS) - 1)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(model.vocabulary & low).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(w.hashes & low).astype(np.int64)])
    at = np.searchsorted(model.vocabulary, w.hashes[hit])
    exact = at < len(model.vocabulary)
    exact[exact] = model.vocabulary[at[exact]] == w.hashes[hit[exact]]
    pairs = np.unique(w.text_of_word[hit[exact]] * (len(model.vocabulary) + 1) + at[exact])
    doc, word = pairs // (len(model.vocabulary) + 1), pairs % (len(model.vocabulary) + 1)
    z = np.stack([np.bincount(doc, h[SHAPE_FEATURES + word], len(texts)) + h[bands].sum(1) + h[-1] for h in model.weights.T], 1)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p[np.diff(w.first) == 0] = np.nan
    return p


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on the labelled documents with the ``sample`` smallest hashes of their ids."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").alias("_id"), *HEADS).where("_id is not null").orderBy(F.xxhash64("_id"), *HEADS).limit(sample)
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(known), "_id").select("_text", *[F.col(h).cast("double") for h in HEADS], "_id")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, bands = features(b.column(0))
            parts = [np.unique(w.hashes[i:j]).view(np.int64) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(parts, pa.list_(pa.int64())), pa.array(list(bands.astype(np.int32)), pa.list_(pa.int32())), b.column(1), b.column(2)], ["_id", "hashes", "bands", *HEADS])

    schema = f"_id {dict(some.dtypes)['_id']}, hashes array<long>, bands array<int>, quality double, toxic double"
    rows = kept(some.mapInArrow(turn, schema))
    vocabulary = telling_words(rows)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for x in b.column(1):
                h = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                parts.append(at[vocabulary[at] == h] if len(vocabulary) else at[:0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.int64())), *b.columns[2:]], b.schema.names)

    # At most ``sample`` labelled documents, each with the numbers of the chosen words that it has.
    found = rows.mapInArrow(numbered, schema).orderBy("_id", *HEADS).toArrow()
    rows.unpersist()
    if not len(found):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SHAPES), np.int64), np.zeros((0, len(HEADS))), vocabulary)
    lists = found.column("hashes").combine_chunks()
    doc = np.repeat(np.arange(len(found)), lists.value_lengths().to_numpy())
    bands = found.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, SHAPES).astype(np.int64)
    labels = np.stack([found.column(h).to_numpy() for h in HEADS], 1)
    return fit(doc, lists.flatten().to_numpy(), bands, labels, vocabulary)


def scored(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of ``docs`` with _p_quality and _p_toxic of each document by itself; null without any letter or
    digit."""
    ship(docs.sparkSession)
    docs = docs.drop("_p_quality", "_p_toxic")
    columns = docs.columns if columns is None else columns
    rows = docs.select(*columns, F.col(text_col).alias("_scored"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(filled(b.column(len(columns))), model)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *(pa.array(p[:, h], pa.float64(), from_pandas=True) for h in range(2))], [*columns, "_p_quality", "_p_toxic"])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"_p_{h}", T.DoubleType()) for h in HEADS)]))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


@dataclass
class Priors:
    """Global rates, and the strength of the prior by level and head."""

    rates: dict[str, float]
    host: dict[str, float]
    path: dict[str, float]


MOST_STRENGTH = 1e6


def _strength(rate: float, extra: float | None) -> float:
    """The strength of a Beta prior around a rate whose true values vary by ``extra`` beyond chance."""
    return MOST_STRENGTH if extra is None else min(max(rate * (1 - rate) / max(extra, 1e-9) - 1, 1.0), MOST_STRENGTH)


def sites(scores: DataFrame) -> tuple[DataFrame, Priors | None]:
    """Sums of _p_quality and _p_toxic by _host and _path: n, s_quality, s_toxic of the path, n_host, host_quality,
    host_toxic of its host. One row per path; all sums are partial sums first. Strengths by the method of moments: what
    hosts vary around the global rate, and paths around their host's, more than chance would have it."""
    by_path = scores.groupBy("_host", "_path").agg(F.count("_p_quality").alias("n"), *[F.sum(f"_p_{h}").alias(f"s_{h}") for h in HEADS]).where("n > 0")
    by_path = written(by_path, "paths", small=True)
    by_host = by_path.groupBy("_host").agg(F.sum("n").alias("n_host"), F.count(F.lit(1)).alias("paths"), *[F.sum(f"s_{h}").alias(f"host_{h}") for h in HEADS])
    total = by_path.agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(h) for h in HEADS]).first()
    joined = by_path.join(by_host.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    if not total.n:
        return joined, None
    rates = {h: total[h] / total.n for h in HEADS}
    of_hosts = by_host.agg(*[(F.sum(F.col("n_host") * (F.col(f"host_{h}") / F.col("n_host") - rates[h]) ** 2 - rates[h] * (1 - rates[h])) / F.sum("n_host")).alias(h) for h in HEADS]).first()
    own = {h: F.col(f"host_{h}") / F.col("n_host") for h in HEADS}
    several = joined.where("paths > 1")
    of_paths = several.agg(*[(F.sum(F.col("n") * (F.col(f"s_{h}") / F.col("n") - own[h]) ** 2 - own[h] * (1 - own[h])) / F.sum("n")).alias(h) for h in HEADS]).first()
    return joined, Priors(rates, {h: _strength(rates[h], of_hosts[h]) for h in HEADS}, {h: _strength(rates[h], of_paths[h]) for h in HEADS})


def _posterior(head: str, priors: Priors) -> Column:
    """Of a row with its own probability and its site's sums, in which it is counted."""
    p, rate, host, path = F.col(f"_p_{head}"), priors.rates[head], priors.host[head], priors.path[head]
    of_host = (F.greatest(F.col(f"host_{head}") - p, F.lit(0.0)) + host * rate) / (F.col("n_host") - 1 + host)
    of_path = (F.greatest(F.col(f"s_{head}") - p, F.lit(0.0)) + path * of_host) / (F.col("n") - 1 + path)
    return 1 / (1 + F.exp(-(_odds(p) + _odds(of_path) - _odds(F.lit(rate)))))


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of ``docs`` with p_quality, p_toxic (by itself), post_quality, post_toxic (with its site) and keep."""
    new = ["p_quality", "p_toxic", "post_quality", "post_toxic", "keep"]
    own = [c for c in (docs.columns if columns is None else columns) if not c.startswith("_p_")]
    model = train(docs, labels, sample, id_col, text_col)
    marked = docs.withColumns({"_host": F.split_part(F.col(site_col), F.lit("/"), F.lit(1)), "_path": F.split_part(F.col(site_col), F.lit("/"), F.lit(2))})
    scores = written(scored(marked, model, text_col, [*[c for c in own if c not in ("_host", "_path")], "_host", "_path"]), "scored")
    found, priors = sites(scores)
    few = found.limit(MOST_SITES + 1).count() <= MOST_SITES
    sums = ["n", "n_host", *[f"{a}_{h}" for a in ("s", "host") for h in HEADS]]
    found = found.select(F.struct(*sums).alias("_site"), F.col("_host").alias("_h"), F.col("_path").alias("_q"))
    joined = scores.join(F.broadcast(found) if few else found, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q")), "left")
    post = {h: F.lit(0.0) for h in HEADS}
    if priors is not None:
        # The sums of the site, under names that no column of the input can have.
        for h in HEADS:
            post[h] = F.coalesce(_posterior(h, priors), F.lit(0.0))
    rows = joined.select(F.struct(*[F.col(c) for c in own]).alias("_own"), *[f"_p_{h}" for h in HEADS], "_site.*")
    rows = rows.withColumns({f"_post_{h}": post[h] for h in HEADS})
    keep = F.col("_p_quality").isNotNull() & (F.col("_post_quality") >= 0.5) & (F.col("_post_toxic") < 0.5)
    return rows.select(
        *[F.col("_own")[c].alias(c) for c in own if c not in new], *[F.coalesce(f"_p_{h}", F.lit(0.0)).alias(f"p_{h}") for h in HEADS],
        *[F.col(f"_post_{h}").alias(f"post_{h}") for h in HEADS], keep.alias("keep"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents, and whether each is kept."""
    return assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), columns=["doc_id"]).select("doc_id", "p_quality", "p_toxic", "post_quality", "post_toxic", "keep")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return assess(docs, read(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
