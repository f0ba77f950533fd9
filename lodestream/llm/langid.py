"""Language identification with interpolated Kneser-Ney character models.

A text is lower-cased and every run of other characters than letters becomes one blank. For each language the counts
of all 4-character sequences of all training texts are summed; lower orders use continuation counts (of how many
different characters precede), each order has its own absolute discount, and the lowest one is interpolated with the
uniform distribution. All of this is grouped aggregation on the cluster, and nothing is left out: the model grows with
the corpus.

A model is sorted arrays of sequence hashes with their terms, looked up by binary search. It is cut into shards of
about ``SHARD_ROWS`` rows by the last character but one of a sequence, which all sequences and contexts that bear on one
place of a text share (single characters, which have none, are in every shard). Shards come to the driver and are
broadcast one after the other, and texts pass by them one after the other, each adding its places' logarithms. So the
driver holds one shard at a time, however large the model is.

A text's score is its cross-entropy per character, and the lowest wins. A prediction is marked as rejected if the text is
further from the language than nearly all learned texts of that language and of about that length are: ``WIDTH``
standard deviations above their mean, which are those of all learned texts.

``score`` is the posterior under equal priors of ``EVIDENCE`` characters at the text's mean rates: neighbouring
characters are far from independent, and with a text's full length every score would be 0 or 1.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the smaller name; rows with a
null lang are not learned from; with no training text everything is ``und``; repeated rows count as often as they
occur; other columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import kept, read, ship, text_of, written
from lodestream.llm.words import MULTIPLIER, mix

ORDER, UNKNOWN = 4, "und"
SHARD_ROWS = 4_000_000
#: Characters that the reported confidence is based on, and standard deviations beyond which a text is rejected.
EVIDENCE, WIDTH = 40, 4.0
#: Bands of length, and texts that it takes to see what is usual in one.
LEAST_IN_BAND, BANDS = 20, 24
BLANK = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The normalised code points of all texts, each text between blanks, and where each begins (n + 1)."""
    low = pc.utf8_lower(texts)
    joined = " ".join(low.to_pylist())
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate(([0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(BLANK))
    border = np.zeros(len(codes), bool)
    border[begins] = True  # the blank before each text, and the last one
    keep = letter | border
    keep[1:] |= letter[:-1]  # the first of a run of blanks
    place = np.cumsum(keep) - 1
    return codes[keep], place[begins]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive code points."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:m].astype(np.uint64) + np.uint64(1)
    for k in range(1, n):
        h = h * MULTIPLIER + codes[k : m + k] + np.uint64(1)
    return mix(h)


def counted(texts: pa.Array, langs: list[str]) -> list[tuple[str, str, int]]:
    """(language, sequence of ORDER characters, count) of a batch. A text's start is padded with blanks."""
    out = []
    names = np.array(langs, object)
    for lang in sorted(set(langs)):
        codes, begins = characters(texts.filter(pa.array(names == lang)))
        codes = padded(codes, begins)
        hashes = grams(codes, ORDER)
        _, at, count = np.unique(hashes, return_index=True, return_counts=True)
        rows = np.stack([codes[at + k] for k in range(ORDER)], 1)
        strings = np.ascontiguousarray(rows.astype("<u4")).view(f"<U{ORDER}").ravel()
        out += [(lang, s, c) for s, c in zip(strings.tolist(), count.tolist(), strict=True) if not s.endswith("  ")]  # those are padding
    return out


def padded(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """With ORDER - 2 more blanks before each text, so that no sequence spans two texts' letters."""
    return np.insert(codes, np.repeat(begins, ORDER - 2), np.uint32(BLANK))


@dataclass
class Shard:
    """Per order the sorted hashes of sequences with their discounted shares by language, and of contexts with the
    weight of the next lower order."""

    shares: list[tuple[np.ndarray, np.ndarray]]
    weights: list[tuple[np.ndarray, np.ndarray]]
    uniform: float

    def log_shares(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each row of ORDER code points, by language."""
        p = np.full((len(codes), self.shares[0][1].shape[1]), self.uniform)
        for n in range(1, ORDER + 1):
            part = codes[:, ORDER - n :]
            share = _looked_up(*self.shares[n - 1], _hash_rows(part), 0.0)
            weight = _looked_up(*self.weights[n - 1], _hash_rows(part[:, :-1]), 1.0)
            p = share + weight * p
        return np.log(p)


@dataclass
class Model:
    """Languages, shards (broadcast), and the usual cross-entropy of texts by language and band of length: its mean plus
    WIDTH deviations."""

    langs: list[str]
    shards: list[Broadcast]
    limits: np.ndarray  # language, band


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * MULTIPLIER + rows[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def _looked_up(keys: np.ndarray, values: np.ndarray, keys_wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(keys_wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, keys_wanted), len(keys) - 1)
    return np.where((keys[at] == keys_wanted)[:, None], values[at], missing)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of code points: of the last character but one of a sequence, or the last one of a context."""
    return (mix(codes.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def orders(counts: DataFrame) -> DataFrame:
    """From (lang, gram, n) of the longest sequences a row (lang, order, gram, n) per sequence of each order: counts of the
    longest, continuation counts of the others."""
    every, here = None, counts
    for k in range(ORDER, 0, -1):
        rows = here.select("lang", F.lit(k).alias("order"), "gram", F.col("n").cast("double").alias("n"))
        every = rows if every is None else every.union(rows)
        here = here.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return every


def terms(rows: DataFrame) -> DataFrame:
    """(order, kind, gram, lang, value): discounted shares of sequences (kind 0) and back-off weights of contexts (1)."""
    of = ["lang", "order"]
    seen = rows.groupBy(*of).agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))  # ORDER rows a language
    raw = F.when(F.col("once") > 0, F.col("once") / F.greatest(F.col("once") + 2 * F.col("twice"), F.lit(1))).otherwise(0.5)
    discounts = F.broadcast(seen.select(*of, F.least(F.greatest(raw, F.lit(0.1)), F.lit(0.95)).alias("d")))
    rows = rows.withColumn("context", F.expr("substring(gram, 1, order - 1)"))
    contexts = rows.groupBy(*of, "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    shares = rows.join(contexts, [*of, "context"]).join(discounts, of).select("order", F.lit(0).alias("kind"), "gram", "lang", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"))
    weights = contexts.join(discounts, of).select("order", F.lit(1).alias("kind"), F.col("context").alias("gram"), "lang", (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
    return shares.union(weights)


def _table(rows: pa.Table, langs: list[str], order: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and a column of values per language."""
    width = order - kind
    here = rows.filter(pc.and_(pc.equal(rows.column("order"), order), pc.equal(rows.column("kind"), kind)))
    missing = float(kind)  # a context that a language never has leaves all to the lower order
    codes = np.zeros((len(here), 0), np.uint32)
    if width:
        codes = np.array(here.column("gram").to_pylist(), f"<U{width}").view(np.uint32).reshape(-1, width)
    keys, row = np.unique(_hash_rows(codes), return_inverse=True)
    values = np.full((len(keys), len(langs)), missing, np.float32)
    values[row, np.searchsorted(langs, here.column("lang").to_pylist())] = here.column("value").to_numpy()
    return keys, values


def build(counts: DataFrame, shard_rows: int = SHARD_ROWS) -> Model:
    """A model without limits from (lang, gram, n)."""
    spark = counts.sparkSession
    every = kept(orders(counts))
    langs = sorted(r.lang for r in every.select("lang").distinct().collect())
    if not langs:
        return Model([], [], np.zeros((0, BANDS)))
    uniform = 1 / (every.where("order = 1").select("gram").distinct().count() + 1)
    table = written(terms(every), "model")
    shards = table.count() // shard_rows + 1
    place = F.when(F.col("kind") == 1, F.substring("gram", -1, 1)).otherwise(F.expr("substring(gram, -2, 1)"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([ord(c) if c else 0 for c in b.column(5).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(shard_of(codes, shards))], [*b.schema.names[:5], "shard"])

    # Single characters and the empty context bear on every place.
    cut = table.where("order > 1").select("order", "kind", "gram", "lang", "value", place.alias("place")).mapInArrow(marked, "order int, kind int, gram string, lang string, value double, shard long")
    cut = kept(cut) if shards > 1 else cut
    single = table.where("order = 1").toArrow()  # as many rows as there are characters, by language
    out = []
    for k in range(shards):
        rows = pa.concat_tables([cut.where(F.col("shard") == k).drop("shard").toArrow(), single.select(["order", "kind", "gram", "lang", "value"])])
        tables = [[_table(rows, langs, n, kind) for n in range(1, ORDER + 1)] for kind in (0, 1)]
        out.append(spark.sparkContext.broadcast(Shard(*tables, uniform)))
    every.unpersist()
    # A text that is no likelier than letters drawn at random is of no language.
    return Model(langs, out, np.full((len(langs), BANDS), -np.log(uniform)))


@dataclass
class Places:
    """The places of all texts of a batch: distinct sequences, which place has which, and where each text's places are."""

    codes: np.ndarray
    back: np.ndarray
    first: np.ndarray
    last: np.ndarray
    some: np.ndarray  # by text: has it a letter


def places(texts: pa.Array) -> Places:
    n = len(texts)
    codes, begins = characters(texts)
    starts = begins + (ORDER - 2) * np.arange(1, n + 2)  # of the blank before each text
    codes = padded(codes, begins)
    _, at, back = np.unique(grams(codes, ORDER), return_index=True, return_inverse=True)
    # The sequence that ends in position i begins at i - ORDER + 1; a text's characters follow its blank.
    first, last = starts[:-1] + 1 - (ORDER - 1), starts[1:] - (ORDER - 2) - (ORDER - 1)
    spoken = np.concatenate(([0], np.cumsum(codes != BLANK)))
    some = spoken[starts[1:] - (ORDER - 2)] > spoken[starts[:-1]]
    return Places(np.stack([codes[at + k] for k in range(ORDER)], 1), back, first, np.maximum(last, first), some)


def log_sums(where: Places, shard: Shard, k: int, shards: int) -> np.ndarray:
    """By text and language: the sum of the logarithms of the places that a shard decides."""
    logs = np.zeros((len(where.codes), shard.shares[0][1].shape[1]))
    own = np.flatnonzero(shard_of(where.codes[:, -2], shards) == k) if shards > 1 else np.arange(len(where.codes))
    logs[own] = shard.log_shares(where.codes[own])
    out = np.empty((len(where.first), logs.shape[1]))
    for lang in range(logs.shape[1]):
        sums = np.concatenate(([0.0], np.cumsum(logs[where.back, lang])))
        out[:, lang] = sums[where.last] - sums[where.first]
    return out


def band_of(length: np.ndarray) -> np.ndarray:
    """Bands of length: powers of two."""
    return np.minimum(np.log2(np.maximum(length, 1)).astype(np.int64), BANDS - 1)


def entropies(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with _entropy (by language, per character), _length and _some (has the text a letter)."""
    ship(docs.sparkSession)
    fields = [docs.schema[c] for c in columns]
    rows = docs.select(*columns, text_of(text_col).alias("_text"))
    shards = len(model.shards)
    for k, table in enumerate(model.shards):

        def turn(batches: Iterator[pa.RecordBatch], k: int = k, table: Broadcast = table) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(len(columns))
                where = places(texts)
                sums = log_sums(where, table.value, k, shards)
                if k:
                    sums += b.column(len(columns) + 1).flatten().to_numpy().reshape(sums.shape)
                arrays, names = [*b.columns[: len(columns)], texts], [*columns, "_text"]
                if k + 1 == shards:
                    length = where.last - where.first
                    sums = -sums / np.maximum(length, 1)[:, None]
                    arrays, names = [*b.columns[: len(columns)], pa.array(length), pa.array(where.some)], [*columns, "_length", "_some"]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*arrays, flat], [*names, "_entropy"])

        final = k + 1 == shards
        more = [T.StructField("_length", T.LongType()), T.StructField("_some", T.BooleanType())] if final else [T.StructField("_text", T.StringType())]
        rows = rows.mapInArrow(turn, T.StructType([*fields, *more, T.StructField("_entropy", T.ArrayType(T.DoubleType()))]))
    return rows


def calibrated(model: Model, scored: DataFrame, lang_col: str) -> Model:
    """The model with its limits: from the entropies of all learned documents (``entropies``) under their own language."""
    if not model.langs:
        return model
    number = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col(lang_col))
    seen = scored.where(F.col("_some") & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.least(F.floor(F.log2(F.greatest("_length", F.lit(1)))), F.lit(BANDS - 1)).alias("band"), F.element_at("_entropy", number.cast("int")).alias("e"))
    rows = seen.groupBy("_lang", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q")).collect()  # BANDS rows a language
    n, s, q = np.zeros((3, len(model.langs), BANDS))
    for r in rows:
        at = model.langs.index(r["_lang"]), int(r.band)
        n[at], s[at], q[at] = r.n, r.s, r.q
    limits = model.limits.copy()
    for lang in range(len(model.langs)):
        for band in range(BANDS):
            # The band itself, and as many on both sides as it takes.
            for reach in range(BANDS):
                part = slice(max(band - reach, 0), band + reach + 1)
                if (many := n[lang, part].sum()) >= LEAST_IN_BAND:
                    mean = s[lang, part].sum() / many
                    limits[lang, band] = min(limits[lang, band], mean + WIDTH * np.sqrt(max(q[lang, part].sum() / many - mean**2, 0.0)))
                    break
    return Model(model.langs, model.shards, limits)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_rows: int = SHARD_ROWS) -> Model:
    """A model without limits from all rows with a language."""
    ship(docs.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = counted(b.column(0), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = written(rows.mapInArrow(turn, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return build(found, shard_rows)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_rows: int = SHARD_ROWS) -> Model:
    """A model from all rows with a language, with its limits."""
    model = learned(docs, text_col, lang_col, shard_rows)
    some = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"))
    return calibrated(model, entropies(some, model, ["_lang"], "_t"), "_lang") if model.langs else model


def judged(scored: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected from (doc_id, _length, _some, _entropy)."""
    names, limits = pa.array([*model.langs, UNKNOWN]), model.limits

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, some = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            entropy = b.column(3).flatten().to_numpy().reshape(len(length), -1)
            best = entropy.argmin(1)
            lead = entropy - entropy.min(1)[:, None]
            score = 1 / np.exp(-lead * np.minimum(length, EVIDENCE)[:, None]).sum(1)
            rejected = entropy.min(1) > limits[best, band_of(length)]
            best, score, rejected = np.where(some, best, len(names) - 1), np.where(some, score, 0.0), np.where(some, rejected, True)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(best)), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    schema = f"doc_id {dict(scored.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean"
    return scored.select("doc_id", "_length", "_some", "_entropy").mapInArrow(turn, schema)


def _unknown(rows: DataFrame) -> DataFrame:
    """What is said of rows when no language is learned."""
    return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return judged(entropies(rows, model, ["doc_id"]), model) if model.langs else _unknown(rows)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; the model and its limits have seen only those that are not held out. Every document
    is scored once: the limits come from the same entropies as the predictions."""
    docs = read(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out()))
    if model.langs:
        scored = written(entropies(docs, model, ["doc_id", "lang"]), "entropies")
        said = judged(scored, calibrated(model, scored.where(~held_out()), "lang"))
    else:
        said = _unknown(docs)
    return said.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
