"""N-gram Jaccard join by prefix filters under several global token orders.

A text's set holds the 64-bit hashes of its distinct ``WORDS``-word shingles. Texts with equal sets are one node. Let a
similar pair have sets of n and m tokens. Under any total order of tokens that is the same for all, the first k tokens
that they share lie among the first n - ceil(t * n) + k of the one and m - ceil(t * m) + k of the other. With
k = n // 10 + 1 a set's prefix is long enough to ask for many shared tokens, not just for one: a passage that many texts
share does not make them candidates.

1. Post every set's prefix under the first order. Tokens that a single node posts go; a node stays if enough of its
   prefix is left for the least k of any partner.
2. Each node drops its k - 1 most frequent prefix tokens. All nodes rank tokens alike, so of the tokens that a similar
   pair shares at most k - 1 go, and at least one list still holds both.
3. Fetch the sets of the remaining nodes once, and do the same under the other orders (other hashes of the tokens); a
   node stays only if it passes under every order.
4. Stars: every node is compared with ONE partner: the least that is the least of one of its lists under every order.
   What is linked is merged. There are at most as many pairs as nodes.
5. Neighbours: in lists that still span components, every node is held against the next ``NEXT`` of each list, in an
   order of the list's own, and its ``NEAREST`` by a parity sketch (a lower bound of the symmetric difference) are
   taken. Over all lists, a node's ``NEAREST`` and as many others are compared, so there are at most eight pairs a node,
   however many lists a group shares. This takes time in the length of the lists, and a group of near copies of which
   only some are linked becomes one component here, before anything looks at all its pairs.
6. The rest, exactly: in every list that still spans components, all pairs of different components are candidates if
   sizes and sketches allow the similarity.

What a step links is merged by its classes' labels, so that links inside of a class are walked once and not in every
later step. The candidates of 5 and 6 are intersected over all orders and verified on the sets.

Lists of very frequent tokens, found on a sample, are split into blocks, and so are counted by several tasks; the sample
decides nothing else. In 5 and 6 a node brings its sketch once for all lists with the same least node. Only where these
have very many rows, their nodes are dealt to several tasks: to two at most in 5, to pairs of blocks in 6.

Defined cases: null and blank texts have an empty set and are linked with nothing; a text of fewer than WORDS words is
one shingle; repeated rows and copies are one node; documents with a null id get a component only if another document
of their group has an id; other columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lodestream.llm.common import kept, partitions, read, ship, text_of, written
from lodestream.llm.components import components, merged
from lodestream.llm.words import MULTIPLIER, filled, mix, words

WORDS, PERCENT, ORDERS = 5, 80, 2
#: Of so many that follow in a list, so many are compared before the exact step. Neither decides what is linked.
NEXT, NEAREST = 64, 4
#: Pairs that a task holds before it sorts out those that it need not.
MOST_HELD = 1 << 20
#: One in SAMPLED documents is looked at for very frequent tokens; those seen in HOT of them or more are split.
SAMPLED, HOT, MOST_HOT = 64, 60, 1 << 16
BLOCK_ROWS = 4000
#: So many rows of lists are looked at together; of their pairs each is given once.
LEAST_DONE = 100_000
#: Nodes of lists with the same least node and more rows than this are dealt to several tasks.
PART_ROWS = 20_000
#: Up to so many nodes are fetched by a broadcast of their ids (8 bytes each).
MOST_BROADCAST = 500_000
SKETCH_BITS = 1024


def shingle_sets(texts: pa.Array, n_words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = words(texts)
    h, first = w.hashes, w.first
    if len(h) >= n_words:
        s = h[: len(h) - n_words + 1].copy()
        for k in range(1, n_words):
            s = s * MULTIPLIER + h[k : len(s) + k]
        s = mix(s)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= n_words:
            out.append(np.unique(s[i : j - n_words + 1]))
        elif j > i:
            x = np.array([j - i], np.uint64)
            for v in h[i:j]:
                x = mix(x * MULTIPLIER ^ v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """An id of the set itself."""
    return int(mix(np.array([mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def spare(n: int) -> int:
    """k: how many shared prefix tokens sets of n and more are asked for."""
    return n // 10 + 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + spare(n)


def needed(n: Column, percent: int = PERCENT) -> Column:
    """The least k of any partner: of the smallest set that can be similar to one of n."""
    return F.floor(F.ceil(n * percent / 100) / 10) + 1


@dataclass
class Hot:
    """Very frequent tokens, sorted, and into how many blocks their lists are split."""

    tokens: np.ndarray
    blocks: np.ndarray

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.ones(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.blocks[at], 1)


def prefix(s: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set (sorted by hash) under an order."""
    if order:
        s = s[np.argsort(mix(s ^ np.uint64(order * 0x2545F4914F6CDD1D)))]
    return s[: prefix_length(len(s), percent)]


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many tokens fall on each bit. Two sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def _mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """mapInArrow with a function from (ids, sets) to arrays."""
    names = [x.split()[0] for x in schema.split(",")]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(row(b.column(0), shingle_sets(b.column(1))), names)

    return df.mapInArrow(turn, schema)


def _nodes(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
    return [ids, pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]


def _fresh(sets: list[np.ndarray], percent: int) -> list[tuple[int, np.ndarray]]:
    """(node, set) of the different sets that can be linked with another: at best with one of the same and one more token."""
    return list({node_of(s): s for s in sets if len(s) and 100 * len(s) >= percent * (len(s) + 1)}.items())


def hot_tokens(texts: DataFrame, orders: int, percent: int) -> Hot:
    """Tokens that very many prefixes hold, judged by a sample of the documents. This decides only how lists are dealt."""

    def counted(_: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        parts = [prefix(s, order, percent) for _, s in _fresh(sets, percent) for order in range(orders)]
        tokens, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        return [pa.array(tokens.view(np.int64)), pa.array(counts)]

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SAMPLED)) == 0)
    found = _mapped(some, "token long, n long", counted).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    rows = found.orderBy(F.desc("n"), "token").limit(MOST_HOT).toArrow()
    tokens, counts = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    by_hash = np.argsort(tokens)
    return Hot(tokens[by_hash], counts[by_hash] * SAMPLED // BLOCK_ROWS + 1)


POSTING = "token long, block int, blocks int, node long, n long"


def _postings(pairs: list[tuple[int, np.ndarray]], hot: Hot, order: int, percent: int) -> list[pa.Array]:
    """Prefix tokens of (node, set) pairs. ``blocks``: into how many blocks the token's list is split; block: the node's."""
    prefixes = [prefix(s, order, percent) for _, s in pairs]
    sizes = [len(t) for t in prefixes]
    nodes = np.repeat(np.array([v for v, _ in pairs], np.int64), sizes)
    tokens = np.concatenate(prefixes) if pairs else np.zeros(0, np.uint64)
    blocks = hot.of(tokens)
    return [pa.array(tokens.view(np.int64)), pa.array((nodes % blocks).astype(np.int32)), pa.array(blocks.astype(np.int32)), pa.array(nodes), pa.array(np.repeat(np.array([len(s) for _, s in pairs], np.int64), sizes))]


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings (token, block, blocks, node, n) that are left of nodes that can have a link: steps 1 and 2."""
    spark = postings.sparkSession
    block = W.partitionBy("token", "block")
    rows = postings.repartition(partitions(spark), "token", "block").withColumns({"low": F.min("node").over(block), "high": F.max("node").over(block), "df": F.count(F.lit(1)).over(block)})
    # Copies post the same token for the same node. A list in blocks has the same rank everywhere: before all others.
    rows = rows.where("low <> high or blocks > 1").withColumn("df", F.when(F.col("blocks") > 1, F.lit(2**62)).otherwise(F.col("df")))
    rows = rows.select("token", "block", "blocks", "node", "n", "df").dropDuplicates(["token", "block", "node"])
    of_node = W.partitionBy("node")
    ranked = rows.withColumns({"held": F.count(F.lit(1)).over(of_node), "rank": F.row_number().over(of_node.orderBy(F.desc("df"), "token"))})
    return ranked.where((F.col("held") >= needed(F.col("n"), percent)) & (F.col("rank") >= needed(F.col("n"), percent))).select("token", "block", "blocks", "node", "n")


def _lists(shared: DataFrame) -> DataFrame:
    """Postings dealt by their lists, once for all steps that read these."""
    return kept(shared.select("token", "block", "blocks", "node", "n").repartition(partitions(shared.sparkSession), "token", "block"))


def _spans(lists: DataFrame, labels: DataFrame, split: bool) -> DataFrame:
    """Rows of the lists that hold several components, with each node's component (label) and the list's least node (low).
    ``split``: whether any list is in blocks; MOST_HOT lists are at most."""
    few = labels.count() <= MOST_BROADCAST
    block = W.partitionBy("token", "block")
    rows = lists.join(F.broadcast(labels) if few else labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.repartition(partitions(rows.sparkSession), "token", "block").withColumns({"low": F.min("node").over(block), "l0": F.min("label").over(block), "l1": F.max("label").over(block)})
    whole = rows.where("blocks = 1 and l0 <> l1") if split else rows.where("l0 <> l1")
    if split:
        several = rows.where("blocks > 1").groupBy("token").agg(F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("low").alias("low")).where("l0 <> l1").select("token", "low")
        whole = whole.unionByName(rows.where("blocks > 1").drop("low").join(F.broadcast(several), "token"))
    return whole.select("low", "node", "n", "label", "token")


def _stars(lists: list[DataFrame]) -> DataFrame:
    """At most one pair (a, b), a < b, for every node: with the least of its partners under all orders. A node's partners
    are the least nodes of its lists, or of its blocks of these. (Nodes are hashes, so the least is any.)"""
    found = None
    for k, x in enumerate(lists):
        rows = x.repartition(partitions(x.sparkSession), "token", "block").withColumn("low", F.min("node").over(W.partitionBy("token", "block")))
        here = rows.where("low <> node").groupBy("node").agg(F.collect_set("low").alias(f"p{k}"))
        found = here if found is None else found.join(here, "node").withColumn("p0", F.array_intersect("p0", f"p{k}")).drop(f"p{k}")
    return found.select(F.array_min("p0").alias("a"), F.col("node").alias("b")).where("a is not null")


def _allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """In how many tokens sets of n and m may differ and still be similar enough."""
    return (n + m) * (100 - percent) // (100 + percent)


def _words_of(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    about = sets.select("node", "n", "sketch")
    joined = pairs.join(about.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a").join(about.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            apart = np.bitwise_count(_words_of(b.column(4)) ^ _words_of(b.column(5))).sum(1, dtype=np.int64)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= _allowed(n, m, percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], ["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar enough. Only the sets of nodes in pairs are moved, if these are few enough to
    be broadcast as a list."""
    pairs = written(pairs, "pairs", small=True)
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired", small=True)
    if nodes.count() <= MOST_BROADCAST:
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                kept.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(compare, "a long, b long")


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of one of their nodes."""
    out = np.zeros(len(a), bool)
    for x in (a, b):
        order = np.lexsort((apart, x))
        first = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0]) if len(x) else np.zeros(0, np.int64)
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        out[order[rank < most]] = True
    return out


def _few(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, apart), those that are among the ``NEAREST`` nearest of one of their nodes, or among as many that
    are drawn for it: the nearest alone may fall into small circles."""
    ends = pairs.withColumn("node", F.col("a")).union(pairs.withColumn("node", F.col("b")))
    of_node = W.partitionBy("node")
    ranked = ends.withColumns({"r0": F.row_number().over(of_node.orderBy("apart", "a", "b")), "r1": F.row_number().over(of_node.orderBy(F.xxhash64("a", "b"), "a", "b"))})
    return ranked.where((F.col("r0") <= NEAREST) | (F.col("r1") <= NEAREST)).select("a", "b").distinct()


def _candidates(rows: DataFrame, percent: int = PERCENT, near: bool = False) -> DataFrame:
    """Pairs (a, b, apart), a < b, of nodes of different components in the same list whose sizes and sketches allow a link,
    with their sketches' difference; if ``near``, only those that stand near each other in a list, and the nearest of each node.
    rows: low, x, y (a part of the lists of a least node, or two blocks of its nodes), block, node, n, label, tokens (the
    node's lists) and sketch. A pair is in many lists; those with the same least node (low) are dealt to the same task,
    which gives each pair once. Where these have very many rows, their nodes are dealt in parts."""
    cols = ("low", "x", "y", "block", "node", "n", "label", "sketch", "tokens")

    def bounded(t: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the pairs of rows (i, j), nodes and sketch difference of those that pass all filters."""
        small, large = np.minimum(t["n"][i], t["n"][j]), np.maximum(t["n"][i], t["n"][j])
        own = (t["x"][i] == t["y"][i]) | (t["block"][i] != t["block"][j])  # nodes of one block meet in the block's own part
        ok = (t["label"][i] != t["label"][j]) & (100 * small >= percent * large) & own
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(t["sketch"][t["row"][i]] ^ t["sketch"][t["row"][j]]).sum(1, dtype=np.int64)
        ok = apart <= _allowed(t["n"][i], t["n"][j], percent)
        v, u = t["node"][i[ok]], t["node"][j[ok]]
        return np.stack((np.minimum(v, u), np.maximum(v, u), apart[ok]))

    def of_lists(t: dict) -> Iterator[np.ndarray]:
        """Pairs in whole lists."""
        n = len(t["token"])
        change = np.flatnonzero(np.r_[True, (t["token"][1:] != t["token"][:-1]) | (t["group"][1:] != t["group"][:-1])])
        sizes = np.diff(np.r_[change, n])
        last = np.repeat(change + sizes, sizes)  # where each row's list ends
        rows = np.arange(n)
        for gap in range(1, int(min(sizes.max(initial=0), NEXT))):
            i = rows[rows + gap < last]
            yield bounded(t, i, i + gap)
        if near:
            return
        for start, size in zip(change[sizes > NEXT], sizes[sizes > NEXT], strict=True):
            # The gaps that are left. Rows of the most frequent label need no look at each other.
            labels, which, count = np.unique(t["label"][start : start + size], return_inverse=True, return_counts=True)
            most = count.argmax()
            place = np.arange(size)
            for k in np.flatnonzero(which != most):
                far = place[(np.abs(place - k) >= NEXT) & ((which == most) | (place > k))]
                yield bounded(t, np.full(len(far), start + k), start + far)

    def entries(table: pa.Table) -> np.ndarray:
        return pc.list_value_length(table.column("tokens")).to_numpy()

    def once(found: list[np.ndarray]) -> np.ndarray:
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        return pairs[:, _nearest(*pairs, NEAREST)] if near else pairs

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            at = {c: table.column(c).to_numpy() for c in cols[:7]}
            at["group"] = np.cumsum(np.r_[False, np.any([at[c][1:] != at[c][:-1] for c in ("low", "x", "y")], axis=0)])
            row = np.repeat(np.arange(len(table)), entries(table))  # a row for each node in each of its lists
            token = table.column("tokens").combine_chunks().flatten().to_numpy()
            inside = [mix(at["node"][row].view(np.uint64) ^ mix(token.view(np.uint64)))] if near else [at["node"][row], at["n"][row]]
            order = np.lexsort((*inside, token, at["group"][row]))
            row = row[order]
            t = {c: v[row] for c, v in at.items()} | {"token": token[order], "row": row, "sketch": _words_of(table.column("sketch"))}
            found, many, most = [np.zeros((3, 0), np.int64)], 0, MOST_HELD
            for p in of_lists(t):
                found.append(p)
                many += p.shape[1]
                if many > most:
                    found = [once(found)]
                    many = found[0].shape[1]
                    most = max(MOST_HELD, 2 * many)
            pairs = once(found)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b", "apart"])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(held):
                continue
            open_ = np.flatnonzero(np.any([(v := held.column(c).to_numpy()) != v[-1] for c in ("low", "x", "y")], axis=0))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if entries(held.slice(0, cut)).sum() > LEAST_DONE:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    dealt = rows.select(*cols).repartition(partitions(rows.sparkSession), "low", "x", "y").sortWithinPartitions("low", "x", "y")
    return dealt.mapInArrow(turn, "a long, b long, apart long").distinct()


def _spanning(lists: DataFrame, labels: DataFrame, sets: DataFrame, split: bool, near: bool) -> DataFrame:
    """Rows for ``_candidates``: a row per node and least node of its lists that hold several components, with these lists
    and the sketch, which is fetched once for all of them. Where a least node has very many rows, its nodes are dealt:
    if ``near``, in parts, by one hash of the node for one half of the lists and by another for the other half, so that
    a node is in two parts at most and joins them; else in blocks that meet in pairs. Nodes of the least node's largest
    component have blocks of their own, which need not meet each other."""
    rows = written(_spans(lists, labels, split).groupBy("low", "node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list("token").alias("tokens")), "spans")
    by_label = rows.groupBy("low", "label").agg(F.sum(F.size("tokens")).alias("size"))
    heavy = by_label.groupBy("low").agg(F.sum("size").alias("size"), F.max(F.struct("size", "label")).alias("most")).where(F.col("size") > PART_ROWS)
    blocks = lambda size: F.floor(size / PART_ROWS) + 1
    # A power of two, so that the parts of one order are whole parts of the other's, or the other way round.
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("size") / (2 * PART_ROWS))))).cast("long").alias("parts")
    heavy = written(heavy.select("low", parts, F.col("most.label").alias("largest"), blocks(F.col("most.size")).alias("inner"), blocks(F.col("size") - F.col("most.size")).alias("outer")), "heavy", small=True)
    if heavy.count() <= MOST_BROADCAST:
        heavy = F.broadcast(heavy)  # the rows stay where they are; those of one low may be a third of all
    rows = rows.join(sets.select("node", "sketch"), "node").join(heavy, "low", "left")
    zero = F.lit(0).cast("long")
    if near:

        def half(k: int):
            part = F.pmod(F.xxhash64("node", F.lit(k)), F.col("parts")) * 2 + k
            return F.struct(part.alias("x"), part.alias("y"), F.filter("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(2)) == k).alias("tokens"))

        whole = F.struct(zero.alias("x"), zero.alias("y"), F.col("tokens").alias("tokens"))
        dealt = rows.withColumn("p", F.explode(F.when(F.col("parts").isNull(), F.array(whole)).otherwise(F.array(half(0), half(1))))).withColumn("block", zero)
        return dealt.select("low", "p.x", "p.y", "block", "node", "n", "label", "sketch", "p.tokens").where(F.size("tokens") > 0)
    own = F.col("label") == F.col("largest")
    block = F.when(own, F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer")))
    rows = rows.withColumn("block", F.coalesce(block, zero))
    others = F.sequence(zero, F.coalesce(F.col("outer") - 1 + F.when(own, zero).otherwise(F.col("inner")), zero))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    return rows.withColumn("p", F.explode(pairs)).select("low", "p.x", "p.y", "block", "node", "n", "label", "sketch", "tokens")


SETS = "node long, n long, sketch binary, tokens binary"


def _set_rows(sets: list[np.ndarray]) -> list[pa.Array]:
    """node, n, sketch and tokens of the sets that are not empty."""
    some = [s for s in sets if len(s)]
    return [pa.array([node_of(s) for s in some], pa.int64()), pa.array([len(s) for s in some], pa.int64()), pa.array([sketch(s) for s in some], pa.binary()), pa.array([s.tobytes() for s in some], pa.binary())]


def _numbered_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, sketch and tokens from (text, node)."""
    for b in batches:
        sets = [s for v, s in zip(b.column(1).to_pylist(), shingle_sets(b.column(0)), strict=True) if len(s) and node_of(s) == v]
        yield pa.RecordBatch.from_arrays(_set_rows(sets), ["node", "n", "sketch", "tokens"])


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, node, n_shingles) per document, and a row (node, label, component) per node: its class and the
    smallest doc_id of that."""
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs, id_col, text_col)
    base = kept(_mapped(texts, "doc_id long, node long, n_shingles long", _nodes))
    nodes = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    hot = hot_tokens(texts, orders, percent)
    table, split = spark.sparkContext.broadcast(hot), bool((hot.blocks > 1).any())

    first = _mapped(texts, POSTING, lambda _, sets: _postings(_fresh(sets, percent), table.value, 0, percent))
    shared = [written(_shared(first, percent), "shared")]

    # Only these nodes matter from here on; one document of each brings its set. Those without an id come by their texts.
    wanted = shared[0].select("node").distinct().join(nodes, "node").select("node", F.col("least").alias("doc_id"))
    wanted = written(wanted, "wanted", small=True)
    few = wanted.count() <= MOST_BROADCAST
    some = texts.where("doc_id is not null").join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "node")
    sets = some.mapInArrow(_numbered_sets, SETS)
    repeated = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id is not null and rows > 1").limit(1).count()
    if wanted.where("doc_id is null").limit(1).count():
        nameless = _mapped(texts.where("doc_id is null"), SETS, lambda _, sets: _set_rows(sets))
        sets = sets.union(nameless.join(wanted.where("doc_id is null").select("node"), "node", "left_semi"))
        repeated = 1
    sets = sets.repartition(partitions(spark), "node")  # as all joins with them need it
    if repeated:
        sets = sets.dropDuplicates(["node"])  # the same id or none stands on several rows
    sets = kept(sets)

    def posted(order: int):
        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = [(v.as_py(), np.frombuffer(t.as_buffer(), np.uint64)) for v, t in zip(b.column(0), b.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays(_postings(pairs, table.value, order, percent), [x.split()[0] for x in POSTING.split(",")])

        return turn

    for order in range(1, orders):
        shared.append(written(_shared(sets.select("node", "tokens").mapInArrow(posted(order), POSTING), percent), "shared"))
    for other in shared[1:]:
        shared[0] = shared[0].join(other.select("node").distinct(), "node", "left_semi")

    lists = [_lists(x) for x in shared]
    links = written(verified(plausible(_stars(lists), sets, percent), sets, percent), "stars", small=True)
    labels = components(links)
    for near in (True, False):
        found = None
        for x in lists:
            here = written(_candidates(_spanning(x, labels, sets, split, near), percent, near), "candidates", small=True)
            found = here if found is None else found.join(here, ["a", "b"], "left_semi")
        labels = merged(labels, written(verified(_few(found) if near else found.select("a", "b"), sets, percent), "links", small=True))

    leasts = labels.join(nodes, "node").groupBy("label").agg(F.min("least").alias("component"))
    named = labels.join(leasts, "label")
    per_node = nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    return base, per_node


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included)."""
    base, per_node = _classes(docs, id_col, text_col, percent, orders)
    return base.join(per_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity classes of all documents."""
    return similarity_classes(read(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class: the one with the smallest doc_id, once; of a class without any id, one. Each
    text without words is a class of its own. Rows of the same id are told apart by their texts."""
    base, per_node = _classes(docs, "doc_id", "text", PERCENT, ORDERS)
    classes = base.join(per_node, "node", "left")
    chosen = classes.where("doc_id = coalesce(component, doc_id)").select(F.col("doc_id").alias("_kept")).distinct()
    counts = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    nameless = docs.where("doc_id is null")
    if not counts.limit(1).count() and not nameless.limit(1).count():
        return docs.join(chosen, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    # Rows that their id does not tell apart: their sets are made again, and one row of each class is taken.
    names = [f.name for f in docs.schema.fields]
    odd = docs.join(counts.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi").union(nameless)
    plain = docs.join(chosen, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi").join(counts.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    at = names.index("text")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(s) if len(s) else None for s in shingle_sets(filled(b.column(at)))], pa.int64())], [*names, "_node"])

    told = odd.mapInArrow(numbered, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))
    told = told.join(per_node.select(F.col("node").alias("_node"), F.col("label").alias("_label"), F.col("component").alias("_component")), "_node", "left")
    kept_rows = told.where("_component is null or _component = cast(doc_id as bigint)")
    worded = kept_rows.where("_label is not null").withColumn("_text", F.xxhash64("text"))
    one = worded.groupBy("_label").agg(F.min(F.struct("_node", "_text")).alias("_first"))
    once = worded.join(one, "_label").where("_node = _first._node and _text = _first._text").dropDuplicates(["_label"])
    return plain.union(once.select(*names)).union(kept_rows.where("_label is null").select(*names))


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLES: dict[str, str] = {}
