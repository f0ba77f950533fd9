"""Best-fit packing of tokenised documents into sequences.

Bin packing sees only lengths, and there are at most ``capacity`` of them, so the whole instance is a histogram: the
packing is solved on counts, and its size on the driver is bounded by the capacity whatever the number of documents.

1. Dominance reduction after Martello and Toth: a set of at most three pieces that dominates every other set holding
   its largest piece is fixed permanently, as many times as the counts allow, and the instance shrinks.
2. What remains is packed best-fit decreasing, again on counts.

Pieces are then numbered within their length (in salted groups, since one length may hold a third of all pieces) and
looked up in the solution. Token ids are those of ``tokenizers`` with its file. Texts without any of the file's added
tokens, which is nearly all, get the same ids from the same vocabulary in its rank form, about four times as fast; a
test holds the two against each other. A text with an added token (``<|endoftext|>``) goes through ``tokenizers``
itself, which gives that token its own id.

Defined cases: a null text is empty and becomes the single end token; equal rows are pieces of their own; documents
of more than ``capacity`` tokens are cut so that all pieces but the first are full; columns other than the two named
are ignored; an empty table has no sequences.
"""

import base64
import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.llm.common import partitions, read, ship, text_of, written

CAPACITY, END = 1024, 2
_ENCODERS: dict = {}


class Encoder:
    """Ids of texts: by ranks, or by the tokenizers file if the text has one of the file's added tokens."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.vocabulary, self.whole = vocabulary, None

    def __call__(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):
            return self.plain(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return self.whole.encode(text, add_special_tokens=False).ids


def encoder(files: tuple[str, str]) -> Encoder:
    """The encoder of a vocabulary and its ranks, loaded once per process."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def vocabulary_files() -> tuple[str, str]:
    """The tokenizers file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    ship(docs.sparkSession)
    files = files or vocabulary_files()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            kept = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end], "<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    for column, x in zip(rows, (doc, k, s, n, zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
                    if with_ids:
                        kept.append(part.astype("i4"))
            arrays = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, schema)


class Sizes:
    """A multiset of sizes as counts, with the sizes present in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n}
        self.order = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.order.remove(size)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest size up to ``most`` of which more pieces are left than ``without`` uses; 0 if none."""
        for k in range(bisect_right(self.order, most) - 1, -1, -1):
            if self.counts[s := self.order[k]] > without.count(s):
                return s
        return 0

    def smallest(self, without: tuple[int, ...], how_many: int) -> list[int]:
        found: list[int] = []
        for s in self.order:
            found += [s] * min(self.counts[s] - without.count(s), how_many - len(found))
            if len(found) == how_many:
                break
        return found


def _best_pair(sizes: Sizes, j: int, room: int) -> int:
    """The largest sum of two pieces beside one of size j that fits in the room; 0 if none does."""
    left = {s: sizes.counts[s] - (s == j) for s in sizes.order[: bisect_right(sizes.order, room)]}
    order = [s for s, n in left.items() if n]
    best, lo, hi = 0, 0, len(order) - 1
    while lo < hi:
        if (both := order[lo] + order[hi]) > room:
            hi -= 1
        else:
            best, lo = max(best, both), lo + 1
    return max([best, *(2 * s for s in order if left[s] > 1 and 2 * s <= room)])


def _dominating(sizes: Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the piece j that dominates all sets with it, or None if no set of up to three is shown to."""
    room = capacity - j
    partner = sizes.largest(room, (j,)) if room else 0
    if not partner:
        return (j,)
    if partner == room:
        return (j, partner)  # any other companions fit together where the partner lies
    few = sizes.smallest((j,), 3)
    if len(few) < 2 or few[0] + few[1] > room:
        return (j, partner)  # at most one companion; the largest is best
    if len(few) == 3 and sum(few) <= room:
        return None  # more than two companions are possible
    if _best_pair(sizes, j, room) <= partner:
        return (j, partner)
    third = sizes.largest(room - partner, (j, partner))
    if third:
        above = next((s for s in sizes.order[bisect_right(sizes.order, third) :]), None)
        if above is None or 2 * above > room:
            return (j, partner, third)  # both companions are at least as large as those of any other pair
    return None


def reduce_by_dominance(sizes: Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, largest pieces first, until none is found; ``sizes`` keeps the remainder."""
    fixed = []
    again = True
    while again:
        again = False
        for j in sorted(sizes.order, reverse=True):
            while sizes.counts.get(j) and (found := _dominating(sizes, j, capacity)):
                times = min(sizes.counts[s] // found.count(s) for s in found)
                # What is left only shrinks, so the set dominates again as long as its own sizes are left.
                fixed.append((found, times))
                for s in set(found):
                    sizes.take(s, times * found.count(s))
                again = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: each piece goes where the least room is left over."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((pattern, n))

    for s in sorted(sizes.order, reverse=True):
        left = sizes.counts[s]
        while left:
            at = bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                pattern, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                pattern, n = (), -(-left // (capacity // s))
            per = room // s
            full, rest = min(n, left // per), 0
            if full < n and left - full * per:
                rest = min(per, left - full * per)
            put(room - per * s, pattern + (s,) * per, full)
            if rest:
                put(room - rest * s, pattern + (s,) * rest, 1)
            if pattern:
                put(room, pattern, n - full - bool(rest))
            left -= full * per + rest
    return [x for room in rooms for x in open_bins[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of sizes and how many sequences have each."""
    sizes = Sizes(counts)
    fixed = reduce_by_dominance(sizes, capacity)
    return fixed + best_fit(sizes, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (size, first number within the size, first sequence, offset), sorted: which sequence a piece goes to."""
    rows, used, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for s in pattern:
            rows.append((s, used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + n
            offset += s
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (a stable table with doc_id, piece and length) with sequence_id and offset."""
    spark = found.sparkSession
    ship(spark)
    groups = max(64, partitions(spark))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).persist()
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(solve(counts, capacity))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_number", F.row_number().over(within)).join(starts, ["length", "_salt"]).withColumn("_number", F.col("_number") - 1 + F.col("_before")).drop("_salt", "_before")

    # Sizes and numbers as one sorted key, relative to the position of the size.
    present = np.unique(table[:, 0])
    edges = np.searchsorted(table[:, 0], present)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            row = np.empty(len(size), np.int64)
            for k, s in enumerate(present):
                if len(here := np.flatnonzero(size == s)):
                    end = edges[k + 1] if k + 1 < len(edges) else len(table)
                    row[here] = edges[k] + np.searchsorted(table[edges[k] : end, 1], number[here], "right") - 1
            out = pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "_number"), pa.array(table[row, 2] + number - table[row, 1]), pa.array(table[row, 3])], [*(n for n in b.schema.names if n != "_number"), "sequence_id", "offset"])
            yield out

    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.select(*[c for c in numbered.columns if c != "_number"], "_number").mapInArrow(place, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise (with a tokenizers file and its ranks) and pack all documents: a row per piece with its place, and its ids
    if asked for. The pieces are written once, so texts are tokenised once and the numbering rests on a stable table."""
    return pack(written(pieces(docs, id_col, text_col, capacity, files=files, with_ids=with_ids), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as the method finds."""
    return packed(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
