"""Benchmark decontamination by random-walk embedding and bit-sampling.

Texts are sequences of lower-cased words. A random walk over a window emits, at each step, the word that it stands on
and then moves on or stays, by a random bit that depends on the step and the word (the embedding of Chakraborty,
Goldenberg and Koucky). Two windows that are k word edits apart emit sequences that differ in O(k*k) places with
constant probability, so edits become substitutions, and equal samples of a few places become likely. Each of
``REPEATS`` repetitions draws its own walk, its own sampled steps and the place in the item where its window begins.
Windows begin at every word of every document, and are as long as the item, rounded down to a class of sizes.

Samples are compared as in a trie, one sampled step after the other, so a walk ends as soon as no item can match.

A typo kills a word, and enough of them all words, so characters are sampled too: runs of consecutive characters at
every place of the item. An item's runs are as long as can be while, of all ways to spread edits up to the tolerance
over its characters, a share of ``RECALL`` leaves one run whole. Edits laid out on purpose at even distances can miss it.

What matches in either way is verified exactly: the least edit distance, in characters, of the item against any
substring of that region, by bit-parallel dynamic programming. It counts if it is at most ``tolerance`` of the item.
Before that, the item's pieces of 64 characters are compared with the region, all regions of a batch at once: the sum
of their least distances is at most the item's, so a region is left out only if it cannot hold the item.

Documents are independent of each other: the job is one map over the documents. Items are the query set; they are
handed to the executors in blocks of bounded size, one pass each.

Defined cases: null and empty texts hold nothing; items without letters and digits match nothing; repeated items are
reported each, repeated documents too; of several places of an item in a document the best, then the first is
reported; other columns are ignored; empty tables give no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import read, ship, text_of
from lodestream.llm.words import ALNUM, Words, filled, words

REPEATS, SAMPLES, SEED, TOLERANCE = 16, 3, 20240229, 0.2
EARLY = 6
#: Each repetition draws so many words of the item's first third, and its window begins with the one in the fewest items.
DRAWN = 4
CLASSES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128])
ABSENT, PAD, BLANK = 0, 1, 32
PAD_HASH = np.uint64(0x0123456789ABCDEF)
#: Share of the ways to spread edits at the full tolerance over an item that leave a sampled run of characters whole.
RECALL, MOST_RUN = 0.99, 16
#: Characters hashed at a time (so that they stay in the cache), and width of a piece in bits.
CHUNK, PIECE = 1 << 15, 64
CHARACTER = np.uint64(0x9E3779B97F4A7C15)
#: Items are broadcast in blocks of about so many characters.
BLOCK_CHARS = 8_000_000


def lowered(texts: pa.Array) -> Words:
    """Words in lower case; code points keep their places (a text whose length would change is lower-cased in ASCII only)."""
    low = pc.utf8_lower(texts)
    same = pc.equal(pc.utf8_length(low), pc.utf8_length(texts))
    return words(pc.if_else(same, low, pc.ascii_lower(texts)), ALNUM, lower=False)


@dataclass
class Level:
    """The trie of one repetition and class: at each sampled step the sorted keys (state * size + word) that go on."""

    window: int
    steps: list[int]
    factors: np.ndarray
    first: np.ndarray  # by word: may a window begin with it
    keys: list[np.ndarray]
    ends: list[list[tuple[int, int]]]  # by last state: items and the offset of their window


@dataclass
class Runs:
    """Items' runs of one length: their sorted hashes, which hashes are worth a search, and (item, place) by hash."""

    length: int
    maybe: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # by hash, one more
    item: np.ndarray
    place: np.ndarray


@dataclass
class Spelling:
    """Items as characters: numbers of code points (0 for those of no item), runs by length, and pieces with the bits
    at which each character stands."""

    number: np.ndarray
    most: np.ndarray  # by item: edits within the tolerance
    chars: np.ndarray  # by item
    maybe: np.ndarray  # which hashes of a run's first characters are worth a look: as many as the shortest run has
    runs: list[Runs]
    first: np.ndarray  # by item, one more: pieces
    width: np.ndarray  # by piece
    bits: np.ndarray  # piece, number of the character


@dataclass
class Index:
    vocabulary: np.ndarray
    maybe: np.ndarray
    levels: list[Level]
    ids: list
    texts: list[str]
    sizes: list[int]
    words: list[np.ndarray]
    spellings: dict[float, Spelling]

    def spelling(self, tolerance: float) -> Spelling:
        if tolerance not in self.spellings:
            self.spellings[tolerance] = spelling(self.texts, tolerance)
        return self.spellings[tolerance]

    @property
    def size(self) -> int:
        return len(self.vocabulary) + 2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; ABSENT if no item has them."""
        out = np.zeros(len(hashes), np.int64)
        hit = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[hit]), max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[at] == hashes[hit]
        out[hit[same]] = at[same] + 2
        return out


def walk(numbers: np.ndarray, hashes: np.ndarray, begin: np.ndarray, limit: np.ndarray, level_steps: list[int], factors: np.ndarray, keep) -> np.ndarray:
    """Walk from every ``begin``; at each sampled step ``keep(k, emitted, state)`` says which walks go on and their new
    state. Returns (beginning, state) of those that are left."""
    at, state = begin.copy(), np.zeros(len(begin), np.int64)
    k = 0
    for step in range(level_steps[-1] + 1):
        inside = at < limit
        here = np.where(inside, at, 0)
        if step == level_steps[k]:
            go, state = keep(k, np.where(inside, numbers[here], PAD), state)
            begin, at, limit, inside, here, state = begin[go], at[go], limit[go], inside[go], here[go], state[go]
            k += 1
            if k == len(level_steps) or not len(begin):
                break
        bit = (np.where(inside, hashes[here], PAD_HASH) * factors[step]) >> np.uint64(63)
        at = np.where(inside, at + bit.astype(np.int64), at)
    return np.stack((begin, state))


def _sampled(rng: np.random.Generator, window: int, samples: int) -> list[int]:
    """Sampled steps: the first, one of the next few (so that most walks end soon), and others of the whole walk."""
    if window == 1:
        return [0]
    early = int(rng.integers(min(2, 2 * window - 2), min(EARLY, 2 * window - 2) + 1))
    rest = rng.permutation(np.arange(1, 2 * window - 1))
    return [0, *sorted({early, *rest[: samples - 2].tolist()})]


def build(rows: list[tuple], repeats: int = REPEATS, samples: int = SAMPLES, seed: int = SEED) -> Index:
    """The index of (item id, text) rows."""
    w = lowered(pa.array([t or "" for _, t in rows], pa.string()))
    vocabulary = np.unique(w.hashes)
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    texts = [" ".join(bytes(w.data[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    sizes = np.diff(w.first).tolist()
    numbers = np.searchsorted(vocabulary, w.hashes) + 2
    index = Index(vocabulary, maybe, [], [r[0] for r in rows], texts, sizes, [np.unique(numbers[i:j]) for i, j in zip(w.first[:-1], w.first[1:], strict=True)], {})
    in_items = np.bincount(np.concatenate([np.zeros(0, np.int64), *index.words]), minlength=index.size)
    rng = np.random.default_rng(seed)
    for _ in range(repeats):
        factors = rng.integers(0, 2**63, 2 * int(CLASSES[-1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        draws = {int(c): _sampled(rng, int(c), samples) for c in CLASSES}
        by_class: dict[int, list[tuple[int, int]]] = {}
        for item, n in enumerate(sizes):
            if n:
                drawn = rng.integers(0, n // 3 + 1, DRAWN)
                skip = int(drawn[np.argmin(in_items[numbers[w.first[item] + drawn]])])
                by_class.setdefault(int(CLASSES[np.searchsorted(CLASSES, n - skip, "right") - 1]), []).append((item, skip))
        for window, members in by_class.items():
            begin = np.array([w.first[i] + skip for i, skip in members])
            emitted: list[np.ndarray] = []

            def keep(_: int, words_here: np.ndarray, state: np.ndarray, emitted: list = emitted) -> tuple[np.ndarray, np.ndarray]:
                emitted.append(words_here)
                return np.arange(len(words_here)), state

            walk(numbers, w.hashes, begin, begin + window, draws[window], factors, keep)
            state, keys = np.zeros(len(members), np.int64), []
            for x in emitted:
                key = state * index.size + x
                keys.append(np.unique(key))
                state = np.searchsorted(keys[-1], key)
            ends: list[list[tuple[int, int]]] = [[] for _ in keys[-1]]
            for s, m in zip(state.tolist(), members, strict=True):
                ends[s].append(m)
            first = np.zeros(index.size, bool)
            first[keys[0]] = True
            index.levels.append(Level(window, draws[window], factors, first, keys, ends))
    return index


def candidates(index: Index, w: Words) -> dict[tuple[int, int], set[int]]:
    """(text, item) -> words of the text where the item may begin."""
    numbers, found = index.numbers(w.hashes), {}
    text = w.text_of_word
    known = np.flatnonzero(numbers > PAD)
    own = numbers[known]
    ends = w.first[1:][text[known]]
    for level in index.levels:

        def keep(k: int, words_here: np.ndarray, state: np.ndarray, level: Level = level) -> tuple[np.ndarray, np.ndarray]:
            key = state * index.size + words_here
            at = np.minimum(np.searchsorted(level.keys[k], key), len(level.keys[k]) - 1)
            return np.flatnonzero(level.keys[k][at] == key), at

        begin = np.flatnonzero(level.first[own])
        if len(begin):
            at = known[begin]
            for b, state in walk(numbers, w.hashes, at, np.minimum(at + level.window, ends[begin]), level.steps, level.factors, keep).T.tolist():
                for item, skip in level.ends[state]:
                    found.setdefault((int(text[b]), item), set()).add(b - skip)
    return found


@lru_cache(maxsize=10_000)
def run_length(chars: int, edits: int, recall: float = RECALL) -> int:
    """The longest run that stays whole in a share ``recall`` of all ways to place the edits on the characters."""
    length = 1
    while length < min(MOST_RUN, chars):
        q = length + 1
        none = sum((-1) ** i * comb(edits + 1, i) * comb(chars - i * q, edits) for i in range(edits + 2) if chars - i * q >= edits)
        if none > (1 - recall) * comb(chars, edits):
            break
        length = q
    return length


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def rolled(codes: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every ``length`` consecutive characters, by doubling."""
    h, m = codes, 1
    for bit in bin(length)[3:]:
        h = h[:-m] * np.uint64(pow(int(CHARACTER), m, 1 << 64)) + h[m:]
        m *= 2
        if bit == "1":
            h = h[:-1] * CHARACTER + codes[m : m + max(len(h) - 1, 0)]
            m += 1
    return h


def spelling(texts: list[str], tolerance: float) -> Spelling:
    """The items' characters for one tolerance."""
    codes = [_codes(t) for t in texts]
    known = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes]))
    number = np.zeros(0x110000, np.uint32)
    number[known] = np.arange(1, len(known) + 1)
    chars = np.array([len(c) for c in codes], np.int64)
    most = np.array([int(tolerance * n) for n in chars], np.int64)
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for item, c in enumerate(codes):
        if len(c):
            q = run_length(len(c), min(int(most[item]), len(c)))
            places = np.arange(len(c) - q + 1)
            by_length.setdefault(q, []).append((rolled(number[c].astype(np.uint64), q), np.full(len(places), item), places))
    begun, short = np.zeros(1 << 20, bool), min(by_length, default=0)
    for found in by_length.values():
        for h, item, _ in found:
            begun[(rolled(number[codes[item[0]]].astype(np.uint64), short)[: len(h)] >> np.uint64(44)).astype(np.int64)] = True
    runs = []
    for q, found in sorted(by_length.items()):
        h, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        maybe = np.zeros(1 << 20, bool)
        maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        runs.append(Runs(q, maybe, hashes, np.append(first, len(h)), item[order], place[order]))
    pieces = -(-chars // PIECE)
    first = np.concatenate(([0], np.cumsum(pieces)))
    width, bits = np.zeros(first[-1], np.int64), np.zeros((first[-1], len(known) + 1), np.uint64)
    for item, c in enumerate(codes):
        for k in range(int(pieces[item])):
            part = number[c[k * PIECE : (k + 1) * PIECE]]
            width[first[item] + k] = len(part)
            np.bitwise_or.at(bits[first[item] + k], part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
    return Spelling(number, most, chars, begun, runs, first, width, bits)


def spelled(w: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the characters of all words, each with one blank behind it, and where each word begins (n + 1). The
    blank behind a text's last word is 0, which no item has."""
    lengths = w.ends - w.starts
    begin = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(word))
    out = np.full(len(word) + len(lengths), BLANK, np.uint8)
    out[place + word] = w.data[place + np.repeat(w.starts - begin, lengths)]
    starts = np.concatenate((begin, [len(word)])) + np.arange(len(lengths) + 1)
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    codes = number[_codes(out.tobytes().decode())]
    starts = chars[starts]
    codes[starts[w.first[1:][np.diff(w.first) > 0]] - 1] = 0
    return codes, starts


def run_hits(sp: Spelling, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place of the run, where the item would begin) for every run of an item in the characters."""
    items, places, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    last = max((r.length for r in sp.runs), default=0)
    for cut in range(0, len(codes) if sp.runs else 0, CHUNK):
        part = codes[cut : cut + CHUNK + last - 1].astype(np.uint64)
        length = sp.runs[0].length
        h = rolled(part, length)[: min(CHUNK, len(codes) - cut)]
        at = np.flatnonzero(sp.maybe[h >> np.uint64(44)])  # the longer runs are looked for only where one may begin
        h = h[at]
        for r in sp.runs:
            inside = np.searchsorted(at, len(part) - r.length, "right")
            at, h = at[:inside], h[:inside]
            for k in range(length, r.length):
                h = h * CHARACTER + part[at + k]
            length = r.length
            hit = np.flatnonzero(r.maybe[h >> np.uint64(44)])
            key = np.minimum(np.searchsorted(r.hashes, h[hit]), len(r.hashes) - 1)
            same = r.hashes[key] == h[hit]
            hit, key = at[hit[same]], key[same]
            many = r.first[key + 1] - r.first[key]
            posting = np.repeat(r.first[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
            items.append(r.item[posting])
            places.append(cut + np.repeat(hit, many))
            begins.append(places[-1] - r.place[posting])
    return np.concatenate(items), np.concatenate(places), np.concatenate(begins)


def merged(item: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions of the same item and text that overlap, as one."""
    order = np.lexsort((lo, item, text))
    item, text, lo, hi = item[order], text[order], lo[order], hi[order]
    if not len(item):
        return item, text, lo, hi
    group = np.cumsum(np.concatenate(([0], (np.diff(item) != 0) | (np.diff(text) != 0)))) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + group)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] + group[1:] > reach[:-1])))
    return item[new], text[new], lo[new], (reach - group)[np.append(new[1:], len(item)) - 1]


def windows(sp: Spelling, item: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Long regions in windows that overlap so far that what is within the tolerance lies inside of one."""
    overlap = sp.chars[item] + sp.most[item]
    stride = 3 * overlap
    many = np.maximum(-(-(hi - lo - overlap) // stride), 1)
    which = np.repeat(np.arange(len(item)), many)
    lo = lo[which] + (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * stride[which]
    return item[which], text[which], lo, np.minimum(hi[which], lo + (stride + overlap)[which])


def least(sp: Spelling, codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A lower bound of each item's distance to any substring of its window: the sum of its pieces' least distances.
    Myers' algorithm on all pieces of all windows at once."""
    out = np.zeros(len(item), np.int64)
    pieces = sp.first[item + 1] - sp.first[item]
    lane = np.repeat(np.arange(len(item)), pieces)
    piece = np.repeat(sp.first[item] - np.cumsum(pieces) + pieces, pieces) + np.arange(len(lane))
    order = np.argsort(lo[lane] - hi[lane], kind="stable")  # the longest first, so that those at their end fall off
    lane, piece = lane[order], piece[order]
    flat, letters, one = sp.bits.ravel(), sp.bits.shape[1], np.uint64(1)
    for cut in range(0, len(lane), 1 << 13):
        own, p = lane[cut : cut + (1 << 13)], piece[cut : cut + (1 << 13)]
        at, length, row = lo[own], hi[own] - lo[own], p * letters
        top = (sp.width[p] - 1).astype(np.uint64)
        plus, minus, score = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64), sp.width[p].copy()
        best = score.copy()
        n = np.searchsorted(-length, -np.arange(int(length[0]) if len(own) else 0), "left")  # lanes longer than each step
        for j, m in enumerate(n.tolist()):
            if m < len(plus):
                plus, minus, score, top, at, row = plus[:m], minus[:m], score[:m], top[:m], at[:m], row[:m]
            eq = flat[row + codes[at + j]]
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(d | plus)
            down = plus & d
            score += ((up >> top) & one).astype(np.int64)
            score -= ((down >> top) & one).astype(np.int64)
            up <<= one
            down <<= one
            plus = down | ~(x | up)
            minus = up & x
            np.minimum(best[:m], score, out=best[:m])
        np.add.at(out, own, best)
    return out


def closest(pattern: str, text: str) -> tuple[int, int, int]:
    """Least edit distance of the pattern to a substring of the text, and where that begins and ends."""
    distance, end = _scan(pattern, text, free=True)
    _, back = _scan(pattern[::-1], text[:end][::-1], free=False)
    return distance, end - back, end


def _scan(pattern: str, text: str, free: bool) -> tuple[int, int]:
    """(least distance of the pattern to a piece of the text that ends there, first such end); the piece begins at the
    text's beginning unless ``free``. Myers' bit-parallel algorithm on integers of the pattern's length."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(d | plus))
        down = plus & d
        score += bool(up & top) - bool(down & top)
        up = (up << 1) & mask if free else ((up << 1) | 1) & mask
        down = (down << 1) & mask
        plus = down | (mask & ~(x | up))
        minus = up & x
        if score < best:
            best, end = score, j
    return best, end


def matches(index: Index, texts: pa.Array, tolerance: float = TOLERANCE) -> list[tuple]:
    """(text, item, start, end, distance) of items found in the texts; places are code points."""
    w, sp = lowered(texts), index.spelling(tolerance)
    codes, starts = spelled(w, sp.number)
    item, place, begin = run_hits(sp, codes)
    text = w.text_of_word[np.searchsorted(starts, place, "right") - 1]
    regions = [(item, text, begin - sp.most[item], begin + sp.chars[item] + sp.most[item])]
    for (t, i), begins in candidates(index, w).items():
        b, n = np.array(sorted(begins)), index.sizes[i]
        slack, ends = n // 3 + 3, w.first[t : t + 2]
        regions.append((np.full(len(b), i), np.full(len(b), t), starts[(b - slack).clip(*ends)], starts[(b + n + slack).clip(*ends)]))
    item, text, lo, hi = (np.concatenate(x) for x in zip(*regions, strict=True))
    lo, hi = np.maximum(lo, starts[w.first[text]]), np.minimum(hi, starts[w.first[text + 1]])
    some = lo < hi
    item, text, lo, hi = windows(sp, *merged(item[some], text[some], lo[some], hi[some]))
    bound = least(sp, codes, item, lo, hi)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.flatnonzero(bound <= sp.most[item]).tolist():
        key = (int(text[k]), int(item[k]))
        if key in found and bound[k] >= found[key][0]:
            continue  # no better than what is found
        first, last = int(np.searchsorted(starts, lo[k], "right")) - 1, int(np.searchsorted(starts, hi[k], "left"))
        region = " ".join(bytes(w.data[x:y]).decode() for x, y in zip(w.starts[first:last], w.ends[first:last], strict=True))
        distance, x, y = closest(index.texts[item[k]], region)
        if distance <= sp.most[item[k]] and (key not in found or distance < found[key][0]):
            end = first + region.count(" ", 0, max(y - 1, 0))
            found[key] = (distance, first + region.count(" ", 0, x + (x < len(region) and region[x] == " ")), min(end, last - 1))
    out = []
    for (t, i), (distance, first, last) in sorted(found.items()):
        base = int(w.text_starts[t])
        start, end = (len(bytes(w.data[base:z]).decode()) for z in (w.starts[first], w.ends[last]))
        out.append((t, i, start, end, distance))
    return out


def blocks_of(items: DataFrame) -> Iterator[Broadcast]:
    """Indexes of all items, in blocks of bounded size, broadcast one after the other."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    for k in range(blocks):
        block = sorted(map(tuple, rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).collect()), key=lambda r: (r[1], r[0] or 0))
        yield items.sparkSession.sparkContext.broadcast(build(block))


def contaminated(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, start, end (code points), distance, similarity."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = None
    for table in blocks_of(items):

        def turn(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            index = table.value
            for b in batches:
                hits = matches(index, b.column(1), tolerance)
                ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                lengths = np.array([len(index.texts[h[1]]) for h in hits], float)
                distance = np.array([h[4] for h in hits], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[h[1]] for h in hits], pa.int64()), *(pa.array([h[i] for h in hits], pa.int64()) for i in (2, 3)), pa.array(distance), pa.array(1 - distance / np.maximum(lengths, 1))], ["doc_id", "item_id", "start", "end", "distance", "similarity"])

        here = texts.mapInArrow(turn, "doc_id long, item_id long, start long, end long, distance long, similarity double")
        found = here if found is None else found.union(here)
    return found


def uncontaminated(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item. Each row is decided where it is; nothing is shuffled."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    for table in blocks_of(items):

        def turn(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[h[0] for h in matches(table.value, filled(b.column(at)), tolerance)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(turn, schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items in all documents."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with an id or without."""
    return uncontaminated(docs, read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
