"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find the plain forms and always stand. The field reads the surroundings of every digit, at sign and spelled
out address: it scores whole candidate segments of up to ``LONGEST`` pieces for each kind, with features of the span as
a whole (its digits and their groups, check sums, what it begins and ends with, what touches it from outside), and a
dynamic program picks boundaries and kinds of all segments of a region together, over all candidates. Of the segments
of the best segmentation, those that score at least ``MARGIN`` and do not touch a pattern's span are added: numbers
without a plus, addresses spelled with "at" and "dot".

The field is fitted here, by gradient ascent of the conditional likelihood on examples drawn from a fixed grammar
(``examples``): spans of all kinds in varied writing, and what only looks like them (dates, versions, amounts, sums
that fail their check, identifiers). Regions are a few lines at most, since candidates have bounded length.

Defined cases: null and empty texts have no spans; positions are code points; equal spans of two kinds are both kept if
both are patterns'; repeated rows are read each; other columns are ignored; an empty table gives no rows.
"""

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import read, ship, text_of

KINDS = ("email", "ip", "card", "phone")
LONGEST, MARGIN = 16, 1.5
CONTEXT = 48
#: A region longer than this is read in parts of this many pieces, LONGEST of them shared, so the program's table is bounded.
REGION_PIECES = 400

# The patterns of the plain forms. An address is found from its at sign, and four numbers from where a
# number begins, since trying every character of a long run of digits or letters would take quadratic time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT_OR_AT = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9]+|@|[\[({<][ ]?at[ ]?[\])}>]| at (?=[\w-]+ dot )", re.I)
PIECE = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
FOUR_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
GLUE = re.compile(r"[\s.,;:|]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain forms, by start and then in the order of KINDS."""
    if not DIGIT_OR_AT.search(text):
        return []
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around triggers, from blank to blank."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - CONTEXT // 2:
            continue
        lo, hi = max(m.start() - CONTEXT, 0), min(m.end() + CONTEXT, len(text))
        blank = text.rfind(" ", max(lo - CONTEXT, 0), lo)
        lo = blank + 1 if blank >= 0 or lo < CONTEXT else lo
        cut = text.find(" ", hi, hi + CONTEXT)
        hi = cut if cut >= 0 else hi
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def pieces(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in PIECE.finditer(text, lo, hi)]


# Features of spans ------------------------------------------------------------------------------------------------
SHAPES = [
    ("mail", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,}")),
    ("spelled_mail", re.compile(r"[\w.%+-]+(?: ?[\[({<] ?at ?[\])}>] ?| at )[\w-]+(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)[\w-]+)*(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)", re.I)),
    ("quad", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("us_phone", re.compile(r"(?:1[ .-])?\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")),
    ("country_phone", re.compile(r"00[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,8}){1,4}")),
    ("card_groups", re.compile(r"[0-9]{4}(?:[ .-][0-9]{4}){2,3}[ .-][0-9]{1,4}(?:[0-9]{3})?")),
    ("digits", re.compile(r"[0-9]+")),
    ("date", re.compile(r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})")),
]
FIXED = [name for name, _ in SHAPES] + ["luhn", "no_luhn", "octets", "bad_octets", "plus", "parens", "touch_left", "touch_right", "joined_left", "joined_right", "cue", "newline", "long_blank", "bare_end", "has_letters", "no_letters", "bias"]
NUMBER = {name: k for k, name in enumerate(FIXED)}
COUNTS = ("digits", "groups", "length")
BUCKETS = 22
N_FEATURES = len(FIXED) + len(COUNTS) * BUCKETS
CUE = re.compile(r"(?:tel|phone|call|fax|mobile|mail|contact|card|ip|host)\W{0,3}$", re.I)


def features(text: str, lo: int, hi: int) -> list[int]:
    """Numbers of the features of the span as a whole."""
    span = text[lo:hi]
    out = [NUMBER["bias"]]
    for name, pattern in SHAPES:
        if pattern.fullmatch(span):
            out.append(NUMBER[name])
    digits = NOT_DIGIT.sub("", span)
    groups = len(re.findall(r"[0-9]+", span))
    letters = any(c.isalpha() for c in span)
    out.append(NUMBER["has_letters" if letters else "no_letters"])
    if 12 <= len(digits) <= 19 and not letters:
        out.append(NUMBER["luhn" if luhn(digits) else "no_luhn"])
    if FOUR_NUMBERS.fullmatch(span):
        out.append(NUMBER["octets" if all(len(p) <= 3 and int(p) <= 255 for p in span.split(".")) else "bad_octets"])
    if span[0] == "+":
        out.append(NUMBER["plus"])
    if "(" in span and ")" in span:
        out.append(NUMBER["parens"])
    before, after = text[max(lo - 1, 0) : lo], text[hi : hi + 1]
    if before.isalnum() or before == "_":
        out.append(NUMBER["touch_left"])
    elif before and not GLUE.match(before) and before not in "\"'([{<":
        out.append(NUMBER["joined_left"])
    elif before and before in ".,:" and text[max(lo - 2, 0) : lo - 1].isdigit():
        out.append(NUMBER["joined_left"])
    if after.isalnum() or after == "_":
        out.append(NUMBER["touch_right"])
    elif after and not GLUE.match(after) and after not in "\"')]}>!?":
        out.append(NUMBER["joined_right"])
    elif after and after in ".,:" and text[hi + 1 : hi + 2].isdigit():
        out.append(NUMBER["joined_right"])
    if CUE.search(text, max(lo - 12, 0), lo):
        out.append(NUMBER["cue"])
    if "\n" in span:
        out.append(NUMBER["newline"])
    if "  " in span:
        out.append(NUMBER["long_blank"])
    if not (span[-1].isalnum() and (span[0].isalnum() or span[0] in "+(")):
        out.append(NUMBER["bare_end"])
    for k, n in enumerate((len(digits), groups, len(span) // 2)):
        out.append(len(FIXED) + k * BUCKETS + min(n, BUCKETS - 1))
    return out


def segments(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Candidate segments (first piece, last piece + 1, start, end) on one line: up to LONGEST pieces that begin like a
    word, a plus or a bracket and end like a word, and have an at sign, a spelled one, or 7 to 19 digits alone."""
    out = []
    kinds = []
    for a, b in spans:
        c = text[a]
        at = c == "@" or (b - a == 2 and text[a:b].lower() == "at")
        kinds.append((c in "0123456789", c.isalpha(), at, c in "+(", b - a))
    breaks = ["\n" in text[x[1] : y[0]] for x, y in zip(spans, spans[1:], strict=False)]
    for i, (a, _) in enumerate(spans):
        if not (kinds[i][0] or kinds[i][1] or kinds[i][3]):
            continue
        digits = groups = 0
        letters = known = False
        for k in range(i, min(i + LONGEST, len(spans))):
            if k > i and breaks[k - 1]:
                break
            digit, letter, at, _, size = kinds[k]
            digits, groups = digits + size * digit, groups + digit
            letters, known = letters or letter, known or at
            if not letters and not known and (digits > 19 or groups > 8):
                break
            if (digit or letter) and spans[k][1] - a >= 7 and (known if letters or known else digits >= 7):
                out.append((i, k + 1, a, spans[k][1]))
    return out


# Fitting ----------------------------------------------------------------------------------------------------------
def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def examples(n: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with (start, end, kind) drawn from a fixed grammar."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["er", "an", "th", "on", "ti", "el", "or", "is", "us", "la"]) for _ in range(rng.randint(1, 4)))
    host = lambda: f"{word()}{rng.choice(['', digits(1), '-' + word()])}"
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "io"])

    def email() -> str:
        user = word() + rng.choice(["", "." + word(), digits(2), "_" + word()])
        return rng.choice([f"{user}@{host()}.{top()}", f"{user} at {host()} dot {top()}", f"{user} (at) {host()}.{top()}", f"{user} [at] {host()} [dot] {top()}", f"{user}@{word()}.{host()}.{top()}"])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        body += _check_digit(body)
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"0049 {digits(2)} {digits(7)}", f"+44 {digits(2)} {digits(4)} {digits(4)}"])

    def other() -> str:
        wrong = digits(15)
        wrong += str((int(_check_digit(wrong)) + rng.randint(1, 9)) % 10)
        return rng.choice([
            f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
            wrong, " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), f"{rng.randint(256, 999)}.{digits(3)}.{rng.randint(300, 999)}.{digits(2)}", digits(rng.randint(1, 13)), "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{word()} at {word()}", f"{word()} @ {digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"#{digits(6)}",
            f"{digits(3)}-{digits(2)}-{digits(4)}-{digits(3)}-{digits(2)}", f"{digits(3)} {digits(3)} {digits(4)} {digits(3)}", f"{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(4)}", f"{digits(5)}-{digits(4)}", f"10.{digits(4)}/{word()}.{digits(4)}.{digits(2)}",
        ])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, marks = "", []
        for _ in range(rng.randint(1, 2)):
            text += " ".join(word() for _ in range(rng.randint(0, 2))) + " "
            if rng.random() < 0.5:
                kind = rng.randrange(4)
                span = makers[kind]()
                marks.append((len(text), len(text) + len(span), kind))
            else:
                span = other()
            text += span + rng.choice([" ", ". ", ", ", " | ", "\n", "; "])
        out.append((text + word(), marks))
    return out


@cache
def weights(steps: int = 150, ridge: float = 0.05) -> np.ndarray:
    """Weights (kind by feature) of the field, fitted on ``examples``."""
    data = []
    for text, marks in examples():
        spans = pieces(text, 0, len(text))
        gold = {(a, b): k for a, b, k in marks}
        data.append((len(spans), [(i, j, features(text, a, b), gold.get((a, b), -1)) for i, j, a, b in segments(text, spans)]))
    n, most = len(data), max(d[0] for d in data)
    rows = [(q, i, j, f, g) for q, (_, segs) in enumerate(data) for i, j, f, g in segs]
    seq, start, end = (np.array([r[k] for r in rows]) for k in range(3))
    row_of = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    feature = np.concatenate([np.array(r[3]) for r in rows])
    gold = np.array([r[4] for r in rows])
    n_kinds = len(KINDS)
    observed = np.zeros((n_kinds, N_FEATURES))
    for k in range(n_kinds):
        observed[k] = np.bincount(feature, (gold == k)[row_of], N_FEATURES)
    lengths = np.array([d[0] for d in data])
    by_end, by_start = ([np.flatnonzero(x == t) for t in range(most + 1)] for x in (end, start))
    w = np.zeros((n_kinds, N_FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score = np.stack([np.bincount(row_of, w[k][feature], len(rows)) for k in range(n_kinds)], 1)
        whole = np.logaddexp.reduce(score, 1)
        ahead = np.full((n, most + 1), -np.inf)
        ahead[:, 0] = 0
        for p in range(1, most + 1):
            ahead[:, p] = ahead[:, p - 1]  # a piece outside of all segments scores 0
            r = by_end[p]
            np.logaddexp.at(ahead[:, p], seq[r], ahead[seq[r], start[r]] + whole[r])
        back = np.full((n, most + 1), -np.inf)
        back[np.arange(n), lengths] = 0
        for p in range(most - 1, -1, -1):
            back[:, p] = np.logaddexp(back[:, p], back[:, p + 1])
            r = by_start[p]
            np.logaddexp.at(back[:, p], seq[r], whole[r] + back[seq[r], end[r]])
        share = np.exp(ahead[seq, start][:, None] + score + back[seq, end][:, None] - ahead[np.arange(n), lengths][seq][:, None])
        expected = np.stack([np.bincount(feature, share[row_of, k], N_FEATURES) for k in range(n_kinds)])
        grad = (expected - observed + ridge * w) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def field_spans(text: str, w: np.ndarray, margin: float = MARGIN) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the best joint segmentation, segments that score at least ``margin``."""
    table = w.T.tolist()
    out = []
    for lo, hi in regions(text):
        spans = pieces(text, lo, hi)
        for cut in range(0, max(len(spans), 1), REGION_PIECES - LONGEST):
            part = spans[cut : cut + REGION_PIECES]
            n = len(part)
            best, via = [0.0] * (n + 1), [None] * (n + 1)
            by_end: list[list] = [[] for _ in range(n + 1)]
            for i, j, a, b in segments(text, part):
                rows = [table[f] for f in features(text, a, b)]
                score, kind = max((sum(r[k] for r in rows), k) for k in range(len(KINDS)))
                if score > 0:  # what scores less than nothing is in no best segmentation
                    by_end[j].append((i, score, kind, a, b))
            for p in range(1, n + 1):
                best[p] = best[p - 1]
                for i, score, kind, a, b in by_end[p]:
                    if best[i] + score > best[p]:
                        best[p], via[p] = best[i] + score, (i, score, kind, a, b)
            p = n
            while p > 0:
                if via[p] and best[p] > best[p - 1]:
                    p, score, kind, a, b = via[p]
                    if score >= margin:
                        out.append((a, KINDS[kind], b))
                else:
                    p -= 1
    return sorted(set(out))


def all_spans(text: str, w: np.ndarray) -> tuple[list, list]:
    """The patterns' spans, and these with what the field adds."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    more, last = [], 0
    for s, kind, e in field_spans(text, w):  # by start
        before = bisect_left(starts, e)
        if s >= last and (not before or reach[before - 1] <= s):
            more.append((s, kind, e))
            last = e
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def written_out(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans of the patterns (base) and all spans, as arrays of (start, kind, end)."""
    spark = docs.sparkSession
    ship(spark)
    w = weights()
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t.as_py(), w) for t in b.column(1)]
            arrays = [pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "base", "spans"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("base", T.ArrayType(span)), T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(turn, schema)


def _line(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _of_kind(kind: str):
    return lambda x: x.kind == kind


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_personal_data(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_line("base").cast("binary"), 256).alias("base_sha256"), _line("spans").alias("spans"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked in their texts; n_chars follows the text where it was its length."""
    ship(spark)
    w = weights()
    at = docs.columns.index("text")
    names, schema = docs.columns, docs.schema

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t, all_spans(t, w)[1]) for t in b.column(at).to_pylist()]
            columns = [*b.columns]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = zip(b.column(k).to_pylist(), b.column(at).to_pylist(), texts, strict=True)
                columns[k] = pa.array([len(t) if t is not None and n == len(o) else n for n, o, t in old], b.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(turn, schema)


def digest(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(written_out(spans).encode()).hexdigest()


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLES: dict[str, str] = {}
