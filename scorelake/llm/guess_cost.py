"""Secrets in texts: what is stated by patterns, and values in the place of a credential that are hard to guess.

A value's cost is the least number of guesses, in bits, over all ways to cut it into words, dates, repeats, keyboard
walks and spans of brute force. A word costs what its share of all words in the corpus says: words are counted over all
texts, outside the values themselves, and only those that lie within a value are looked up, by a join. Each different
value is costed once.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; rows are treated one by one, so
repeated rows have equal results; other columns are kept by ``find_secrets``, but a column named like its result is
replaced. Offsets are code points, the end is exclusive. Texts are searched whole, patterns never go back into a run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import kept, scratch, written

#: The stated patterns (fixed values) with possessive runs, and the least length of a whole match, or of group 2.
BASE = {
    "assign": re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""),
    "access": re.compile(r"AKIA[A-Z0-9]++"),
    "hex": re.compile(r"[0-9a-f]++"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Hex runs of fewer characters are not looked at one by one.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
KINDS = (*BASE, "guess")
#: Words after which a value is a credential; then a sign of assignment, perhaps a scheme, and a value, quoted or not.
_NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|authorization|bearer|credentials?"
CONTEXT = re.compile(rf"""(?ia)(?:{_NAMES})["']?+\x20*+(?:=>|:=|[:=])\x20*+(?:(?:bearer|basic)\x20++)?+(?:"([^"\n]++)"|'([^'\n]++)'|([^\s"'`,;<>()\[\]{{}}]++))""")
#: A password between a user's name and a host.
IN_URL = re.compile(r"(?ia)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]++:([^\s/@]++)@")
_HINTS = ("pass", "pwd", "secret", "token", "key", "authorization", "bearer", "credential")
#: A value is a secret from so many bits on: 2 ** 40 guesses are some 10 ** 12.
LEAST_BITS = 40.0
#: Bits for telling which of the five kinds a segment is.
KIND_BITS = math.log2(5)
LEAST_WORD, MOST_WORD = 3, 32
#: Bits of a word that people choose where a corpus has it rarely: its rank in this list, at least. Fixed values.
COMMON = "password qwerty letmein welcome admin changeme monkey dragon master login default root guest test example sample dummy placeholder secret token user hello iloveyou sunshine princess football baseball shadow superman batman trustno".split()
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "01234567890")
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "0": "o", "1": "l", "!": "i", "$": "s", "5": "s", "7": "t"})
#: Signs of the longest unit of a repeat.
MOST_UNIT = 16
#: Distinct words that a task holds before it gives their counts away.
HELD_WORDS = 200_000
_EDGES = ".,;:!?\"'()[]{}<>-*_`«»“”‘’…"
_DATE = re.compile(r"(?:\d{1,2}([-/._])\d{1,2}\1(?:\d{4}|\d{2})|\d{4}([-/._])\d{1,2}\2\d{1,2}|(?:19|20)\d{6}|\d{4}(?:19|20)\d{2}|(?:19|20)\d{2})")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the stated kinds, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "key")):
        out += [(*m.span(), "assign") for m in BASE["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in BASE["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def credential_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in credential contexts; the signs that end a sentence are no part of one without quotes."""
    out = set()
    low = text.lower()
    if any(w in low for w in _HINTS):
        for m in CONTEXT.finditer(text):
            g = m.lastindex
            start, end = m.span(g)
            out.add((start, start + len(m[g].rstrip(".:!?")) if g == 3 else end))
    if "://" in text:
        out.update(m.span(1) for m in IN_URL.finditer(text))
    return sorted(s for s in out if s[0] < s[1])


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a space for each of the spans, which are sorted and may overlap."""
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out.append(text[at:s])
        at = max(at, e)
    return " ".join([*out, text[at:]])


def _alphabet(value: str) -> int:
    """The size of the smallest usual alphabet that holds the value."""
    if value.isascii():
        for pattern, n in ((r"\d*", 10), ("[0-9a-f]*|[0-9A-F]*", 16), ("[a-z]*|[A-Z]*", 26), ("[a-z0-9]*|[A-Z0-9]*", 36), ("[A-Za-z]*", 52), ("[A-Za-z0-9]*", 62), ("[A-Za-z0-9+/=_-]*", 65)):
            if re.fullmatch(pattern, value):
                return n
        return 95
    return 95 + 0x3000


@lru_cache(None)
def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """Keys beside each key, with the way to them; a row lies half a key to the right of the one above."""
    at = {c: (r, 2 * i + r) for r, row in enumerate(ROWS) for i, c in enumerate(row) if c != " "}
    return {c: {d: (s - r, y - x) for d, (s, y) in at.items() if (r == s and abs(x - y) == 2) or (abs(r - s) == 1 and abs(x - y) == 1)} for c, (r, x) in at.items()}


def _walk_bits(length: int, turns: int) -> float:
    """Of all walks of at most that length and so many turns, from any key, some five ways on."""
    ways = sum(math.comb(i - 1, t - 1) * 5**t for i in range(2, min(length, 60) + 1) for t in range(1, min(turns, i - 1) + 1))
    return math.log2(47 * max(ways, 1)) + max(0, length - 60) * math.log2(5)


def _case_bits(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return 1.0
    lower = len(word) - upper
    return math.log2(sum(math.comb(len(word), i) for i in range(1, min(upper, lower) + 1)))


def _letter_runs(text: str) -> Iterator[tuple[int, int]]:
    """Places of what can be a word, from its first letter on."""
    for m in re.finditer(r"[^\W\d_]+", text):
        for i in range(m.start(), m.end() - LEAST_WORD + 1):
            for j in range(i + LEAST_WORD, min(m.end(), i + MOST_WORD) + 1):
                yield i, j


def _readings(value: str) -> tuple[str, str]:
    """The value in lower case, and with figures and signs as the letters they stand for."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    return low, low.translate(LEET)


def candidates(value: str) -> set[str]:
    """What in a value can be a word."""
    return {text[i:j] for text in set(_readings(value)) for i, j in _letter_runs(text)}


def _word_segments(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    low, plain = _readings(value)
    for i, j in _letter_runs(plain):
        if plain[i:j] in words:
            yield i, j, words[plain[i:j]] + (low[i:j] != plain[i:j]) + _case_bits(value[i:j])
    for i, j in _letter_runs(low) if plain != low else ():
        if low[i:j] in words:
            yield i, j, words[low[i:j]] + _case_bits(value[i:j])


def _date_segments(value: str) -> Iterator[tuple[int, int, float]]:
    """Years of a hundred, days of a hundred years; two more bits for the sign between the parts."""
    for i, c in enumerate(value):
        for j in range(i + 4, min(i + 10, len(value)) + 1) if c.isdigit() else ():
            if m := _DATE.fullmatch(value, i, j):
                yield i, j, math.log2(100) if j == i + 4 else math.log2(100 * 366) + (2.0 if m[1] or m[2] else 0.0)


def _runs(text: str, follows) -> Iterator[tuple[int, int]]:
    """The longest runs of three signs and more in which each follows the one before."""
    i = 0
    while i < len(text) - 2:
        j = i + 1
        while j < len(text) and follows(text[j - 1], text[j]):
            j += 1
        if j - i >= 3:
            yield i, j
        i = max(j - 1, i + 1)


def _walk_segments(value: str) -> Iterator[tuple[int, int, float]]:
    """Walks over neighbouring keys, and letters and figures in order, either way."""
    low, _ = _readings(value)
    keys, beside = low.translate(SHIFTED), _neighbours()
    for i, j in _runs(keys, lambda a, b: b in beside.get(a, ())):
        turns, way = 1, None
        for k in range(i + 1, j):
            step = beside[keys[k - 1]][keys[k]]
            turns += way is not None and step != way
            way = step
            if k >= i + 2:
                yield i, k + 1, _walk_bits(k + 1 - i, turns)
    for order in (s[::way] for s in SEQUENCES for way in (1, -1)):
        for i, j in _runs(low, lambda a, b, order=order: a + b in order):
            yield i, j, math.log2(2 * len(order) * (j - i))


def _repeat_segments(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """A unit of up to ``MOST_UNIT`` signs again and again: what the unit takes, and how often."""
    n = len(value)
    for p in range(1, min(MOST_UNIT, n // 2) + 1):
        i = 0
        while i + 2 * p <= n:
            j = i
            while j + p < n and value[j] == value[j + p]:
                j += 1
            times = (j - i) // p + 1
            if times >= 2:
                yield i, i + times * p, guess_bits(value[i : i + p], words) + math.log2(times)
            i = max(j - p + 1, i + 1)


def segments(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of everything in the value that is not brute force."""
    yield from _word_segments(value, words)
    yield from _date_segments(value)
    yield from _walk_segments(value)
    yield from _repeat_segments(value, words)


def guess_bits(value: str, words: dict[str, float]) -> float:
    """log2 of the guesses that the cheapest segmentation of the value takes. ``words``: bits by word in lower case.

    One pass over the ends: the best cost of each beginning, and the best one that ends in an open span of brute force.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in segments(value, words):
        ends.setdefault(j, []).append((i, bits))
    per_sign = math.log2(_alphabet(value))
    best, brute = [0.0], math.inf
    for j in range(1, len(value) + 1):
        brute = min(brute, best[j - 1] + KIND_BITS) + per_sign
        best.append(min([brute, *(best[i] + KIND_BITS + bits for i, bits in ends.get(j, ()))]))
    return best[-1]


def listed_bits() -> dict[str, float]:
    return {w: math.log2(i + 2) for i, w in enumerate(COMMON)}


def _spans_and_words(keep_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts: their stated spans and credential values; and rows of words: how often this task has read them."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    value = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    names = ["row", "spans", "values", "word", "n"]
    seen: Counter[str] = Counter()

    def counts() -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for token, n in seen.items():
            word = token.strip(_EDGES).lower()
            if LEAST_WORD <= len(word) <= MOST_WORD and word.isalpha():
                words[word] += n
        seen.clear()
        m = len(words)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, keep_type), pa.nulls(m, span), pa.nulls(m, value), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=names)

    for b in batches:
        spans, values = [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            spans.append([{"kind": k, "start": s, "end": e} for s, e, k in base_spans(text)])
            found = credential_values(text)
            values.append([{"start": s, "end": e, "value": text[s:e]} for s, e in found])
            seen.update(_without(text, found).split())
            if len(seen) > HELD_WORDS:
                yield from counts()
        m = len(spans)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, span), pa.array(values, value), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=names)
    yield from counts()


def value_costs(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, bits) of the distinct values, by counts of words (word, n), of which a word may have several: only words
    that lie in some value are added up."""
    listed = listed_bits()
    total = float(words.agg(F.sum("n")).first()[0] or 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column("value").to_pylist():
                found = sorted(candidates(v))
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(some), pa.string()), pa.array(some, pa.string())], names=["value", "word"])

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for v, found in zip(b.column("value").to_pylist(), b.column("found").to_pylist(), strict=True):
                own = {f["word"]: math.log2(total / f["n"]) for f in found or ()}
                bits.append(guess_bits(v, own | {w: min(x, own.get(w, x)) for w, x in listed.items()}))
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(bits, pa.float64())], names=["value", "bits"])

    asked = written(values.mapInArrow(parts, "value string, word string"), "asked")
    known = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    found = asked.join(known, "word").groupBy("value").agg(F.collect_list(F.struct("word", "n")).alias("found"))  # words of one value
    return values.join(found, "value", "left").mapInArrow(cost, "value string, bits double")


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """``docs`` with ``secret_spans``, (kind, start, end, bits) by start, then kind: the stated kinds, without bits, and
    'guess', values in a credential's place that take at least ``least_bits``. ``keep``: the columns that come along, all
    unless named."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secret_spans"]
    with scratch(docs.sparkSession):
        rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
        row = rows.schema["row"].dataType.simpleString()
        schema = f"row {row}, spans array<struct<kind:string,start:int,end:int>>, values array<struct<start:int,end:int,value:string>>, word string, n long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                yield from _spans_and_words(first.schema.field("row").type, chain([first], batches))

        made = written(rows.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()), "found")
        texts = made.where("row is not null").drop("word", "n")
        words = made.where("word is not null").select("word", "n")
        hard = texts.where(F.size("values") > 0).select("id", F.explode("values").alias("v")).select("id", "v.*")
        costs = written(value_costs(hard.select("value").distinct(), words).where(F.col("bits") >= least_bits), "costs")
        guesses = hard.join(costs, "value").groupBy("id").agg(F.collect_list(F.struct("start", F.lit(len(BASE)).alias("rank"), "end", "bits")).alias("guesses"))  # values of one text
        stated = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.array(*map(F.lit, BASE)), s["kind"]) - 1).cast("int").alias("rank"), s["end"].alias("end"), F.lit(None).cast("double").alias("bits")))
        none = F.array().cast("array<struct<start:int,rank:int,end:int,bits:double>>")
        some = texts.where(F.size("values") > 0).join(guesses, "id", "left").select("row", F.array_sort(F.concat(stated, F.coalesce("guesses", none))).alias("all"))
        all_ = texts.where(F.size("values") == 0).select("row", stated.alias("all")).unionByName(some)
        kinds = F.array(*map(F.lit, KINDS))
        spans = F.transform("all", lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["bits"].alias("bits")))
        return kept(all_.select("row.*", spans.alias("secret_spans")), "secrets")


def _joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def query(docs: DataFrame) -> DataFrame:
    """The stated result per document: counts of the stated kinds, their digest, all spans, and the hardest value's bits."""
    found = find_secrets(docs, keep=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("secret_spans").alias("spans"),
        F.round(F.array_max(F.transform("secret_spans", lambda s: s["bits"])), 6).alias("top_bits"),
    )
