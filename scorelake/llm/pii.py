"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression: no Python runs on the executors.

Defined cases: a null text counts as empty and has no spans; an empty table gives no rows; repeated rows are
treated one by one; other columns of the input are kept by ``find_pii`` and ``redact`` unless they bear the name
of an added column, which then wins. Offsets are code points, the end is exclusive. Very long texts are searched
whole; every pattern below starts only where a run starts and never backtracks into a run, so the time is
linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an IBAN by country code, from the registry of ISO 13616.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(c for codes in IBAN_CHARS.values() for c in codes.split())
#: The country code gives the length, so a match ends where the IBAN ends. Codes without a known length end with
#: their run of characters, or else with the run of such words.
_IBAN = "|".join(
    [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, codes in IBAN_CHARS.items()]
    + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}+|(?:\x20?+[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"]
)
#: Java patterns that find the leftmost non-overlapping matches of the stated base expressions. A lookbehind (or
#: the end of the last match, \G) keeps the search from starting again inside a run that has already failed.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the first letter; group 1 looks ahead over the whole, so that what fails the checksum hides no IBAN inside it
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN}))[A-Z]",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: A cheap test that a text can hold the kind at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: (score of a confirmed span, words nearby that raise it)
CONTEXT = {
    "email": (0.8, "e?mail|contact|write|adresse|correo|courriel"),
    "ip": (0.6, r"ip\b|host|server|address|adresse|serveur"),
    "card": (0.8, "card|visa|master|amex|credit|debit|karte|carte|tarjeta"),
    "phone": (0.6, r"phone|tel\b|telef|teleph|t[ée]l[ée]|call|fax|mobile|anruf|appel|llama"),
    "iban": (0.8, "iban|bank|account|konto|compte|cuenta"),
}
#: Score of an added span whose country code is not in the registry: it needs a word nearby to reach the least score.
UNLISTED = 0.4
CONTEXT_CHARS = 40
#: Steps of a fold between two of its results.
BLOCK = 256
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn_ok(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def mod97_ok(match: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, and the number mod 97 is 1."""
    code = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: F.length(c) > 0),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(code).between(15, 34) & (value == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn_ok(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97_ok(match)
    return F.lit(True)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's own expressions are computed at each of its uses."""
    return F.transform(F.array(value), body)[0]


def blocks(array: Column) -> Column:
    """The array in pieces of ``BLOCK``, so that what a fold appends to stays short and the whole takes linear time."""
    n = F.size(array)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(array, i, F.lit(BLOCK)))


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind in the text, by start.

    The pieces between the matches (split) and the matches themselves alternate, so a running sum of their
    lengths gives the offsets.
    """
    gaps = F.split(text, PATTERNS[kind], -1)
    ahead = kind == "iban"
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1 if ahead else 0))
    n = F.size(matches)
    steps = F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), matches.alias("match"), F.slice(gaps, F.lit(2), n).alias("after"))
    base, words = CONTEXT[kind]

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["gap"])
        end = start + F.length(s["match"])
        before, after = F.right(s["gap"], F.lit(CONTEXT_CHARS)), F.left(s["after"], F.lit(CONTEXT_CHARS))
        if ahead:  # only the first letter parts the gaps
            before = F.right(s["gap"], F.least(F.lit(CONTEXT_CHARS), start - acc["free"]))
            after = F.substring(s["after"], F.length(s["match"]), F.lit(CONTEXT_CHARS))
        own = F.when(s["match"].rlike(f"^(?:{_LISTED})"), base).otherwise(UNLISTED) if ahead else F.lit(base)
        score = own + F.when(F.lower(F.concat_ws(" ", before, after)).rlike(rf"\b(?:{words})"), 0.2).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        good = _confirmed(kind, s["match"])
        if ahead:
            good = (start >= acc["free"]) & good
        kept = F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + 1 if ahead else end).alias("at"), F.when(good, end).otherwise(acc["free"]).alias("free"), kept.alias("spans"))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["free"].alias("free"), F.array().cast(_SPANS).alias("spans")), step)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), d["free"].alias("free"), F.concat(acc["blocks"], F.array(d["spans"])).alias("blocks")))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast(f"array<{_SPANS}>").alias("blocks"))
    found = bound(steps, lambda all_: F.flatten(F.aggregate(blocks(all_), zero, block, lambda acc: acc["blocks"])))
    possible = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9][ -]?[0-9]")
    return F.when(possible, found).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """``docs`` with one array column of spans per kind (``email_spans`` ...) and ``pii_spans``, all of them.

    Base kinds stay whatever their score; an added kind needs ``least_score``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"{k}_spans": spans_of(body, k) for k in KINDS})
    out = out.withColumns({f"{k}_spans": F.filter(f"{k}_spans", lambda s: s["score"] >= least_score) for k in KINDS if k not in BASE_KINDS})
    return out.withColumn("pii_spans", F.concat(*(f"{k}_spans" for k in KINDS)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; spans that overlap are
    replaced together, by the kind of the first (then longest)."""
    names = docs.columns
    mine = next(f"_text{i}" for i in range(len(names) + 1) if f"_text{i}" not in names)
    spans = next(f"_spans{i}" for i in range(len(names) + 1) if f"_spans{i}" not in names)
    # the caller's columns may bear the names of the spans' columns, so they travel in one struct meanwhile
    found = find_pii(docs.select(F.struct(*names).alias(mine), F.col(text)), text).withColumnRenamed("pii_spans", spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("neg_end"), s["kind"])))
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.array().cast("array<string>")

    def block(acc: Column, part: Column) -> Column:
        # substrings are taken from the block's own stretch of the text: to find a place in the whole is to read up to it
        begin, last = acc["at"], F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: -s["neg_end"])))
        stretch = F.substring(body, begin + 1, last - begin)

        def folded(own: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                new = F.array(F.substring(own, a["at"] - begin + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
                return F.struct(F.greatest(-s["neg_end"], a["at"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], new)).otherwise(a["out"]).alias("out"))

            return F.aggregate(part, F.struct(begin.alias("at"), pieces.alias("out")), step)

        return bound(bound(stretch, folded), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), pieces.alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
    masked = bound(ordered, lambda all_: F.aggregate(blocks(all_), zero, block, rest))
    value = F.when(F.size(spans) > 0, masked).otherwise(F.col(text))
    return found.select(*(value.alias(n) if n == text else F.col(mine)[n].alias(n) for n in names))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """The stated result per document: counts of the base kinds, their digest and all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    base = found.withColumn("base_spans", F.concat(*(f"{k}_spans" for k in BASE_KINDS)))
    return base.select(
        "doc_id",
        *(F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
        _joined("pii_spans").alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )
