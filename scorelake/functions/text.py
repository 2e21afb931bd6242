"""Text functions as column expressions: tokens, hashed embeddings, buckets, stub judges and judge output."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the length buckets; the last bucket is open.
LENGTH_BOUNDS = (0, 32, 64, 128, 256, 512, 1024, 2048, 4096)
JUDGE_BUCKETS = 10
DIM = 64
#: White space of any script, as Python sees it, for use inside a class of a Java pattern.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed format of what a judge is asked.
ASKED = "RUBRIC: %s\n\nPROMPT: %s\n\nRESPONSE: %s\n"


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def length_bucket(text: Column) -> Column:
    return length_bucket_of(F.length(text))


def length_bucket_of(length: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, LENGTH_BOUNDS)), lambda b: b <= length)) - 1


def judge_bucket(score: Column) -> Column:
    return F.least(F.lit(JUDGE_BUCKETS - 1), F.greatest(F.lit(0), F.floor(score * JUDGE_BUCKETS).cast("int")))


def word_count_judge(text: Column) -> Column:
    return F.pmod(F.size(tokens(text)) * 7, F.lit(100)) / F.lit(100.0)


def length_judge(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length(text) / F.lit(200.0)))


def judge_prompt(rubric: Column, prompt: Column, response: Column) -> Column:
    return F.format_string(ASKED, rubric, prompt, response)


def section(asked: Column, header: str) -> Column:
    """The first part between blank lines that begins with the header, without it; '' if there is none."""
    part = F.try_element_at(F.filter(F.split(asked, "\n\n"), lambda c: c.startswith(f"{header}:")), F.lit(1))
    return F.coalesce(stripped(F.substr(part, F.lit(len(header) + 2))), F.lit(""))


def content_words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$")), F.lower)


def overlap_judge(asked: Column) -> Column:
    """0.85 if the prompt and the response of what the judge is asked share a content word, else 0.20."""
    return F.when(F.arrays_overlap(content_words(section(asked, "PROMPT")), content_words(section(asked, "RESPONSE"))), 0.85).otherwise(0.2)


def constant_judge(score: float) -> Column:
    return F.lit(float(score))


def needle_judge(asked: Column, scores: dict[str, float], default: float = 0.5) -> Column:
    """The score of the first needle, in the order given, that occurs in what the judge is asked."""
    out = F.lit(float(default))
    for needle, score in reversed(scores.items()):
        out = F.when(F.contains(asked, F.lit(needle)), float(score)).otherwise(out)
    return out


def hash_mod(token: Column, modulus: int) -> Column:
    """SHA-1 of the token as a number, modulo ``modulus``: by its last digits for a power of two, else by Horner's
    rule over eight hex digits at a time."""
    digest = F.sha1(token.cast("binary"))
    if modulus & (modulus - 1) == 0 and modulus <= 1 << 32:
        digits = max(1, -(-(modulus.bit_length() - 1) // 4))
        return F.conv(F.right(digest, F.lit(digits)), 16, 10).cast("long") % modulus
    acc = F.lit(0).cast("long")
    for at in range(1, 41, 8):
        part = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        acc = (acc * pow(2, 32, modulus) + part) % modulus
    return acc


def finite(x: Column, what: str) -> Column:
    """The number itself; a null, NaN or infinite one fails the job."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what} must be finite; got "), F.coalesce(x.cast("string"), F.lit("null"))))).otherwise(x)


def clamp01(x: Column) -> Column:
    """Within [0, 1]; a null, NaN or infinite value is an error."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), finite(x.cast("double"), "judge score")))


def judge_output(text: Column) -> Column:
    """Struct (score, reasoning, error) of a judge's text: the first SCORE line that holds a plain number and the first
    REASONING line with a text, in any case; a line may begin on the one below its label. error tells which is missing."""
    score_line = rf"(?imdu)^[{SPACE}]*SCORE:[{SPACE}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[{SPACE}]*$"
    reason_line = rf"(?imdu)^[{SPACE}]*REASONING:[{SPACE}]*(.+)$"
    number, reason = F.regexp_extract(text, score_line, 1), stripped(F.regexp_extract(text, reason_line, 1))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number.try_cast("double")))
    missing = F.when(text.isNull() | ~text.rlike(score_line), "missing SCORE: line").when(~text.rlike(reason_line), "missing REASONING: line")
    return F.struct(F.when(missing.isNull(), score).alias("score"), F.when(missing.isNull(), reason).alias("reasoning"), missing.alias("error"))


def judged(text: Column) -> Column:
    """``judge_output`` as struct (score, reasoning); a text that lacks a line fails the job."""
    out = judge_output(text)
    said = F.concat(out["error"], F.lit(" in judge output: "), F.coalesce(text, F.lit("null")))
    return F.when(out["error"].isNotNull(), F.raise_error(said)).otherwise(F.struct(out["score"].alias("score"), out["reasoning"].alias("reasoning")))
