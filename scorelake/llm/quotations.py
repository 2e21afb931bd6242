"""Quotation linking: nested quotes are parsed, hashed by passage, and joined to the messages that said it first.

A line that begins with one or more '>' is quoted, their number is its level. A passage is a run of neighbouring
lines of one level (a line without a letter or digit parts passages); it is compared in lower case, with signs left
out and line breaks and white space made even, so wrapping does not matter. Where nobody said the whole passage, its
lines are looked up one by one, as when a reply quotes a part of a paragraph. (A part that was wrapped anew besides is
not found.) A line goes to the first message of its own conversation that says its passage (else the line) in its own
words before, else to the first message of all other conversations (smallest conv_id, turn); the first speakers of
two conversations are kept for each hash, so one differs from the quoter's and a very common line never multiplies.
A message answers the message that most of its quoted lines of the least level come from (ties: the latest turn,
then the smallest conv_id); quotes of the message itself or of later turns of the same conversation don't count.

Defined cases: a null text is an empty message; a message without linked quotes answers nothing and begins a thread
of its own place; answers that run in a ring keep their links, but are ordered by turn as if they had none, and their
answers hang below them. Of rows that repeat a message one stands for it: one that answers nothing, else the one with
the smallest parent. Threads can be of any depth.
Repeated rows are linked one by one, to the same original; rows with a null conv_id or turn are returned unlinked.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import common

_MARK = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
_SIGNS = re.compile(r"[^\w]+|_+")
PARSED = "row_no long, conv_id long, turn long, role string, text string, own array<long>, quoted array<struct<level:int,hash:long,passage:long>>"


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(text without quotes, own lines, (level, line) of the quoted ones)."""
    own, quoted = [], []
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        if m:
            quoted.append((m[1].count(">"), m[2]))
        else:
            own.append(line)
    return "\n".join(own).strip("\n"), own, quoted


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines) of neighbouring lines of a level, 0 for own ones; a line without letters or digits parts them."""
    out, last = [], None
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level, body = (m[1].count(">"), m[2]) if m else (0, line)
        if not _SIGNS.sub("", body):
            last = None
        elif level == last:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
            last = level
    return out


def line_hash(line: str) -> int | None:
    """Hash of a normalised line; None where nothing is left of it."""
    flat = " ".join(_SIGNS.sub(" ", line.lower()).split())
    return xxhash.xxh64_intdigest(flat) - 2**63 if flat else None


def _parsed(rows: DataFrame) -> DataFrame:
    pair = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("passage", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, owns, quotes = [], [], []
            for t in b.column("text").to_pylist():
                texts.append(parse(t)[0])
                own, quoted = set(), []
                for level, lines in passages(t):
                    whole = line_hash(" ".join(lines))
                    if level:
                        quoted += ({"level": level, "hash": line_hash(x), "passage": whole} for x in lines)
                    else:
                        own.add(whole)
                        own.update(map(line_hash, lines))
                owns.append(sorted(own))
                quotes.append(quoted)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("row_no", "conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(owns, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pair))],
                names=["row_no", "conv_id", "turn", "role", "text", "own", "quoted"],
            )

    return rows.mapInArrow(run, PARSED)


def link(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, parent_conv, parent_turn, n_quoted, n_linked, row_no), a row a message."""
    rows = messages.select(F.monotonically_increasing_id().alias("row_no"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = common.written(_parsed(rows), "parsed")
    quotes = parsed.where("conv_id is not null and turn is not null and size(quoted) > 0").select("row_no", "conv_id", "turn", F.posexplode("quoted").alias("pos", "q"))
    # the passage's hash comes first, then that of the line
    tries = F.array_distinct(F.array(F.struct(F.lit(0).alias("rank"), F.col("q.passage").alias("hash")), F.struct(F.lit(1).alias("rank"), F.col("q.hash").alias("hash"))))
    quotes = quotes.select("row_no", "conv_id", "turn", "pos", "q.level", F.explode(tries).alias("t")).select("row_no", "conv_id", "turn", "pos", "level", "t.rank", "t.hash")
    quotes = common.written(quotes, "quotes")
    asked = common.written(quotes.select("hash").distinct(), "asked")
    said = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("hash"))
    # only lines that someone quotes; then one row for each conversation and line, and one for each line
    said = common.written(said.join(asked, "hash").groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn")), "said")
    place = F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))
    two = said.withColumn("place", place).where("place <= 2").groupBy("hash")
    at = lambda k, c: F.min(F.when(F.col("place") == k, F.col(c)))
    first = common.written(two.agg(at(1, "conv_id").alias("far_conv"), at(1, "near_turn").alias("far_turn"), at(2, "conv_id").alias("next_conv"), at(2, "near_turn").alias("next_turn")), "first")
    near = quotes.join(said, ["conv_id", "hash"], "left")
    near = common.written(near, "near").join(first, "hash", "left")
    here = F.col("near_turn") < F.col("turn")
    there = F.col("far_conv") != F.col("conv_id")
    to = F.when(here, F.struct("rank", F.col("conv_id").alias("c"), F.col("near_turn").alias("t"))).when(there, F.struct("rank", F.col("far_conv").alias("c"), F.col("far_turn").alias("t")))
    to = to.when(F.col("next_conv").isNotNull(), F.struct("rank", F.col("next_conv").alias("c"), F.col("next_turn").alias("t")))
    found = near.groupBy("row_no", "pos", "level").agg(F.min(to).alias("to")).select("row_no", "level", F.col("to.c").alias("to_conv"), F.col("to.t").alias("to_turn"))
    votes = found.groupBy("row_no", "level", "to_conv", "to_turn").agg(F.count("*").alias("n"))
    best = votes.groupBy("row_no").agg(
        F.max(F.when(F.col("to_conv").isNotNull(), F.struct(-F.col("level"), "n", "to_turn", -F.col("to_conv")))).alias("best"),
        F.sum("n").alias("n_quoted"),
        F.sum(F.when(F.col("to_conv").isNotNull(), F.col("n"))).alias("n_linked"),
    )
    best = best.select("row_no", (-F.col("best.col4")).alias("parent_conv"), F.col("best.to_turn").alias("parent_turn"), "n_quoted", "n_linked")
    zero = F.lit(0).cast("long")
    return parsed.join(best, "row_no", "left").select("row_no", "conv_id", "turn", "role", "text", "parent_conv", "parent_turn", F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"))


def _pad(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.when(c < 0, "-").otherwise("0"), F.lpad(F.abs(c).cast("string"), 18, "0"))


def _step() -> Column:
    return F.concat(F.lit("/"), _pad("conv_id"), F.lit("."), _pad("turn"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each node (conv_id, turn) with the place to_conv, to_turn where its way up ends, its depth below that and the
    path; and the nodes in rings, None where there are none. A round doubles the way; the places reached that go on
    themselves become fewer with each step until only rings are left."""
    at = common.written(nodes.select("conv_id", "turn", "to_conv", "to_turn", F.lit(1).alias("depth"), _step().alias("path")), "climb")
    before = None
    while True:
        going = at.select("to_conv", "to_turn").distinct().join(at.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn")), ["to_conv", "to_turn"], "left_semi")
        going = common.written(going, "going")
        left = going.count()
        if left == 0:
            return at, None
        if left == before:
            return at, going.select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"))
        before = left
        up = at.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("up_conv"), F.col("to_turn").alias("up_turn"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        at = at.join(up, ["to_conv", "to_turn"], "left").select(
            "conv_id", "turn", F.coalesce("up_conv", "to_conv").alias("to_conv"), F.coalesce("up_turn", "to_turn").alias("to_turn"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.concat(F.coalesce("up_path", F.lit("")), "path").alias("path"),
        )
        at = common.written(at, "climb")


def conversations(messages: DataFrame) -> DataFrame:
    """``link`` with thread_conv (the conversation where the thread begins), depth and reply_order: ordering a thread by
    reply_order puts every message behind the one it answers and beside its other answers.

    Ways up are doubled until all have ended; only messages that answer are joined.
    """
    linked = common.written(link(messages), "linked")
    top = ("row_no", F.col("conv_id").alias("thread_conv"), F.lit(0).alias("depth"), _pad("turn").alias("reply_order"))
    roots = linked.where("parent_conv is null")
    places = roots.select(*top)
    answers = common.written(linked.where("parent_conv is not null").select("row_no", "conv_id", "turn", "parent_conv", "parent_turn"), "answers")
    if not answers.isEmpty():
        key = ["conv_id", "turn"]
        nodes = answers.join(roots.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct("parent_conv", "parent_turn")).alias("p"))
        nodes = common.written(nodes.select(*key, F.col("p.parent_conv").alias("to_conv"), F.col("p.parent_turn").alias("to_turn")), "nodes")
        at, ring = _climb(nodes)
        if ring is not None:
            held = nodes.join(ring, key, "left_semi").select(*key, F.col("to_conv").alias("parent_conv"), F.col("to_turn").alias("parent_turn"))
            ringed = common.written(answers.join(held, [*key, "parent_conv", "parent_turn"], "left_semi"), "ringed")
            places = places.union(ringed.select(*top))
            answers = answers.join(ringed.select("row_no"), "row_no", "left_anti")
            at, _ = _climb(nodes.join(ring, key, "left_anti"))
        above = at.select(F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), "to_conv", "to_turn", F.col("depth").alias("above"), "path")
        below = answers.join(above, ["parent_conv", "parent_turn"], "left")
        order = F.concat(_pad(F.coalesce("to_turn", "parent_turn")), F.coalesce("path", F.lit("")), _step())
        places = places.union(below.select("row_no", F.coalesce("to_conv", "parent_conv").alias("thread_conv"), (F.coalesce("above", F.lit(0)) + 1).alias("depth"), order.alias("reply_order")))
    return linked.join(places, "row_no").drop("row_no")


def query(messages: DataFrame) -> DataFrame:
    out = conversations(messages)
    return out.select("conv_id", "turn", "role", "parent_conv", "parent_turn", "thread_conv", "depth", "reply_order", "n_quoted", "n_linked", "text")


_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_PAD = "(CASE WHEN {0} < 0 THEN '-' ELSE '0' END || lpad(CAST(abs({0}) AS VARCHAR), 18, '0'))"
_STEP = f"concat('/', {_PAD.format('conv_id')}, '.', {_PAD.format('turn')})"
#: The same parsing and joining in SQL; rings are found by what can be reached from a message, then threads are walked.
ORACLE = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row_no, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
cut AS (SELECT row_no, conv_id, turn, string_split(text, chr(10)) AS ls FROM m),
line AS (SELECT row_no, conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^((?:[ \\t]*>)+)[ \\t]?', 1) AS mark FROM cut, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
body AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, CASE WHEN mark = '' THEN line ELSE regexp_replace(line, '^(?:[ \\t]*>)+[ \\t]?', '') END AS words FROM line),
keyed AS (SELECT *, {_KEY.format('words')} AS key FROM body),
solid AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM keyed WHERE key <> '' WINDOW w AS (PARTITION BY row_no ORDER BY i)),
run AS (SELECT *, sum(new) OVER (PARTITION BY row_no ORDER BY i) AS run FROM solid),
passage AS (SELECT *, {_KEY.format("string_agg(words, ' ' ORDER BY i) OVER (PARTITION BY row_no, run)")} AS whole FROM run),
said AS (SELECT conv_id, key, min(turn) AS turn FROM (SELECT conv_id, turn, key FROM passage WHERE level = 0 UNION ALL SELECT conv_id, turn, whole FROM passage WHERE level = 0)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
asked AS (SELECT row_no, conv_id, turn, i, level, 0 AS rank, whole AS key FROM passage WHERE level > 0 UNION ALL SELECT row_no, conv_id, turn, i, level, 1, key FROM passage WHERE level > 0),
known AS (SELECT * FROM asked WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
source AS (SELECT a.row_no, a.i, a.level, arg_min(s.conv_id, (a.rank, s.conv_id <> a.conv_id, s.conv_id)) AS c, arg_min(s.turn, (a.rank, s.conv_id <> a.conv_id, s.conv_id)) AS t
  FROM known a LEFT JOIN said s ON s.key = a.key AND (s.conv_id <> a.conv_id OR s.turn < a.turn) GROUP BY ALL),
vote AS (SELECT row_no, level, c, t, count(*) AS n FROM source GROUP BY ALL),
best AS (SELECT row_no, arg_max(c, (-level, n, t, -c)) FILTER (c IS NOT NULL) AS pc, arg_max(t, (-level, n, t, -c)) FILTER (c IS NOT NULL) AS pt, sum(n) AS q, coalesce(sum(n) FILTER (c IS NOT NULL), 0) AS l FROM vote GROUP BY row_no),
linked AS (SELECT m.*, pc, pt, coalesce(q, 0) AS q, coalesce(l, 0) AS l FROM m LEFT JOIN best USING (row_no)),
node AS (SELECT conv_id, turn, CASE WHEN bool_or(pc IS NULL) THEN NULL ELSE min((pc, pt)) END AS up FROM linked WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
edge AS (SELECT (conv_id, turn) AS a, (up[1], up[2]) AS b FROM node WHERE up IS NOT NULL),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
ring AS (SELECT a FROM reach WHERE a = b),
held AS (SELECT linked.row_no FROM linked JOIN ring ON (conv_id, turn) = ring.a JOIN edge ON edge.a = ring.a AND (pc, pt) = edge.b),
root AS (SELECT (conv_id, turn) AS place, conv_id AS thread, {_PAD.format('turn')} AS path FROM node WHERE up IS NULL OR (conv_id, turn) IN (SELECT a FROM ring)),
down AS (SELECT place, thread, 0 AS depth, path FROM root
  UNION ALL SELECT e.a, d.thread, d.depth + 1, concat(d.path, '/', {_PAD.format('e.a[1]')}, '.', {_PAD.format('e.a[2]')}) FROM down d JOIN edge e ON e.b = d.place WHERE e.a NOT IN (SELECT a FROM ring)),
placed AS (SELECT k.*, CASE WHEN k.pc IS NULL OR held.row_no IS NOT NULL THEN NULL ELSE (k.pc, k.pt) END AS below FROM linked k LEFT JOIN held USING (row_no))
SELECT conv_id, turn, role, pc AS parent_conv, pt AS parent_turn, coalesce(d.thread, conv_id) AS thread_conv, CAST(CASE WHEN below IS NULL THEN 0 ELSE d.depth + 1 END AS INTEGER) AS depth,
  CASE WHEN below IS NULL THEN {_PAD.format('turn')} ELSE concat(d.path, {_STEP}) END AS reply_order, CAST(q AS BIGINT) AS n_quoted, CAST(l AS BIGINT) AS n_linked,
  trim(array_to_string(list_filter(string_split(placed.text, chr(10)), lambda x: NOT regexp_matches(x, '^(?:[ \\t]*>)+')), chr(10)), chr(10)) AS text
FROM placed LEFT JOIN down d ON d.place = below
"""
