"""The trie of conversations that begin alike, by names of blocks whose lengths are powers of two.

Equal turns get one dense number; two neighbouring blocks of 2**k turns, aligned at multiples of their length, make one of
2**(k+1), and equal pairs of numbers get one number again: as many rounds as a conversation's length has bits. A prefix of
d turns is then the prefix without the lowest bit of d, and the one block that follows it; so all prefixes are named, in
rounds by the number of bits of d, by their smallest member. What is summed over subtrees goes up by jumps that double.

Defined cases: a null role or text is empty; rows with a null conv_id belong to no conversation and are left out; a null
turn comes first; turns that share a number are ordered by the digest of their role and text; an empty table, or one of
null conv_ids only, gives no rows; other columns are not looked at. A conversation of any length and a turn, prefix or
whole conversation that any number shares are spread over tasks: nothing is gathered but a node's ends, in blocks of 4096
numbers whose digest one pass over the blocks makes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import sql
from scorelake.llm.common import kept, scratch, written
from scorelake.operators.ordinals import dense, numbered

FAMILY = 5
MOST_HEAD = 9
#: Conversation numbers of a block of ends, as a power of two.
ENDS_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the rebuilt conversations: (conv, d, turn, bytes), d from 1 on, and (conv, length).

    Conversation c starts with the first h turns of c - c % 5, h = crc32(c) % 9, and goes on with its own after its first h.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), own.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))

    def families(sizes: DataFrame) -> DataFrame:
        base = F.col("conv") - F.col("conv") % FAMILY
        mine = sizes.select("conv", F.col("n_rows").alias("n"), base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_HEAD).alias("h"))
        there = sizes.select(F.col("conv").alias("base"), F.col("n_rows").alias("n_base"))
        return mine.join(there, "base", "left").select("conv", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"))

    rows = numbered(rows, ["conv"], ["at", "turn"], "pos", attach=families)
    each = rows.where("pos = 0").select("conv", "n", "base", "h", "head")
    tail = rows.where("pos >= h").select("conv", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("d"), "turn", "bytes")
    first = rows.where((F.col("pos") < MOST_HEAD - 1) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), "pos", "turn", "bytes")
    head = each.select("conv", "base", "h").join(first, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("d"), "turn", "bytes")
    turns = written(tail.unionByName(head), "turns")
    return turns, written(each.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")


def _last_blocks(turns: DataFrame, longest: int) -> DataFrame:
    """(conv, d, block): the name of the aligned block that ends at each turn and is as long as the lowest bit of d."""
    names = dense(turns.select("turn").distinct(), "block")
    blocks = written(turns.join(names, "turn").select("conv", (F.col("d") - 1).alias("j"), "block"), "blocks")
    k, out = 0, []
    while True:
        # a block whose number is odd ends at a multiple of a larger power of two
        out.append(blocks.where("j % 2 = 0").select("conv", F.shiftleft(F.col("j") + 1, k).alias("d"), "block"))
        if 2 << k > longest:
            break
        odd = F.col("j").bitwiseAND(1) == 1
        pairs = blocks.groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("block"))).alias("left"), F.max(F.when(odd, F.col("block"))).alias("right")).where("right is not null")
        names = dense(pairs.select("left", "right").distinct(), "block")
        blocks = written(pairs.join(names, ["left", "right"]).select("conv", "j", "block"), "blocks")
        k += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv, d, node, n): of each conversation's first d turns the smallest conversation with the same, and how many have
    the same."""
    blocks = _last_blocks(turns, longest)
    most_bits = max((d.bit_count() for d in (longest, (1 << max(longest.bit_length() - 1, 0)) - 1)), default=0)
    done, out = None, []
    for bits in range(1, most_bits + 1):
        rows = blocks.where(F.bit_count("d") == bits)
        if done is not None:
            before = done.select("conv", F.col("d").alias("_before"), F.col("node").alias("stem"))
            rows = rows.withColumn("_before", F.col("d").bitwiseAND(F.col("d") - 1)).join(before, ["conv", "_before"]).drop("_before")
        else:
            rows = rows.withColumn("stem", F.lit(0).cast("long"))
        keys = ["d", "stem", "block"]
        groups = rows.groupBy(*keys).agg(F.min("conv").alias("node"), F.count("*").alias("n"))
        done = written(rows.join(groups, keys).select("conv", "d", "node", "n"), "prefixes")
        out.append(done)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _ends(lengths: DataFrame, names: DataFrame, root: int) -> DataFrame:
    """(d, node, ends_sha256) of the nodes at which a conversation ends."""
    there = lengths.where("length > 0").join(names.select("conv", F.col("d").alias("length"), "node"), ["conv", "length"])
    at = there.select(F.col("length").alias("d"), "node", "conv").unionByName(lengths.where("length = 0").select(F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("node"), "conv"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = at.groupBy("d", "node", F.shiftright("conv", ENDS_BITS).alias("block")).agg(ids.alias("ids"))
    ordered = blocks.repartition("d", "node").sortWithinPartitions("d", "node", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for d, node, text in zip(*(b.column(c).to_pylist() for c in ("d", "node", "ids")), strict=True):
                if (d, node) == last:
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (d, node), hashlib.sha256(text.encode())
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["d", "node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([state.hexdigest()])], names=["d", "node", "ends_sha256"])

    return ordered.mapInArrow(run, "d long, node long, ends_sha256 string")


def _summed_up(shared: DataFrame, names: DataFrame, root: int) -> DataFrame:
    """(d, node, leaves, saved) of shared nodes, summed over their subtrees.

    After k rounds a node holds the sums of its next 2**k levels; in a round each node sends its sums to its ancestor
    2**k levels up, which is the node of the same conversation there. Ancestors of shared nodes are shared.
    """
    sums = written(shared, "sums")
    deepest = sums.agg(F.max("d")).first()[0]
    up = names.where("n > 1").select(F.col("conv").alias("node"), F.col("d").alias("to"), F.col("node").alias("ancestor"))
    k = 0
    while 1 << k <= deepest:
        sent = sums.where(F.col("d") >= 1 << k).withColumn("to", F.col("d") - (1 << k))
        high = sent.where("to = 0").select("to", F.lit(root).cast("long").alias("ancestor"), "leaves", "saved")
        low = sent.where("to > 0").join(up, ["node", "to"]).select("to", "ancestor", "leaves", "saved")
        got = high.unionByName(low).groupBy(F.col("to").alias("d"), F.col("ancestor").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        sums = written(sums.join(got, ["d", "node"], "left").select("d", "node", *added), "sums")
        k += 1
    return sums


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv, d, turn, bytes), d from 1 to the (conv, length)'s length: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). ``turn`` is equal for equal turns."""
    root, n, longest = lengths.agg(F.min("conv"), F.count("*"), F.max("length")).first()
    spark = lengths.sparkSession
    top = [(0, root, n, None)] if n else []
    heads = spark.createDataFrame(top, "d long, node long, n long, parent long")
    if longest:
        names = prefixes(turns, longest)
        own = names.where("conv = node").select("d", "node", "n")
        above = names.select(F.col("conv").alias("node"), (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
        first = own.where("d = 1").withColumn("parent", F.lit(root).cast("long"))
        nodes = written(heads.unionByName(first).unionByName(own.where("d > 1").join(above, ["d", "node"]).select("d", "node", "n", "parent")), "nodes")
    else:
        names = turns.select("conv", "d", F.col("conv").alias("node"), F.lit(1).cast("long").alias("n"))
        nodes = heads
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("alone"))
    known = written(nodes.join(children, ["d", "node"], "left").na.fill(0, ["n_children", "alone"]), "known")
    # below a node of one conversation there is nothing but the rest of it
    bytes_ = turns.select(F.col("conv").alias("node"), "d", "bytes")
    wide = known.where((F.col("n") > 1) | (F.col("d") == 0)).join(bytes_, ["d", "node"], "left")
    begin = wide.select("d", "node", (F.col("alone") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"))
    if n:
        sums, ends = _summed_up(begin, names, root), _ends(lengths, names, root)
    else:
        sums, ends = begin, spark.createDataFrame([], "d long, node long, ends_sha256 string")
    out = known.join(sums, ["d", "node"], "left").join(ends, ["d", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """The stated result: a row for each node of the trie of rebuilt conversations."""
    with scratch(conversations.sparkSession):
        return kept(trie(*rebuilt(conversations)), "trie")


ORACLE = f"""WITH {sql.CRC}, t AS (SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, s, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS p FROM t),
h AS (SELECT c, c - c % {FAMILY} AS b, {sql.crc32('c::VARCHAR')} % {MOST_HEAD} AS h FROM (SELECT DISTINCT c FROM t), crc),
r AS (SELECT h.c, 0 AS part, o.p, s, bytes FROM h JOIN o ON o.c = h.b AND o.p <= h.h UNION ALL SELECT h.c, 1, o.p, s, bytes FROM h JOIN o ON o.c = h.c AND o.p > h.h),
q AS (SELECT c, row_number() OVER w AS d, string_agg(s, '') OVER w AS key, bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p)),
a AS (SELECT c, 0 AS d, '' AS key, 0 AS bytes FROM h UNION ALL SELECT c, d, key, bytes FROM q),
n AS (SELECT d, key, min(c) AS node, count(*) AS n, any_value(bytes) AS bytes FROM a GROUP BY ALL),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(key, d) AS key FROM a GROUP BY c) GROUP BY key),
k AS (SELECT n.d, n.key, n.node, n.n, n.bytes, p.node AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND starts_with(x.key, n.key)) AS kids FROM n LEFT JOIN n p ON p.d = n.d - 1 AND starts_with(n.key, p.key)),
u AS (SELECT k.d, k.key, count_if(x.kids = 0) AS leaves, sum((x.n - 1) * x.bytes) AS saved FROM k JOIN k x ON starts_with(x.key, k.key) GROUP BY ALL)
SELECT node AS conv_id, k.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM k JOIN u USING (d, key) LEFT JOIN e USING (key)"""
