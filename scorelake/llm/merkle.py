"""A manifest of a data set: a hash tree for each source, one over the sources' roots, and a proof for every row.

Leaves are numbered within their source in an order over all partitions. A task walks its run of consecutive leaves
with a stack of open runs, one a level: sixteen nodes that begin at a multiple of sixteen are one run, their hash is
carried to the level above, and the run is recorded. What does not fill a run within the task (its unaligned edges, and
the last run of a source) is left open and merged level by level with what other tasks have left open; a short run is
hashed as it is, without padding. Going down again, each run takes its path to the root from the run above it.

Defined cases: a null field is hashed as ``-``; a null source is a source of its own, the first; a null doc_id comes
first within its source and is not tampered with; rows that share a doc_id are ordered by their leaf, so equal rows are
interchangeable; a lone leaf is its source's root; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import sql
from scorelake.llm.common import kept, scratch, written
from scorelake.operators.ordinals import numbered

FANOUT = 16  # a power of two
BITS = FANOUT.bit_length() - 1
HEX = 64
#: Records of a batch that a task gives back.
BATCH = 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<kids:string,at:int>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Hash of the fields, each ``-`` for null, else its UTF-8 bytes' count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Mountains:
    """The open runs of consecutive leaves of one tree, a list a level of (number, hash, member)."""

    def __init__(self, tree: str, n: int, out: list[tuple]):
        self.tree, self.n, self.out, self.open, self.next = tree, n, out, [], None

    def add(self, number: int, value: str, member: object) -> None:
        self.next = number + 1
        level = 0
        while True:
            if level == len(self.open):
                self.open.append([])
            run = self.open[level]
            run.append((number, value, member))
            if number % FANOUT != FANOUT - 1:
                return
            if len(run) < FANOUT:  # it began before this task's leaves
                self._leave(level)
                return
            kids = "".join(h for _, h, _ in run)
            number //= FANOUT
            self.out.append((self.tree, self.n, level, number, None, kids, [m for _, _, m in run] if level == 0 else None))
            run.clear()
            value, member, level = digest(kids), None, level + 1

    def _leave(self, level: int) -> None:
        for number, value, member in self.open[level]:
            self.out.append((self.tree, self.n, level, number, value, None, None if member is None else [member]))
        self.open[level].clear()

    def close(self) -> None:
        for level in range(len(self.open)):
            self._leave(level)


def _records(leaves: DataFrame) -> DataFrame:
    """(tree, n, level, number, hash, kids, members) of (tree, n, number, leaf, member): recorded runs, which have kids
    (and at level 0 members), and nodes left open, which have a hash. Whatever rows a task gets, it is right; few nodes
    are left open if they are consecutive."""
    member = leaves.schema["member"].dataType.simpleString()
    schema = f"tree string, n long, level int, number long, hash string, kids string, members array<{member}>"
    ordered = leaves.select("tree", "n", "number", "leaf", "member").sortWithinPartitions("tree", "number")
    arrow = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("number", pa.int64()), ("hash", pa.string()), ("kids", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        range_: Mountains | None = None
        kind = None

        def given() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=False)] + [pa.array(cols[-1], pa.list_(kind))]
            return pa.RecordBatch.from_arrays(arrays, names=[*arrow.names, "members"])

        for b in batches:
            kind = b.schema.field("member").type
            for tree, n, number, value, m in zip(*(b.column(c).to_pylist() for c in ("tree", "n", "number", "leaf", "member")), strict=True):
                if range_ is None or range_.tree != tree or range_.next != number:
                    if range_ is not None:
                        range_.close()
                    range_ = Mountains(tree, n, out)
                range_.add(number, value, m)
                if len(out) >= BATCH:
                    yield given()
        if range_ is not None:
            range_.close()
        if out:
            yield given()

    return ordered.mapInArrow(run, schema)


def _nodes_at(level: int) -> Column:
    """Nodes of a tree at a level, from its number of leaves."""
    return F.shiftright(F.col("n") + (FANOUT**level - 1), BITS * level)


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(runs, tops, levels) of (tree, n, number, leaf, member), tree no null, number from 0 to n - 1 within a tree.

    runs: (tree, n, level, number, kids, members), a row for each run of up to 16 nodes, kids their hashes one behind
    the other, members those of a run of leaves. tops: (tree, n, hash, members), a row a tree, members only where it is a
    lone leaf. levels: of the deepest tree.
    """
    made = written(_records(leaves), "records")
    deepest = made.agg(F.max("n")).first()[0] or 0
    levels = 0
    while FANOUT**levels < deepest:
        levels += 1
    left = made.where("hash is not null").drop("kids")
    runs, tops, carried = made.where("kids is not null").drop("hash"), [], None
    for level in range(levels + 1):
        here = left.where(F.col("level") == level)
        here = here if carried is None else here.unionByName(carried)
        tops.append(here.where(_nodes_at(level) == 1).select("tree", "n", "hash", "members"))
        if level == levels:
            break
        # at most 16 nodes a group
        parts = F.array_sort(F.collect_list(F.struct("number", "hash", "members")))
        grouped = here.where(_nodes_at(level) > 1).groupBy("tree", "n", F.shiftright("number", BITS).alias("number")).agg(parts.alias("p"))
        kids = F.array_join(F.transform("p", lambda x: x["hash"]), "")
        members = F.flatten(F.transform("p", lambda x: x["members"])) if level == 0 else F.lit(None)
        merged = grouped.select("tree", "n", F.lit(level).alias("level"), "number", kids.alias("kids"), members.cast(left.schema["members"].dataType).alias("members"))
        merged = written(merged, "merged")
        runs = runs.unionByName(merged)
        carried = merged.select("tree", "n", F.lit(level + 1).alias("level"), "number", F.sha2("kids", 256).alias("hash"), F.lit(None).cast(left.schema["members"].dataType).alias("members"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return runs, out, levels


def paths(runs: DataFrame, tops: DataFrame, levels: int, above: DataFrame) -> DataFrame:
    """(tree, number, kids, members, path, *more), a row for each run of leaves, and one without kids for a lone leaf.

    path: for each node from the run's own up to below the last root, the kids of the run that it is in and its place
    among them. ``above``: (tree, path, *more), where the tree's root goes on from.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    heads = tops.select("tree", "n", F.col("members").alias("_lone")).join(above, "tree")
    parents = None
    for level in range(levels - 1, -1, -1):
        here = runs.where(F.col("level") == level)
        first = here.where(_nodes_at(level + 1) == 1).join(heads.drop("n", "_lone"), "tree")
        found = first.select("tree", "number", "kids", "members", "path", *more)
        if parents is not None:
            up = parents.select("tree", F.col("number").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *more)
            below = here.where(_nodes_at(level + 1) > 1).withColumn("_up", F.shiftright("number", BITS)).join(up, ["tree", "_up"])
            step = F.struct(F.col("_kids").alias("kids"), F.col("number").bitwiseAND(FANOUT - 1).cast("int").alias("at"))
            found = found.unionByName(below.select("tree", "number", "kids", "members", F.concat(F.array(step), "_path").cast(_PATH).alias("path"), *more))
        parents = found
    lone = heads.where("n = 1").select("tree", F.lit(0).cast("long").alias("number"), F.lit(None).cast("string").alias("kids"), F.col("_lone").alias("members"), "path", *more)
    return lone if parents is None else parents.unionByName(lone)


def grown(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """``build`` of (tree, leaf, member, *order), leaves numbered within their tree."""
    leaves = numbered(rows, ["tree"], order, "number", attach=lambda totals: totals.withColumnRenamed("n_rows", "n"))
    return build(leaves)


def fold(value: str, kids: str | None, at: int, path: list[tuple[str, int]]) -> str:
    """The root that a node's hash and its siblings on the way up give."""
    for these, place in ([] if kids is None else [(kids, at)]) + path:
        value = digest(these[: place * HEX] + value + these[place * HEX + HEX :])
    return value


def without(kids: str, at: int) -> str:
    return kids[: at * HEX] + kids[at * HEX + HEX :]


def manifest(rows: DataFrame, tree: Column, order: list[Column], value: Column, member: Column) -> DataFrame:
    """(tree, number, kids, members, path, subroot, root) of a two-level manifest: a row for each run of leaves.

    ``tree`` names the row's tree (no null) and orders the trees, ``order`` orders a tree's rows, ``value`` is the
    leaf's hash, ``member`` a struct of what is to be kept with it.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    leaves = rows.select(tree.alias("tree"), value.alias("leaf"), member.alias("member"), *(o.alias(k) for o, k in zip(order, keys, strict=True)))
    with scratch(rows.sparkSession):
        leaves = written(leaves, "leaves")  # what follows reads hashes, no texts
        runs, tops, levels = grown(leaves, [*keys, "leaf"])
        tops = written(tops, "tops")
        over = tops.select(F.lit("").alias("tree"), F.col("hash").alias("leaf"), F.struct(F.col("tree").alias("tree"), F.col("hash").alias("hash")).alias("member"), F.col("tree").alias("_key"))
        outer, root, outer_levels = grown(over, ["_key"])
        begin = root.select("tree", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
        ways = paths(outer, root, outer_levels, begin)
        ways = ways.select("kids", "path", "root", F.posexplode("members").alias("at", "m"))
        own = F.when(F.col("kids").isNull(), F.array().cast(_PATH)).otherwise(F.array(F.struct("kids", F.col("at").cast("int").alias("at"))))
        above = written(ways.select(F.col("m.tree").alias("tree"), F.concat(own, "path").alias("path"), F.col("m.hash").alias("subroot"), "root"), "above")
        return kept(paths(runs, tops, levels, above), "manifest")


def proved(runs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of a manifest whose members are (doc_id, leaf,
    tampered): each row's siblings up to the root are hashed, and the root is recomputed from its tampered leaf, if it
    has one, and the siblings."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for kids, members, path, subroot, root in zip(*(b.column(c).to_pylist() for c in ("kids", "members", "path", "subroot", "root")), strict=True):
                way = [(p["kids"], p["at"]) for p in path]
                tail = "".join(without(k, at) for k, at in way)
                sound = None
                for at, m in enumerate(members):
                    proof = digest((without(kids, at) if kids is not None else "") + tail)
                    if m["tampered"] is None or m["tampered"] == m["leaf"]:
                        # with its own leaf in its place every member of a run gives the same text
                        sound = folded = sound or fold(m["leaf"], kids, at, way)
                    else:
                        folded = fold(m["tampered"], kids, at, way)
                    out.append((m["doc_id"], m["leaf"], subroot, root, proof, folded, folded == root))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for c, n in zip(cols, names, strict=True)], names=names)

    return runs.select("kids", "members", "path", "subroot", "root").mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """The stated result per document."""
    c = {f: F.col(f) for f in FIELDS}
    value = leaf([c[f] for f in FIELDS])
    changed = leaf([F.translate("text", UPPER, LOWER) if f == "text" else c[f] for f in FIELDS])
    struck = F.coalesce(F.crc32(c["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    member = F.struct(c["doc_id"].cast("long").alias("doc_id"), value.alias("leaf"), F.when(struck, changed).alias("tampered"))
    tree = F.coalesce(F.concat(F.lit("1"), c["source"]), F.lit("0"))  # null first, then by bytes
    return proved(manifest(docs.select(*FIELDS), tree, [c["doc_id"]], value, member))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"


def _tree(leaves: str, out: str, levels: int) -> str:
    """Tables of a tree in SQL: {out}0 to {out}{levels} are its nodes (tree, i, h) by level, {out}way the proof and the runs
    (tree, i, way) of each leaf. ``levels`` bounds a tree to 16 ** levels leaves."""
    parts = [f"{out}0 AS (SELECT tree, i, h FROM {leaves})"]
    for k in range(levels):
        parts.append(f"{out}r{k} AS (SELECT tree, i // {FANOUT} AS run, list(h ORDER BY i) AS kids FROM {out}{k} WHERE tree IN (SELECT tree FROM {out}{k} GROUP BY tree HAVING count(*) > 1) GROUP BY ALL)")
        parts.append(f"{out}{k + 1} AS (SELECT tree, run AS i, sha256(array_to_string(kids, '')) AS h FROM {out}r{k})")
    steps = " UNION ALL ".join(f"SELECT l.tree, l.i, {k} AS level, r.kids, (l.i // {FANOUT**k}) % {FANOUT} + 1 AS pos FROM {out}0 l JOIN {out}r{k} r ON r.tree = l.tree AND r.run = l.i // {FANOUT ** (k + 1)}" for k in range(levels))
    parts.append(f"{out}way AS (SELECT tree, i, list(struct_pack(kids := kids, at_ := pos) ORDER BY level) AS way FROM ({steps}) GROUP BY ALL)")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {out}{k} WHERE tree IN (SELECT tree FROM {out}{k} GROUP BY tree HAVING count(*) = 1)" + (f" AND tree IN (SELECT tree FROM {out}r{k - 1})" if k else "") for k in range(levels + 1))
    return ", ".join([*parts, f"{out}top AS ({tops})"])


_WHOLE = "list_concat(coalesce(w.way, []), coalesce(v.way, []))"
ORACLE = f"""WITH {{crc}}, d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS tree, sha256({{leaf}}) AS leaf,
  CASE WHEN {{struck}} % 5 = 0 THEN sha256({{changed}}) END AS other FROM documents, crc),
leaves AS (SELECT id, doc_id, tree, leaf, other, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{{inner}},
over AS (SELECT '' AS tree, h, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM ltop),
{{outer}},
ways AS (SELECT l.*, t.h AS subroot, r.h AS root, {_WHOLE} AS way FROM leaves l JOIN ltop t USING (tree) JOIN over o ON o.name = l.tree CROSS JOIN otop r
  LEFT JOIN lway w ON w.tree = l.tree AND w.i = l.i LEFT JOIN oway v ON v.i = o.i),
folded AS (SELECT *, sha256(array_to_string(list_transform(way, lambda s: array_to_string(s.kids[:s.at_ - 1], '') || array_to_string(s.kids[s.at_ + 1:], '')), '')) AS proof_sha256,
  coalesce(other, leaf) AS node FROM ways),
{{climbed}}
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {{last}}"""


def oracle(levels: int = 5, over: int = 3) -> str:
    """The query in SQL, for sources of at most 16 ** levels rows and 16 ** over sources."""
    changed = f"translate(text, '{UPPER}', '{LOWER}')"
    last = "folded"
    steps = []
    for k in range(1, levels + over + 1):
        step = f"CASE WHEN len(way) >= {k} THEN sha256(array_to_string(way[{k}].kids[:way[{k}].at_ - 1], '') || node || array_to_string(way[{k}].kids[way[{k}].at_ + 1:], '')) ELSE node END"
        steps.append(f"up{k} AS (SELECT * REPLACE ({step} AS node) FROM {last})")
        last = f"up{k}"
    return ORACLE.format(
        crc=sql.CRC, leaf=" || ".join(map(_field, FIELDS)), changed=" || ".join(_field(changed if f == "text" else f) for f in FIELDS), struck=sql.crc32("doc_id::VARCHAR"),
        inner=_tree("leaves", "l", levels), outer=_tree("over", "o", over), climbed=", ".join(steps), last=last,
    )
