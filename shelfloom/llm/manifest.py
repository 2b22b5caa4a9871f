"""Merkle manifest of a table: a radix-ranked trie of digests for each group.

Leaves of a group stand in the order of their ids. Their ranks come from
histograms of the ids' digits and not from a sort of the table: ids are counted
by all but their last digit, these counts by all but the last two, and so on up
to one node; going down again, the counts of smaller siblings add up to the
number of rows before every node, and at last before every id. A node has
``2 ** DIGIT`` children at most, so no task orders more of them.

The digits of a rank to the base of the fan-out are a leaf's path in the trie.
Nodes that share the longest prefix are reduced first, ``LEVELS`` levels in one
task: the leaves of a chunk come together, become one digest each level, and the
chunk's digest is a leaf of the next stage, until every group has one node, its
subroot. The subroots are the leaves of one more trie, whose node is the root.
Proofs go the other way: a chunk's siblings above it meet those within it.

Digests are SHA-256 in lower-case hex, over the hex text of the digests below.

Defined results: a null id comes before all others and a null group before all
other groups; rows of equal id stand in the order of their leaves, and equal rows
are leaves of their own; a null field is ``-``; extra columns are ignored; an
empty table gives no rows. Texts are hashed whole where they are read, and
never moved; what is shuffled are ids and digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.llm.common import materialise, renamed, ship
from shelfloom.operators.ranking import numbered

#: Bits of a digit of the ids.
DIGIT = 8
#: Leaves that one task reduces at a time, at most.
CHUNK = 256
#: Equal rows that are told apart in one go.
COPIES = 4096

_PATH = "_lefts array<string>, _rights array<string>, _subroot string, _root string"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def _before(counts: DataFrame, group: list[str], key: str) -> DataFrame:
    """``counts`` (group, key, _n), one row a key, with ``_before``: the sum of
    ``_n`` over the smaller keys of the group. Neither may be null."""
    levels = [counts.select(*group, key, "_n")]
    while True:
        above = levels[-1].groupBy(*group, F.shiftright(key, DIGIT).alias(key)).agg(F.sum("_n").alias("_n"))
        levels.append(materialise(above, "manifest-digits"))
        if levels[-1].filter(~F.col(key).isin(0, -1)).isEmpty():
            break
    smaller = lambda by: F.coalesce(F.sum("_n").over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = levels.pop().withColumn("_before", smaller(Window.partitionBy(*group)))
    while levels:
        up = out.select(*group, F.col(key).alias("_up"), F.col("_before").alias("_base"))
        here = levels.pop().withColumn("_up", F.shiftright(key, DIGIT)).join(up, [*group, "_up"])
        out = here.withColumn("_before", F.col("_base") + smaller(Window.partitionBy(*group, "_up"))).drop("_up", "_base")
    return out.select(*group, key, "_n", "_before")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (_g, _id, _leaf, _claim) with ``_rank``, from 0 inside each group by id and leaf."""
    keyed = rows.withColumns({"_has": F.col("_id").isNotNull().cast("int"), "_key": F.coalesce(F.col("_id").cast("long"), F.lit(0))})
    # the leaf of an id that is there once comes along, so that no row has to meet its rank in a join
    ids = keyed.groupBy("_g", "_has", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_leaf").alias("_leaf"), F.min("_claim").alias("_claim"))
    ids = materialise(ids, "manifest-ids")
    # null ids are one key more, before the others
    nulls = ids.filter("_has = 0").select("_g", F.col("_n").alias("_nulls"))
    places = _before(ids.filter("_has = 1"), ["_g"], "_key").join(nulls, "_g", "left")
    places = places.select("_g", F.lit(1).alias("_has"), "_key", (F.col("_before") + F.coalesce("_nulls", F.lit(0))).alias("_before"))
    places = places.union(nulls.select("_g", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")))
    placed = ids.join(places, ["_g", "_has", "_key"])
    id_ = F.when(F.col("_has") == 1, F.col("_key")).alias("_id")
    once = placed.filter("_n = 1").select("_g", id_, "_leaf", "_claim", F.col("_before").alias("_rank"))
    if ids.filter("_n > 1").isEmpty():
        return once
    # ids that repeat: by leaf, whose first 60 bits are a key like any other, and equal rows one after another
    again = placed.filter("_n > 1").select("_g", "_has", "_key", F.col("_before").alias("_start"))
    again = keyed.join(materialise(again, "manifest-again"), ["_g", "_has", "_key"])
    group = ["_g", "_has", "_key"]
    kinds = again.groupBy(*group, "_start", "_leaf", "_claim").agg(F.count(F.lit(1)).alias("_m"))
    kinds = materialise(kinds.withColumn("_prefix", F.conv(F.substring(F.hex("_leaf"), 1, 15), 16, 10).cast("long")), "manifest-kinds")
    prefixes = _before(kinds.groupBy(*group, "_prefix").agg(F.sum("_m").alias("_n")), group, "_prefix").drop("_n")
    tied = Window.partitionBy(*group, "_prefix").orderBy("_leaf", "_claim").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.join(prefixes, [*group, "_prefix"])
    kinds = kinds.withColumn("_rank", F.col("_start") + F.col("_before") + F.coalesce(F.sum("_m").over(tied), F.lit(0)))
    batches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / COPIES))).alias("_b")
    split = kinds.select("_g", id_, "_leaf", "_claim", "_rank", "_m", batches)
    split = split.repartition("_g", "_id", "_leaf", "_b")
    last = F.least(F.col("_m") - 1, F.col("_b") * COPIES + COPIES - 1)
    copies = split.select("_g", "_id", "_leaf", "_claim", "_rank", F.explode(F.sequence(F.col("_b") * COPIES, last)).alias("_j"))
    return once.union(copies.select("_g", "_id", "_leaf", "_claim", (F.col("_rank") + F.col("_j")).alias("_rank")))


def _digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _shape(fanout: int, chunk: int) -> tuple[int, int]:
    """(levels, leaves) that a task reduces at once."""
    levels = 1
    while fanout ** (levels + 1) <= chunk:
        levels += 1
    return levels, fanout**levels


def _depth(total: int, fanout: int, chunk: int) -> int:
    """The levels of a chunk, in a stage with ``total`` nodes in the group."""
    levels, span = _shape(fanout, chunk)
    if total > span:
        return levels
    out, reach = 0, 1
    while reach < total:
        out, reach = out + 1, reach * fanout
    return out


def _levels(nodes: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The nodes of every level of a chunk, the given ones first; every run of ``fanout`` nodes becomes one."""
    out = [nodes]
    for _ in range(depth):
        out.append([_digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def _siblings(levels: list[list[str]], k: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``k`` and of those above it, level by level."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        first = k - k % fanout
        lefts.append("".join(nodes[first:k]))
        rights.append("".join(nodes[k + 1 : first + fanout]))
        k //= fanout
    return lefts, rights


def _folded(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights, strict=True):
        node = _digest([left, node, right])
    return node


class Trie:
    """The tries of all groups of ``nodes`` (_g, _rank, _h and more columns):
    ``stages`` has the chunks of every stage, ``tops`` (_g, _h) what remains."""

    def __init__(self, nodes: DataFrame, fanout: int, chunk: int = CHUNK):
        if fanout < 2:
            raise ValueError("a node has two children or more")
        ship(nodes.sparkSession)
        self.fanout, self.chunk, self.stages = fanout, chunk, []
        _, span = _shape(fanout, chunk)

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for g, number, total, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    top = _levels([x["_h"].hex() for x in found], _depth(total, fanout, chunk), fanout)[-1]
                    made.append((g, number, -(-total // span), bytes.fromhex(top[0])))
                columns = list(zip(*made, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_g", "_rank", "_total", "_h"])

        totals = nodes.groupBy(F.col("_g").alias("_t")).agg(F.count(F.lit(1)).alias("_total"))
        nodes = nodes.join(totals, F.col("_g") == F.col("_t")).drop("_t")
        while True:
            more = [c for c in nodes.columns if c not in ("_g", "_rank", "_total", "_h")]
            number = F.floor(F.col("_rank") / span) if span & (span - 1) else F.shiftright("_rank", span.bit_length() - 1)
            chunks = nodes.groupBy("_g", number.cast("long").alias("_chunk"), "_total")
            # no more than the chunk's leaves come together
            chunks = chunks.agg(F.sort_array(F.collect_list(F.struct("_rank", "_h", *more))).alias("_nodes"))
            self.stages.append(materialise(chunks, "manifest-chunks"))
            nodes = self.stages[-1].mapInArrow(reduced, "_g string, _rank long, _total long, _h binary")
            nodes = materialise(nodes, "manifest-nodes")
            if nodes.filter("_total > 1").isEmpty():
                break
        self.tops = nodes.select("_g", "_h")

    def paths(self, above: DataFrame, stage: int = 0) -> DataFrame:
        """(_g, _rank, path) of the nodes of ``stage``; ``above`` has those of the groups' tops."""
        for chunks in reversed(self.stages[stage:]):
            above = self._down(chunks, above, self._paths_of(self.fanout, self.chunk), f"_g string, _rank long, {_PATH}")
        return above

    @staticmethod
    def _down(chunks: DataFrame, above: DataFrame, step, schema: str) -> DataFrame:
        met = above.withColumnsRenamed({"_g": "_ag", "_rank": "_arank"})
        met = chunks.join(met, (F.col("_g") == F.col("_ag")) & (F.col("_chunk") == F.col("_arank")))
        return met.select("_g", "_total", "_nodes", "_lefts", "_rights", "_subroot", "_root").mapInArrow(step, schema)

    @staticmethod
    def _paths_of(fanout: int, chunk: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for g, total, found, lefts, rights, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    levels = _levels([x["_h"].hex() for x in found], _depth(total, fanout, chunk), fanout)
                    for k, node in enumerate(found):
                        a, b = _siblings(levels, k, fanout)
                        made.append((g, node["_rank"], a + lefts, b + rights, subroot, root))
                columns = list(zip(*made, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
                names = ["_g", "_rank", "_lefts", "_rights", "_subroot", "_root"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return step

    def proofs(self, above: DataFrame) -> DataFrame:
        """Of every leaf: (_g, _rank, _id, _leaf, _subroot, _root, _proof, _folded). ``_folded`` comes from the leaf's
        ``_claim``, or the leaf itself where that is null, and the original siblings."""
        fanout, chunk = self.fanout, self.chunk

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for g, total, found, lefts, rights, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    levels = _levels([x["_h"].hex() for x in found], _depth(total, fanout, chunk), fanout)
                    for k, node in enumerate(found):
                        a, b = _siblings(levels, k, fanout)
                        a, b = a + lefts, b + rights
                        proof = _digest([x + y for x, y in zip(a, b, strict=True)])
                        claim = node["_claim"].hex() if node["_claim"] is not None else levels[0][k]
                        made.append((g, node["_rank"], node["_id"], levels[0][k], subroot, root, proof, _folded(claim, a, b)))
                columns = list(zip(*made, strict=True)) or [[]] * 8
                names = ["_g", "_rank", "_id", "_leaf", "_subroot", "_root", "_proof", "_folded"]
                arrays = [pa.array(c, pa.int64() if n in ("_rank", "_id") else pa.string()) for c, n in zip(columns, names, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        schema = "_g string, _rank long, _id long, _leaf string, _subroot string, _root string, _proof string, _folded string"
        return self._down(self.stages[0], self.paths(above, 1), step, schema)


def manifest(leaves: DataFrame, fanout: int = 2, chunk: int = CHUNK) -> tuple[Trie, DataFrame]:
    """The groups' tries of ``leaves`` (_g, _id, _leaf, _claim; _g not null) and (_g, _rank, path) of their subroots, with
    subroot and root."""
    trie = Trie(ranked(leaves).withColumnRenamed("_leaf", "_h"), fanout, chunk)
    tops = numbered(trie.tops, [], ["_g"], "_rank").select(F.lit("").alias("_g"), (F.col("_rank") - 1).cast("long").alias("_rank"), "_h", F.col("_g").alias("_of"))
    tops = materialise(tops, "manifest-tops")
    forest = Trie(tops, fanout, chunk)
    root = forest.tops.select(
        F.lit("").alias("_g"), F.lit(0).cast("long").alias("_rank"), F.array().cast("array<string>").alias("_lefts"), F.array().cast("array<string>").alias("_rights"),
        F.lit("").alias("_subroot"), F.lower(F.hex("_h")).alias("_root"),
    )
    paths = forest.paths(root).select(F.col("_rank").alias("_r"), "_lefts", "_rights", "_root")
    above = tops.join(paths, F.col("_rank") == F.col("_r")).select(
        F.col("_of").alias("_g"), F.lit(0).cast("long").alias("_rank"), "_lefts", "_rights", F.lower(F.hex("_h")).alias("_subroot"), "_root"
    )
    return trie, materialise(above, "manifest-roots")


def query(spark: SparkSession, documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    rows = renamed(documents, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = rows.select(
        # null before every other language, and never null
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("_g"),
        F.col("doc_id").cast("long").alias("_id"),
        leaf(*columns).alias("_leaf"),
        F.when(tampered, leaf(*columns[:3], more, columns[4])).alias("_claim"),
    )
    trie, above = manifest(materialise(leaves, "manifest-leaves"), chunk=chunk)
    return trie.proofs(above).select(
        F.col("_id").alias("doc_id"),
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.col("_proof").alias("proof_sha256"),
        F.col("_folded").alias("folded_root"),
        (F.col("_folded") == F.col("_root")).alias("verified"),
    )


ORACLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS z,
         list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, q: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc
  FROM documents
), d AS (
  SELECT doc_id, lang, sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || z) AS changed,
         xor(crc, 4294967295) % 7 = 0 AS tampered
  FROM f
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d
), t AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY rank) AS h FROM o GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM t WHERE len(h) > 1
), s AS (
  SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank FROM t WHERE len(h) = 1
), u AS (
  SELECT 0 AS lvl, list(subroot ORDER BY rank) AS h FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM u WHERE len(h) > 1
), step AS (
  SELECT o.doc_id, o.lang, o.rank, t.lvl, (o.rank >> t.lvl) AS i, t.h FROM o JOIN t ON t.lang IS NOT DISTINCT FROM o.lang WHERE len(t.h) > 1
  UNION ALL
  SELECT o.doc_id, o.lang, o.rank, 1000 + u.lvl, (s.rank >> u.lvl), u.h FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN u WHERE len(u.h) > 1
), side AS (
  SELECT doc_id, lang, rank, lvl, CASE WHEN i % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(h[CASE WHEN i % 2 = 1 THEN i ELSE i + 2 END], '') AS x FROM step
), path AS (
  SELECT lang, rank, list(x ORDER BY lvl) AS p FROM side GROUP BY lang, rank
), top AS (SELECT h[1] AS root FROM u WHERE len(h) = 1),
r AS (
  SELECT o.doc_id, o.leaf, s.subroot, top.root, sha256(array_to_string(list_transform(coalesce(path.p, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN o.tampered THEN o.changed ELSE o.leaf END], coalesce(path.p, [])),
           lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root
  FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN top LEFT JOIN path ON path.lang IS NOT DISTINCT FROM o.lang AND path.rank = o.rank
)
SELECT *, folded_root = root AS verified FROM r
"""
