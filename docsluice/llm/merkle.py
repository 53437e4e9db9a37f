"""Operator 12: Merkle manifest of a dataset, with an inclusion proof for every row.

A row is a leaf: the digest of its fields, each with its length. The leaves of a language ascend by
doc_id; two neighbours at a time become their digest until one is left, the subroot. Subroots,
ordered by language, give the root in the same way.

The levels are built bottom-up and written to the shared folder; the proofs are pushed top-down
over them: a node hands its proof down, and each child puts its own sibling before it. A shuffle
goes WIDTH levels at a time: the levels between are lists of at most 2**WIDTH nodes in the row of
their common ancestor, so a tree of n leaves takes log(n) / WIDTH joins, of n / 2**WIDTH rows and
fewer, and the leaves themselves are shuffled twice: to find their places, and into their blocks.
All steps are DataFrame functions.

Defined cases: a null field counts as `-`, an empty one as `0:`; a null language is a group of its
own, before all others; rows without doc_id come first in their group and are never tampered with;
rows of equal doc_id are ordered by their leaves (and are told apart by nothing if these are equal
too); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import kept, numbered, table

#: Levels of a block.
WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of the doc_id this divides are tampered with.
TAMPERED = 7
GROUP = ["no_gap", "name"]


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """doc_id, the group, leaf, and other_leaf: that of the row with one character more, where it is tampered with."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    digest = lambda n_chars: F.sha2(F.concat(*(field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS)), 256)
    changed = (F.crc32(F.col("doc_id").cast("string")) % tampered == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", F.col("lang").isNotNull().alias("no_gap"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("name"), digest(F.col("n_chars")).alias("leaf"), F.when(changed, digest(more)).alias("other_leaf"))


#: One level up: neighbours two by two, an odd last one alone.
UP = "transform(sequence(0, (size({0}) + 1) div 2 - 1), j -> sha2(concat({0}[2 * j], coalesce(get({0}, 2 * j + 1), '')), 256))"
#: Siblings of the block's entry i from the lowest level up, null where there is none; then what the block inherits.
PROOF = "concat(transform(slice(levels, 1, high), (nodes, l) -> struct(get(nodes, int(shiftright(i, l) ^ 1)) AS hash, shiftright(i, l) & 1 = 1 AS left)), suffix)"
FOLD = "aggregate(proof, {0}, (h, p) -> sha2(CASE WHEN p.hash IS NULL THEN h WHEN p.left THEN concat(p.hash, h) ELSE concat(h, p.hash) END, 256))"


def blocks_of(nodes: DataFrame, group: list[str], entry: list[str]) -> DataFrame:
    """Blocks of nodes(group, total, idx, hash, entry...): entries and all levels, the nodes' own first.

    high is the number of levels over the nodes: WIDTH, or as many as are left where the block is its group's only one.
    """
    own = F.sort_array(F.collect_list(F.struct("idx", "hash", *entry)))  # 2**WIDTH at most
    left = F.when(F.col("total") > 1 << WIDTH, WIDTH).otherwise(F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0))
    rows = nodes.groupBy(*group, "total", F.shiftright("idx", WIDTH).alias("block")).agg(own.alias("entries")).withColumn("high", left.cast("int"))
    last = "element_at(acc, -1)"
    grown = F.expr(f"aggregate(slice(sequence(1, {max(WIDTH, 1)}), 1, high), array(transform(entries, e -> e.hash)), (acc, x) -> concat(acc, array({UP.format(last)})))")
    return kept(rows.withColumn("levels", grown).withColumn("entries", F.transform("entries", lambda e: F.struct(*(e[c].alias(c) for c in entry)))))


def built(nodes: DataFrame, group: list[str], entry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of every WIDTH levels, lowest first; (group, rows, top) of every group)."""
    steps, tops = [], None
    nodes = nodes.withColumn("rows", F.col("total"))
    while True:
        blocks = blocks_of(nodes, [*group, "rows"], entry)
        steps.append(blocks)
        top = blocks.select(*group, "rows", "total", "block", F.element_at("levels", -1)[0].alias("hash"))
        done = top.where(F.col("total") <= 1 << WIDTH).select(*group, "rows", F.col("hash").alias("top"))
        tops = done if tops is None else tops.union(done)
        left = top.where(F.col("total") > 1 << WIDTH)
        if left.isEmpty():
            return steps, tops
        nodes = left.select(*group, "rows", F.ceil(F.col("total") / (1 << WIDTH)).cast("long").alias("total"), F.col("block").alias("idx"), "hash")
        entry = []


def pushed(steps: list[DataFrame], handed: DataFrame, group: list[str]) -> DataFrame:
    """Every entry of the lowest blocks with its proof: own siblings first, then what its ancestors hand down.

    handed has a row for each group: rows, suffix (siblings above the group's top), and columns that each entry gets.
    """
    carried = [c for c in handed.columns if c not in (*group, "rows", "suffix")]
    above = None
    for k in reversed(range(len(steps))):
        inherited = handed.where(F.col("rows") <= 1 << WIDTH * (k + 1)).select(*group, "suffix", F.lit(0).cast("long").alias("block"), *carried)
        if above is not None:
            inherited = inherited.union(above.select(*group, F.col("proof").alias("suffix"), F.col("idx").alias("block"), *carried))
        rows = steps[k].join(inherited, [*group, "block"]).select(*group, "block", "high", "levels", "suffix", *carried, F.posexplode("entries").alias("i", "entry"))
        above = rows.withColumn("proof", F.expr(PROOF)).select(*group, (F.col("block") * (1 << WIDTH) + F.col("i")).alias("idx"), F.col("levels")[0][F.col("i")].alias("hash"), "entry", "proof", *carried)
    return above


def merkle_manifest(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and proof itself.

    proof lists (hash, left) level by level from the leaf to the root, hash null where a node has no
    sibling. folded_root is what the proof gives for the tampered leaf, or the leaf where it is not.
    """
    spots = numbered(leaves(docs, tampered), GROUP, ["doc_id", "leaf"]).withColumnRenamed("leaf", "hash")
    low, subroots = built(spots, GROUP, ["doc_id", "other_leaf"])
    names = numbered(subroots.withColumn("all", F.lit(0)), ["all"], GROUP).withColumnRenamed("rows", "leaves").withColumnRenamed("top", "hash")
    high, roots = built(names, ["all"], [*GROUP, "leaves"])
    nothing = F.array().cast("array<struct<hash:string,left:boolean>>")
    upper = pushed(high, roots.withColumnRenamed("top", "root").withColumn("suffix", nothing), ["all"])
    handed = upper.select("entry.no_gap", "entry.name", F.col("entry.leaves").alias("rows"), F.col("proof").alias("suffix"), F.col("hash").alias("subroot"), "root")
    rows = pushed(low, handed, GROUP).select("entry.doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(F.array_join("proof.hash", ""), 256).alias("proof_sha256"), F.coalesce("entry.other_leaf", "hash").alias("shown"), "proof")
    folded = rows.withColumn("folded_root", F.expr(FOLD.format("shown")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents")).drop("proof")


_field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_leaf = lambda n: f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field(n)} || {_field('text')})"
#: crc32 bit by bit; levels by pairs of neighbours; each leaf looks its siblings up and folds them.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + 1)')} AS other, n_chars IS NOT NULL AND
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END)) % 7 = 0 AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
lo AS (SELECT lang, 0 AS l, i, n, leaf AS h FROM p UNION ALL
  SELECT lang, l + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS nx FROM lo) WHERE n > 1 AND i % 2 = 0),
s AS (SELECT lang, h, l AS high, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS m FROM lo WHERE n = 1),
hi AS (SELECT 0 AS l, g AS i, m AS n, h FROM s UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nx FROM hi) WHERE n > 1 AND i % 2 = 0),
top AS (SELECT h AS root, l AS high FROM hi WHERE n = 1),
steps AS (
  SELECT p.leaf, p.doc_id, p.i AS place, p.lang, k.l AS l, (p.i >> k.l) & 1 = 1 AS lft, x.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, UNNEST(range(0, s.high)) AS k(l) LEFT JOIN lo x ON x.lang IS NOT DISTINCT FROM p.lang AND x.l = k.l AND x.i = xor(p.i >> k.l, 1)
  UNION ALL
  SELECT p.leaf, p.doc_id, p.i, p.lang, 100 + k.l, (s.g >> k.l) & 1 = 1, x.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, top, UNNEST(range(0, top.high)) AS k(l) LEFT JOIN hi x ON x.l = k.l AND x.i = xor(s.g >> k.l, 1)),
proofs AS (SELECT lang, place, coalesce(string_agg(h, '' ORDER BY l), '') AS joined, list((CASE WHEN lft THEN 'L' ELSE 'R' END) || coalesce(h, '') ORDER BY l) AS sibs FROM steps GROUP BY ALL),
f AS (SELECT p.*, s.h AS subroot, root, coalesce(joined, '') AS joined, list_reduce(list_prepend(CASE WHEN tampered THEN other ELSE leaf END, coalesce(sibs, [])), lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN top LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.place = p.i)
SELECT doc_id, leaf, subroot, root, sha256(joined) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f
"""
