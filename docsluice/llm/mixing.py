"""Operator 6: mixing sources to target weights by temperature, with DataFrame functions only.

Each source's share of all words is raised to an exponent and normalised. The exponent is bisected:
the smallest one at which no source is repeated more often than `repetition_limit`, or the largest
one whose weights reach `target_entropy` nats. The largest budget is the one at which no source
loses a document: the source with the greatest share per weight is read once, every other one as
often as its weight asks for.

A source's documents are dealt into blocks of about BLOCK_WORDS words by a hash, and the blocks of a
source are permuted by another. Whole passes take every block; what is left of the budget takes
blocks in permuted order, and of the block where it ends documents in hash order, as far as they
fit. Ordering the result by (mix_block, mix_pos) interleaves the blocks of all sources.

All decisions about a document are comparisons with numbers of its source, so texts are never
shuffled and a source with a third of all rows costs no more than its rows.

Defined cases: a null source counts as the empty one; null text has no words; documents without
words are read as their source's blocks are; rows that repeat a doc_id go together; an empty table
gives an empty result; columns named copy, mix_block and mix_pos are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import kept, sheltered, table

REPETITION_LIMIT = 1.5
BLOCK_WORDS = 100_000
#: Sources up to which the plan of one row a source is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000
#: The blocks of a source are summed up in parts by so many leading bits of their keys.
PART_BITS = 12
ADDED = ("copy", "mix_block", "mix_pos")


def _hash(*parts: Column | str) -> Column:
    """48 bits of an MD5 over the parts as text, so that other engines can compute them too."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def _joined(df: DataFrame, plan: DataFrame, sources: int, on: list[str]) -> DataFrame:
    return df.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, on)


def exponent(words: DataFrame, repetition_limit: float | None, target_entropy: float | None) -> DataFrame:
    """One row: the exponent, for words(n) with a row for each source that has words."""
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    if repetition_limit is not None:  # the smallest exponent at which the smallest source is not read too often
        one = words.agg(F.max("n").cast("double").alias("most"), F.min("n").cast("double").alias("least"))
        high_enough = f"pow(most / least, 1 - x) <= {float(repetition_limit)!r}D"
    else:  # the largest exponent whose entropy still reaches the target
        one = words.agg(F.collect_list(F.col("n").cast("double")).alias("ns"), F.sum("n").cast("double").alias("total"))
        power = "aggregate(ns, 0D, (a, n) -> a + pow(n / total, x))"
        high_enough = f"ln({power}) - x * aggregate(ns, 0D, (a, n) -> a + pow(n / total, x) * ln(n / total)) / {power} <= {float(target_entropy)!r}D"
    halve = f"transform(array((s.lo + s.hi) / 2), x -> IF({high_enough}, named_struct('lo', s.lo, 'hi', x), named_struct('lo', x, 'hi', s.hi)))[0]"
    found = f"transform(array(0D), x -> IF({high_enough}, 0D, aggregate(sequence(1, 60), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {halve}).hi))[0]"
    return one.select(F.expr(f"least(1D, ceil(coalesce({found}, 1D) * 1e6) / 1e6)").alias("exponent"))


def _edge(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of each source's rows(s, n, rest, ...) in order, the one in which the sum of n passes rest, and what is left of rest there."""
    upto = F.sum("n").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_upto", upto).where("_upto - n <= rest and rest < _upto").withColumn("left", F.col("rest") - F.col("_upto") + F.col("n")).drop("_upto")


def mixed(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text, source, ...) once for each time it is read, with copy, mix_block and mix_pos."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    words = kept(docs.select(source.alias("s"), _hash("doc_id").alias("h"), count.alias("n")).groupBy("s", "h").agg(F.sum("n").alias("n")))
    totals = words.groupBy("s").agg(F.sum("n").alias("n"))
    power = exponent(totals.where("n > 0"), repetition_limit, target_entropy)
    most = totals.agg(F.max("n").cast("double").alias("most"))
    repeats = F.when(F.col("n") > 0, F.round(F.pow(F.col("most") / F.col("n"), 1 - F.col("exponent")), 6)).otherwise(F.lit(1.0))
    plan = totals.crossJoin(F.broadcast(power)).crossJoin(F.broadcast(most)).withColumn("repeats", repeats)  # each one row
    plan = kept(plan.select("s", "repeats", F.floor("repeats").alias("passes"), (F.floor(F.col("n") * F.col("repeats")) - F.floor("repeats") * F.col("n")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_words)).alias("blocks")))
    sources = plan.count()

    block = F.pmod("h", "blocks").alias("block")
    dealt = _joined(words, plan.select("s", "rest", "blocks"), sources, ["s"]).select("s", "h", "n", "rest", block)
    sums = dealt.groupBy("s", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("key", _hash(F.lit("block"), "s", "block"))
    sums = sums.withColumn("part", F.shiftright("key", 48 - PART_BITS))
    # the budget ends in one part of a source's keys, and there in one block: no window sees all blocks of a source
    parts = _edge(sums.groupBy("s", "part").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), ["part"]).select("s", "part", F.col("left").alias("rest"))
    edge = kept(_edge(sums.drop("rest").join(parts, ["s", "part"]), ["key", "block"]).select("s", "key", "block", "left"))
    inside = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = _joined(dealt.select("s", "h", "n", "block"), edge, sources, ["s", "block"]).withColumn("upto", F.sum("n").over(inside)).where(F.col("upto") <= F.col("left")).groupBy("s").agg(F.max("h").alias("last"))
    cuts = kept(plan.join(edge.select("s", "key", F.col("block").alias("edge")), "s", "left").join(last, "s", "left").select(F.col("s").alias("_s"), "passes", F.col("blocks").alias("_blocks"), F.col("key").alias("_key"), F.col("edge").alias("_edge"), F.col("last").alias("_last")))

    inner, columns = sheltered(docs, ("doc_id", "text", "source"))  # no column of docs is named as one of the plan
    own = [c for name, c in zip(docs.columns, columns) if name.lower() not in ADDED]
    named = inner.select("*", source.alias("_s"), _hash("doc_id").alias("_h"))
    chosen = _joined(named, cuts, sources, ["_s"]).withColumn("_block", F.pmod("_h", "_blocks")).withColumn("_own", _hash(F.lit("block"), "_s", "_block"))
    before = (F.col("_own") < F.col("_key")) | ((F.col("_own") == F.col("_key")) & (F.col("_block") < F.col("_edge")))
    extra = F.coalesce(before | ((F.col("_block") == F.col("_edge")) & (F.col("_h") <= F.col("_last"))), F.lit(False))
    times = F.col("passes") + extra.cast("int")
    return (
        chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
        .select(*own, "copy", _hash(F.lit("mix"), "_s", "_block", "copy").alias("mix_block"), F.col("_h").alias("mix_pos"))
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


#: The exponent in closed form: the most repeated source is the smallest.
OP6_SQL = r"""
WITH words AS (
  SELECT coalesce(source, '') AS s, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h,
         sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::BIGINT AS n
  FROM documents GROUP BY 1, 2),
totals AS (SELECT s, sum(n)::BIGINT AS n FROM words GROUP BY s),
ends AS (SELECT max(n)::DOUBLE AS most, (min(n) FILTER (WHERE n > 0))::DOUBLE AS least FROM totals),
power AS (SELECT most, CASE WHEN most / least <= 1.5 THEN 0 ELSE least(1, ceil((1 - ln(1.5) / ln(most / least)) * 1e6) / 1e6) END AS x FROM ends),
plan0 AS (SELECT s, n, CASE WHEN n > 0 THEN round(pow(most / n, 1 - x), 6) ELSE 1 END AS r FROM totals, power),
plan AS (SELECT s, floor(r)::BIGINT AS passes, floor(n * r)::BIGINT - floor(r)::BIGINT * n AS rest, greatest(1, ceil(n / 100000.0))::BIGINT AS blocks FROM plan0),
dealt AS (SELECT s, h, n, rest, h % blocks AS block FROM words JOIN plan USING (s)),
sums AS (SELECT s, block, sum(n)::BIGINT AS n, any_value(rest) AS rest, ('0x' || substr(md5('block|' || s || '|' || block), 1, 12))::BIGINT AS key FROM dealt GROUP BY s, block),
upto AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY key, block ROWS UNBOUNDED PRECEDING) AS upto FROM sums),
edge AS (SELECT s, key, block, rest - upto + n AS room FROM upto WHERE upto - n <= rest AND rest < upto),
inner_ AS (SELECT d.s, d.h, e.room, sum(d.n) OVER (PARTITION BY d.s ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto FROM dealt d JOIN edge e ON d.s = e.s AND d.block = e.block),
last_ AS (SELECT s, max(h) AS last FROM inner_ WHERE upto <= room GROUP BY s),
docs AS (
  SELECT d.doc_id, d.source, p.s, p.passes, ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h, p.blocks
  FROM documents d JOIN plan p ON coalesce(d.source, '') = p.s),
owned AS (SELECT *, h % blocks AS block, ('0x' || substr(md5('block|' || s || '|' || (h % blocks)), 1, 12))::BIGINT AS own FROM docs),
times AS (
  SELECT o.*, passes + coalesce(own < e.key OR (own = e.key AND o.block < e.block) OR (o.block = e.block AND h <= l.last), false)::INT AS times
  FROM owned o LEFT JOIN edge e ON o.s = e.s LEFT JOIN last_ l ON o.s = l.s)
SELECT doc_id, source, c::INT AS copy, ('0x' || substr(md5('mix|' || s || '|' || block || '|' || c), 1, 12))::BIGINT AS mix_block, h AS mix_pos
FROM times, UNNEST(range(times)) AS u(c)
"""
