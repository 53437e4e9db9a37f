"""Quotes are grounded in the text, model outputs are validated, findings are assembled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..dims import REVIEWER_CHARS, SEVERITY, mapped
from ..functions.scalars import evidence_id, finding_id, quote_key, title_case, unfenced

MAX_QUOTES, OBSERVATION_CHARS, QUOTE_CHARS, SHOWN_QUOTES, FLEXIBLE_CHARS = 8, 500, 280, 2, 1200
#: Characters of passages that are sent to the tasks at once.
PASSAGE_BYTES = 4_000_000
STATES, GRADES = ("observed", "not_found", "ambiguous"), tuple(SEVERITY)
# What notes and findings say where the model's answer does not hold.
UNGROUNDED = "The worker returned an observation, but its quote did not match the normalized paper exactly."
NO_NOTE = "The worker returned no extraction note for this item."
NO_EVIDENCE = "The final judgment cited no matching observed paper evidence."
# The contracts of model outputs: their fields and kinds, in the order in which a parsed value's type names them.
NOTE_SCHEMA = "struct<evidence:array<struct<rubric_item:string,observation:string,quotes:array<string>,evidence_state:string>>>"
NOTE_SHAPE = r"OBJECT<evidence: ARRAY<(?:VOID|OBJECT<(?:evidence_state: STRING, )?observation: STRING(?:, quotes: ARRAY<(?:STRING|VOID)>)?, rubric_item: STRING>)>>"
DECISION_SCHEMA = "struct<assessments:array<struct<rubric_item:string,grade:string,explanation:string,evidence_ids:array<string>>>>"
DECISION_SHAPE = r"OBJECT<assessments: ARRAY<(?:VOID|OBJECT<(?:evidence_ids: ARRAY<(?:STRING|VOID)>, )?explanation: STRING, grade: STRING, rubric_item: STRING>)>>"


def shaped(content: Column, shape: str) -> Column:
    """The content is JSON of the shape: no field is unknown, none has another kind."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(content)).rlike(f"^{shape}$"), F.lit(False))


def grounded_quote(text: Column, quote: Column) -> Column:
    """The words of the text that the quote stands for: exact, else with any white space between its words; null if none."""
    bare = F.regexp_replace(F.regexp_replace(quote, r"(?U)^\s+|\s+$", ""), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    bare = F.nullif(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), F.lit(""))
    words = F.transform(F.split(bare, r"(?U)\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    flexible = F.nullif(F.call_function("regexp_extract", text, F.concat(F.lit("(?U)"), F.array_join(words, r"\s+")), F.lit(0)), F.lit(""))
    return F.when(F.contains(text, bare), bare).when(F.length(bare) <= FLEXIBLE_CHARS, flexible)


def ground(papers: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes(paper_id, quote, ...) with grounded, start and end (code points); null where the paper does not say it."""
    joined = quotes.join(papers.select("paper_id", "text"), "paper_id")
    found = joined.withColumn("grounded", grounded_quote(F.col("text"), F.col("quote")))
    start = F.when(F.col("grounded").isNotNull(), F.expr("instr(text, grounded)") - 1)
    return found.withColumn("start", start).withColumn("end", start + F.length("grounded")).drop("text")


class Passages:
    """All runs of n words of a block of passages, found in texts by a sum over word hashes and then compared word by word."""

    def __init__(self, block: list[tuple[int, str]], n: int):
        self.n, self.block = n, block
        self._runs: dict[int, list[tuple[int, list[bytes]]]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_runs": None}  # hashes of words hold in one process only

    def sums(self, words: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        out = hashes[: len(words) - self.n + 1].copy()
        for k in range(1, self.n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(out) + k]
        return out

    @property
    def runs(self) -> dict[int, list[tuple[int, list[bytes]]]]:
        if self._runs is None:
            self._runs = {}
            for number, text in self.block:
                words = text.encode().split()
                if len(words) >= self.n:
                    for at, h in enumerate(self.sums(words).tolist()):
                        self._runs.setdefault(h, []).append((number, words[at : at + self.n]))
            self.known = np.sort(np.fromiter(self._runs, np.uint64, len(self._runs)))
        return self._runs

    def found(self, text: str) -> dict[int, int]:
        """Passage to the place (in words) of its first run in the text."""
        words, runs = text.encode().split(), self.runs
        if len(words) < self.n or not runs:
            return {}
        sums = self.sums(words)
        near = self.known[np.minimum(np.searchsorted(self.known, sums), len(self.known) - 1)] == sums
        out: dict[int, int] = {}
        for at in np.flatnonzero(near).tolist():
            for number, run in runs[int(sums[at])]:
                if number not in out and run == words[at : at + self.n]:
                    out[number] = at
        return out


def shared_passages(papers: DataFrame, passages: DataFrame, n: int = 8, limit: int = PASSAGE_BYTES) -> DataFrame:
    """(paper_id, passage_id, at): pairs of a text and a passage that share n words in a row, with the first such place in the text.

    papers(paper_id, text) are read once for each block of passages(passage_id, text); nothing is
    shuffled. White space parts words.
    """
    kind, key = (t.schema[c].dataType.simpleString() for t, c in ((papers, "paper_id"), (passages, "passage_id")))
    spark, parts, arrow_key = papers.sparkSession, [], to_arrow_type(passages.schema["passage_id"].dataType)

    def search(block: list[tuple]) -> DataFrame:
        ids = [p for p, _ in block]
        shared = spark.sparkContext.broadcast(Passages([(i, t) for i, (_, t) in enumerate(block)], n))  # about `limit` characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for batch in batches:
                hits = [(r, i, at) for r, text in enumerate(batch.column("text").to_pylist()) for i, at in finder.found(text or "").items()]
                if hits:
                    rows, numbers, at = zip(*hits)
                    yield pa.RecordBatch.from_arrays([batch.column("paper_id").take(pa.array(rows)), pa.array([ids[i] for i in numbers], arrow_key), pa.array(at, pa.int32())], ["paper_id", "passage_id", "at"])

        return papers.select("paper_id", "text").mapInArrow(run, f"paper_id {kind}, passage_id {key}, at int")

    block, size = [], 0
    for r in passages.select("passage_id", "text").where("passage_id is not null and text is not null").toLocalIterator(prefetchPartitions=False):
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= limit:
            parts.append(search(block))
            block, size = [], 0
    parts.append(search(block))
    return reduce(DataFrame.union, parts)


def quote_audit(papers: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per paper: displayed quotes checked, and those that the normalised text does not hold."""
    rows = quotes.join(papers.select("paper_id", quote_key("text").alias("_key")), "paper_id")
    held = F.contains(F.col("_key"), quote_key("quote"))
    return rows.groupBy("paper_id").agg(F.count("*").alias("checked"), F.count_if(~held).alias("mismatches"))


def worker_notes(raw: DataFrame, papers: DataFrame, rubric: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, evidence, failures) from worker_raw(paper_id, module_key, content).

    A module fails as a whole if its content is no JSON of the contract (an unknown field counts),
    names an unknown or repeated item, an unknown state, or gives more than eight quotes. Otherwise
    every expected item has one note. A note without a state is ambiguous; observed notes keep
    grounded quotes only, and become ambiguous without any. Observations are kept whole.
    """
    content = unfenced("content")
    parsed = raw.withColumns({"_j": F.from_json(content, NOTE_SCHEMA), "_shaped": shaped(content, NOTE_SHAPE)}).join(papers.select("paper_id", "profile"), "paper_id")
    expected = rubric.groupBy("profile", "module_key").agg(F.collect_set("rubric_item").alias("_items"))
    checked = parsed.join(expected, ["profile", "module_key"], "left")
    notes = F.transform("_j.evidence", lambda n: n.withField("evidence_state", F.coalesce(n["evidence_state"], F.lit("ambiguous"))))
    items = F.transform(notes, lambda n: n["rubric_item"])
    reason = (
        F.when(~F.col("_shaped") | notes.isNull() | F.exists(notes, lambda n: n["rubric_item"].isNull() | n["observation"].isNull()), "no JSON of the contract")
        .when(F.exists(items, lambda i: ~F.array_contains(F.coalesce("_items", F.array().cast("array<string>")), i)), "unknown rubric item")
        .when(F.size(F.array_distinct(items)) < F.size(items), "repeated rubric item")
        .when(F.exists(notes, lambda n: ~n["evidence_state"].isin(*STATES)), "unknown evidence state")
        .when(F.exists(notes, lambda n: F.coalesce(F.size(n["quotes"]) > MAX_QUOTES, F.lit(False))), "too many quotes")
    )
    checked = checked.withColumns({"_reason": reason, "_notes": notes})
    failures = checked.where("_reason is not null").select("paper_id", "module_key", F.col("_reason").alias("reason"))
    rows = checked.where("_reason is null").select("paper_id", "module_key", F.posexplode("_notes").alias("pos", "n")).select("paper_id", "module_key", "pos", "n.*")
    quotes = rows.where("evidence_state = 'observed'").select("paper_id", "module_key", "rubric_item", F.posexplode(F.array_distinct("quotes")).alias("quote_pos", "quote"))
    found = ground(papers, quotes).where("grounded is not null")
    found = found.withColumn("evidence_id", evidence_id(F.col("module_key"), F.col("rubric_item"), F.lit("observed"), F.col("start"), F.col("end"), F.col("grounded")))
    evidence = found.groupBy("paper_id", "module_key", "rubric_item", "evidence_id").agg(F.min("quote_pos").alias("quote_pos"), F.first("grounded").alias("quote"), F.min("start").alias("start"), F.min("end").alias("end"))
    kept = evidence.groupBy("paper_id", "module_key", "rubric_item").agg(F.array_sort(F.collect_list(F.struct("quote_pos", "evidence_id", "quote"))).alias("_q"))
    grid = checked.where("_reason is null").select("paper_id", "profile", "module_key").join(rubric, ["profile", "module_key"])
    joined = grid.join(rows.drop("pos", "quotes"), ["paper_id", "module_key", "rubric_item"], "left").join(kept, ["paper_id", "module_key", "rubric_item"], "left")
    lost = (F.col("evidence_state") == "observed") & F.col("_q").isNull()
    state = F.when(F.col("evidence_state").isNull() | lost, "ambiguous").otherwise(F.col("evidence_state"))
    text = F.when(F.col("evidence_state").isNull(), NO_NOTE).when(lost, UNGROUNDED).otherwise(F.col("observation"))
    notes_out = joined.select("paper_id", "module_key", "item_pos", "rubric_item", text.alias("observation"), state.alias("evidence_state"), F.coalesce(F.col("_q.quote"), F.array().cast("array<string>")).alias("quotes"), F.coalesce(F.col("_q.evidence_id"), F.array().cast("array<string>")).alias("evidence_ids"))
    return notes_out, evidence, failures


def safe_failures(failures: DataFrame, faults: DataFrame) -> DataFrame:
    """failures(paper_id, module_key, reason) with the text that a report shows: where the output is wrong, never what it says.

    faults(paper_id, module_key, pos, location, kind); the first four are named.
    """
    first = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("location", F.lit(":"), "kind").alias("at")))), lambda x: x["at"]), 1, 4), ", ")
    named = faults.groupBy("paper_id", "module_key").agg(first.alias("_at"))
    text = F.when(F.col("_at").isNotNull(), F.concat(F.lit("Invalid structured output ("), "_at", F.lit(")."))).when(F.col("reason").rlike("^(?:unknown|duplicate) rubric item:"), F.concat(F.left("reason", F.lit(200)), F.lit(".")))
    return failures.join(named, ["paper_id", "module_key"], "left").withColumn("text", F.coalesce(text, F.lit("The evidence extraction did not complete."))).drop("_at")


def displayed_notes(notes: DataFrame) -> DataFrame:
    """What a progress view shows of notes: bounded texts and the first two quotes."""
    return notes.withColumn("observation", F.left("observation", F.lit(OBSERVATION_CHARS))).withColumn("quotes", F.transform(F.slice("quotes", 1, SHOWN_QUOTES), lambda q: F.left(q, F.lit(QUOTE_CHARS))))


def reviewer_decisions(raw: DataFrame) -> DataFrame:
    """reviewer_raw(paper_id, attempt, content): the first attempt that keeps the contract, 'initial' before 'schema_repair'; its decisions by position.

    An unknown grade or field makes an attempt break it as a whole.
    """
    content = unfenced("content")
    parsed = raw.withColumns({"_j": F.from_json(content, DECISION_SCHEMA), "_shaped": shaped(content, DECISION_SHAPE)})
    whole = F.forall("_j.assessments", lambda d: d["rubric_item"].isNotNull() & d["explanation"].isNotNull() & F.coalesce(d["grade"].isin(*GRADES), F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.when(F.col("attempt") == "initial", 0).otherwise(1)))
    one = parsed.where(F.col("_shaped") & whole).withColumn("_t", turn).where("_t = 1")
    return one.select("paper_id", (F.col("attempt") != "initial").alias("repaired"), F.posexplode("_j.assessments").alias("pos", "d")).select("paper_id", "repaired", "pos", "d.*")


def final_findings(decisions: DataFrame, papers: DataFrame, rubric: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, run): one finding for the first decision of each expected item, and counts and warnings a paper.

    A grade needs evidence of the same module and item; without any it becomes not assessed.
    decisions(paper_id, pos, rubric_item, grade, explanation, evidence_ids), papers(paper_id, profile, source_quality).
    """
    first = Window.partitionBy("paper_id", "rubric_item").orderBy("pos")
    own = decisions.join(papers.select("paper_id", "profile", "source_quality"), "paper_id").join(rubric, ["profile", "rubric_item"], "left")
    own = own.withColumn("_turn", F.row_number().over(first))
    unknown, repeated = F.col("module_key").isNull(), F.col("module_key").isNotNull() & (F.col("_turn") > 1)
    used = own.where(~unknown & (F.col("_turn") == 1))
    asked = used.select("paper_id", "pos", "module_key", "rubric_item", F.posexplode(F.array_distinct("evidence_ids")).alias("id_pos", "evidence_id"))
    registry = evidence.select("paper_id", "evidence_id", "module_key", "rubric_item", "quote", "start", "end")
    linked = asked.join(registry, ["paper_id", "evidence_id", "module_key", "rubric_item"]).groupBy("paper_id", "pos").agg(F.array_sort(F.collect_list(F.struct("id_pos", "quote", "start", "end"))).alias("_spans"))
    lost = asked.join(registry.select("paper_id", "evidence_id").distinct(), ["paper_id", "evidence_id"], "left_anti").groupBy("paper_id").agg(F.count_distinct("evidence_id").alias("unknown_ids"))
    joined = used.join(linked, ["paper_id", "pos"], "left")
    wants = F.col("grade") != "not_assessed"
    grounded = wants & F.col("_spans").isNotNull()
    grade = F.when(grounded, F.col("grade")).otherwise("not_assessed")
    findings = joined.select(
        "paper_id", "pos", finding_id("module_key", "rubric_item").alias("id"), F.col("module_key").alias("category"), "rubric_item", title_case("rubric_item").alias("title"), "explanation", grade.alias("grade"),
        mapped(grade, SEVERITY).alias("severity"), F.when(grounded, F.bround("source_quality", 2)).otherwise(0.0).alias("confidence"), F.coalesce("_spans", F.array().cast("array<struct<id_pos:int,quote:string,start:int,end:int>>")).alias("paper_spans"),
        F.when(wants & ~grounded, F.array(F.lit(NO_EVIDENCE))).otherwise(F.array().cast("array<string>")).alias("limitations"), F.lit("accepted").alias("critic_disposition"), wants.alias("_wants"), grounded.alias("_grounded"),
    )
    counts = findings.groupBy("paper_id").agg(F.count_if("_wants").alias("attempts"), F.count_if("_grounded").alias("grounded"))
    odd = own.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.when(unknown, F.col("rubric_item")))).alias("unknown_items"), F.array_sort(F.collect_set(F.when(repeated, F.col("rubric_item")))).alias("repeated_items"))
    run = papers.select("paper_id").join(counts, "paper_id", "left").join(odd, "paper_id", "left").join(lost, "paper_id", "left").fillna(0, ["attempts", "grounded", "unknown_ids"])
    return findings.drop("_wants", "_grounded"), run


def validation_warnings(run: DataFrame) -> DataFrame:
    """run(paper_id, repeated_items, unknown_items, unknown_ids) with the sentences that a report shows."""
    # fixed values: the sentences about what an assessment said in vain
    listed = lambda c, text: F.when(F.size(c) > 0, F.concat(F.lit(text), F.array_join(c, ", "), F.lit(".")))
    return run.withColumn("warnings", F.array_compact(F.array(
        listed("repeated_items", "Duplicate final methodology items were ignored: "), listed("unknown_items", "Unknown final methodology item IDs were ignored: "),
        F.when(F.col("unknown_ids") > 0, F.format_string("%d unknown reviewer evidence IDs were ignored.", F.col("unknown_ids"))),
    )))


def _quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"^\[|\]$", "")


def reviewer_payload(papers: DataFrame, modules: DataFrame, rubric: DataFrame, notes: DataFrame, limit: int = REVIEWER_CHARS) -> DataFrame:
    """papers(paper_id, profile) to one JSON text within the limit: an entry for each expected item, in order.

    An entry gains its observation and evidence if the note is observed and cites any; where that
    would pass the limit it stays bare, and the next is tried. A paper's entries are its rubric's
    items, a bounded number. Whether one fits depends on those before it, so they are folded in
    order; bare entries that pass the limit on their own are an error.
    """
    names = F.concat(F.lit('{"module": '), _quoted(F.col("module_key").cast("string")), F.lit(', "rubric_item": '), _quoted(F.col("rubric_item")), F.lit(', "evidence": ['))
    evidence = F.transform(F.arrays_zip("evidence_ids", "quotes"), lambda e: F.concat(F.lit('{"id": '), _quoted(e["evidence_ids"]), F.lit(', "quote": '), _quoted(F.left(e["quotes"], F.lit(QUOTE_CHARS))), F.lit("}")))
    cited = (F.col("evidence_state") == "observed") & (F.size("evidence_ids") > 0)
    more = F.when(cited, F.concat(F.array_join(evidence, ", "), F.lit('], "observation": '), _quoted(F.left("observation", F.lit(OBSERVATION_CHARS))), F.lit("}")))
    # items are listed once a profile and notes once a paper: no row for each item of a paper is made
    asked = rubric.join(modules.select("module_key", "module_pos"), "module_key").groupBy("profile").agg(F.collect_list(F.struct("module_pos", "item_pos", "module_key", "rubric_item", names.alias("names"))).alias("_asked"))
    said = notes.groupBy("paper_id").agg(F.collect_list(F.struct("module_key", "rubric_item", more.alias("more"))).alias("_said"))

    def entries(i: Column) -> Column:
        own = F.transform(F.filter("_said", lambda n: (n["module_key"] == i["module_key"]) & (n["rubric_item"] == i["rubric_item"])), lambda n: n["more"])
        bare = F.concat(i["names"], F.lit("]}"))
        texts = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
        return F.transform(texts, lambda t: F.struct(i["module_pos"].alias("module_pos"), i["item_pos"].alias("item_pos"), bare.alias("bare"), F.coalesce(F.concat(i["names"], t), bare).alias("full")))

    listed = papers.select("paper_id", "profile").join(said, "paper_id", "left").join(F.broadcast(asked), "profile").select("paper_id", F.array_sort(F.flatten(F.transform("_asked", entries))).alias("es"))
    total = F.aggregate("es", F.lit(0), lambda a, e: a + F.length(e["bare"]) + 2)  # two marks around all, and two between each
    listed = listed.withColumn("_bare", F.when(total <= limit, total).otherwise(F.raise_error(F.lit("the bare entries pass the limit")).cast("int")))

    def take(state: Column, e: Column) -> Column:
        more = F.length(e["full"]) - F.length(e["bare"])
        fits = state["used"] + more <= limit
        return F.struct(F.when(fits, state["used"] + more).otherwise(state["used"]).alias("used"), F.array_append(state["out"], F.when(fits, e["full"]).otherwise(e["bare"])).alias("out"), (state["dropped"] + (~fits).cast("int")).alias("dropped"))

    start = F.struct(F.col("_bare").alias("used"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("dropped"))
    packed = listed.withColumn("_p", F.aggregate("es", start, take))
    return packed.select("paper_id", F.concat(F.lit("["), F.array_join("_p.out", ", "), F.lit("]")).alias("payload"), F.col("_p.dropped").alias("dropped"))
