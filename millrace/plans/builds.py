"""Builds: whole data sets written to a folder, with their reports and manifests.

Each build reads frames, writes Parquet or JSON lines below a folder that must not hold anything yet, and a manifest with
counts, digests of id sets and of the files. What a manifest collects is bounded: one row for each split, source or reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import assemble, packing, sft, stats, tokenize
from ..scratch import Scratch
from ..session import ship
from ..sources import files, reports, shards

SPLITS = ("train", "validation", "test")


def fresh(spark: SparkSession, folder: str) -> None:
    """A build never writes over another one."""
    if reports.exists(spark, f"{folder}/manifest.json"):
        raise FileExistsError(f"{folder} holds a build already")


def unique_ids(df: DataFrame, key: str, what: str) -> DataFrame:
    """df, with an error at run time if an id is missing, empty or stands twice."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col(key).cast("string") == "") | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: missing or repeated id {bad[0][key]!r}")
    return df


def id_digest(df: DataFrame, key: str) -> tuple[int, str]:
    found = assemble.id_set_hash(df.select(F.col(key).cast("string").alias("_id")), "_id").first()
    return found["ids"], found["ids_sha256"]


@dataclass(frozen=True)
class InstructionBuild:
    """How an instruction-tuning set is built; ids of the tokenizer's special tokens, and what its sources must be."""

    tokenizer: str
    bos: int
    eos: int
    pad: int
    length: int = 1024
    validation: float = 0.05
    test: float = 0.0
    seed: int = 42
    sources: Sequence[str] = ()
    least: int = 0


def prepare_instructions(df: DataFrame, c: InstructionBuild, order: str = "line") -> tuple[DataFrame, DataFrame]:
    """(examples, rejected): parsed, encoded, deduplicated and split records of df(order, id, source, text, ..), in its order.

    The sources that are left must be exactly c.sources (if given), each with c.least examples, and no split may be empty.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "instructions")
    parsed = sft.parse(df)
    usable = sft.encode_unpadded(parsed.where("parse_error is null"), c.tokenizer, c.length, c.bos, c.eos)
    usable = scratch.save(usable.drop("parse_error", "prompt"), "encoded")
    good = sft.deduplicate(sft.prompt_group(usable.where("unpadded.error is null")), order)
    good = scratch.save(good, "deduplicated")
    of = lambda frame, reason: frame.select(order, "id", "source", reason.alias("reason"))
    rejected = of(parsed.where("parse_error is not null"), F.col("parse_error")).union(of(usable.where("unpadded.error is not null"), F.col("unpadded.error"))).union(of(good.where("rejection is not null"), F.col("rejection")))
    kept = good.where("rejection is null").drop("rejection").withColumn("source", F.coalesce("source", F.lit("unknown")))
    counts = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if c.sources and sorted(counts) != sorted(c.sources):
        raise ValueError(f"sources {sorted(counts)} are not those of the contract {sorted(c.sources)}")
    if short := {s: n for s, n in sorted(counts.items()) if n < c.least}:
        raise ValueError(f"sources below {c.least} examples: {short}")
    out = scratch.save(sft.split_groups(kept, c.validation, c.test, c.seed), "split")
    there = {r["split"] for r in out.select("split").distinct().collect()}
    wanted = {"train", "validation", *(["test"] if c.test else [])}
    if counts and wanted - there:
        raise ValueError(f"empty splits: {', '.join(sorted(wanted - there))}")
    return out.withColumn("encoded", sft.padded(F.col("unpadded"), c.length, c.pad)).drop("unpadded"), rejected


def example_report(examples: DataFrame) -> DataFrame:
    """One row per split: examples, what was cut, supervised and prompt tokens, percentiles of lengths."""
    active = F.aggregate("encoded.attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))
    marks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
    spread = [F.percentile(x, F.lit(q)).alias(f"{n}_{m}") for n, x in (("sequence", active), ("response", F.col("encoded.response_tokens"))) for m, q in marks.items()]
    cut = {"truncated": F.col("encoded.context_truncated") | F.col("encoded.response_truncated"), "context_truncated": F.col("encoded.context_truncated"), "response_truncated": F.col("encoded.response_truncated")}
    sums = [F.sum(f"encoded.{n}").alias(m) for n, m in (("response_tokens", "supervised_tokens"), ("prompt_tokens", "prompt_tokens"))]
    return examples.groupBy("split").agg(F.count("*").alias("examples"), *(F.count_if(c).alias(n) for n, c in cut.items()), *sums, *spread)


def build_instructions(df: DataFrame, c: InstructionBuild, folder: str, order: str = "line") -> dict:
    """Write examples (by split), rejected records and the manifest of an instruction-tuning set."""
    spark = df.sparkSession
    fresh(spark, folder)
    examples, rejected = prepare_instructions(df, c, order)
    out = examples.select("*", *(F.col(f"encoded.{n}").alias(n) for n in ("input_ids", "attention_mask", "labels", "context_truncated", "response_truncated"))).drop("encoded")
    files.write_jsonl(rejected, f"{folder}/rejected")
    # ordered within a split by source and id, as arrays are read by place
    out.repartitionByRange("split", "source", "id").sortWithinPartitions("split", "source", "id").write.mode("errorifexists").partitionBy("split").parquet(f"{folder}/examples")
    splits = {r["split"]: r for r in reports.rows(example_report(examples))}
    for split, r in splits.items():
        mine = examples.where(F.col("split") == split)
        r["ids"], r["id_sha256"] = id_digest(mine, "id")
        r["prompt_groups"], r["prompt_group_sha256"] = id_digest(mine, "prompt_group")
        r["sources"] = {x["source"]: x["count"] for x in mine.groupBy("source").count().collect()}
    made = {
        "dataset_type": "response_only_supervised_fine_tuning", "format_version": 2, "template_version": "instruction_input_response_v1", "tokenizer": c.tokenizer, "max_length": c.length, "ignore_index": sft.IGNORE,
        "validation_fraction": c.validation, "test_fraction": c.test, "split_seed": c.seed, "expected_sources": sorted(c.sources), "minimum_examples_per_source": c.least, "rejected": {r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()},
        "overlaps": {k: reports.rows(sft.overlaps(examples, k)) for k in ("id", "prompt_group")}, "splits": splits, "artifacts": reports.artifacts(spark, f"{folder}/examples"),
    }
    reports.write_json(spark, f"{folder}/manifest.json", made)
    return made


def read_instructions(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """(id, source, input_ids, attention_mask, labels) of one split as 64-bit arrays, in the order of source and id."""
    rows = spark.read.parquet(f"{folder}/examples").where(F.col("split") == split)
    return rows.select("id", "source", *(F.col(n).cast("array<bigint>").alias(n) for n in ("input_ids", "attention_mask", "labels"))).orderBy("source", "id")


def check_instructions(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with a written set: rows against the rules, counts and digests against the manifest; empty if nothing is."""
    known = reports.read_json(spark, f"{folder}/manifest.json")
    rows = spark.read.parquet(f"{folder}/examples")
    t = tokenize.load(known["tokenizer"])
    found = [f"{r['split']}: {r['violation']} ({r['examples']})" for r in sft.violations(rows, known["max_length"], t.get_vocab_size(), _end(rows)).collect()]
    for split, r in known["splits"].items():
        mine = rows.where(F.col("split") == split)
        for key, digest in (("id", "id_sha256"), ("prompt_group", "prompt_group_sha256")):
            if id_digest(mine, key)[1] != r[digest]:
                found.append(f"{split}: digest of {key} differs")
        supervised = mine.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("labels", lambda x: x != sft.IGNORE))).alias("s")).first()
        if (supervised["n"], supervised["s"]) != (r["examples"], r["supervised_tokens"]):
            found.append(f"{split}: {supervised['n']} examples with {supervised['s']} supervised tokens, not {r['examples']} with {r['supervised_tokens']}")
    if known["test_fraction"] and "test" not in known["splits"]:
        found.append("no sealed test split")
    return found + reports.verify(spark, f"{folder}/examples", known["artifacts"])


def _end(rows: DataFrame) -> int:
    """The last supervised id, which must be the same in all rows; any of them is taken."""
    last = rows.select(F.element_at(F.filter("labels", lambda x: x != sft.IGNORE), -1).alias("e")).where("e is not null").first()
    return last["e"] if last else -1


@dataclass(frozen=True)
class CorpusBuild:
    """How the final corpus is put together."""

    review_policy: str = "include"
    most_per_input: int | None = None
    characters_per_token: float = 4.0
    tokenizer_split: str = "train"
    flatten: bool = True
    separator: str = "\n"

    def __post_init__(self) -> None:
        if self.review_policy not in ("include", "exclude"):
            raise ValueError(f"review_policy must be include or exclude, not {self.review_policy!r}")
        if self.most_per_input is not None and self.most_per_input < 1:
            raise ValueError("most_per_input must be positive")
        if self.characters_per_token <= 0:
            raise ValueError("characters_per_token must be positive")
        if self.tokenizer_split not in SPLITS:
            raise ValueError(f"no split {self.tokenizer_split!r}")


@dataclass(frozen=True)
class Input:
    """One input of a corpus: a data set's split and the split of the corpus that it goes to."""

    dataset: str
    source_split: str
    output_split: str
    frame: DataFrame = field(compare=False, repr=False)


def check_inputs(inputs: Sequence[Input]) -> None:
    if not inputs:
        raise ValueError("a corpus needs inputs")
    seen = set()
    for i in inputs:
        if i.output_split not in SPLITS:
            raise ValueError(f"no output split {i.output_split!r}")
        key = (i.dataset, i.source_split, i.output_split)
        if key in seen:
            raise ValueError(f"input {i.dataset}/{i.source_split} -> {i.output_split} stands twice")
        seen.add(key)


def judged_inputs(inputs: Sequence[Input], c: CorpusBuild, order: str = "ord") -> DataFrame:
    """All rows of all inputs with dataset, source_split, output_split and exclusions (empty: taken); limits count before any filter."""
    check_inputs(inputs)
    out = None
    for i in inputs:
        rows = i.frame.select(F.lit(i.dataset).alias("dataset"), F.lit(i.source_split).alias("source_split"), F.lit(i.output_split).alias("output_split"), "*")
        if c.most_per_input is not None:
            rows = assemble.limit_each(rows, "dataset", order, c.most_per_input)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("exclusions", assemble.exclusion_reasons(include_review=c.review_policy == "include"))


def corpus_report(judged: DataFrame) -> DataFrame:
    """(output_split, dataset, source_split, input_documents, output_documents, excluded_documents)."""
    taken = F.size("exclusions") == 0
    return judged.groupBy("output_split", "dataset", "source_split").agg(F.count("*").alias("input_documents"), F.count_if(taken).alias("output_documents"), F.count_if(~taken).alias("excluded_documents"))


def build_corpus(inputs: Sequence[Input], c: CorpusBuild, folder: str, order: str = "ord") -> dict:
    """Write train, validation and test, the excluded records, the text for tokenizers, statistics and the manifest."""
    spark = inputs[0].frame.sparkSession if inputs else None
    check_inputs(inputs)
    ship(spark)
    fresh(spark, folder)
    judged = Scratch(spark, "corpus").save(judged_inputs(inputs, c, order), "judged")
    taken = judged.where(F.size("exclusions") == 0).drop("exclusions")
    counts = {s: files.write_jsonl(taken.where(F.col("output_split") == s), f"{folder}/{s}.jsonl") for s in SPLITS}
    excluded = judged.where(F.size("exclusions") > 0).select("dataset", "source_split", "output_split", "doc_id", "exclusions")
    files.write_jsonl(excluded, f"{folder}/excluded.jsonl")
    text = taken.where(F.col("output_split") == c.tokenizer_split)
    files.write_corpus(text, f"{folder}/tokenizer_corpus", order, c.flatten, c.separator)
    reasons = excluded.select("output_split", F.explode("exclusions").alias("reason")).groupBy("output_split", "reason").count()
    numbers = stats.corpus_statistics(taken.withColumnRenamed("output_split", "split"), "split")
    made = {
        "pipeline_stage": "final_corpus_assembly", "review_policy": c.review_policy, "max_documents_per_input": c.most_per_input, "documents": counts, "inputs": reports.rows(corpus_report(judged)),
        "exclusion_reasons": reports.rows(reasons), "statistics": reports.rows(numbers), "totals": reports.rows(stats.totals(taken.withColumnRenamed("output_split", "split"), "split")),
        "artifacts": {name: reports.artifacts(spark, f"{folder}/{name}") for name in (*(f"{s}.jsonl" for s in SPLITS), "excluded.jsonl", "tokenizer_corpus")},
    }
    reports.write_json(spark, f"{folder}/manifest.json", made)
    return made


@dataclass(frozen=True)
class Phase:
    """One phase of a corpus: token targets by source, or (without targets) a balanced mixture of its sources."""

    sources: Sequence[str]
    targets: Mapping[str, int] = field(default_factory=dict)
    exclude: Sequence[str] = ()


def phase_rows(df: DataFrame, phase: Phase, excluded: DataFrame, tokens: str = "tokens", order: str = "doc_id", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a phase over df(source, order, key, text, tokens); rows of excluded(key) are passed over.

    A balanced phase takes as many rows of every source as the smallest has; position tells their round-robin order.
    """
    spark = df.sparkSession
    mine = df.where(F.col("source").isin(list(phase.sources)))
    there = {r["source"] for r in mine.select("source").distinct().collect()}
    if lacking := sorted(set(phase.sources) - there):
        raise FileNotFoundError(f"no rows of {', '.join(lacking)}")
    if not phase.targets:
        out = assemble.round_robin(mine, "source", order)
        return out, out.groupBy("source").agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"))
    targets = spark.createDataFrame([(s, int(phase.targets[s])) for s in phase.sources], "source string, target long")
    taken, report = assemble.token_budget(mine, targets, excluded.select(F.col(key).alias(order)) if key != order else excluded.select(order), order=order, tokens=tokens)
    return taken, report


def build_phases(df: DataFrame, phases: Mapping[str, Phase], folder: str, chosen: Sequence[str] | None = None, order: str = "doc_id") -> dict:
    """Write the chosen phases (all without a choice) one after the other; the manifest keeps earlier reports of other phases.

    A phase passes over the ids of the phases that it excludes, which must be there. An id that a phase selects twice is an error.
    """
    spark = df.sparkSession
    ship(spark)
    if unknown := sorted(set(chosen or ()) - set(phases)):
        raise ValueError(f"unknown phases: {', '.join(unknown)}")
    path, done = f"{folder}/manifest.json", {}
    if chosen is not None and reports.exists(spark, path):
        done = dict(reports.read_json(spark, path).get("phases", {}))
    for name, phase in phases.items():
        if chosen is not None and name not in chosen:
            continue
        out = None
        for other in phase.exclude:
            if not reports.exists(spark, f"{folder}/{other}/train"):
                raise FileNotFoundError(f"phase {name} excludes {other}, which isn't there")
            ids = unique_ids(spark.read.parquet(f"{folder}/{other}/train").select(order), order, other)
            out = ids if out is None else out.union(ids)
        rows, report = phase_rows(df, phase, out if out is not None else df.select(order).where("false"), order=order)
        files.write_immutable(rows, f"{folder}/{name}/train")
        written = unique_ids(spark.read.parquet(f"{folder}/{name}/train"), order, name)
        files.write_corpus(written, f"{folder}/{name}/corpus", order)
        n, digest = id_digest(written, order)
        done[name] = {"documents": n, "document_id_sha256": digest, "excluded_phases": list(phase.exclude), "balanced": not phase.targets, "sources": reports.rows(report)}
    made = {"phases": done, "selected_phases": list(chosen) if chosen is not None else None}
    reports.write_json(spark, path, made, replace=True)
    return made


def build_evaluation(df: DataFrame, sizes: Mapping[str, Mapping[str, int]], excluded: DataFrame, folder: str, order: str = "doc_id") -> dict:
    """Write disjoint evaluation splits of unused documents: for each split the token targets of its sources.

    Each source's rows are taken in order, one split after the other; a source that ends before its target is an error.
    """
    spark = df.sparkSession
    ship(spark)
    fresh(spark, folder)
    unused = df.join(excluded.select(order).distinct(), order, "left_anti").where(~T.blank(F.coalesce("text", F.lit(""))))
    scratch, made = Scratch(spark, "evaluation"), {}
    rest = scratch.save(unused, "unused")
    for split, targets in sizes.items():
        if not targets or any(t <= 0 for t in targets.values()):
            raise ValueError(f"split {split} needs positive targets")
        wanted = spark.createDataFrame([(s, int(t)) for s, t in targets.items()], "source string, target long")
        run = assemble.running_total(rest.join(F.broadcast(wanted), "source"), "source", order, "tokens", "total")
        mine = scratch.save(run.where(F.col("total") - F.col("tokens") < F.col("target")), split)
        got = {r["source"]: r.asDict() for r in mine.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).collect()}
        for source, target in targets.items():
            if got.get(source, {"tokens": 0})["tokens"] < target:
                raise ValueError(f"source {source} was exhausted while building {split}")
        files.write_jsonl(mine.select(*df.columns), f"{folder}/{split}.jsonl")
        n, digest = id_digest(mine, order)
        made[split] = {"documents": n, "document_id_sha256": digest, "sources": {s: {**r, "target": targets[s]} for s, r in got.items()}, "artifacts": reports.artifacts(spark, f"{folder}/{split}.jsonl")}
        rest = scratch.save(rest.join(mine.select(order), order, "left_anti"), "rest")
    out = {"method": "source_stratified_document_disjoint", "splits": made}
    reports.write_json(spark, f"{folder}/manifest.json", out)
    return out


@dataclass(frozen=True)
class TokenBuild:
    """How splits are tokenized and packed into binary shards."""

    tokenizer: str
    eos: int
    width: int = 1024
    per_shard: int = 8192
    kind: str = "auto"


def token_stream(df: DataFrame, c: TokenBuild, order: str = "doc_id") -> DataFrame:
    """(order, ids) of documents with text: the ids and the end; blank documents are left out."""
    rows = df.where(~T.blank(F.coalesce("text", F.lit("")))).select(order, T.strip(F.col("text")).alias("text"))
    return rows.select(order, F.concat(tokenize.encode(F.col("text"), c.tokenizer), F.array(F.lit(c.eos))).alias("ids"))


def build_tokens(splits: Mapping[str, DataFrame], c: TokenBuild, folder: str, order: str = "doc_id") -> dict:
    """Write packed shards of each split with their statistics and the manifest; a split without a whole record is an error."""
    if not splits:
        raise ValueError("there are no splits")
    spark = next(iter(splits.values())).sparkSession
    ship(spark)
    fresh(spark, folder)
    vocabulary, made = tokenize.load(c.tokenizer).get_vocab_size(), {}
    kind = packing.token_type(vocabulary, c.kind)
    scratch = Scratch(spark, "tokens")
    for split, df in splits.items():
        stream = scratch.save(packing.checked(token_stream(df, c, order), vocabulary), split)
        numbers = packing.statistics(stream, c.width).first().asDict()
        if not numbers["documents"]:
            raise ValueError(f"split {split} has no usable document")
        if not numbers["records"]:
            raise ValueError(f"split {split} has too few tokens for one record of {c.width + 1}")
        seen = df.count()
        found = scratch.save(shards.write_shards(packing.pack(stream, c.width, order, per_shard=c.per_shard), f"{folder}/{split}", vocabulary, c.kind), f"{split}-shards")
        made[split] = {"documents_seen": seen, "empty_documents": seen - numbers["documents"], **numbers, "shards": found.count(), "records_written": found.agg(F.sum("records")).first()[0], "artifacts": reports.artifacts(spark, f"{folder}/{split}")}
    out = {"format_version": 1, "tokenizer": c.tokenizer, "vocabulary": vocabulary, "eos": c.eos, "width": c.width, "records_per_shard": c.per_shard, "dtype": kind, "splits": made, "total_tokens": sum(s["tokens"] for s in made.values())}
    reports.write_json(spark, f"{folder}/manifest.json", out)
    return out


def check_tokenizer(path: str, special: Mapping[str, str], size: int | None = None) -> list[str]:
    """What is wrong with a tokenizer file: special tokens must be given, be distinct and single ids, and a text must come back."""
    names = ("pad_token", "unknown_token", "beginning_of_sequence_token", "end_of_sequence_token")
    found = [f"{n} is missing" for n in names if not special.get(n)]
    if len(set(special.values())) < len(special):
        found.append("special tokens must differ")
    t = tokenize.load(path)
    found += [f"{n} {x!r} isn't in the vocabulary" for n, x in special.items() if x and t.token_to_id(x) is None]
    if size is not None and t.get_vocab_size() > size:
        found.append(f"the vocabulary has {t.get_vocab_size()} entries, more than {size}")
    sample = "A patient, 42 years old: 1.5 mg/kg."
    if t.decode(t.encode(sample, add_special_tokens=False).ids).strip() != sample:
        found.append("a text doesn't come back")
    return found

