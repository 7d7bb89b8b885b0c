"""Command line: python -m millrace.cli <command> ...; every command is a call of the functions of the same name.

Frames are read from Parquet, or from JSON lines where the path ends in .json or .jsonl. Configurations are YAML or JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import assemble, select, sft, stats, tokenize
from .plans import builds, stages
from .sources import ingest, reports

#: Commands that run one stage, by the stage's name.
STAGES = {"clean": "clean", "dedup": "exact_dedup", "global-dedup": "global_dedup", "near-dedup": "near_dedup", "language": "language", "quality": "quality", "license": "license", "toxicity": "toxicity", "assembly": "assembly"}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def shown(value: object) -> None:
    print(json.dumps(value, indent=2, default=str, ensure_ascii=False))


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    config = ingest.load_config(a.config)
    names = sorted(config["datasets"]) if a.dataset == "all" else [a.dataset]
    shown({name: ingest.ingest(spark, config, name) for name in names})


def run_stage(spark: SparkSession, a: argparse.Namespace) -> None:
    kept, diverted = stages.STAGES[STAGES[a.command]](read(spark, a.input), ingest.load_config(a.config, "stage")["stage"] if a.config else {})
    kept.write.mode("errorifexists").parquet(f"{a.output}/kept")
    if diverted is not None:
        diverted.write.mode("errorifexists").parquet(f"{a.output}/diverted")
    shown({"kept": spark.read.parquet(f"{a.output}/kept").count()})


def run_pipeline(spark: SparkSession, a: argparse.Namespace) -> None:
    shown({"rows": stages.run(spark, a.input, a.output, a.start_at, a.stop_after).count()})


def counted(df: DataFrame, tokenizer: str | None) -> DataFrame:
    """df with tokens: exact ones with the document's end where a tokenizer is given, else an estimate."""
    return df.withColumn("tokens", tokenize.token_count(F.col("text"), tokenizer) if tokenizer else assemble.token_estimate(F.col("text")))


def run_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    config = ingest.load_config(a.config, "corpus")["corpus"]
    inputs = [builds.Input(str(e["dataset"]), str(e["source_split"]), str(e["output_split"]), ingest.numbered(read(spark, e["input_path"])).withColumnRenamed("source_index", "ord")) for e in config["inputs"]]
    known = {k: config[k] for k in ("review_policy", "most_per_input", "characters_per_token", "tokenizer_split", "flatten", "separator") if k in config}
    shown(builds.build_corpus(inputs, builds.CorpusBuild(**known), a.output)["documents"])


def run_phases(spark: SparkSession, a: argparse.Namespace) -> None:
    config = ingest.load_config(a.config, "corpora")["corpora"]
    made = {}
    for name, c in config.items():
        targets = {s: int(v["tokens"]) for s, v in c["sources"].items()} if "target_tokens" in c else {}
        made[name] = builds.Phase(tuple(c["sources"]), targets, tuple(c.get("exclude_phases", ())))
    shown(builds.build_phases(counted(read(spark, a.input), a.tokenizer), made, a.output, a.phase or None)["phases"])


def run_evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    config = ingest.load_config(a.config, "splits")["splits"]
    sizes = {name: {s: int(v["tokens"]) for s, v in c["sources"].items()} for name, c in config.items()}
    used = read(spark, a.exclude).select("doc_id") if a.exclude else read(spark, a.input).select("doc_id").where("false")
    shown(builds.build_evaluation(counted(read(spark, a.input), a.tokenizer), sizes, used, a.output)["splits"])


def run_tokens(spark: SparkSession, a: argparse.Namespace) -> None:
    splits = {s: read(spark, p) for s, p in (x.split("=", 1) for x in a.split)}
    shown(builds.build_tokens(splits, builds.TokenBuild(a.tokenizer, a.eos, a.width, a.per_shard, a.kind), a.output)["splits"])


def run_tokenizer_check(spark: SparkSession, a: argparse.Namespace) -> None:
    found = builds.check_tokenizer(a.tokenizer, json.loads(a.special))
    shown(found)
    sys.exit(bool(found))


def run_tokenizer_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = read(spark, a.input).select("text", F.coalesce("source", F.lit("unknown")).alias("source"))
    found = {t: reports.rows(tokenize.metrics(docs, t, "source")) for t in a.tokenizer}
    if a.output:
        reports.write_json(spark, f"{a.output}/metrics.json", found)
        reports.write_text(spark, f"{a.output}/metrics.md", reports.markdown("Tokenizer metrics", found))
    shown(found)


def run_sft_prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    config = ingest.load_config(a.config, "build")["build"]
    rows = ingest.numbered(read(spark, a.input)).withColumnRenamed("source_index", "line")
    shown(builds.build_instructions(rows, builds.InstructionBuild(**config), a.output)["splits"])


def run_sft_check(spark: SparkSession, a: argparse.Namespace) -> None:
    found = builds.check_instructions(spark, a.input)
    shown(found)
    sys.exit(bool(found))


def run_sft_audit(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(f"{a.input}/examples")
    for c in ("license", "license_decision"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    found = {"licenses": reports.rows(select.license_summary(rows)), "overlaps": reports.rows(sft.overlaps(rows, "prompt_group"))}
    if a.output:
        reports.write_text(spark, a.output, reports.markdown("Audit of an instruction-tuning set", found))
    shown(found)


def run_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    shown(reports.rows(stats.corpus_statistics(read(spark, a.input), *([a.by] if a.by else []))))


def run_verify(spark: SparkSession, a: argparse.Namespace) -> None:
    found = reports.verify(spark, a.input, json.loads(reports.read_text(spark, a.inventory)))
    shown(found)
    sys.exit(bool(found))


def run_inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    reports.write_text(spark, a.output, json.dumps(reports.artifacts(spark, a.input), indent=2))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *needed: str, **optional) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for n in needed:
            one.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            one.add_argument(f"--{n.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return one

    command("ingest", run_ingest, "config", dataset="all")
    for name in STAGES:
        command(name, run_stage, "input", "output", config=None)
    command("pipeline", run_pipeline, "input", "output", start_at=None, stop_after=None)
    command("corpus", run_corpus, "config", "output")
    command("phases", run_phases, "input", "config", "output", tokenizer=None).add_argument("--phase", action="append")
    command("evaluation", run_evaluation, "input", "config", "output", tokenizer=None, exclude=None)
    command("tokens", run_tokens, "tokenizer", "output", eos=0, width=1024, per_shard=8192, kind="auto").add_argument("--split", action="append", required=True, help="name=path")
    command("tokenizer-check", run_tokenizer_check, "tokenizer", special="{}")
    command("tokenizer-metrics", run_tokenizer_metrics, "input", output=None).add_argument("--tokenizer", action="append", required=True)
    command("sft-prepare", run_sft_prepare, "input", "config", "output")
    command("sft-check", run_sft_check, "input")
    command("sft-audit", run_sft_audit, "input", output=None)
    command("statistics", run_statistics, "input", by=None)
    command("inventory", run_inventory, "input", "output")
    command("verify", run_verify, "input", "inventory")
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("millrace").getOrCreate(), a)


if __name__ == "__main__":
    main()
