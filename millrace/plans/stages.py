"""The data-preparation run: nine stages in order, each of which can begin or end it.

    python -m millrace.plans.stages --input docs.parquet --output out --start-at clean --stop-after quality

A stage reads the Parquet output of the one before it and writes its own, with what it diverts beside it, to folders
that must not exist; so a run can be taken up again at any stage.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import assemble, clean as cleaning, dedup, language, licensing, quality, toxicity
from ..session import ship

Stage = Callable[[DataFrame, dict], tuple[DataFrame, DataFrame | None]]


def clean(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
    out = cleaning.clean(df, c.get("cleaning", cleaning.CleaningPolicy()))
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select("doc_id", "reason")


def _exact(by: list[str]) -> Stage:
    def run(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
        out = dedup.mark_exact(df, [x for x in by if x in df.columns], form=c.get("form", "NFKC"))
        return out.where("outcome = 'kept'").drop("outcome", "content_hash"), out.where("outcome <> 'kept'").select("doc_id", "content_hash", "outcome")

    return run


def near_dedup(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
    members, reps = dedup.classes_of(dedup.shingles(df, "doc_id", size=c.get("shingle", 5), min_words=c.get("min_words", 20)), "doc_id")
    gone = dedup.greedy_removed(members, dedup.similar_classes(reps, c.get("similarity", 0.9))).withColumnRenamed("k", "doc_id")
    return df.join(gone, "doc_id", "left_anti"), gone


def verify_language(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
    """c["detector"] makes a detector; without one the lang column is believed."""
    p = c.get("language", language.LanguagePolicy())
    if "detector" in c:
        said = language.predictor(c["detector"], p.top_k)(language.sample(F.col("text"), p.sample_characters))
    else:
        said = F.array(F.struct(F.col("lang").alias("language"), F.lit(1.0).alias("confidence")))
    out = language.decide(df.withColumn("predictions", said), p)
    return out.where("language_keep").drop("predictions", "language_keep", "language_reason"), out.where("not language_keep").select("doc_id", "language_reason", F.substring("text", 1, 300).alias("text_preview"))


def filter_quality(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
    return quality.split_decisions(quality.evaluate(df, c.get("quality", quality.QualityPolicy())))


def validate_licenses(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame | None]:
    """Without a policy in c["license"], a source's word is taken and every row passes."""
    if "license" not in c:
        return df.withColumn("license_decision", F.lit("pass")), None
    out = licensing.obligations(licensing.decide(licensing.normalize(df, c["license"]), c["license"]), c["license"])
    return out.where("license_decision <> 'reject'"), out.where("license_decision = 'reject'").select("doc_id", "license_reasons", F.substring("text", 1, 300).alias("text_preview"))


def audit_toxicity(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame | None]:
    """Annotates; only an automatic reject takes rows out. c["scorer"] makes a model, which scores chunks; without one nothing is scored."""
    p = c.get("toxicity", toxicity.ToxicityPolicy())
    scored = toxicity.predict(df, c["scorer"], **c.get("chunks", {})) if "scorer" in c else df.withColumns({"scores": F.expr("cast(map() as map<string, double>)"), "chunks_processed": F.lit(0)})
    out = toxicity.decide(toxicity.context(scored, p), p)
    return out.where("decision <> 'reject'"), out.where("decision = 'reject'").select("doc_id", "maximum_label", "maximum_score", F.substring("text", 1, 500).alias("text_preview"))


def assembly(df: DataFrame, c: dict) -> tuple[DataFrame, DataFrame]:
    out = df.withColumn("exclusions", assemble.exclusion_reasons(include_review=c.get("include_review", True)))
    return out.where(F.size("exclusions") == 0).drop("exclusions"), out.where(F.size("exclusions") > 0).select("doc_id", "exclusions")


STAGES: dict[str, Stage] = {
    "clean": clean, "exact_dedup": _exact(["source", "doc_id"]), "global_dedup": _exact(["doc_id"]), "near_dedup": near_dedup, "language": verify_language,
    "quality": filter_quality, "license": validate_licenses, "toxicity": audit_toxicity, "assembly": assembly,
}


def chosen(start_at: str | None = None, stop_after: str | None = None) -> list[str]:
    names = list(STAGES)
    a, b = names.index(start_at) if start_at else 0, names.index(stop_after) if stop_after else len(names) - 1
    if b < a:
        raise ValueError(f"{stop_after} comes before {start_at}")
    return names[a : b + 1]


def run(spark: SparkSession, source: str, output: str, start_at: str | None = None, stop_after: str | None = None, config: dict | None = None) -> DataFrame:
    """Run the chosen stages; the last one's output as read from its folder."""
    ship(spark)
    names, todo = list(STAGES), chosen(start_at, stop_after)
    first = names.index(todo[0])
    path = f"{output}/{first - 1:02d}-{names[first - 1]}/kept" if first else source
    for k, name in enumerate(todo, first):
        kept, diverted = STAGES[name](spark.read.parquet(path), config or {})
        path = f"{output}/{k:02d}-{name}/kept"
        kept.write.mode("errorifexists").parquet(path)
        if diverted is not None:
            diverted.write.mode("errorifexists").parquet(f"{output}/{k:02d}-{name}/diverted")
    return spark.read.parquet(path)


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--start-at", choices=list(STAGES))
    p.add_argument("--stop-after", choices=list(STAGES))
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    print(run(spark, a.input, a.output, a.start_at, a.stop_after).count())


if __name__ == "__main__":
    main()
