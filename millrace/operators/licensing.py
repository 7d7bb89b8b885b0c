"""Licence validation: identifiers, aliases, composite fields, policies and obligations, all as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: The actions of a policy and what separates licences in one field.
ACTIONS = ("pass", "review", "reject")
SEPARATOR = r"(?i)\s*(?:,|;|\+|\||\band\b)\s*"


def canonical(c: Column) -> Column:
    """Lower case with single hyphens for everything but letters a-z and digits, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_text(value: str) -> str:
    return re.sub("[^a-z0-9]+", "-", value.casefold().strip()).strip("-")


@dataclass(frozen=True)
class License:
    aliases: Sequence[str] = ()
    allowed: bool = True
    requires_review: bool = False
    attribution_required: bool = False
    share_alike_required: bool = False
    commercial_use: bool = True
    redistribution: bool = True


@dataclass(frozen=True)
class DatasetPolicy:
    accepted: Sequence[str]
    require_all: bool = False


@dataclass(frozen=True)
class LicensePolicy:
    licenses: Mapping[str, License]
    datasets: Mapping[str, DatasetPolicy]
    missing: str = "reject"
    unknown: str = "reject"
    mismatch: str = "review"
    lookup: Mapping[str, str] = field(init=False)

    def __post_init__(self) -> None:
        if not {self.missing, self.unknown, self.mismatch} <= set(ACTIONS):
            raise ValueError(f"actions must be of {', '.join(ACTIONS)}")
        lookup: dict[str, str] = {}
        for name, license_ in self.licenses.items():
            for alias in (name, *license_.aliases):
                key = canonical_text(alias)
                if not key:
                    continue
                if lookup.setdefault(key, name) != name:
                    raise ValueError(f"alias {alias!r} stands for both {lookup[key]} and {name}")
        object.__setattr__(self, "lookup", lookup)


def _parts(c: Column, table: Column) -> Column:
    """The identifiers of one licence field; one that is an alias as a whole isn't split, so aliases may hold the word `and`."""
    whole = F.element_at(table, canonical(c))
    cut = F.filter(F.transform(F.split(F.trim(c), SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(T.blank(F.coalesce(c, F.lit(""))), F.expr("cast(array() as array<string>)")).when(whole.isNotNull(), F.array(whole)).when(F.size(cut) > 0, cut).otherwise(F.array(F.trim(c)))


def normalize(df: DataFrame, p: LicensePolicy, column: str = "license") -> DataFrame:
    """Adds declared (recognised licences, each once, in order) and unknown_ids of a column of strings or of lists of strings.

    A value of any other type is one unknown identifier.
    """
    table = F.create_map(*(F.lit(x) for kv in p.lookup.items() for x in kv))
    kind = df.schema[column].dataType.simpleString()
    if kind == "array<string>":
        parts = F.flatten(F.transform(F.coalesce(F.col(column), F.expr("cast(array() as array<string>)")), lambda x: _parts(x, table)))
    elif kind == "string":
        parts = _parts(F.col(column), table)
    else:
        parts = F.array_compact(F.array(F.col(column).cast("string")))
    df = T.let(df, l_parts=parts)
    known = lambda x: F.element_at(table, canonical(x)) if kind in ("string", "array<string>") else F.lit(None).cast("string")
    return df.withColumns({"declared": F.array_distinct(F.filter(F.transform("l_parts", known), lambda x: x.isNotNull())), "unknown_ids": F.filter("l_parts", lambda x: known(x).isNull())}).drop("l_parts")


def missing(df: DataFrame, column: str) -> Column:
    """Whether a licence field says nothing: null, blank, or a list without a text."""
    if df.schema[column].dataType.simpleString() == "array<string>":
        return ~F.exists(F.coalesce(F.col(column), F.expr("cast(array() as array<string>)")), lambda x: ~T.blank(F.coalesce(x, F.lit(""))))
    return T.blank(F.coalesce(F.col(column).cast("string"), F.lit("")))


def decide(df: DataFrame, p: LicensePolicy, dataset: str = "dataset", column: str = "license") -> DataFrame:
    """Adds license_decision, license_status, license_reasons, missing_ids and unexpected_ids to normalised rows."""
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    accepted, every = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")
    for name, rule in p.datasets.items():
        accepted = F.when(F.col(dataset) == name, names(rule.accepted)).otherwise(accepted)
        every = F.when(F.col(dataset) == name, F.lit(rule.require_all)).otherwise(every)
    df = T.let(df, l_accepted=accepted, l_every=every)
    lacking = F.when(F.col("l_every"), F.array_except("l_accepted", "declared")).when(F.size(F.array_intersect("l_accepted", "declared")) > 0, F.array_except("l_accepted", "l_accepted")).otherwise(F.col("l_accepted"))
    df = T.let(df, missing_ids=F.array_sort(lacking), unexpected_ids=F.array_sort(F.array_except("declared", "l_accepted")))
    banned = names([n for n, x in p.licenses.items() if not x.allowed])
    manual = names([n for n, x in p.licenses.items() if x.requires_review])
    rules = [
        (missing(df, column), "missing_declared_license", p.missing), (F.size("unknown_ids") > 0, "unknown_license_identifier", p.unknown),
        (F.size("missing_ids") > 0, "expected_license_missing", p.mismatch), (F.size("unexpected_ids") > 0, "unexpected_declared_license", p.mismatch),
        (F.arrays_overlap("declared", banned), "license_not_allowed", "reject"), (F.arrays_overlap("declared", manual), "license_requires_manual_review", "review"),
    ]
    foreign = F.col("l_accepted").isNull()
    df = T.let(df, l_hits=F.array_compact(F.array(*(F.when(c, F.struct(F.lit(r).alias("reason"), F.lit(a).alias("action"))) for c, r, a in rules))))
    has = lambda action: F.exists("l_hits", lambda h: h["action"] == action)
    decision = F.when(foreign | has("reject"), "reject").when(has("review"), "review").otherwise("pass")
    df = df.withColumn("license_decision", decision)
    df = df.withColumn("license_status", F.when(foreign, "unknown_dataset").when(decision == "pass", "allowed").when(decision == "review", "needs_review").otherwise("rejected"))
    return df.withColumn("license_reasons", F.when(foreign, F.array(F.lit("dataset_policy_not_found"))).otherwise(F.transform("l_hits", lambda h: h["reason"]))).drop("l_hits", "l_accepted", "l_every")


def obligations(df: DataFrame, p: LicensePolicy) -> DataFrame:
    """Adds the four obligations of the recognised licences: any of the first two, all (and at least one) of the last two."""
    def having(attribute: str) -> Column:
        return F.array(*(F.lit(n) for n, x in p.licenses.items() if getattr(x, attribute))).cast("array<string>")

    some = F.size("declared") > 0
    return df.withColumns(
        {a: F.arrays_overlap("declared", having(a)) for a in ("attribution_required", "share_alike_required")}
        | {a: some & (F.size(F.array_except("declared", having(a))) == 0) for a in ("commercial_use", "redistribution")}
    )
