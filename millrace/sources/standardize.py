"""Standardizers: source schemas to the canonical document, as column expressions.

Each takes a frame with source_index (a whole number over all rows, unusable ones included) and gives canonical
documents: id, source, source_dataset, source_config, source_split, license, language, text and a metadata map. The cap
counts accepted rows in source order.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types

from ..functions import text as T
from ..operators.assemble import limit_each, running_total
from ..operators.clean import document_id
from ..operators.sft import instruction_text


@dataclass(frozen=True)
class Source:
    """What a source's documents carry besides their text."""

    name: str
    dataset: str
    config: str | None = None
    split: str = "train"
    output_split: str = "train"
    license: str = "unknown"
    language: str = "en"
    max_documents: int | None = None


def first_string(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is a string and not blank, stripped; the empty string if there is none."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [F.when(~T.blank(F.col(f"`{n}`")), T.strip(F.col(f"`{n}`"))) for n in names if isinstance(kinds.get(n), types.StringType)]
    return F.coalesce(*found, F.lit(""))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def present(c: Column) -> Column:
    """c, null where it is empty."""
    return F.nullif(c, F.lit(""))


def canonical(df: DataFrame, s: Source, text: Column, license_: Column | None = None, more: Column | None = None, **metadata: Column) -> DataFrame:
    """Canonical documents of the rows whose text isn't empty; metadata columns go to a map of strings, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in {"source_index": F.col("source_index"), **metadata}.items()))
    held = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    if more is not None:  # the source's own metadata, of which ours take precedence
        held = F.map_concat(F.map_filter(F.coalesce(more, F.expr("cast(map() as map<string, string>)")), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(held), k)), held)
    # behind a generator, as the text is asked for several times below
    rows = T.let(df, _text=text).select("source_index", F.col("_text").alias("text"), (license_ if license_ is not None else F.lit(s.license)).alias("license"), held.alias("metadata"))
    rows = rows.where(~T.blank(F.col("text")))
    if s.max_documents is not None:
        rows = limit_each(rows.withColumn("_g", F.lit(0)), "_g", "source_index", s.max_documents).drop("_g")
    return rows.select(
        document_id(F.lit(s.name), F.lit(s.output_split), F.col("source_index"), F.col("text")).alias("id"), F.lit(s.name).alias("source"), F.lit(s.dataset).alias("source_dataset"),
        F.lit(s.config).cast("string").alias("source_config"), F.lit(s.split).alias("source_split"), "license", F.lit(s.language).alias("language"), "text", "metadata",
    )


def _titled(title: Column, body: Column, cased: bool) -> Column:
    """The body, with the title before it unless it begins with it."""
    a, b = (body, title) if cased else (F.lower(body), F.lower(title))
    return F.when(body == "", "").when((title == "") | F.startswith(a, b), body).otherwise(F.concat(title, F.lit("\n\n"), body))


def plain_text(df: DataFrame, s: Source) -> DataFrame:
    return canonical(df, s, first_string(df, "text"), document_type=F.lit("synthetic_story"))


def wikipedia(df: DataFrame, s: Source) -> DataFrame:
    text = _titled(first_string(df, "title"), first_string(df, "text"), False)
    named = {"source_document_id": "id", "title": "title", "url": "url"}
    return canonical(df, s, text, document_type=F.lit("encyclopedia_article"), **{k: present(first_string(df, n)) for k, n in named.items()})


def heading(c: Column) -> Column:
    """struct(title, level) of a heading line, null for any other: as many equal signs on both sides, and a title."""
    shape = r"^\s*((?:=\s*)+)(.*?)((?:\s*=)+)\s*$"
    level = lambda g: F.length(F.regexp_replace(F.regexp_extract(c, shape, g), "[^=]", ""))
    title = T.strip(F.regexp_extract(c, shape, 2))
    return F.when(F.regexp_like(c, F.lit(shape)) & (title != "") & (level(1) == level(3)), F.struct(title.alias("title"), level(1).alias("level")))


def articles(df: DataFrame, line: str = "text", order: str = "source_index", group: str | None = None) -> DataFrame:
    """Rows of a line-wise source joined to articles: (group,) article, source_index, source_end_index, title, text, parts, headings.

    A heading of the first level begins an article (number 0 holds what comes before any); deeper headings are parts of
    it by their title. Blank lines and a part equal to the one before it are left out. Articles are numbered by a
    running total in two levels, so a source without groups isn't one task.
    """
    keys = [group] if group else ["_g"]
    df = df.select(*([group] if group else [F.lit(0).alias("_g")]), order, F.col(line).alias("_line"), heading(F.col(line)).alias("_h"))
    df = df.withColumn("_top", F.coalesce(F.col("_h.level") == 1, F.lit(False)).cast("int"))
    df = running_total(df, keys[0], order, "_top", "article")
    df = df.withColumn("_part", F.coalesce(F.col("_h.title"), T.strip(F.col("_line")))).where("_part <> ''")
    inside = Window.partitionBy(*keys, "article").orderBy(order)
    df = df.withColumn("_same", F.coalesce(F.lag("_part").over(inside) == F.col("_part"), F.lit(False))).where("not _same")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_part").alias("p"), F.coalesce(F.col("_h.level"), F.lit(0)).alias("level"))))
    out = df.groupBy(*keys, "article").agg(parts.alias("_ps"), F.max(F.when(F.col("_h.level") == 1, F.col("_h.title"))).alias("title"), F.max(order).alias("source_end_index"))
    return out.select(
        *([group] if group else []), "article", F.col("_ps")[0]["o"].alias("source_index"), "source_end_index", "title",
        F.array_join(F.transform("_ps", lambda x: x["p"]), "\n\n").alias("text"), F.size("_ps").cast("long").alias("parts"),
        F.transform(F.filter("_ps", lambda x: x["level"] > 1), lambda x: F.struct(x["p"].alias("heading"), x["level"].alias("level"), x["o"].alias("source_index"))).alias("headings"),
    )


def wikitext(df: DataFrame, s: Source) -> DataFrame:
    whole = articles(df)
    first, last = F.col("source_index"), F.col("source_end_index")
    return canonical(
        whole, s, F.col("text"), document_type=F.lit("wikitext_article"), title=F.col("title"), source_start_index=first, source_end_index=last,
        source_row_count=last - first + 1, section_count=F.size("headings"), section_headings=F.to_json("headings"),
    )


#: The fields that an instruction, its input and its response are looked for in, by source.
FIELDS = {
    "alpaca": (("instruction", "question", "prompt"), ("input", "context"), ("output", "answer", "response")),
    "medinstruct": (("instruction", "question"), ("input", "context"), ("output", "text-davinci-003-answer", "gpt-4-answer", "gpt-3.5-turbo-answer", "claude-2", "answer")),
    "openmedinstruct": (("instruction", "question", "query", "prompt"), ("input", "context"), ("output", "response", "answer")),
}


def _example(ask: Column, context: Column, answer: Column) -> Column:
    """The text of an example, empty if it lacks the instruction or the response."""
    return F.when((ask == "") | (answer == ""), "").otherwise(instruction_text(ask, context, answer))


def _instruction(kind: str, fields: str = "alpaca", extra: tuple[str, ...] = ()) -> Callable[[DataFrame, Source], DataFrame]:
    """A standardizer of rows with fallback lists for instruction, input and response."""

    def run(df: DataFrame, s: Source) -> DataFrame:
        text = _example(*(first_string(df, *names) for names in FIELDS[fields]))
        return canonical(df, s, text, document_type=F.lit(kind), task_type=F.lit("sft"), **{n: optional(df, n) for n in extra})

    return run


def medmcqa(df: DataFrame, s: Source) -> DataFrame:
    """Multiple choice: a question, four options and the number of the right one, 0 to 3 (a whole number, or the row goes)."""
    options = [first_string(df, n) for n in ("opa", "opb", "opc", "opd")]
    listed = F.concat_ws("\n", *(F.concat(F.lit(f"{letter}. "), o) for letter, o in zip("ABCD", options, strict=True)))
    whole = dict(df.dtypes).get("cop") in ("tinyint", "smallint", "int", "bigint")
    right = F.col("cop").cast("int") if whole else F.lit(None).cast("int")
    ask, why = first_string(df, "question"), first_string(df, "exp", "explanation")
    usable = (ask != "") & right.between(0, 3)
    for o in options:
        usable = usable & (o != "")
    pick = lambda values: F.get(F.array(*values), right)
    answer = F.concat(pick([F.lit(x) for x in "ABCD"]), F.lit(". "), pick(options))
    response = F.concat_ws("\n\n", answer, F.when(why != "", F.concat(F.lit("Explanation: "), why)))
    text = F.concat(F.lit("Instruction:\n"), ask, F.lit("\n\nOptions:\n"), listed, F.lit("\n\nResponse:\n"), response)
    text = F.when(F.coalesce(usable, F.lit(False)), text).otherwise("")
    return canonical(df, s, text, document_type=F.lit("multiple_choice_qa"), task_type=F.lit("sft"), answer_index=right, subject=optional(df, "subject_name"), topic=optional(df, "topic_name"))


def openmedinstruct(df: DataFrame, s: Source) -> DataFrame:
    """Fields, or the messages by role where the instruction or the response lacks."""
    ask, context, answer = (first_string(df, *names) for names in FIELDS["openmedinstruct"])
    if "messages" in df.columns:
        said = lambda *roles: F.array_join(F.transform(F.filter(F.coalesce("messages", F.array()), lambda m: F.lower(m["role"]).isin(*roles) & ~T.blank(m["content"])), lambda m: T.strip(m["content"])), "\n")
        lacking = ((ask == "") | (answer == "")) & F.col("messages").isNotNull()
        ask, answer = F.when(lacking, said("user", "human")).otherwise(ask), F.when(lacking, said("assistant", "gpt")).otherwise(answer)
    return canonical(df, s, _example(ask, context, answer), document_type=F.lit("open_medical_instruction_sft"), task_type=F.lit("sft"))


def pubmedqa(df: DataFrame, s: Source) -> DataFrame:
    """A question with contexts (a string, a list, or a struct with a list) and a long answer behind its decision."""
    kind = df.schema["context"].dataType.typeName() if "context" in df.columns else "string"
    listed = {"struct": lambda: F.col("context.contexts"), "array": lambda: F.col("context")}.get(kind)
    context = F.array_join(F.filter(F.transform(listed(), lambda x: T.strip(x.cast("string"))), lambda x: x != ""), "\n") if listed else first_string(df, "context")
    ask, answer, decision = first_string(df, "question"), first_string(df, "long_answer", "answer"), first_string(df, "final_decision")
    full = F.when(decision != "", F.concat(decision, F.lit("\n\n"), answer)).otherwise(answer)
    text = F.when((ask == "") | (answer == ""), "").otherwise(instruction_text(ask, F.coalesce(context, F.lit("")), full))
    return canonical(df, s, text, document_type=F.lit("biomedical_qa"), task_type=F.lit("sft"), pmid=optional(df, "pubid"), final_decision=present(decision))


def _within(element: ET.Element | None) -> str:
    """All text below an element, nested markup included."""
    return "" if element is None else "".join(element.itertext())


def _citation(root: ET.Element) -> dict[str, str]:
    """What a document takes from one citation; labelled parts of the abstract begin with their label."""
    parts = [(part.get("Label"), _within(part).strip()) for part in root.iterfind(".//Abstract/AbstractText")]
    one = lambda path: _within(root.find(path)).strip()
    return {
        "title": one(".//ArticleTitle"), "body": "\n".join(f"{label}: {text}" if label else text for label, text in parts if text), "pmid": one(".//PMID"), "pmcid": "",
        "journal": one(".//Journal/Title"), "doi": one(".//ArticleId[@IdType='doi']"), "statement": one(".//Abstract/CopyrightInformation"),
    }


def _article(root: ET.Element) -> dict[str, str]:
    """What a document takes from one open-access article; white space is folded."""
    one = lambda x: " ".join(_within(root.find(x) if isinstance(x, str) else x).split())
    paragraphs = [one(p) for p in root.iterfind(".//body//p")]
    ids = {k: one(f".//article-id[@pub-id-type='{v}']") for k, v in (("pmid", "pmid"), ("pmcid", "pmc"), ("doi", "doi"))}
    return {"title": one(".//article-title"), "body": "\n\n".join(p for p in paragraphs if p), **ids, "journal": "", "statement": one(".//permissions/license")}


_XML = ("title", "body", "pmid", "pmcid", "journal", "doi", "statement")


def _parsed(df: DataFrame, read: Callable[[ET.Element], dict[str, str]]) -> DataFrame:
    """df with the struct x of what `read` takes from its xml; XPath expressions give no text of nested elements one by one."""

    @F.pandas_udf(", ".join(f"{n} string" for n in _XML))
    def run(xml: pd.Series) -> pd.DataFrame:
        found = [dict.fromkeys(_XML, "") if x is None else read(ET.fromstring(x)) for x in xml]
        return pd.DataFrame(found, columns=list(_XML))

    return T.let(df, x=run(F.col("xml"))) if isinstance(df.schema["xml"].dataType, types.StringType) else df.where("false").withColumn("x", F.struct(*(F.lit("").alias(n) for n in _XML)))


def _with_title() -> Column:
    return F.when(F.col("x.body") == "", "").otherwise(F.concat_ws("\n\n", present(F.col("x.title")), F.col("x.body")))


def pubmed_abstracts(df: DataFrame, s: Source) -> DataFrame:
    """XML of one citation: title and parts of the abstract, nested markup included. Markup that isn't XML is an error."""
    df = _parsed(df, _citation)
    named = {"pmid": "pmid", "title": "title", "journal": "journal", "doi": "doi", "copyright_information": "statement"}
    return canonical(df, s, _with_title(), document_type=F.lit("biomedical_abstract"), **{k: present(F.col(f"x.{n}")) for k, n in named.items()})


#: Licence statements of open-access articles with their identifiers, in the order in which they are tried.
ARTICLE_LICENSES = [
    (r"(?i)creativecommons\.org/publicdomain/zero|\bcc0\b", "cc0-1.0"),
    (r"(?i)creativecommons\.org/licenses/by/4|\bcc by 4", "cc-by-4.0"),
    (r"(?i)creativecommons\.org/licenses/by/3|\bcc by 3", "cc-by-3.0"),
    (r"(?i)creativecommons\.org/licenses/by-sa", "cc-by-sa"),
    (r"(?i)creativecommons\.org/licenses/by-nc", "cc-by-nc"),
]


def article_license(statement: Column) -> Column:
    """The identifier of an article's licence statement, unknown if none fits."""
    found = [F.when(statement.rlike(pattern), name) for pattern, name in ARTICLE_LICENSES]
    return F.coalesce(*found, F.lit("unknown"))


def pmc_open_access(df: DataFrame, s: Source) -> DataFrame:
    """XML of one article: title and body paragraphs; each article has its own licence. Markup that isn't XML is an error."""
    df = _parsed(df, _article)
    named = {"pmcid": "pmcid", "pmid": "pmid", "doi": "doi", "title": "title", "license_statement": "statement"}
    return canonical(df, s, _with_title(), article_license(F.col("x.statement")), document_type=F.lit("biomedical_full_text_article"), **{k: present(F.col(f"x.{n}")) for k, n in named.items()})


def project_gutenberg(df: DataFrame, s: Source) -> DataFrame:
    """A book for each row; the metadata of the source (a map or a struct) is kept."""
    kind = df.schema["metadata"].dataType if "metadata" in df.columns else None
    more = None
    if isinstance(kind, types.MapType):
        more = F.col("metadata").cast("map<string, string>")
    elif isinstance(kind, types.StructType):
        more = F.map_from_entries(F.array(*(F.struct(F.lit(n), F.col(f"metadata.`{n}`").cast("string")) for n in kind.names)))
    own = F.coalesce(present(optional(df, "id")), more["book_id"] if more is not None else F.lit(None))
    return canonical(df, s, first_string(df, "text", "content"), more=more, document_type=F.lit("public_domain_book"), source_document_id=own)


def fineweb_edu(df: DataFrame, s: Source) -> DataFrame:
    named = {"source_document_id": "id", "url": "url", "dump": "dump", "source_token_count": "token_count", "educational_score": "score", "language_score": "language_score"}
    return canonical(df, s, first_string(df, "text"), document_type=F.lit("educational_web_document"), **{k: optional(df, n) for k, n in named.items()})


def wikidoc(df: DataFrame, s: Source) -> DataFrame:
    """Rows of this source alone (an empty tag counts as its own); the title stands before the content unless it begins it."""
    title, content = first_string(df, "title"), first_string(df, "clean_text", "content", "text", "raw_text")
    own = df.where(F.lower(first_string(df, "source")).isin("", "wikidoc"))
    return canonical(own, s, _titled(title, content, True), document_type=F.lit("medical_encyclopedia_passage"), source_document_id=optional(df, "id"), title=present(title), url=optional(df, "url"))


REGISTRY: dict[str, Callable[[DataFrame, Source], DataFrame]] = {
    "tinystories": plain_text, "wikipedia": wikipedia, "wikitext103": wikitext,
    "alpaca": _instruction("alpaca_instruction"), "chatdoctor": _instruction("medical_dialogue_sft"), "medalpaca": _instruction("medical_flashcard_sft"),
    "medinstruct": _instruction("medical_instruction_sft", "medinstruct", ("difficulty",)),
    "medmcqa": medmcqa, "openmedinstruct": openmedinstruct, "pubmedqa": pubmedqa, "pubmed_abstracts": pubmed_abstracts, "pmc_open_access": pmc_open_access,
    "project_gutenberg_public_domain": project_gutenberg, "fineweb_edu": fineweb_edu, "wikidoc": wikidoc,
}


def standardize(df: DataFrame, s: Source) -> DataFrame:
    """Documents of a source by its registered standardizer."""
    if s.name not in REGISTRY:
        raise ValueError(f"no standardizer for {s.name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[s.name](df, s)
