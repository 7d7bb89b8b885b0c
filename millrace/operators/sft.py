"""Instruction tuning: folding chats, parsing templates, prompt groups, ordered deduplication and leak-free splits."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_CEILING, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow as A, text as T
from ..scratch import Scratch
from ..session import ship
from .tokenize import load

IGNORE = -100


def instruction_text(instruction: Column, context: Column, response: Column) -> Column:
    """Sections of an example, a blank line between them; the input section is left out if there is none."""
    middle = F.when(context != "", F.concat(F.lit("Input:\n"), context))
    return F.concat_ws("\n\n", F.concat(F.lit("Instruction:\n"), instruction), middle, F.concat(F.lit("Response:\n"), response))


def fold_chat(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, instruction, response, text): the turns of both sides of each chat; other roles and blank turns are left out."""
    turns = turns.where(~T.blank(F.col("text"))).select(key, order, F.lower("role").alias("role"), T.strip(F.col("text")).alias("text"))
    side = F.when(F.col("role").isin("user", "human"), "instruction").when(F.col("role").isin("assistant", "gpt"), "response")
    turns = turns.withColumn("side", side).where("side is not null")
    said = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct(order, "text")))), lambda x: x["text"]), "\n")
    out = turns.groupBy(key).agg(said("instruction").alias("instruction"), said("response").alias("response")).where("instruction <> '' and response <> ''")
    return out.withColumn("text", instruction_text(F.col("instruction"), F.lit(""), F.col("response")))


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds instruction, context, context_type, response, prompt and parse_error (null: parsed).

    The header may lack its colon; the last response marker and the first input or options section count.
    """
    head, mark = r"(?is)^Instruction:[:.]?[ \t]*\n?", r"\n\nResponse:[ \t]*\n?"
    df = T.let(df, p_head=F.regexp_like(text, F.lit(head)), p_body=F.regexp_extract(text, rf"(?is)\A(.*){mark}", 1), p_any=F.regexp_like(text, F.lit("(?i)" + mark)))
    df = T.let(df, p_response=F.regexp_extract(text, rf"(?is)\A.*{mark}(.*)\z", 1), p_ask=F.regexp_replace("p_body", head, ""))
    section = r"(?is)\A(.*?)\n\n(Input|Options):[ \t]*\n?(.*)\z"
    df = T.let(df, p_has=F.regexp_like("p_ask", F.lit(section)))
    raw = F.when(F.col("p_has"), F.regexp_extract("p_ask", section, 3)).otherwise("")
    out = {
        "instruction": T.strip(F.when(F.col("p_has"), F.regexp_extract("p_ask", section, 1)).otherwise(F.col("p_ask"))), "context": T.strip(raw),
        "context_type": F.when(F.col("p_has"), F.lower(F.regexp_extract("p_ask", section, 2))).otherwise("none"), "response": T.strip(F.col("p_response")), "p_raw": raw,
    }
    df = T.let(df, **out)
    error = F.when(~F.coalesce("p_head", F.lit(False)), "no_instruction_section").when(~F.col("p_any"), "no_response_section").when((F.col("instruction") == "") | (F.col("response") == ""), "empty_instruction_or_response")
    middle = F.when(F.col("p_raw") != "", F.concat(F.initcap("context_type"), F.lit(":\n"), F.col("context")))
    prompt = F.concat(F.concat_ws("\n\n", F.concat(F.lit("Instruction:\n"), F.col("instruction")), middle), F.lit("\n\nResponse:\n"))
    df = df.withColumns({"parse_error": error, "prompt": prompt})
    return df.drop("p_head", "p_body", "p_any", "p_response", "p_ask", "p_has", "p_raw")


def plain(c: Column) -> Column:
    """The form in which prompts and responses are compared."""
    return T.squash(A.casefold(A.normalize(F.coalesce(c, F.lit("")), "NFKC")))


def prompt_group(df: DataFrame) -> DataFrame:
    """Adds prompt_group, the digest of the normalised instruction, context type and context."""
    return df.withColumn("prompt_group", F.sha2(F.concat_ws("\n", plain(F.col("instruction")), plain(F.col("context_type")), plain(F.col("context"))), 256))


def deduplicate(df: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Adds rejection: missing_id, duplicate_id, duplicate_pair or null, in the given order (a unique whole number).

    A row that goes as a duplicate pair doesn't take its id, so both rules are resolved together, in rounds: a row that
    is the first of those left with its id, and of those with its pair, is kept, and all others with this id or this
    pair go. Each round is two aggregates over what is undecided, however popular an id or a pair is.
    """
    scratch = Scratch(df.sparkSession, "sft")
    df = df.withColumn("_pair", F.sha2(F.concat_ws("\n", F.col("prompt_group"), plain(F.col("response"))), 256)).withColumn("_id", F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    left = scratch.save(df.where("_id <> ''").select(F.col(order).alias("_at"), "_id", "_pair"), "rows")
    found = None
    while True:
        firsts = [left.groupBy(c).agg(F.min("_at").alias(f"_first{c}")) for c in ("_id", "_pair")]
        both = left.join(firsts[0], "_id").join(firsts[1], "_pair")
        kept = scratch.save(both.where((F.col("_at") == F.col("_first_id")) & (F.col("_at") == F.col("_first_pair"))).select("_at", "_id", "_pair"), "kept")
        found = kept if found is None else found.union(kept)
        left = scratch.save(left.join(kept.select("_id"), "_id", "left_anti").join(kept.select("_pair"), "_pair", "left_anti").select("_at", "_id", "_pair"), "left")
        if not left.limit(1).count():
            break
    out = df.join(found.select("_id", F.col("_at").alias("_first")), "_id", "left")
    at = F.col(order)
    reason = F.when(F.col("_id") == "", "missing_id").when(F.col("_first") == at, None).when(F.col("_first") < at, "duplicate_id").otherwise("duplicate_pair")
    return out.select(*(c for c in df.columns if c not in ("_pair", "_id")), reason.alias("rejection"))


def _edge(fraction: float) -> str:
    """The least 256-bit number whose share of 2^256 isn't below the fraction, as 64 hex digits."""
    with localcontext() as c:
        c.prec = 120
        return f"{int((Decimal(fraction) * 2**256).to_integral_value(ROUND_CEILING)):064x}"


def split_groups(df: DataFrame, validation: float = 0.05, test: float = 0.05, seed: int = 42, source: str = "source") -> DataFrame:
    """Adds split: all rows of a prompt group go to one, by the digest of seed, the group's least source and the group."""
    if not 0 < validation < 1 or not 0 <= test < 1 or validation + test >= 1:
        raise ValueError("fractions must be positive and leave a training share")
    least = df.groupBy("prompt_group").agg(F.min(F.coalesce(F.col(source), F.lit("unknown"))).alias("_source"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_source"), F.col("prompt_group")), 256)
    split = F.when(digest < _edge(test), "test") if test else F.when(F.lit(False), "test")
    groups = least.withColumn("split", split.when(digest < _edge(test + validation), "validation").otherwise("train")).drop("_source")
    return df.join(groups, "prompt_group")


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """(split_a, split_b, shared): keys that stand in two splits; empty if nothing leaks."""
    each = df.select(key, "split").distinct()
    a, b = each.withColumnRenamed("split", "split_a"), each.withColumnRenamed("split", "split_b")
    return a.join(b, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def masked_example(prompt: Column, response: Column, bos: int, eos: int, pad: int, length: int) -> Column:
    """struct(input_ids, attention_mask, labels) of token arrays: only the response and the end are supervised, only the response is cut."""
    room = F.greatest(F.lit(length - 2) - F.size(prompt), F.lit(0))
    answer = F.slice(response, F.lit(1), room)
    ids = F.concat(F.array(F.lit(bos)), prompt, answer, F.array(F.lit(eos)))
    fill = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    padded = lambda a, x: F.concat(a, F.array_repeat(F.lit(x), fill))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt) + 1), answer, F.array(F.lit(eos)))
    return F.struct(padded(ids, pad).alias("input_ids"), padded(F.array_repeat(F.lit(1), F.size(ids)), 0).alias("attention_mask"), padded(labels, IGNORE).alias("labels"))


def encode_structured(df: DataFrame, path: str, length: int, bos: int, eos: int, pad: int) -> DataFrame:
    """Adds encoded: response-masked arrays of `length` ids, counts, what was cut, and an error (null: usable).

    df has instruction, context, context_type and response. If prompt and response don't fit, the context is shortened
    first, by characters, to the longest beginning that fits; it is dropped if the response alone leaves no room, and
    then the response is cut. The length of a prompt has to be known in tokens, so this is an Arrow function.
    """
    return T.let(encode_unpadded(df, path, length, bos, eos), encoded=padded(F.col("unpadded"), length, pad)).drop("unpadded")


def padded(c: Column, length: int, pad: int) -> Column:
    """The struct encoded of encode_structured() from that of encode_unpadded()."""
    ids, n, prompt = c["ids"], F.size(c["ids"]), c["prompt_tokens"]
    fill = F.when(n == 0, 0).otherwise(F.lit(length) - n)
    active = F.when(n == 0, 0).otherwise(prompt + 1)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), active), F.slice(ids, active + 1, n - active), F.array_repeat(F.lit(IGNORE), fill))
    arrays = (F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)).alias("attention_mask"), labels.alias("labels"))
    return F.struct(*arrays, *(c[x].alias(x) for x in ("prompt_tokens", "response_tokens", "context_truncated", "response_truncated", "error")))


def encode_unpadded(df: DataFrame, path: str, length: int, bos: int, eos: int) -> DataFrame:
    """Adds unpadded: the ids of prompt and response as encode_structured() fits them, without the padding, which padded() adds.

    Padding may be most of a row, so it is neither made in Python nor shuffled or saved.
    """
    schema = "struct<ids: array<int>, prompt_tokens: int, response_tokens: int, context_truncated: boolean, response_truncated: boolean, error: string>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        t = load(path)
        ids = lambda text: t.encode(text, add_special_tokens=False).ids
        for columns in batches:
            rows = [_fitted(ids, *(x if isinstance(x, str) else "" for x in row), length, bos, eos) for row in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=["ids", "prompt_tokens", "response_tokens", "context_truncated", "response_truncated", "error"])

    ship(df.sparkSession)
    return T.let(df, unpadded=run("instruction", "context", "context_type", "response"))


def prompt_of(instruction: str, context: str, kind: str) -> str:
    """The prompt of one example; a context without a kind is an input."""
    middle = f"\n\n{(kind if kind in ('input', 'options') else 'input').title()}:\n{context.strip()}" if context.strip() else ""
    return f"Instruction:\n{instruction.strip()}{middle}\n\nResponse:\n"


def _fitted(ids, instruction: str, context: str, kind: str, response: str, length: int, bos: int, eos: int) -> tuple:
    bare, answer, room, context = ids(prompt_of(instruction, "", "")), ids(response), length - 2, context.strip()
    problem = "empty_response" if not answer else "instruction_too_long" if len(bare) + 1 > room else None
    if problem:
        return [], 0, 0, False, False, problem
    prompt, shortened = ids(prompt_of(instruction, context, kind)), False
    if context and len(prompt) + len(answer) > room:
        prompt, shortened, budget, a, z = bare, True, room - len(answer), 0, len(context)
        while len(bare) <= budget and a <= z:  # the longest beginning of the context whose prompt fits
            middle = (a + z) // 2
            tried = ids(prompt_of(instruction, context[:middle].rstrip(), kind))
            if len(tried) <= budget:
                prompt, a = tried, middle + 1
            else:
                z = middle - 1
    kept = answer[: room - len(prompt)]
    return [bos, *prompt, *kept, eos], len(prompt), len(kept) + 1, shortened, len(kept) < len(answer), None


def violations(examples: DataFrame, length: int, vocabulary: int, eos: int) -> DataFrame:
    """(split, violation, examples) of prepared examples; empty if all is well.

    examples: split, id, prompt_group, input_ids, attention_mask, labels. Ids and prompt groups must not stand in two splits.
    """
    supervised = lambda f: F.exists(F.zip_with("labels", f, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] != IGNORE) & x["b"])
    active = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))
    wrong_label = F.exists(F.zip_with("labels", "input_ids", lambda a, b: (a != IGNORE) & (a != b)), lambda x: x)
    rules = {
        "shape": (F.size("input_ids") != length) | (F.size("attention_mask") != length) | (F.size("labels") != length),
        "id_outside_vocabulary": F.exists("input_ids", lambda x: (x < 0) | (x >= vocabulary)), "mask_not_binary": F.exists("attention_mask", lambda x: ~x.isin(0, 1)),
        "label_differs": wrong_label, "padding_supervised": supervised(F.transform("attention_mask", lambda x: x == 0)), "nothing_supervised": ~F.exists("labels", lambda x: x != IGNORE),
        "end_not_supervised": F.get("labels", active - 1) != eos,
    }
    found = examples.select("split", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())))).alias("violation"))
    out = found.groupBy("split", "violation").agg(F.count("*").alias("examples"))
    for key in ("id", "prompt_group"):
        shared = overlaps(examples, key).select(F.concat_ws("/", "split_a", "split_b").alias("split"), F.lit(f"shared_{key}").alias("violation"), F.col("shared").alias("examples"))
        out = out.union(shared)
    return out


def crop_batches(examples: DataFrame, batch: str = "batch") -> DataFrame:
    """examples with their arrays cut to the longest active row of their batch; a batch with less than two active places is an error."""
    active = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))
    longest = examples.groupBy(batch).agg(F.max(active).alias("_longest"))
    longest = longest.withColumn("_longest", F.when(F.col("_longest") < 2, F.raise_error(F.lit("a batch needs two active places at least")).cast("int")).otherwise(F.col("_longest")))
    out = examples.join(longest, batch)
    return out.select(*(F.slice(c, F.lit(1), F.col("_longest")).alias(c) if c in ("input_ids", "attention_mask", "labels") else c for c in examples.columns))
