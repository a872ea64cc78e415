"""What prompts name: files, functions and library calls, with how sure that is and what stands around them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches, plain


class Sign(NamedTuple):
    kind: str
    pattern: str
    sure: int  # hundredths
    clues: str


# Kinds, patterns, how sure each is, and words near by that make it surer. A path that begins with / is met with the character before it.
PATH = r"(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+"
FILE_CLUES = "in the file|modify|create|at path|open|edit"
SIGNS = [
    Sign("file_path", rf"\.{{1,2}}/{PATH}(?:\.[a-zA-Z0-9]+)?", 85, FILE_CLUES),
    Sign("file_path", rf"~/{PATH}(?:\.[a-zA-Z0-9]+)?", 85, FILE_CLUES),
    Sign("file_path", rf"(?:\A|[^:/.])/{PATH}\.[a-zA-Z0-9]+", 80, FILE_CLUES + "|in|from"),
    Sign("function_name", r"\b[a-z_][a-zA-Z0-9_]*\s*\(\)", 75, "function|method|call|create|implement|modify|the"),
    Sign("function_name", r"\b[a-z_][a-zA-Z0-9_]*\.[a-z_][a-zA-Z0-9_]*\s*\(", 70, "function|method|call"),
    Sign("function_name", r"\b[A-Z][a-zA-Z0-9]*\.[a-z_][a-zA-Z0-9_]*", 65, "function|method|class"),
    Sign("api_reference", r"\b[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+\b", 70, "use|call|import|from|with"),
    Sign("api_reference", r"\buse[A-Z][a-zA-Z0-9]*\b", 90, "react|hook"),
    Sign("file_path", r"(?:[a-zA-Z0-9_-][a-zA-Z0-9_.-]*/)+[a-zA-Z0-9_.-]*[a-zA-Z0-9_-]\.[a-zA-Z0-9]+", 80, FILE_CLUES),  # ours: a project's path as a whole, where only its end would be met
]
LIBRARIES = """os sys re json pathlib datetime typing collections asyncio functools itertools subprocess logging math requests fastapi pydantic sqlalchemy django flask pytest numpy
    pandas torch tensorflow httpx aiohttp celery langchain langgraph langchain_core langchain_openai langchain_anthropic langchain_community langsmith fs path http crypto util stream
    events axios express prisma next react vue lodash moment""".split()
EXTENSIONS = "py js ts tsx jsx json yaml yml md css html go rs java vue svelte toml cfg ini sh rb php c cpp h hpp".split()
NO_NAMES = "if for while return print in is not and or".split()
#: Hundredths for a known library and for a clue; code points on either side in which clues, the beginning of an address and the context are looked for.
LIBRARY_BONUS, CLUE_BONUS, CLUES_WITHIN, ADDRESS_WITHIN, CONTEXT_WITHIN = 20, 15, 30, 50, 40


def found(text: Column) -> Column:
    """All that the signs find in a text, overlaps included: start, stop (from 0), at (which sign), kind, named, sure (hundredths), library (whether it is a known one). Letters beyond
    ASCII count as underscores."""
    return F.flatten(F.array(*[_by_sign(text, at, sign) for at, sign in enumerate(SIGNS)]))


def _by_sign(text: Column, at: int, sign: Sign) -> Column:
    low = F.lower(text)

    def entity(m: Column) -> Column:
        # the character before an absolute path is no part of it
        extra = F.when(m["match"].startswith("/"), 0).otherwise(1) if sign.pattern.startswith(r"(?:\A") else F.lit(0)
        start = m["start"] + extra
        named = F.regexp_replace(F.substring(m["match"], extra + 1, F.length(m["match"])), r"\s*\(\)?\z", "")
        from_ = F.greatest(start - CLUES_WITHIN, F.lit(0))
        clue = F.substring(low, from_ + 1, m["end"] + CLUES_WITHIN - from_).rlike(sign.clues)
        library = F.lit(sign.kind == "api_reference") & F.split_part(named, F.lit("."), F.lit(1)).isin(*LIBRARIES)
        sure = F.least(F.lit(100), sign.sure + F.when(library, LIBRARY_BONUS).otherwise(0)) + F.when(clue, CLUE_BONUS).otherwise(0)
        return F.struct(start.alias("start"), m["end"].alias("stop"), F.lit(at).alias("at"), F.lit(sign.kind).alias("kind"), named.alias("named"), F.least(F.lit(100), sure).alias("sure"), library.alias("library"))

    def real(e: Column) -> Column:
        last = F.lower(F.element_at(F.split(e["named"], "[.]"), -1))
        if sign.kind == "file_path":
            from_ = F.greatest(e["start"] - ADDRESS_WITHIN, F.lit(0))
            address = F.substring(text, from_ + 1, e["start"] - from_).rlike(r"://[^ ]*\z")
            return ~address & (~e["named"].contains(".") | (last == "") | last.isin(*EXTENSIONS))
        return ~last.isin(*NO_NAMES) if sign.kind == "function_name" else F.lit(True)

    return F.filter(F.transform(matches(plain(text), F.lit(sign.pattern)), entity), real)


def entities(prompts: DataFrame) -> DataFrame:
    """prompt_id, kind, start, stop, named, confidence, library, context of what prompts (prompt_id, text) name, without what lies within something longer; of equal places the sign
    named first. Spans in order of their starts, the longer first, lie within an earlier one exactly if none ends later: one window over a prompt."""
    each = prompts.select("prompt_id", "text", F.explode(found(F.col("text"))).alias("e")).select("prompt_id", "text", "e.*")
    earlier = Window.partitionBy("prompt_id").orderBy("start", F.desc("stop"), "at").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.greatest(F.col("start") - CONTEXT_WITHIN, F.lit(0))
    context = F.trim(F.substring("text", from_ + 1, F.col("stop") + CONTEXT_WITHIN - from_))
    kept = each.select("prompt_id", "kind", "start", "stop", "at", "named", (F.col("sure") / 100.0).alias("confidence"), "library", context.alias("context"))
    return kept.withColumn("reach", F.max("stop").over(earlier)).where("reach is null or stop > reach").drop("reach", "at")
