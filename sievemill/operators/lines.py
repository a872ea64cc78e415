"""Rules that look around a line: windows over lines (file_id, line, text, indent, blank), functions and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound

#: What opens a loop, asks a database, blocks, and closes off unsafe code.
LOOP = r"^\s*(?:for|while)\b"
QUERY = r"\.(?:execute|query|filter|get)\s*\("
BLOCKING = r"\btime\.sleep\s*\(|\brequests\.(?:get|post|put|delete)\s*\(|\bsubprocess\.(?:run|call|check_output)\s*\("
ASYNC = r"^\s*async\s+def\b"


def lines(files: DataFrame) -> DataFrame:
    out = files.select("file_id", F.posexplode(F.split("code", "\n")).alias("at", "text"))
    return out.select("file_id", (F.col("at") + 1).alias("line"), "text", (F.length("text") - F.length(F.ltrim("text"))).alias("indent"), (F.trim("text") == "").alias("blank"))


def flagged_lines(files: DataFrame, **flags: Column) -> DataFrame:
    """file_id, lang, line, text, and what `flags` say of the whole file. They are worked out once a file, within what is exploded: beside it they would be worked out for each line."""
    each = lambda f: F.transform(F.split("code", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), *[f[n].alias(n) for n in flags]))
    held = files.select("file_id", "lang", F.explode(bound(F.struct(*[c.alias(n) for n, c in flags.items()]), each)).alias("l"))
    return held.select("file_id", "lang", "l.*")


def within(table: DataFrame, opener: str, hit: str, reach: int) -> DataFrame:
    """Openers with a hit within the `reach` lines after them, and the first such hit: one window over a file's lines."""
    ahead = Window.partitionBy("file_id").orderBy("line").rowsBetween(1, reach)
    out = table.withColumn("hit", F.min(F.when(F.col("text").rlike(hit), F.col("line"))).over(ahead))
    return out.where(F.col("text").rlike(opener) & F.col("hit").isNotNull()).select("file_id", "line", "hit")


def query_in_loop(table: DataFrame) -> DataFrame:
    return within(table, LOOP, QUERY, 20)


def blocking_in_async(table: DataFrame) -> DataFrame:
    return within(table, ASYNC, BLOCKING, 49)


def undocumented_unsafe(table: DataFrame) -> DataFrame:
    """Lines with an unsafe block without SAFETY in a comment on them or the three lines before."""
    near = Window.partitionBy("file_id").orderBy("line").rowsBetween(-3, 0)
    out = table.withColumn("safe", F.max(F.col("text").rlike(r"//.*SAFETY")).over(near))
    return out.where(F.col("text").rlike(r"\bunsafe\s*\{") & ~F.col("safe")).select("file_id", "line")


def long_files(table: DataFrame, most: int) -> DataFrame:
    """Files of more than `most` lines that aren't blank or comments."""
    real = ~F.col("blank") & ~F.ltrim("text").rlike("^(?:#|//)")
    return table.groupBy("file_id").agg(F.count_if(real).alias("lines")).where(F.col("lines") > most)


#: What opens functions, in Python and in all languages, and blocks that nest.
DEF_LINE = r"^\s*(?:async\s+)?def\s+\w+"
ANY_FUNCTION = r"^\s*(?:def|function|fn|func|pub\s+fn|async\s+def|async\s+function)\s+\w+"
NESTING = r"^\s*(?:if|for|while|with|try|except|async for|async with)\b"


def extents(rows: Column, opener: str) -> Column:
    """(start, stop) of what an opener's line begins: up to the line before the next one that isn't blank and not further in. rows: a file's lines.

    One pass from the last line up. The lines that can still end something above are kept: one for each smaller indent."""
    line = F.transform(rows, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.when(t.rlike(r"\S"), F.length(F.regexp_extract(t, r"^[ \t]*", 0))).alias("indent")))
    none = F.struct(F.array().cast("array<struct<indent:int,line:int>>").alias("ends"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        end = F.array_min(F.transform(F.filter(acc["ends"], lambda e: e["indent"] <= r["indent"]), lambda e: e["line"]))
        found = F.struct(r["line"].alias("start"), (F.coalesce(end, F.size(rows) + 1) - 1).alias("stop"))
        ends = F.concat(F.array(F.struct(r["indent"].alias("indent"), r["line"].alias("line"))), F.filter(acc["ends"], lambda e: e["indent"] < r["indent"]))
        out = F.when(r["text"].rlike(opener), F.concat(F.array(found), acc["out"])).otherwise(acc["out"])
        return F.when(r["indent"].isNull(), acc).otherwise(F.struct(ends.alias("ends"), out.alias("out")))

    return F.aggregate(F.reverse(line), none, step, lambda acc: acc["out"])


def inner_lines(rows: Column, d: Column) -> Column:
    """The lines behind the first of an extent."""
    return F.when(d["stop"] > d["start"], F.transform(F.sequence(d["start"], d["stop"] - 1), lambda i: F.get(rows, i))).otherwise(F.array().cast("array<string>"))


def block_depth(body: Column) -> Column:
    """How many blocks are open at once at most: the number of distinct indents of openers above an opener that are still open, with its own."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, t: Column) -> Column:
        i = F.length(t) - F.length(F.ltrim(t))
        left = F.concat(F.filter(acc["open"], lambda o: o < i), F.array(i))
        return F.struct(left.alias("open"), F.greatest(acc["most"], F.size(left)).alias("most"))

    return F.aggregate(F.filter(body, lambda t: t.rlike(NESTING)), start, step, lambda acc: acc["most"])


def function_list(rows: Column) -> Column:
    """name, start, stop, body (without comments, blanks made one, empty lines left out), depth of the Python functions among a file's lines: an array."""

    def one(d: Column) -> Column:
        clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "#[^\\n]*", ""), r"[ \t]+", " "))
        told = lambda inner: F.struct(
            F.regexp_extract(F.get(rows, d["start"] - 1), r"def\s+(\w+)", 1).alias("name"), d["start"].alias("start"), d["stop"].alias("stop"),
            F.array_join(F.filter(F.transform(inner, clean), lambda t: t != ""), "\n").alias("body"), block_depth(inner).alias("depth"),
        )
        return bound(inner_lines(rows, d), told)

    return F.transform(extents(rows, DEF_LINE), one)


def functions(files: DataFrame) -> DataFrame:
    """Python functions (file_id, name, start, stop, body, depth): a def line and the lines up to the next one that isn't blank and not
    further in. One pass over each file's lines as an array; nothing is shuffled, and no line is copied but into its functions' bodies."""
    found = files.where("lang = 'python'").select("file_id", F.explode(bound(F.split("code", "\n"), function_list)).alias("f"))
    return found.select("file_id", "f.*")


def repeated_blocks(rows: Column, least: int = 5) -> Column:
    """The lines of functions of over `least` lines, of any language, whose text, but for comments and white space, an earlier one of the file has. Functions within others are left out."""
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    outer = F.aggregate(extents(rows, ANY_FUNCTION), none, lambda acc, d: F.when(d["start"] > acc["last"], F.struct(d["stop"].alias("last"), F.concat(acc["out"], F.array(d)).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, "#.*$", ""), "//.*$", "")
    plain = lambda d: F.trim(F.regexp_replace(F.array_join(F.transform(inner_lines(rows, d), clean), "\n"), r"\s+", " "))
    hashed = F.array_sort(F.transform(F.filter(outer, lambda d: d["stop"] - d["start"] > least), lambda d: F.struct(F.md5(plain(d)).alias("hash"), d["start"].alias("line"))))
    return bound(hashed, repeats)


def repeats(hashed: Column) -> Column:
    """The lines of (hash, line), in order, whose hash the one before has."""
    same = F.transform(hashed, lambda h, i: F.when((i > 0) & (F.get(hashed, i - 1)["hash"] == h["hash"]), h["line"]))
    return F.array_compact(same)


def long_functions(table: DataFrame, most: int) -> DataFrame:
    length = F.col("stop") - F.col("start") + 1
    return table.where(length > most).select("file_id", "name", "start", length.alias("length"))


def duplicates(blocks: DataFrame, by: str = "body") -> DataFrame:
    """All but the first of blocks (file_id, start, body) with an equal body, with how many there are: over the whole corpus.

    The first and the count come from an aggregate that is combined before its shuffle, so a body that a third of all files
    share is no burden; the join back is one that can be split by skew.
    """
    keyed = blocks.select("file_id", "start", F.md5(by).alias("hash"))
    first = keyed.groupBy("hash").agg(F.min(F.struct("file_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "hash").where("struct(file_id, start) <> first").select("file_id", "start", F.col("first.file_id").alias("first_id"), "n")


def magic_numbers(table: DataFrame) -> DataFrame:
    """Asserts with a number of two digits or more, without a comment on the line or the one before."""
    before = F.lag("text").over(Window.partitionBy("file_id").orderBy("line"))
    out = table.withColumn("before", F.coalesce(before, F.lit("")))
    return out.where(F.col("text").rlike(r"^\s*assert\b.*[^\w.][0-9]{2,}") & ~F.contains("text", F.lit("#")) & ~F.ltrim("before").startswith("#")).select("file_id", "line")


def changed_lines(diff: DataFrame) -> DataFrame:
    """New-file line numbers of the added lines of unified diffs (diff_id, seq, text): each hunk's start is carried forward, and
    the added and kept lines since are counted."""
    order = Window.partitionBy("diff_id").orderBy("seq")
    start = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    rows = diff.withColumn("path", F.last(F.when(F.col("text").startswith("+++ "), F.substring("text", 5, 10_000)), True).over(order))
    rows = rows.withColumn("hunk", F.count(F.when(start != "", 1)).over(order)).withColumn("from", F.last(F.when(start != "", start.cast("int")), True).over(order))
    inside = (F.col("hunk") > 0) & ~F.col("text").rlike(r"^(?:@@|\+\+\+|---)")
    kept = F.count_if(inside & F.col("text").rlike(r"^[+ ]")).over(Window.partitionBy("diff_id", "hunk").orderBy("seq"))
    rows = rows.withColumn("line", F.col("from") + kept - 1)
    return rows.where(inside & F.col("text").startswith("+")).select("diff_id", "path", F.col("line").cast("int").alias("line"), F.expr("substring(text, 2)").alias("added"))
