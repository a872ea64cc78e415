"""What validations of the same file say when compared over time (session_id, file_path, ts, event_id, score, rules, ...)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..places import cut

FILE = ["session_id", "file_path"]


def _time(newest_first: bool = False) -> list:
    return [F.col("ts").desc(), F.col("event_id").desc()] if newest_first else ["ts", "event_id"]


def latest(validations: DataFrame) -> DataFrame:
    """The last validation of each file in each session."""
    return validations.withColumn("_i", F.row_number().over(Window.partitionBy(*FILE).orderBy(*_time(True)))).where("_i = 1").drop("_i")


def latest_score(validations: DataFrame) -> DataFrame:
    return validations.groupBy(*FILE).agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"), F.count("*").alias("validations"))


def persistence(validations: DataFrame) -> DataFrame:
    """For each rule of a file's last validation, in how many validations running, up to the last, it was met.

    Places in time less the rule's own rank are equal within a run without a gap; the run that ends at the last place counts.
    """
    placed = validations.withColumn("_i", F.row_number().over(Window.partitionBy(*FILE).orderBy(*_time())))
    placed = placed.withColumn("_n", F.max("_i").over(Window.partitionBy(*FILE)))
    each = placed.select(*FILE, "_i", "_n", F.explode("rules").alias("rule"))
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*FILE, "rule").orderBy("_i"))
    runs = each.withColumn("_run", island).groupBy(*FILE, "rule", "_run").agg(F.count("*").alias("running"), F.max("_i").alias("_end"), F.max("_n").alias("_n"))
    return runs.where("_end = _n").select(*FILE, "rule", "running")


def persistent_requirements(validations: DataFrame) -> DataFrame:
    """Rules that a file's last two validations at least have in common, with the last score."""
    return persistence(validations).where("running >= 2").join(latest_score(validations).drop("validations"), FILE)


def delta(validations: DataFrame) -> DataFrame:
    """Rules that each validation has resolved and brought, against the one before; how many have stayed."""
    before = F.lag("rules").over(Window.partitionBy(*FILE).orderBy(*_time()))
    out = validations.withColumn("_before", before).where("_before is not null")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "event_id", text(F.array_except("_before", "rules")).alias("resolved"), text(F.array_except("rules", "_before")).alias("new"), F.size(F.array_intersect("rules", "_before")).alias("stayed")
    )


def security_regression(validations: DataFrame) -> DataFrame:
    """Validations with a security finding where the file's one before had none."""
    before = F.lag("has_security").over(Window.partitionBy(*FILE).orderBy(*_time()))
    return validations.withColumn("_before", before).where("has_security and not _before").select("event_id", *FILE)


def session_summary(validations: DataFrame) -> DataFrame:
    """Each session by its files' last validations: score, errors, pass rate; and the number of all validations."""
    counts = validations.groupBy("session_id").agg(F.count("*").alias("validations"))
    last = latest(validations).groupBy("session_id").agg(
        F.count("*").alias("files"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )
    return counts.join(last, "session_id")


def session_snapshot(validations: DataFrame) -> DataFrame:
    return session_summary(validations).select("session_id", F.col("avg_score").alias("score"), (F.col("errors") == 0).alias("passed"), "errors", "warnings")


def unvalidated(changed: DataFrame, validations: DataFrame) -> DataFrame:
    """Changed files (session_id, file_path) without any validation in their session."""
    return changed.join(validations.select(*FILE), FILE, "left_anti")


def newest(validations: DataFrame, keep: int) -> DataFrame:
    """The `keep` sessions whose last validation is newest (ties: by name): what a table of sessions holds at most."""
    last = validations.groupBy("session_id").agg(F.max("ts").alias("last"))
    return last.orderBy(F.desc("last"), "session_id").limit(keep).select("session_id")


def fresh(found: DataFrame, asof: str, hours: int) -> DataFrame:
    """The newest row of each key (name), with whether it is younger than `hours` at `asof`."""
    last = found.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
    return last.select("name", "value", (F.col("ts") >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")).alias("fresh"))


def sessions_by_gap(validations: DataFrame, minutes: int = 30) -> DataFrame:
    """Runs of a user's validations without a gap of `minutes` minutes: start, end and count, and the last run's errors."""
    out = validations.groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("validations"), F.sum("score").alias("score_sum"), F.max_by("errors", F.struct("ts", "event_id")).alias("last_errors"), F.count_distinct("file_path").alias("files")
    )
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "validations", "score_sum", "last_errors", "files")


#: The tier of claims that are still open, or live longer than 2 to the power of this in hours.
OPEN_TIER = 24
#: Claims of one path, tier and stretch that meet as many others in one cell, on average, unless COPIES asks for more; and pairs to compare in one task, on average.
CELL, TASK_PAIRS = 8192, 1 << 27
#: How often a claim is written for further cells, besides its first, on average at most; claims in one pack, at most; claims sorted in one task, on average.
COPIES, PACK, TASK_CLAIMS = 8, 64, 1 << 18


def _hour(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / 3_600_000_000)


def _stretch(at: Column, tier: Column, low: int = 0) -> Column:
    """The stretch of a tier that a stretch of the tier `low` (0: an hour) lies in."""
    return F.when(tier >= OPEN_TIER, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at, tier - low))


def _packer(key: list[str], values: list[str], most: int):
    """Sorted rows -> a row for each run of up to `most` rows of one key (not null), with an array of each value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            at, new = np.arange(n), np.arange(n) == 0
            for name in key:
                new[1:] |= pc.not_equal(batch[name].slice(1), batch[name].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0
            heads = np.flatnonzero(new)
            ends = pa.array(np.append(heads, n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(heads)) for c in key] + [pa.ListArray.from_arrays(ends, batch[c]) for c in values], [*key, *values])

    return pack


def claim_conflicts(claims: DataFrame, cell: int = CELL, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Claims on a file (event_id, session_id, file_path, kind, ts, released) that meet another session's live claim: a write
    meets a write (warning) or a read (info), a read meets a write (warning). A claim without `released` is still open.

    A claim's life falls into at most two stretches of time of its own tier, the least power of two hours that it fits into; open claims share one stretch. A claim looks for others in the
    stretch of its start at each tier there is, so that only claims near in time meet, and each pair once, however long claims live.

    Claims are sorted once, by range, and packed: up to PACK claims of one path, tier and kind that start in one stretch of the least tier become a row with arrays. Packs are what is shuffled
    and what meets; only packs that meet are taken apart, one claim with all that it meets in a pack, then the next with nearly the same, which columnar files hold in little space.

    Where many claims share path, tier and stretch, both sides' packs are dealt by hash into blocks of `cell` claims, and each block meets each in a cell of its own; cells are dealt to as many
    tasks as there are pairs to compare. So neither a path that all claim nor open claims make one task long. Blocks grow where claims would be copied into other cells more than COPIES times on
    average, so that what is shuffled grows as the claims do; what is returned still grows with the square of the claims of a path."""
    least = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    life = _hour(F.col("released")) - _hour(F.col("ts")) + 1
    tier = F.coalesce(F.least(F.ceil(F.log2(life.cast("double"))), F.lit(OPEN_TIER)), F.lit(OPEN_TIER)).cast("int")
    live = F.col("released").isNull() | (F.col("released") > F.col("ts"))
    # claims that never live are in tier -1: they look for others, and none finds them
    claims = claims.where("ts is not null and file_path is not null").withColumn("_tier", F.when(live, tier).otherwise(F.lit(-1)))
    counts = dict(claims.groupBy("_tier").count().collect())  # OPEN_TIER + 2 at most
    tiers = sorted(t for t in counts if t >= 0)
    low = tiers[0] if tiers else OPEN_TIER

    key, values = ["file_path", "_tier", "_writes", "_hours"], ["event_id", "session_id", "ts", "released"]
    claims = claims.withColumn("_writes", F.coalesce(F.col("kind") == "write", F.lit(False))).withColumn("_hours", _stretch(_hour(F.col("ts")), F.lit(low))).select(*key, *values)
    schema = ", ".join(f"{c} {kind}" if c in key else f"{c} array<{kind}>" for c, kind in claims.dtypes)
    order = [*key, "ts", "event_id"]
    ordered = claims.repartitionByRange(max(least, -(-sum(counts.values()) // TASK_CLAIMS)), *order).sortWithinPartitions(*order)
    packs = cut(ordered.mapInArrow(_packer(key, values, min(PACK, cell)), schema))

    asked = packs.drop("released").withColumn("_tier", F.explode(F.array(*map(F.lit, tiers)) if tiers else F.array().cast("array<int>")))
    asked = asked.withColumn("_hours", _stretch(F.col("_hours"), F.col("_tier"), low)).withColumn("_last", F.element_at("ts", -1))
    other = packs.where("_tier >= 0").withColumnsRenamed({c: f"o_{c}" for c in values} | {"_writes": "_owrites"}).withColumn("_first", F.element_at("o_ts", 1))
    first = _stretch(F.col("_hours"), F.col("_tier"), low)
    last = F.coalesce(_stretch(_hour(F.array_max("o_released")), F.col("_tier")), first)
    other = other.withColumn("_hours", F.explode(F.sequence(first, last)))

    place = ["file_path", "_tier", "_hours"]
    zero = F.lit(0).cast("long")
    sized = asked.select(*place, F.size("event_id").alias("_a"), F.when(F.col("_writes"), F.size("event_id")).otherwise(0).alias("_aw"), zero.alias("_o"), zero.alias("_ow"))
    sized = sized.unionByName(other.select(*place, zero.alias("_a"), zero.alias("_aw"), F.size("o_event_id").alias("_o"), F.when(F.col("_owrites"), F.size("o_event_id")).otherwise(0).alias("_ow")))
    sized = sized.groupBy(*place).agg(*[F.sum(c).alias(c) for c in ("_a", "_aw", "_o", "_ow")])
    sized = cut(sized.withColumn("_pairs", F.col("_a").cast("double") * F.col("_ow") + F.col("_aw").cast("double") * (F.col("_o") - F.col("_ow"))).where("_pairs > 0"))
    # blocks of n claims copy each of a claims o / n times and each of o others a / n times
    pairs, copied, rows = (x or 0 for x in sized.agg(F.sum("_pairs"), F.sum(F.col("_a").cast("double") * F.col("_o")), F.sum(F.col("_a") + F.col("_o"))).first())
    cell = max(cell, math.ceil(2 * copied / (COPIES * rows)) if rows else 0)
    sized = sized.withColumn("_a", F.ceil(F.col("_a") / cell)).withColumn("_o", F.ceil(F.col("_o") / cell))
    crowded = F.broadcast(sized.where("_a > 1 or _o > 1").select(*place, "_a", "_o"))  # a row for each `cell` claims at most

    def dealt(packs: DataFrame, own: str, across: str, event: str) -> DataFrame:
        """Packs in each cell that they take part in: of their own block, by each block of the other side."""
        packs = packs.join(crowded, place, "left").withColumn(f"_block{own}", F.pmod(F.xxhash64(event), F.coalesce(own, F.lit(1))))
        return packs.withColumn(f"_block{across}", F.explode(F.sequence(zero, F.coalesce(across, F.lit(1)) - 1))).drop("_a", "_o")

    cells = [*place, "_block_a", "_block_o"]
    tasks = max(least, min(math.ceil(pairs / task_pairs), sized.agg(F.sum(F.col("_a") * F.col("_o"))).first()[0] or 0))
    asked, other = dealt(asked, "_a", "_o", "event_id"), dealt(other, "_o", "_a", "o_event_id")
    # numbers of partitions that are asked for aren't lowered by the little that is shuffled
    met = asked.repartition(tasks, *cells).join(other.repartition(tasks, *cells), cells).where("(_writes or _owrites) and _first <= _last")
    met = met.select(F.when(F.col("_owrites"), "warning").otherwise("info").alias("severity"), *values[:3], *[f"o_{c}" for c in values])
    # observe ends the code that Spark generates for the join, which else would hold all rows of a pack and all packs that it meets at once; now the rows of two packs
    met = met.observe(f"claim packs {uuid.uuid4()}", F.count("*").alias("met"))
    theirs = ["o_event_id", "o_session_id", "o_ts", "o_released"]
    met = met.select("severity", *theirs, "session_id", "ts", F.posexplode("event_id").alias("_i", "event_id"))
    met = met.select("severity", *theirs, "event_id", F.get("session_id", "_i").alias("session_id"), F.get("ts", "_i").alias("ts"))
    met = met.select("severity", "event_id", "session_id", "ts", *theirs[1:], F.posexplode("o_event_id").alias("_j", "other_id"))
    until = F.get("o_released", "_j")
    met = met.where((F.get("o_ts", "_j") <= F.col("ts")) & (until.isNull() | (until > F.col("ts"))) & (F.get("o_session_id", "_j") != F.col("session_id")))
    return met.select("event_id", "other_id", "severity")


def agent_results(validations: DataFrame) -> DataFrame:
    """Per session: files claimed (met), files done (last validation passed), average score, errors."""
    return latest(validations).groupBy("session_id").agg(
        F.count("*").alias("claimed"), F.count_if("passed").alias("done"), F.avg("score").alias("avg_score"), F.sum(F.col("errors") + F.col("warnings")).alias("violations")
    )


def override_counts(overrides: DataFrame, least: int = 5) -> DataFrame:
    """How often each rule (rule_id, severity) was overridden, and the severity one step down from `least` times on."""
    n = overrides.groupBy("rule_id", "severity").agg(F.count("*").alias("overrides"), F.count_distinct("file_path").alias("files"))
    down = F.when(F.col("overrides") >= least, F.when(F.col("severity") == "error", "warning").when(F.col("severity") == "warning", "info"))
    return n.withColumn("suggested", down)
