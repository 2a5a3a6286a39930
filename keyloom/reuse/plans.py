"""Plans as tables, and how much of one plan another has in common with it.

A plan is a list of steps; ``plan_nodes`` has one row per step:
``job_id, pos, op, fn, inputs, mtimes``. Positions are consecutive from 0 in post-order, a
step with op ``scan`` reads files. Two steps match when op and fn agree without regard to
case and the inputs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require_columns
from ..plans.shared import materialise

SCAN = "scan"
SCHEMA = "job_id string, pos int, op string, fn string, inputs array<string>, mtimes array<bigint>"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _plans(nodes: DataFrame) -> DataFrame:
    """(job_id, plan, scans): a digest per step in order, and where the scans are.

    Steps are digested before they move, so plans stay short whatever the steps say.
    """
    require_columns(nodes, ["job_id", "pos", "op", "fn", "inputs"])
    step = F.struct(
        F.lower(F.coalesce("op", F.lit(""))).alias("op"),
        F.lower(F.coalesce("fn", F.lit(""))).alias("fn"),
        F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"),
    )
    is_scan = F.lower(F.coalesce("op", F.lit(""))) == SCAN
    steps = nodes.select(
        "job_id", "pos", _digest(F.to_json(step)).alias("digest"), is_scan.alias("is_scan")
    )
    gathered = steps.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "is_scan"))).alias("steps")
    )
    scans = F.filter(F.transform("steps", lambda e, i: F.when(e["is_scan"], i)), lambda i: i.isNotNull())
    return gathered.select(
        "job_id", F.transform("steps", lambda e: e["digest"]).alias("plan"), scans.alias("scans")
    )


def _common_run(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Number of equal steps of plan a from i on and plan b from j on."""
    same = F.zip_with(F.slice(a, i + 1, F.size(a)), F.slice(b, j + 1, F.size(b)), lambda x, y: x.eqNullSafe(y))
    # a difference is added behind the last step, so one is always found
    return (F.array_position(F.array_append(same, F.lit(False)), False) - 1).cast("int")


def match_plans(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Longest common run of steps that starts at a scan, for each asked pair of jobs.

    ``pairs`` has (job_a, job_b). Result: (job_a, job_b, matched, begin_a, end_a, begin_b,
    end_b); without a match all numbers are 0. Of equal runs the earliest in a, then in b,
    is taken. One row per pair is joined, and the work on it is bounded by the two plans.
    The plans are put together once and read for both sides.
    """
    plans = materialise(_plans(nodes), "plans")
    asked = pairs.select("job_a", "job_b").distinct()
    a = plans.select(F.col("job_id").alias("job_a"), F.col("plan").alias("a"), F.col("scans").alias("scans_a"))
    b = plans.select(F.col("job_id").alias("job_b"), F.col("plan").alias("b"), F.col("scans").alias("scans_b"))

    def run(i: Column, j: Column) -> Column:
        return F.struct(
            _common_run(F.col("a"), i, F.col("b"), j).alias("matched"), (-i).alias("i"), (-j).alias("j")
        )

    runs = F.flatten(F.transform("scans_a", lambda i: F.transform("scans_b", lambda j: run(i, j))))
    found = F.filter(runs, lambda r: r["matched"] > 0)
    # plans compress well, so their file size would pass as small enough to broadcast
    both = asked.join(a.hint("merge"), "job_a", "left").join(b.hint("merge"), "job_b", "left")
    best = both.select(
        "job_a", "job_b", F.array_max(found).alias("r")
    )
    matched, i, j = F.col("r.matched"), -F.col("r.i"), -F.col("r.j")
    fields = {
        "matched": matched,
        "begin_a": i,
        "end_a": i + matched - 1,
        "begin_b": j,
        "end_b": j + matched - 1,
    }
    return best.select("job_a", "job_b", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in fields.items()])


def reuse_matrix(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(job_a, job_b, share): matched steps as a share of the steps of a, a real ratio.

    Entries are computed for the asked pairs; the full matrix of many jobs is never built.
    """
    sizes = nodes.groupBy(F.col("job_id").alias("job_a")).agg(F.count(F.lit(1)).alias("steps"))
    return (
        match_plans(nodes, pairs)
        .join(sizes, "job_a")
        .select("job_a", "job_b", (F.col("matched") / F.col("steps")).alias("share"))
    )


def plan_prefixes(nodes: DataFrame) -> DataFrame:
    """(job_id, steps, begin, matched, prefix): every run that starts at a scan, by a digest.

    Two jobs have a common run of length n exactly when they share a prefix of length n, so
    pairs need not be formed to find the best partner.
    """
    starts = _plans(nodes).select(
        "job_id", F.size("plan").alias("steps"), "plan", F.explode("scans").alias("begin")
    )
    rest = F.slice("plan", F.col("begin") + 1, F.size("plan"))
    # each digest covers its step and the digest before it
    digests = F.aggregate(
        rest,
        F.array().cast("array<binary>"),
        lambda done, step: F.array_append(
            done,
            _digest(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), step)),
        ),
    )
    return starts.select(
        "job_id", "steps", "begin", F.posexplode(digests).alias("at", "prefix")
    ).select("job_id", "steps", "begin", (F.col("at") + 1).alias("matched"), "prefix")


def plan_reuse(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """For each job, the earlier job with the greatest share; that one stores, this one reads.

    ``order`` has (job_id, seq). Result: (job_id, source_job, share); jobs that share nothing
    with an earlier one are left out, ties go to the earliest. Linear in the number of steps:
    each prefix keeps only the earliest job that has it.
    """
    prefixes = materialise(
        plan_prefixes(nodes).join(order.select("job_id", "seq"), "job_id"), "prefixes"
    )
    earliest = prefixes.groupBy("prefix").agg(
        F.min_by("job_id", "seq").alias("source_job"), F.min("seq").alias("source_seq")
    )
    best = (
        prefixes.join(earliest, "prefix")
        .filter(F.col("source_seq") < F.col("seq"))
        .groupBy("job_id")
        .agg(
            F.max_by(
                F.struct("source_job", (F.col("matched") / F.col("steps")).alias("share")),
                F.struct("matched", (-F.col("source_seq")).alias("s")),
            ).alias("best")
        )
    )
    return best.select("job_id", "best.source_job", "best.share")
