"""Jobs, caches and retention as relations: each step takes a table's rows and gives the rows after it.

A job is (id, kind, status, lease_expires, created). What is decided depends on rows and a given time alone, so a step that
is run again after a failure decides the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def _time(at) -> Column:
    return F.lit(at).cast("timestamp") if not isinstance(at, Column) else at


def claim(jobs: DataFrame, now, limit: int, lease: int) -> DataFrame:
    """Jobs with the oldest ``limit`` claimable ones running under a lease of so many seconds: queued, or running under one that has ended."""
    open_ = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires") < _time(now)))
    taken = jobs.where(open_).orderBy("created", "id").limit(min(max(limit, 1), 50)).select("id", F.lit(True).alias("taken"))
    expires = _time(now) + F.make_dt_interval(secs=F.lit(min(max(lease, 1), 86_400)))
    out = jobs.join(F.broadcast(taken), "id", "left")
    return out.select(*(c for c in jobs.columns if c not in ("status", "lease_expires")), F.when(F.col("taken"), "running").otherwise(F.col("status")).alias("status"), F.when(F.col("taken"), expires).otherwise(F.col("lease_expires")).alias("lease_expires"), F.coalesce("taken", F.lit(False)).alias("claimed"))


def heartbeat_after(lease: int) -> int:
    """Seconds after which a worker renews its lease: a third of it."""
    return max(lease // 3, 1)


def finished(jobs: DataFrame, ends: DataFrame) -> DataFrame:
    """Jobs after their ends (id, end): the first end holds, later ones change nothing."""
    out = jobs.join(ends.groupBy("id").agg(F.min("end").alias("end")), "id", "left")
    status = F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise(F.coalesce("end", "status"))
    return out.withColumn("status", status).drop("end")


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs and of the new ones (id, key, ...) those whose key no job holds that has not ended; of new ones with one key the first."""
    active = jobs.where(~F.col("status").isin(*TERMINAL)).select("key").distinct()
    first = new.groupBy("key").agg(F.min_by(F.struct(*new.columns), "id").alias("r")).select("r.*")
    return jobs.unionByName(first.join(active, "key", "left_anti").select(*jobs.columns))


def admitted(jobs: DataFrame, most: int) -> DataFrame:
    """By kind how many run, and whether one more may start."""
    return jobs.groupBy("kind").agg(F.count_if(F.col("status") == "running").alias("running")).withColumn("admit", F.col("running") < most)


#: States of a request's cache entry in the order in which it can pass them.
STATES = ("pending", "running", "ready", "failed")


def cache_states(log: DataFrame) -> DataFrame:
    """The state of each request (key) by its log (key, status, at, id): the last entry holds, an unknown status is ignored."""
    known = log.where(F.col("status").isin(*STATES))
    return known.groupBy("key").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.count("*").alias("changes"))


LIMITS = ("memory", "temp", "download", "upload", "cache")


def resources(demands: DataFrame, limits: dict[str, int], soft: int) -> DataFrame:
    """Demands (one column for each resource) with the first resource that they ask too much of, and whether they pass the soft limit."""
    refused = F.coalesce(*(F.when(F.col(r) > limits[r], F.lit(r)) for r in LIMITS if r in limits))
    return demands.withColumn("refused", refused).withColumn("soft", refused.isNull() & (F.col("memory") > soft))


def claimed_garbage(objects: DataFrame, references: DataFrame, now, hold: int) -> DataFrame:
    """First phase: expired objects (id, expires) that nothing refers to, claimed until ``hold`` seconds from now."""
    free = objects.where(F.col("expires") < _time(now)).join(references.select("id").distinct(), "id", "left_anti")
    return free.withColumn("claimed_until", _time(now) + F.make_dt_interval(secs=F.lit(hold)))


def collected(claims: DataFrame, references: DataFrame, now) -> DataFrame:
    """Second phase: claims with what becomes of them: deleted, kept (referred to since) or lapsed (the claim has ended)."""
    used = references.select("id").distinct().withColumn("used", F.lit(True))
    fate = F.when(F.col("claimed_until") < _time(now), "lapsed").when(F.col("used"), "kept").otherwise("deleted")
    return claims.join(used, "id", "left").withColumn("fate", fate).drop("used")


def newest_kept(files: DataFrame, now, days: int, most: int) -> DataFrame:
    """Files (folder, path, modified) to delete: expired ones, and of the others all but the newest ``most`` of their folder."""
    expired = F.col("modified") < _time(now) - F.make_dt_interval(days=F.lit(days))
    order = W.partitionBy("folder").orderBy(F.desc("modified"), F.desc("path"))
    live = files.where(~expired).withColumn("rn", F.row_number().over(order)).where(F.col("rn") > most).drop("rn")
    return files.where(expired).withColumn("why", F.lit("expired")).unionByName(live.withColumn("why", F.lit("excess")))


def directories(objects: DataFrame) -> DataFrame:
    """Candidates (kind, directory, name, bytes) by directory: names in order, how many, how large."""
    return objects.groupBy("kind", "directory").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))


def artifact_reason(now) -> Column:
    """Why an artifact (job, pinned, status, job_status, expires, cached) is kept, or that it may go."""
    chain = F.when(F.col("job").isNull() | F.col("job_status").isNull(), "protected_missing_parent_worker_job").when(F.col("pinned"), "protected_pinned_artifact").when(F.col("status") == "deleted", "protected_already_deleted").when(F.col("status") != "ready", "protected_artifact_not_ready")
    chain = chain.when(F.col("job_status").isin("queued", "running", "waiting"), "protected_active_parent_worker_job").when(F.col("expires").isNull(), "protected_missing_expires_at").when(F.col("expires") > _time(now), "protected_expires_at_in_future")
    return chain.when(F.col("cached"), "protected_request_cache_reference").otherwise("eligible_expired_unpinned_artifact")


def cache_reason(now, days: int) -> Column:
    """Why a cache entry (status, accessed, job_status) is kept, or that it may go."""
    recent = F.col("accessed") >= _time(now) - F.make_dt_interval(days=F.lit(days))
    return F.when(F.col("status").isin("pending", "running"), "protected_active_request_cache").when(recent, "protected_recent_request_cache_access").when(F.col("job_status").isin("queued", "running", "waiting"), "protected_active_parent_worker_job").otherwise("eligible_stale_request_cache")


def batches(candidates: DataFrame, size: int, execute: bool) -> DataFrame:
    """Candidates (idx from 0) in batches with what is done: deleted, or planned in a dry run."""
    return candidates.withColumn("batch", F.floor(F.col("idx") / size)).withColumn("done", F.lit("deleted" if execute else "planned"))


#: Programs of maintenance jobs.
PROGRAMS = {"artifact_gc": "artifact_gc", "snapshot_gc": "snapshot_gc", "result_gc": "result_gc", "package_artifact_gc": "package_gc", "process_flow_graph_cache": "process_flow_graph_cache_builder"}


def argv(kind: Column, options: dict[str, Column], execute: Column, dry_run: Column) -> Column:
    """The program and arguments of a maintenance job; it executes only if asked to and not also asked for a dry run; null for an unknown one."""
    program = F.try_element_at(F.create_map(*(F.lit(x) for pair in PROGRAMS.items() for x in pair)), kind)
    given = [F.concat(F.lit(f"--{k.replace('_', '-')} "), options[k].cast("string")) for k in sorted(options)]
    return F.when(program.isNotNull(), F.concat_ws(" ", program, *given, F.when(execute & ~dry_run, "--execute").otherwise("--dry-run")))


def visible(rows: DataFrame, owner: str, role: str, user=None) -> DataFrame:
    """What a role may read: the service all rows, a signed-in user its own, others none."""
    if role == "service":
        return rows
    return rows.where(F.col(owner) == user) if role == "authenticated" and user is not None else rows.where(F.lit(False))


#: Names of a payload that may also be written without underscores.
ALIASES = {"job_id": ("jobId", "lcaJobId"), "snapshot_id": ("snapshotId", "modelVersion"), "process_id": ("processId",), "impact_id": ("impactId",), "request_roots": ("requestRoots",)}


def normal_payload(json: Column) -> Column:
    """A payload's values under their canonical names; a canonical name that is there wins over its aliases."""
    m = F.from_json(json, "map<string,string>")
    pick = lambda key, names: F.when(F.map_contains_key(m, key), m[key]).otherwise(F.coalesce(*(m[a] for a in names)))
    return F.struct(*(pick(k, a).alias(k) for k, a in ALIASES.items()))


def request_roots(json: Column) -> Column:
    """Roots (id, version, state) of a manifest's processes, under either spelling; without a list of them null."""
    item = "array<struct<id: string, processId: string, version: string, processVersion: string, stateCode: int, state_code: int>>"
    return F.transform(F.from_json(F.get_json_object(json, "$.processes"), item), lambda p: F.struct(F.coalesce(p["id"], p["processId"]).alias("id"), F.trim(F.coalesce(p["version"], p["processVersion"])).alias("version"), F.coalesce(p["stateCode"], p["state_code"]).alias("state")))
