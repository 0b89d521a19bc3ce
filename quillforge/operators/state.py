"""Tables as values: upserts, guarded transitions, claims, sweeps and quotas.

Each function takes the current rows and gives the new ones; ``swap`` writes them beside the old table
and puts them in place. There is one writer; readers see the old or the new table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.operators.running import tail


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """K1, K3: incoming rows replace those of their key; other rows stay. Keys of incoming are unique."""
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def insert_ignore(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """K2: incoming rows are added where their key is new."""
    return current.unionByName(incoming.join(current.select(*key), key, "left_anti"))


def replace_partition(current: DataFrame, incoming: DataFrame, partition: str) -> DataFrame:
    """K4: incoming rows replace all rows of the partitions they fall into."""
    return current.join(incoming.select(partition).distinct(), partition, "left_anti").unionByName(incoming)


def delete_returning(current: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """K6: (kept, removed); a null condition keeps."""
    gone = F.coalesce(gone, F.lit(False))
    return current.where(~gone), current.where(gone)


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Each key's first row by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: From which states a request may come into each state.
FROM = {"approved": ("requested",), "rejected": ("requested", "approved"), "running": ("approved",), "complete": ("running",), "failed": ("running",)}


def transition(requests: DataFrame, ids: DataFrame, to: str, by: str | None, as_of: datetime) -> DataFrame:
    """The requests of ``ids`` (id) go to a state they may come into; others stay as they are."""
    hit = F.col("_hit").isNotNull() & F.col("status").isin(*FROM[to])
    marked = requests.join(ids.select("id", F.lit(1).alias("_hit")).distinct(), "id", "left")
    out = marked.withColumn("decided_by", F.when(hit & F.lit(to in ("approved", "rejected")), F.lit(by)).otherwise(F.col("decided_by")))
    return out.withColumn("updated_at", F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, F.lit(to)).otherwise(F.col("status"))).drop("_hit").select(requests.columns)


def claim(requests: DataFrame) -> DataFrame:
    """O3, R2: the approved request that waits longest: undated decisions first, then by creation and id."""
    return requests.where("status = 'approved'").orderBy(F.asc_nulls_first("decided_at"), "created_at", "id").limit(1)


def start(requests: DataFrame, as_of: Column) -> DataFrame:
    """R2: the claimed request runs from now on; with one writer, no other worker can claim it again."""
    taken = claim(requests).select(F.col("id").alias("_taken"))
    hit = F.col("_taken").isNotNull()
    now = lambda c: F.when(hit, as_of).otherwise(F.col(c))
    marked = requests.join(F.broadcast(taken), F.col("id") == F.col("_taken"), "left")
    return marked.withColumn("started_at", now("started_at")).withColumn("updated_at", now("updated_at")).withColumn("status", F.when(hit, "running").otherwise(F.col("status"))).select(requests.columns)


def requeue(requests: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Interrupted requests (id) are approved again, not started; results they have cached stay."""
    marked = requests.join(ids.select("id", F.lit(1).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit").isNotNull()
    out = marked.withColumn("status", F.when(hit, "approved").otherwise(F.col("status"))).withColumn("started_at", F.when(~hit, F.col("started_at")))
    return out.withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).withColumn("message", F.when(hit, "worker interrupted; requeued").otherwise(F.col("message"))).select(requests.columns)


def fail(requests: DataFrame, failures: DataFrame, lines: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Requests of ``failures`` (id, reason) fail, with their last ``n`` of ``lines`` (id, pos, line) in the error."""
    last = tail(lines, "id", [F.desc("pos")], n).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("_tail"))
    marked = requests.join(failures.join(last, "id", "left").select("id", F.concat("reason", F.coalesce(F.concat(F.lit("\n\n--- last output ---\n"), "_tail"), F.lit(""))).alias("_error")), "id", "left")
    hit = F.col("_error").isNotNull()
    out = marked.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("error", F.coalesce("_error", "error"))
    return out.withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).select(requests.columns)


def flushes(updates: DataFrame, job: str, at: str, tie: str, forced: str, every: float = 1.0) -> DataFrame:
    """The updates of each job that are written: forced ones, and those ``every`` seconds after the last written.

    Which are written depends on the one written before, so a job's updates are folded in order of (at, tie).
    """
    row = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(forced).alias("forced"))
    ordered = updates.groupBy(job).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    wait = F.expr(f"make_dt_interval(0, 0, 0, {float(every)!r})")
    zero = F.struct(F.lit(None).cast(updates.schema[at].dataType).alias("last"), F.expr(f"cast(array() as array<{updates.schema[tie].dataType.simpleString()}>)").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        write = x["forced"] | s["last"].isNull() | (x["at"] >= s["last"] + wait)
        return F.when(write, F.struct(x["at"].alias("last"), F.array_append(s["kept"], x["tie"]).alias("kept"))).otherwise(s)

    return ordered.select(job, F.explode(F.aggregate("rows", zero, step, lambda s: s["kept"])).alias(tie))


def upsert_genealogies(current: DataFrame, edges: DataFrame, incoming: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """K3: genealogies of (concept, prompt_version) in ``incoming`` (with nodes) keep their id, take the new nodes, run again
    and lose their edges; new ones get ids after the largest. Keys of incoming are unique."""
    key = ["concept", "prompt_version"]
    new = incoming.select(*key, F.col("nodes").alias("_nodes"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    kept = current.join(new, key, "left")
    out = kept.withColumn("nodes", F.when(hit, F.col("_nodes")).otherwise(F.col("nodes"))).withColumn("status", F.when(hit, "running").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
    # The window runs over the new rows, not over the table.
    number = F.row_number().over(Window.orderBy(*key)) + F.coalesce(current.agg(F.max("id")).scalar(), F.lit(0))
    fresh = incoming.join(current.select(*key), key, "left_anti").select(number.cast("long").alias("id"), *key, "nodes", F.lit("running").alias("status"), as_of.alias("updated_at"))
    cleared = edges.join(kept.where(hit).select(F.col("id").alias("genealogy_id")), "genealogy_id", "left_anti").select(edges.columns)
    return out.select(current.columns).unionByName(fresh.select(current.columns)), cleared


def stale(requests: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    """Running requests whose last heartbeat is more than ``minutes`` ago."""
    return requests.where((F.col("status") == "running") & (F.col("updated_at") < F.lit(as_of) - F.expr(f"make_dt_interval(0, 0, {int(minutes)})")))


def quota(requests: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(requested_by, open, week): requests still open, and those of the last ``days``."""
    open_now = F.col("status").isin("requested", "approved", "running")
    recent = F.col("created_at") > as_of - F.expr(f"make_dt_interval({int(days)})")
    return requests.groupBy("requested_by").agg(F.count_if(open_now).alias("open"), F.count_if(recent).alias("week"))


def open_unique(requests: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming requests whose concept has no open one; of several, the first by id."""
    held = requests.where(F.col("status").isin("requested", "approved", "running")).select("concept")
    return newest(incoming.join(held, "concept", "left_anti"), ["concept"], [F.asc("id")])


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule (name: condition that must not be false), with the names they break."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)
