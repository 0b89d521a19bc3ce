"""Queue, state and running-total queries: requests are orders and events, heartbeats and spend events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.operators import export, running, state
from quillforge.plans.registry import query
from quillforge.session import table


def latest(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The fixed 'now' of time-based queries: the last event's time, as a scalar subquery."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).scalar()


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def q_dedup_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key."""
    return state.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""with s as (select l_orderkey, min(year(l_shipdate)) as y from lineitem group by 1)
select o_orderkey, (case when y is not null and year(o_orderdate) > y then y else year(o_orderdate) end)::INTEGER as year from orders left join s on l_orderkey = o_orderkey""")
def q_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column corrected from a derived table."""
    told = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.year("l_shipdate")).alias("y"))
    own = table(spark, sf_dir, "orders").join(told, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return own.select("o_orderkey", F.when(F.year("o_orderdate") > F.col("y"), F.col("y")).otherwise(F.year("o_orderdate")).alias("year"))


SCALAR = """select c_custkey, (select count(*) from orders o where o.o_custkey = c.c_custkey) as order_count,
(select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F') as final_count from customer c"""


@query(SCALAR)
def q_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts, 0 where there is none."""
    return spark.sql(SCALAR.replace("from orders", "from {orders}").replace("from customer", "from {customer}"), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


@query("""select sn.n_name as supp_nation, cn.n_name as cust_nation, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey
join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation cn on cn.n_nationkey = c_nationkey group by 1, 2""")
def q_role_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension in two roles."""
    nation = table(spark, sf_dir, "nation")
    source, target = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation")), nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    held = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return held.join(source, "s_nationkey").join(target, "c_nationkey").groupBy("supp_nation", "cust_nation").agg(F.count("*").alias("n"))


@query("""select c_custkey, coalesce(case when s_acctbal > 0 then s_acctbal end, case when c_acctbal > 0 then c_acctbal end) as value,
case when s_acctbal > 0 then 'first' when c_acctbal > 0 then 'second' else 'unknown' end as source from customer left join supplier on s_suppkey = c_custkey""")
def q_priority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that knows, with its name."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    first, second = (F.when(F.col(c) > 0, F.col(c)) for c in ("s_acctbal", "c_acctbal"))
    return both.select("c_custkey", F.coalesce(first, second).alias("value"), F.when(first.isNotNull(), "first").when(second.isNotNull(), "second").otherwise("unknown").alias("source"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def q_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's last row."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


@query("select l_linestatus, count(*) filter (where l_returnflag = 'R') as verified, count(*) filter (where l_returnflag <> 'R') as inferred from lineitem group by 1")
def q_verified_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: conditional counts."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("verified"), F.count_if(F.col("l_returnflag") != "R").alias("inferred"))


REQUEST = "case event_type when 'click' then 'requested' when 'view' then 'approved' when 'purchase' then 'running' else 'complete' end"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: id, requested_by, concept, status, created_at, updated_at, decided_at, decided_by."""
    status = F.when(F.col("event_type") == "click", "requested").when(F.col("event_type") == "view", "approved").when(F.col("event_type") == "purchase", "running").otherwise("complete")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("requested_by"), F.concat(F.lit("concept "), (F.col("event_id") % 97).cast("string")).alias("concept"), status.alias("status"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("decided_at"), F.lit(None).cast("string").alias("decided_by"),
    )


REQUESTS = f"reqs as (select event_id as id, user_id as requested_by, 'concept ' || event_id % 97 as concept, {REQUEST} as status, ts, case when event_id % 50 <> 0 then ts end as decided_at from events), n as (select max(ts) as as_of from events)"


@query(f"""with {REQUESTS} select requested_by, count(*) filter (where status in ('requested', 'approved', 'running')) as open, count(*) filter (where ts > as_of - interval 7 day) as week from reqs, n group by 1""")
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open requests and those of the last week."""
    return state.quota(requests(spark, sf_dir), F.lit(latest(spark, sf_dir)).cast("timestamp_ntz"))


@query(f"with {REQUESTS} select id, requested_by from reqs, n where status = 'running' and ts < as_of - interval 10 minute")
def q_stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running requests without a recent heartbeat."""
    return state.stale(requests(spark, sf_dir), latest(spark, sf_dir)).select("id", "requested_by")


@query(f"with {REQUESTS} select id, concept from reqs where status = 'approved' order by decided_at asc nulls first, ts, id limit 1")
def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, R2: the one request a worker takes."""
    return state.claim(requests(spark, sf_dir)).select("id", "concept")


@query(f"""with {REQUESTS} select id, case when status in ('requested', 'approved') and requested_by % 3 = 0 then 'rejected' else status end as status,
case when status in ('requested', 'approved') and requested_by % 3 = 0 then 'owner' end as decided_by from reqs""")
def q_state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded transition."""
    own = requests(spark, sf_dir)
    return state.transition(own, own.where("requested_by % 3 = 0").select("id"), "rejected", "owner", latest(spark, sf_dir)).select("id", "status", "decided_by")


@query(f"""with {REQUESTS}, i as (select o_orderkey as id, 'concept ' || o_orderkey % 131 as concept from orders)
select id, concept from i where concept not in (select concept from reqs where status in ('requested', 'approved', 'running')) qualify row_number() over (partition by concept order by id) = 1""")
def q_open_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open request a concept."""
    incoming = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("concept "), (F.col("o_orderkey") % 131).cast("string")).alias("concept"))
    return state.open_unique(requests(spark, sf_dir), incoming).select("id", "concept")


@query("select event_type, cast(ts as date) as day, count(*) as n, string_agg(event_id::VARCHAR, ',' order by ts, event_id) as ids from events group by 1, 2")
def q_group_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows grouped by type, in order within."""
    own = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    return own.select("event_type", "day", "n", F.array_join(F.transform("e", lambda e: e["event_id"].cast("string")), ",").alias("ids"))


@query("select user_id, string_agg(distinct event_type, ', ' order by event_type) as ops from events group by 1")
def q_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, sorted and joined."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("ops"))


@query("select label, count(*) as n, sum(len(embedding))::BIGINT as total, count(*) filter (where len(embedding) = 0) as n_empty from embeddings group by 1")
def q_array_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array lengths."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("total"), F.count_if(F.size("embedding") == 0).alias("n_empty"))


@query("""with c as (select event_id, cast(round(value * 100) as bigint) as cents, sum(cast(round(value * 100) as bigint)) over (order by ts, event_id rows unbounded preceding) as spent from events)
select event_id, cents, spent::BIGINT as spent from c where spent - cents <= 500000""")
def q_spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to and with the one that passes the cap, in cents."""
    own = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return running.within_cap(own, ["ts", "event_id"], "cents", 500_000, F.date_trunc("hour", "ts")).select("event_id", "cents", "spent")


@query("""with l as (select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
select user_id, count(*) as stages, round(sum(value), 6) as spend from l group by 1""")
def q_counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last cumulative value of each stage, summed."""
    return running.counter_rollup(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "value").withColumn("spend", F.round("spend", 6))


@query("""with t as (select user_id, event_id, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 30)
select user_id, string_agg(event_id::VARCHAR, ',' order by ts, event_id) as tail from t group by 1""")
def q_tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 lines of each job, in order."""
    last = running.tail(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")])
    lines = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    return lines.select("user_id", F.array_join(F.transform("e", lambda e: e["event_id"].cast("string")), ",").alias("tail"))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 50")
def q_recent_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most recent."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming) rows: open orders come again at half the price, with new keys beside them."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    again = own.where("o_orderstatus = 'P'")
    half = (F.col("o_totalprice") / 2).alias("o_totalprice")
    return own, again.select("o_orderkey", "o_orderstatus", half).union(again.select(F.col("o_orderkey") + 10_000_000, "o_orderstatus", half))


INCOMING = "inc as (select o_orderkey, o_orderstatus, o_totalprice / 2 as o_totalprice from orders where o_orderstatus = 'P' union all select o_orderkey + 10000000, o_orderstatus, o_totalprice / 2 from orders where o_orderstatus = 'P')"
STORED = "select o_orderkey, o_orderstatus, o_totalprice from orders"


@query(f"with {INCOMING} {STORED} where o_orderkey not in (select o_orderkey from inc) union all select * from inc")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: incoming rows replace or join the stored ones."""
    return state.upsert(*_incoming(spark, sf_dir), ["o_orderkey"])


@query(f"with {INCOMING} {STORED} union all select * from inc where o_orderkey not in (select o_orderkey from orders)")
def q_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: only new keys are added."""
    return state.insert_ignore(*_incoming(spark, sf_dir), ["o_orderkey"])


@query(f"with {INCOMING} {STORED} where o_orderstatus not in (select o_orderstatus from inc) union all select * from inc")
def q_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: whole partitions replaced."""
    return state.replace_partition(*_incoming(spark, sf_dir), "o_orderstatus")


@query("select case when coalesce(o_totalprice > 200000 and o_orderstatus = 'F', false) then 'removed' else 'kept' end as part, o_orderkey from orders")
def q_delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: what is kept and what is removed."""
    kept, removed = state.delete_returning(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 200_000) & (F.col("o_orderstatus") == "F"))
    return kept.select(F.lit("kept").alias("part"), "o_orderkey").union(removed.select(F.lit("removed").alias("part"), "o_orderkey"))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export a customer: nodes are order statuses, edges its orders."""
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("genealogy_id"), F.col("o_orderstatus").alias("source_node"), F.col("o_orderpriority").alias("target_node"), F.lit("extends").alias("edge_type"),
        F.lit(0.5).alias("confidence"), (F.col("o_orderstatus") == "F").alias("verified"), F.col("o_orderkey").cast("string").alias("source_paper"), F.lit(None).cast("string").alias("target_paper"),
        F.lit('a "quote"\n').alias("source_quote"), F.lit("é").alias("target_quote"),
    )
    from quillforge.schemas import NODE

    genealogy = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("concept"), F.lit("v1").alias("prompt_version"), F.expr(f"cast(array() as array<{NODE}>)").alias("nodes"))
    return export.assemble(genealogy, edges)


@query("select c_name as concept, count(o_orderkey) as edges, count(*) filter (where o_orderstatus = 'F') as verified_edges, count(o_orderkey) - count(*) filter (where o_orderstatus = 'F') as inferred_edges from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name")
def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, A4: assembled exports with their statistics."""
    return _export(spark, sf_dir).select("concept", F.size("edges").cast("long").alias("edges"), "stats.verified_edges", "stats.inferred_edges")


@query("select c_name as concept, o_orderkey as source_paper_id, o_orderstatus as source_node, o_orderpriority as target_node, o_orderstatus = 'F' as verified from customer join orders on o_custkey = c_custkey")
def q_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as JSON texts and back, ids resolved."""
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("arxiv_id"), F.col("o_orderkey").alias("id"))
    return export.restore(export.to_json(_export(spark, sf_dir)), papers).select("concept", "source_paper_id", "source_node", "target_node", "verified")
