"""Corpus-selection and graph queries on the stand-in tables.

Works are parts, states are brands; an order's earlier line cites its later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as X
from quillforge.operators import corpus, graph, vectors
from quillforge.plans.registry import query
from quillforge.session import table

PAIRS = """pairs as (select a.l_partkey as src, b.l_partkey as dst, a.l_shipdate as shipped from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_partkey <> b.l_partkey)"""
CITES = "cites as (select l_partkey, count(*) as cites from lineitem group by 1)"
SEEDS = "seeds as (select p_partkey as id from part where p_brand in ('Brand#1', 'Brand#2') order by p_retailprice desc, p_partkey limit 150)"
FREQ = "freq as (select dst, count(*) as refs from pairs where src in (select id from seeds) group by 1)"
HOP = "hop as (select dst as id, refs from freq where refs >= 2 and dst not in (select id from seeds) order by refs desc, dst limit 300)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, shipped): citations, repeats kept."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    a, b = lines.alias("a"), lines.alias("b")
    on = F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_partkey <> b.l_partkey")
    return a.join(b, on).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"), F.col("a.l_shipdate").alias("shipped"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2"))
    return parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(150).select(F.col("p_partkey").alias("id"))


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("cites"))


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_node, target_node, shipped): citations between parts of different brands, the cited one as source."""
    placed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("node_id"))
    return graph.cross_node_edges(pairs(spark, sf_dir).select(F.col("src").alias("citing"), F.col("dst").alias("cited"), "shipped"), placed)


BRAND_EDGES = f"{PAIRS}, edges as (select s.p_brand as source_node, t.p_brand as target_node, shipped from pairs join part s on s.p_partkey = dst join part t on t.p_partkey = src where s.p_brand <> t.p_brand)"


@query("select p_partkey, p_name, case when p_partkey % 3 = 0 then cast(p_size as varchar) else p_size || '–' || (p_size + p_partkey % 3) end as span from part where p_name is not null")
def q_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection with a computed column."""
    high = (F.col("p_size") + F.col("p_partkey") % 3).cast("long")
    return table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", "p_name", X.year_span(F.col("p_size").cast("long"), high).alias("span"))


@query(f"with {CITES} select p_partkey, coalesce(cites, 0) as cites from part left join cites on l_partkey = p_partkey where p_brand = 'Brand#1' order by 2 desc, 1 limit 400")
def q_seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of one concept, the most cited first, at most 400."""
    own = table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").join(cites(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), "left")
    return own.select("p_partkey", F.coalesce("cites", F.lit(0)).alias("cites")).orderBy(F.desc("cites"), "p_partkey").limit(400)


@query("select doc_id, n_chars from documents where contains(text, 'tion') order by n_chars desc, doc_id limit 100")
def q_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text filter and top k."""
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion"))).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query(f"with {PAIRS}, {SEEDS}, {FREQ} select dst, refs from freq")
def q_ref_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: reference frequency from the seeds."""
    return corpus.reference_frequency(seeds(spark, sf_dir), pairs(spark, sf_dir).select("src", "dst"))


@query(f"with {PAIRS}, {SEEDS}, {FREQ}, {HOP} select id, refs from hop")
def q_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop expansion."""
    own = seeds(spark, sf_dir)
    return corpus.one_hop(corpus.reference_frequency(own, pairs(spark, sf_dir).select("src", "dst")), own).select(F.col("dst").alias("id"), "refs")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and expansion with references and citations, the best of each (name, type)."""
    own = seeds(spark, sf_dir)
    frequency = corpus.reference_frequency(own, pairs(spark, sf_dir).select("src", "dst"))
    hop = corpus.one_hop(frequency, own)
    both = own.select("id", F.lit(1).alias("seed")).unionByName(hop.select(F.col("dst").alias("id"), F.lit(0).alias("seed")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    counted = both.join(frequency.withColumnRenamed("dst", "id"), "id", "left").join(cites(spark, sf_dir).withColumnRenamed("l_partkey", "id"), "id", "left").join(parts, "id")
    filled = counted.select("id", "seed", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("cites", F.lit(0)).alias("cites"), "p_name", "p_type")
    return corpus.keep_best(filled, ["p_name", "p_type"], [F.desc("seed"), F.desc("refs"), F.desc("cites"), F.asc("id")])


POOL = f"""{PAIRS}, {CITES}, {SEEDS}, {FREQ}, {HOP},
both_ as (select id, 1 as seed from seeds union all select id, 0 from hop),
filled as (select b.id, seed, coalesce(f.refs, 0) as refs, coalesce(c.cites, 0) as cites, p_name, p_type from both_ b
  left join freq f on f.dst = b.id left join cites c on c.l_partkey = b.id join part on p_partkey = b.id),
pool as (select id, seed, refs, cites, p_name, p_type from filled qualify row_number() over (partition by p_name, p_type order by seed desc, refs desc, cites desc, id) = 1)"""


@query(f"with {POOL} select id, seed, refs, cites from pool")
def q_dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each key, the earliest on ties."""
    return _pool(spark, sf_dir).select("id", "seed", "refs", "cites")


@query(f"""with {POOL}, scored as (select id, seed, refs, cites, round(2 * ln(1 + refs) + ln(1 + cites), 6) as score from pool order by 5 desc, 1 limit 150)
select row_number() over (order by score desc, id) as rnk, id as p_partkey, seed, refs, cites, score from scored""")
def q_corpus_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: J7, O7, W2, F6 over the whole selection."""
    return corpus.rank(_pool(spark, sf_dir)).withColumnRenamed("id", "p_partkey")


@query("""with q as (select embedding::DOUBLE[] as q from embeddings where vec_id = 0),
n as (select vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) as cos from embeddings, q order by 2 desc, 1 limit 150)
select vec_id, cos from n where cos >= 0.1""")
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 150 by cosine to one query vector, then the floor."""
    own = table(spark, sf_dir, "embeddings")
    return vectors.cosine_top_k(own, own.where("vec_id = 0").select("embedding").scalar(), 150, 0.1)


@query("select label, unnest(generate_series(0, len(embedding) - 1))::INTEGER as dim, unnest(embedding)::DOUBLE as x from embeddings".join(["select label, dim, round(avg(x), 6) as mean from (", ") group by 1, 2"]))
def q_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label."""
    return vectors.centroids(table(spark, sf_dir, "embeddings")).select("label", "dim", F.round("mean", 6).alias("mean"))


@query("""with x as (select label, vec_id, unnest(generate_series(0, len(embedding) - 1)) as dim, unnest(embedding)::DOUBLE as x from embeddings),
c as (select label, dim, avg(x) as m from x group by 1, 2),
n as (select x.label, vec_id, round(sum(x * m), 6) as near from x join c on x.label = c.label and x.dim = c.dim group by 1, 2)
select label, vec_id, near from n qualify row_number() over (partition by label order by near desc, vec_id) = 1""")
def q_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector nearest to each centroid."""
    return vectors.representatives(table(spark, sf_dir, "embeddings"))


@query()
def q_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters within each label; tests hold it against a plain version."""
    return vectors.clusters(table(spark, sf_dir, "embeddings"), cutoff=0.75, group="label")


@query("with m as (select o_orderkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey group by 1, 2) select l_partkey::VARCHAR as member, o_orderkey::VARCHAR as node_id from m")
def q_explode_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with nested members, exploded back to a lookup."""
    member = F.struct(F.col("l_partkey").cast("string").alias("arxiv_id"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    nodes = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set(member).alias("members"))
    return graph.node_of_members(nodes.select(F.col("o_orderkey").cast("string").alias("node_id"), "members"))


@query(f"with {BRAND_EDGES} select source_node, target_node, count(*) as n from edges group by 1, 2")
def q_cross_node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations across states."""
    return brand_edges(spark, sf_dir).groupBy("source_node", "target_node").agg(F.count("*").alias("n"))


@query(f"""with {BRAND_EDGES}, y as (select source_node, target_node, min(nullif(year(shipped), 1992)) as y from edges group by 1, 2)
select source_node, target_node, coalesce(y, 0)::INTEGER as year, row_number() over (partition by source_node order by coalesce(y, 0), target_node)::INTEGER as pos from y""")
def q_edges_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state's edges by year, unknown years as 0 and first."""
    from pyspark.sql import Window

    years = brand_edges(spark, sf_dir).groupBy("source_node", "target_node").agg(F.min(F.nullif(F.year("shipped"), F.lit(1992))).alias("y"))
    known = years.select("source_node", "target_node", F.coalesce("y", F.lit(0)).alias("year"))
    return known.withColumn("pos", F.row_number().over(Window.partitionBy("source_node").orderBy("year", "target_node")))


@query(f"""with {BRAND_EDGES}, d as (select source_node as node, 1 as first from edges union all select target_node, case when source_node <> target_node then 1 else 0 end from edges)
select node, count(*) as ends, sum(first)::BIGINT as edges from d group by 1""")
def q_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree by ends and by edges."""
    return graph.degrees(brand_edges(spark, sf_dir).select(F.col("source_node").alias("src"), F.col("target_node").alias("dst")))


@query(f"with {PAIRS}, r as (select * from pairs where extract(day from shipped) = 1) select p_partkey as node from part where p_partkey not in (select src from r) and p_partkey not in (select dst from r)")
def q_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a citation on the first of a month, in or out."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.isolated(nodes, pairs(spark, sf_dir).where(F.dayofmonth("shipped") == 1).select("src", "dst"))


FAMILY = f"""with recursive {PAIRS}, e as (select src, dst from pairs group by 1, 2 having count(*) >= 2),
ways as (select src, dst from e union select dst, src from e),
reach as (select src as node, src as other from ways union select r.node, w.dst from reach r join ways w on w.src = r.other),
label as (select node, min(other) as family from reach group by 1),
years as (select l_partkey, min(year(l_shipdate)) as y from lineitem group by 1)
select family, count(*) as size, min(y)::INTEGER as first_year, max(y)::INTEGER as last_year from label left join years on l_partkey = node group by 1"""


@query(FAMILY)
def q_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected families of parts cited together twice, with size and years."""
    edges = pairs(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n >= 2").select("src", "dst")
    years = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("y"))
    own = graph.components(edges).join(years, F.col("l_partkey") == F.col("node"), "left")
    return own.groupBy(F.col("label").alias("family")).agg(F.count("*").alias("size"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


@query("""with y as (select p_brand, min(nullif(year(l_shipdate), 1992)) as y from part join lineitem on l_partkey = p_partkey group by 1)
select 'n' || row_number() over (order by coalesce(y, 9999), p_brand) as node_id, p_brand, y::INTEGER as year_start from y""")
def q_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States numbered in time; the window runs over the states only."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.nullif(F.year("l_shipdate"), F.lit(1992)).alias("y"))
    first = table(spark, sf_dir, "part").join(lines, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.min("y").alias("year_start"))
    number = F.row_number().over(Window.orderBy(F.coalesce("year_start", F.lit(9999)), "p_brand"))
    return first.select(F.concat(F.lit("n"), number.cast("string")).alias("node_id"), "p_brand", "year_start")


@query("""select p_partkey, min(nullif(year(l_shipdate), 1992))::INTEGER as low, max(nullif(year(l_shipdate), 1992))::INTEGER as high,
case when min(nullif(year(l_shipdate), 1992)) = max(nullif(year(l_shipdate), 1992)) then cast(min(nullif(year(l_shipdate), 1992)) as varchar)
  else min(nullif(year(l_shipdate), 1992)) || '–' || max(nullif(year(l_shipdate), 1992)) end as span
from part join lineitem on l_partkey = p_partkey group by 1""")
def q_year_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last known year of each part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.nullif(F.year("l_shipdate"), F.lit(1992)).alias("y"))
    span = table(spark, sf_dir, "part").select("p_partkey").join(lines, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return span.withColumn("span", X.year_span(F.col("low"), F.col("high")))


@query("select l_partkey, string_agg(y, ',' order by y) as years, count(*)::INTEGER as n from (select distinct l_partkey, cast(year(l_shipdate) as varchar) as y from lineitem) group by 1")
def q_collect_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members collected in order."""
    years = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.year("l_shipdate"))).alias("y"))
    return years.select("l_partkey", F.array_join(F.transform("y", lambda y: y.cast("string")), ",").alias("years"), F.size("y").alias("n"))


@query(f"""with {BRAND_EDGES}, m as (select case when source_node = 'Brand#1' then 'Brand#2' else source_node end as s, case when target_node = 'Brand#1' then 'Brand#2' else target_node end as t from edges)
select s as source_node, t as target_node, count(*) as n from m where s <> t group by 1, 2""")
def q_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state merged into another, edges rewired, self-loops gone."""
    from quillforge.operators.curation import rewire

    return rewire(brand_edges(spark, sf_dir), "Brand#1", "Brand#2").groupBy("source_node", "target_node").agg(F.count("*").alias("n"))


@query("select p_partkey from part except select l_partkey from lineitem where l_quantity >= 40 and l_returnflag = 'R'")
def q_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one set that the other lacks."""
    gone = table(spark, sf_dir, "lineitem").where("l_quantity >= 40 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("select p_partkey from part where p_size > 20 intersect select l_partkey from lineitem where l_quantity >= 40 and l_returnflag = 'R'")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of both sets."""
    both = table(spark, sf_dir, "lineitem").where("l_quantity >= 40 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 20").select("p_partkey").join(both, "p_partkey", "left_semi")
