"""Curation, queue and source queries: outlines are nations with their suppliers as members, edges their customers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as X
from quillforge.operators import corpus, curation, export, extract, state
from quillforge.plans.registry import query
from quillforge.schemas import EDIT, NODE
from quillforge.session import table

AT = datetime.datetime(2024, 5, 1, 12)
TYPES = curation.EDGE_TYPES

MEMBERS = "m as (select 'n' || n_nationkey as node_id, n_name as label, s_suppkey as k, case when s_suppkey % 7 <> 0 then 1990 + s_suppkey % 30 end as y from nation left join supplier on s_nationkey = n_nationkey)"
KINDS = f"[{', '.join(repr(t) for t in TYPES)}]"
EDGES = f"e as (select c_custkey as id, 'n' || c_nationkey as s, 'n' || c_custkey % 25 as t, {KINDS}[c_custkey % 6 + 1] as kind from customer)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("s_suppkey") % 7 != 0, (1990 + F.col("s_suppkey") % 30).cast("int"))
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    member = F.when(F.col("s_suppkey").isNotNull(), F.struct(F.col("s_suppkey").alias("k"), year.alias("year"), F.col("s_name").alias("title")))
    packed = own.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return packed.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("label"), F.array_min(F.transform("m", lambda x: x["year"])).alias("year_start"), F.array_max(F.transform("m", lambda x: x["year"])).alias("year_end"),
        F.transform("m", lambda x: x["k"].cast("long")).alias("definition_ids"), F.lit(None).cast("string").alias("representative_arxiv_id"), F.transform("m", lambda x: F.struct(x["k"].cast("string").alias("arxiv_id"), x["year"].alias("year"), x["title"].alias("title"))).alias("members"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("genealogy_id"), node(F.col("c_nationkey")).alias("source_node"), node(F.col("c_custkey") % 25).alias("target_node"), kind.alias("edge_type"))


@query(f"with {MEMBERS}, {EDGES}, d as (select node, count(*) as ends from (select s as node from e union all select t from e) group by 1), n as (select node_id, label, min(y) as y from m group by 1, 2) select node_id, label, y::INTEGER as year_start, coalesce(ends, 0) as ends, coalesce(ends, 0) = 0 as isolated from n left join d on d.node = n.node_id")
def q_curate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their edge ends."""
    return curation.listing(nodes(spark, sf_dir), edges(spark, sf_dir)).select("node_id", "label", "year_start", "ends", "isolated")


@query(f"""with {MEMBERS}, x as (select case when node_id = 'n3' then 'n7' else node_id end as node_id, node_id = 'n3' as moved, k, y, node_id in ('n3', 'n7') as merged from m),
g as (select node_id, string_agg(k::VARCHAR, ',' order by case when merged then coalesce(y, 9999) end, moved, k) as members, string_agg(distinct k::VARCHAR, ',' order by k::VARCHAR) as ids, min(y)::INTEGER as year_start, max(y)::INTEGER as year_end from x group by 1)
select g.*, n_name as label from g join nation on node_id = 'n' || n_nationkey""")
def q_curate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node merged into another: members by year, ids as a sorted set, the span of both."""
    merged, _ = curation.merge(nodes(spark, sf_dir), edges(spark, sf_dir), "n3", "n7")
    joined = lambda a: F.nullif(F.array_join(a, ","), F.lit(""))
    return merged.select("node_id", "label", joined(F.transform("members", lambda m: m["arxiv_id"])).alias("members"), joined(F.array_sort(F.transform("definition_ids", lambda i: i.cast("string")))).alias("ids"), "year_start", "year_end")


@query(f"with {EDGES}, w as (select id, kind, case when s = 'n3' then 'n7' else s end as s, case when t = 'n3' then 'n7' else t end as t from e) select id, s as source_node, t as target_node, kind as edge_type from w where s <> t")
def q_curate_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges rewired to the merged node, self-loops gone."""
    return curation.merge(nodes(spark, sf_dir), edges(spark, sf_dir), "n3", "n7")[1].select("id", "source_node", "target_node", "edge_type")


@query("select 'n' || a.n_nationkey as node_id, 'n' || b.n_nationkey as into, b.n_name as label from nation a join nation b on a.n_nationkey <> b.n_nationkey")
def q_merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node may be merged into."""
    return curation.merge_targets(nodes(spark, sf_dir))


@query(f"with {MEMBERS}, {EDGES} select 'node' as part, node_id as id, case when node_id = 'n5' then 'renamed' else label end as value from (select distinct node_id, label from m) where node_id <> 'n2' union all select 'edge', id::VARCHAR, case when id = 7 then 'merges' else kind end from e where s <> 'n2' and t <> 'n2' and id <> 11")
def q_curate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node renamed, one deleted with its edges, an edge deleted, one reclassified."""
    named = curation.rename(nodes(spark, sf_dir), "n5", " renamed ")
    kept, left = curation.delete_node(named, edges(spark, sf_dir), "n2")
    left = curation.reclassify(curation.delete_edge(left, 11), 7, "merges")
    return kept.select(F.lit("node").alias("part"), F.col("node_id").alias("id"), F.col("label").alias("value")).unionByName(left.select(F.lit("edge").alias("part"), F.col("id").cast("string").alias("id"), F.col("edge_type").alias("value")))


def _genealogies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a region: id, concept, prompt_version, status, nodes, user_edits, updated_at; every second has an edit."""
    edit = F.struct(F.lit("merge").alias("op"), F.lit("{}").alias("detail"), F.lit(AT).cast("timestamp").alias("at"), F.lit("me").alias("by"))
    none = F.expr(f"cast(array() as array<{EDIT}>)")
    return table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("long").alias("id"), F.lower("r_name").alias("concept"), F.lit("v1").alias("prompt_version"), F.lit("complete").alias("status"), F.expr(f"cast(array() as array<{NODE}>)").alias("nodes"),
        F.when(F.col("r_regionkey") % 2 == 0, F.array(edit)).otherwise(none).alias("user_edits"), F.lit(AT).cast("timestamp").alias("updated_at"),
    )


@query("select r_regionkey + 1 as id, case when r_regionkey % 2 = 0 then 'merge,rename' else 'rename' end as ops, (case when r_regionkey % 2 = 0 then 2 else 1 end)::INTEGER as n, 'owner' as by from region")
def q_curate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry at the end of each audit."""
    told = _genealogies(spark, sf_dir).withColumn("user_edits", curation.record(F.col("user_edits"), "rename", '{"node": "n1"}', AT, "owner"))
    return told.select(F.col("id").cast("int").alias("id"), F.array_join(F.transform("user_edits", lambda e: e["op"]), ",").alias("ops"), F.size("user_edits").alias("n"), F.element_at("user_edits", -1)["by"].alias("by"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests with all that workers write: the text of a failure, messages and times."""
    from quillforge.plans.states import requests

    none = lambda kind: F.lit(None).cast(kind)
    return requests(spark, sf_dir).withColumn("started_at", F.col("created_at")).withColumn("message", none("string")).withColumn("error", none("string")).withColumn("genealogy_id", F.col("id") % 5 + 1)


STATUS = "case event_type when 'click' then 'requested' when 'view' then 'approved' when 'purchase' then 'running' else 'complete' end"
LAST = "(select max(ts) from events)"


@query("select 'genealogy' as part, r_regionkey + 1 as id, null::BIGINT as link from region where r_regionkey <> 1 union all select 'edge', c_custkey, null from customer where c_custkey % 5 <> 1 union all select 'request', event_id, case when event_id % 5 <> 1 then event_id % 5 + 1 end from events")
def q_delete_genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genealogy whose concept was typed goes with its edges; requests lose their link to it."""
    linked = edges(spark, sf_dir).withColumn("genealogy_id", F.col("id") % 5 + 1)
    every = _genealogies(spark, sf_dir)
    # The second is deleted; the third is not, as another concept was typed.
    left = curation.delete_genealogy(every, linked, _requests(spark, sf_dir), 2, "america")
    kept, own, asked = curation.delete_genealogy(*left, 3, "asia minor")
    part = lambda df, name, link=F.lit(None).cast("long"): df.select(F.lit(name).alias("part"), F.col("id").cast("long").alias("id"), link.alias("link"))
    return part(kept, "genealogy").unionByName(part(own, "edge")).unionByName(part(asked, "request", F.col("genealogy_id")))


@query("select concept, n_nodes, ops, id from (select lower(r_name) as concept, 0::INTEGER as n_nodes, case when r_regionkey % 2 = 0 then 'merge' else '' end as ops, r_regionkey + 1 as id from region union all select lower(r_name) || ' again', 0, 'restore', 5 + row_number() over (order by lower(r_name) || ' again') from region)")
def q_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports restored beside what is there, each with its audit and a new id."""
    own = _genealogies(spark, sf_dir)
    none = edges(spark, sf_dir).limit(0).select("id", "genealogy_id", "source_node", "target_node", "edge_type", F.lit(0.5).alias("confidence"), F.lit(True).alias("verified"), *(F.lit("").alias(c) for c in ("source_paper", "target_paper", "source_quote", "target_quote")))
    texts = export.to_json(export.assemble(own.withColumn("concept", F.concat("concept", F.lit(" again"))), none))
    back = export.restored_genealogies(texts, own, "backup.json", AT)
    return back.select("concept", F.size("nodes").alias("n_nodes"), F.array_join(F.transform("user_edits", lambda e: e["op"]), ",").alias("ops"), F.col("id").cast("int").alias("id"))


@query("select 'genealogy' as part, r_regionkey + 1 as id, lower(r_name) as concept, case when r_regionkey < 2 then 'running' else 'complete' end as status from region union all select 'genealogy', 6, 'new', 'running' union all select 'edge', c_custkey, null, null from customer where c_custkey % 5 + 1 > 2")
def q_upsert_genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: ids stay, nodes are new, edges of what was there are cleared."""
    own = _genealogies(spark, sf_dir).drop("user_edits")
    incoming = own.where("id <= 2").select("concept", "prompt_version", "nodes").union(own.where("id = 1").select(F.lit("new"), "prompt_version", "nodes"))
    kept, left = state.upsert_genealogies(own, edges(spark, sf_dir).withColumn("genealogy_id", F.col("id") % 5 + 1), incoming, F.lit(AT).cast("timestamp"))
    rows = kept.select(F.lit("genealogy").alias("part"), F.col("id").cast("long").alias("id"), "concept", "status")
    return rows.unionByName(left.select(F.lit("edge").alias("part"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("concept"), F.lit(None).cast("string").alias("status")))


@query(f"""with r as (select event_id as id, {STATUS} as status, ts, case when event_id % 50 <> 0 then ts end as decided_at from events), c as (select id from r where status = 'approved' order by decided_at asc nulls first, ts, id limit 1)
select id, case when id in (select id from c) then 'running' else status end as status, case when id in (select id from c) then {LAST} else ts end as started_at from r""")
def q_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the claimed request's transition."""
    from quillforge.plans.states import latest

    return state.start(_requests(spark, sf_dir), latest(spark, sf_dir)).select("id", "status", "started_at")


@query(f"""with r as (select event_id as id, {STATUS} as status, ts from events) select id, case when status = 'running' and id % 3 = 0 then 'approved' when status = 'running' and id % 3 = 1 then 'failed' else status end as status,
case when status <> 'running' or id % 3 <> 0 then ts end as started_at, case when status = 'running' and id % 3 = 0 then 'worker interrupted; requeued' end as message,
case when status = 'running' and id % 3 = 1 then 'stage failed' || chr(10) || chr(10) || '--- last output ---' || chr(10) || (select string_agg('line ' || i, chr(10) order by i) from range(6, 36) t(i)) end as error from r""")
def q_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted requests are queued again, failed ones keep the last 30 lines."""
    from quillforge.plans.states import latest

    own = _requests(spark, sf_dir)
    running, now = own.where("status = 'running'"), latest(spark, sf_dir)
    broken = running.where("id % 3 = 1").select("id", F.lit("stage failed").alias("reason"))
    lines = broken.select("id", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("pos")).withColumn("line", F.concat(F.lit("line "), F.col("pos").cast("string")))
    return state.fail(state.requeue(own, running.where("id % 3 = 0"), now), broken, lines, now).select("id", "status", "started_at", "message", "error")


@query("""with recursive o as (select user_id, ts, event_id, event_type = 'purchase' as forced, row_number() over (partition by user_id order by ts, event_id) as i from events),
w as (select user_id, i, event_id, ts as last, true as written from o where i = 1
  union all select o.user_id, o.i, o.event_id, case when forced or o.ts >= w.last + interval 1 hour then o.ts else w.last end, forced or o.ts >= w.last + interval 1 hour from w join o on o.user_id = w.user_id and o.i = w.i + 1)
select user_id, event_id from w where written""")
def q_flush_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a job's updates, those that are written: one an hour here, and all forced ones."""
    own = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("forced"))
    return state.flushes(own, "user_id", "ts", "event_id", "forced", 3600.0)


@query("""with p as (select doc_id, lang, source, case when n_chars % 5 <> 0 then (n_chars % 100) / 100 end as match, case when doc_id % 4 <> 0 then n_chars % 50 end as cited from documents),
d as (select doc_id, case when quality = 1 then 'en' else 'de' end as lang from labels)
select doc_id, lang, source, row_number() over (partition by lang, source order by cited desc nulls last, doc_id)::INTEGER as pos from p where coalesce(match, 0) >= 0.5 and not exists (select 1 from d where d.doc_id = p.doc_id and d.lang = p.lang and p.source = 'web')""")
def q_to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not extracted yet under all three keys, the most cited first, unknown counts last."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("concept"), F.col("source").alias("prompt_version"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 100 / 100).alias("match"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 50).alias("cited_by_count"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("concept"), F.lit("web").alias("prompt_version"))
    return corpus.to_extract(own, done).select(F.col("id").alias("doc_id"), F.col("concept").alias("lang"), F.col("prompt_version").alias("source"), "pos")


@query("""with w as (select o_orderkey as k, case o_orderkey % 4 when 0 then '10.48550/arXiv.' || o_orderkey when 1 then '10.1/x' end as doi, case when o_orderkey % 3 <> 0 then 'https://arxiv.org/' || case when o_orderkey % 2 = 0 then 'abs' else 'pdf' end || '/2101.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || 'v' || o_orderkey % 7 end as url from orders)
select k, case when k % 4 = 0 then k::VARCHAR else nullif(regexp_extract(coalesce(url, ''), '(\\d{4}\\.\\d{5})', 1), '') end as aid, case when url is not null and k % 2 = 0 then '2101.' || lpad((k % 100000)::VARCHAR, 5, '0') end as plain from w""")
def q_arxiv_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids by DOI, else by location; versions stripped."""
    k = F.col("o_orderkey")
    number = F.concat(F.lit("2101."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v"), (k % 7).cast("string"))
    url = F.when(k % 3 != 0, F.concat(F.lit("https://arxiv.org/"), F.when(k % 2 == 0, "abs").otherwise("pdf"), F.lit("/"), number))
    doi = F.when(k % 4 == 0, F.concat(F.lit("10.48550/arXiv."), k.cast("string"))).when(k % 4 == 1, "10.1/x")
    places = F.array(F.struct(F.when(k % 2 == 0, url).alias("landing_page_url"), F.when(k % 2 != 0, url).alias("pdf_url")))
    own = table(spark, sf_dir, "orders")
    return own.select(k.alias("k"), X.arxiv_id(doi, places).alias("aid"), F.when(k % 2 == 0, X.strip_version(url)).alias("plain"))


@query(r"""with n as (select c_custkey as k, case c_custkey % 4 when 0 then 'Müller' || c_custkey || ', Ana' when 1 then 'Aaron van den Öst' || c_custkey when 2 then 'Zoë' else 'Ann Lee' || c_custkey end as name from customer),
s as (select k, case k % 4 when 0 then 'Müller' || k when 1 then 'van den Öst' || k when 2 then 'Zoë' else 'Lee' || k end as surname from n)
select k, surname, regexp_replace(lower(strip_accents(surname)), '[^a-z0-9]', '', 'g') as ascii from s""")
def q_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surnames of both orders of names, and their ASCII keys."""
    k = F.col("c_custkey")
    number = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("Müller"), number, F.lit(", Ana"))).when(k % 4 == 1, F.concat(F.lit("Aaron van den Öst"), number)).when(k % 4 == 2, "Zoë").otherwise(F.concat(F.lit("Ann Lee"), number))
    own = table(spark, sf_dir, "customer").select(k.alias("k"), X.surname(name).alias("surname"))
    return own.withColumn("ascii", X.ascii_key(F.col("surname")))


@query(r"""with t as (select doc_id, '\section{' || source || '} ' || replace(text, chr(92), ' ') || ' \cite[p. 3]{x}  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' as t from documents),
c as (select doc_id, regexp_replace(t, '\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})?', ' ', 'g') as t from t),
n as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) as t from c) select doc_id, md5(t) as hash from n""")
def q_latex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commands with their arguments removed, the rest normalised."""
    tex = F.concat(F.lit("\\section{"), "source", F.lit("} "), F.replace("text", F.lit("\\"), F.lit(" ")), F.lit(" \\cite[p. 3]{x}  \n\n\n\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.latex_to_text(tex)).alias("hash"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' as text, len(embedding)::INTEGER as n, round(list_sum(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)::DOUBLE)), 6) as total from embeddings")
def q_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors as text and back."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", X.vector_text(F.col("embedding")).alias("text"))
    back = X.vector_of_text(F.col("text"))
    return own.select("vec_id", "text", F.size(back).alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("select label, count(*) as n, string_agg(vec_id::VARCHAR, ',' order by vec_id) as ids, round(sum(embedding[1]::DOUBLE), 6) as first from embeddings group by 1")
def q_answer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come in any order are put back in the order of their index."""
    own = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    # Answers as a service may give them: by another order than they were asked in.
    given = F.transform(F.array_sort(F.collect_list(F.struct(F.hash("vec_id").alias("h"), F.col("vec_id").alias("index"), F.col("e").alias("embedding")))), lambda x: F.struct(x["index"].alias("index"), x["embedding"].alias("embedding")))
    answers = own.groupBy("label").agg(given.alias("answer"))
    put = answers.select("label", extract.in_order(F.col("answer")).alias("v"), F.array_sort(F.transform("answer", lambda x: x["index"])).alias("ids"))
    return put.select("label", F.size("v").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x[0]), 6).alias("first"))


@query("select p_brand as query, 'C' || p_partkey as concept_id from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1")
def q_resolve_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each search's five matches."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")) - 1
    matches = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), place.alias("pos"), F.concat(F.lit("https://example.org/C"), F.col("p_partkey").cast("string")).alias("id")).where("pos < 5")
    return corpus.resolve_concept(matches)


@query("""with r as (select o_orderkey as citing, list_value({'c': 'p' || l_partkey, 'x': l_returnflag}) as refs from orders join lineitem on l_orderkey = o_orderkey)
select citing, refs[1].c as cited, case when trim(refs[1].x) <> '' then '1,' || refs[1].x || ',2,3' else '1,2,3' end as contexts, count(*) as n from r group by all""")
def q_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids with their first four contexts that aren't blank; references without an id go."""
    known = F.struct(F.struct(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ArXiv")).alias("externalIds")).alias("citedPaper"), F.array(F.lit(""), F.lit("1"), F.col("l_returnflag"), F.lit(" "), F.lit("2"), F.lit("3"), F.lit("4")).alias("contexts"), F.array(F.lit("x")).alias("intents"), F.lit(True).alias("isInfluential"))
    none = F.struct(F.struct(F.struct(F.lit(None).cast("string").alias("ArXiv")).alias("externalIds")).alias("citedPaper"), F.array(F.lit("1")).alias("contexts"), F.array(F.lit("x")).alias("intents"), F.lit(True).alias("isInfluential"))
    papers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("citing"), F.array(known, none).alias("refs"))
    return corpus.cited_references(papers).groupBy("citing", "cited", F.array_join("contexts", ",").alias("contexts")).agg(F.count("*").alias("n"))


@query("""select event_id, event_type as model, round(event_id % 1000 / 1e6 * case event_type when 'click' then 5.0 when 'view' then 1.0 else 3.0 end + event_id % 70 / 1e6 * case event_type when 'click' then 25.0 when 'view' then 5.0 else 15.0 end, 9) as usd from events""")
def q_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uses of models by their prices, unknown models by the default's."""
    prices = (("click", 5.0, 25.0), ("view", 1.0, 5.0), ("medium", 3.0, 15.0))
    uses = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"))
    return extract.priced(uses, prices).select("event_id", "model", F.round("usd", 9).alias("usd"))
