"""Text, grounding and export queries: texts are documents, quotes benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import text as X
from quillforge.operators import export, extract, grounding
from quillforge.plans.registry import query
from quillforge.session import table

#: Each document is checked against the item whose number is its own modulo the number of items.
KEYED = "keyed as (select d.*, b.text as quote from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    quotes = items.select(F.col("item_id").alias("_item"), F.col("text").alias("quote"))
    return table(spark, sf_dir, "documents").withColumn("_item", F.col("doc_id") % items.agg(F.count("*")).scalar()).join(quotes, "_item").drop("_item")


@query(f"""with {KEYED}, v as (select doc_id, contains(text, quote) and quote <> '' as src, contains(text, substring(text, 11, 30)) and substring(text, 11, 30) <> '' as tgt from keyed)
select doc_id, src and tgt as verified, concat_ws('+', case when src then 'src' end, case when tgt then 'tgt' end) as reason from v""")
def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both quotes of an edge against their texts."""
    edges = keyed(spark, sf_dir).select("doc_id", F.col("text").alias("source_text"), F.col("quote").alias("source_quote"), F.col("text").alias("target_text"), F.substring("text", 11, 30).alias("target_quote"))
    return grounding.ground(edges).select("doc_id", "verified", "reason")


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) and b.text <> ''")
def q_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote that any text contains."""
    return grounding.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("select d.doc_id, d.n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def q_cache_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cache lacks."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def q_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of a dynamic list."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("""select l.doc_id, d.source, l.quality, row_number() over (partition by d.source order by case when d.n_chars % 7 = 0 then null else d.n_chars end asc nulls last, l.doc_id)::INTEGER as pos
from labels l join documents d on d.doc_id = l.doc_id where l.toxic = 0""")
def q_defs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with their papers, unknown years last."""
    both = table(spark, sf_dir, "labels").where("toxic = 0").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    order = Window.partitionBy("source").orderBy(F.asc_nulls_last(F.when(F.col("n_chars") % 7 != 0, F.col("n_chars"))), "doc_id")
    return both.select("doc_id", "source", "quality", F.row_number().over(order).alias("pos"))


@query(r"""with """ + KEYED + r""", w as (select doc_id, list_filter(list_distinct(regexp_extract_all(lower(quote), '[a-z0-9]+')), lambda w: length(w) > 3 and w not in (
  'with', 'from', 'using', 'their', 'this', 'that', 'than', 'then', 'into', 'over', 'under', 'between', 'through', 'towards', 'toward', 'based', 'very', 'your', 'ours', 'about', 'which', 'while', 'were', 'have', 'been', 'does')) as words, lower(text) as hay from keyed)
select doc_id, round(case when len(words) > 0 then len(list_filter(words, lambda w: contains(hay, w))) / len(words) end, 6) as ratio from w""")
def q_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a title's significant words in a text."""
    return keyed(spark, sf_dir).select("doc_id", F.round(X.title_match(F.col("quote"), F.col("text")), 6).alias("ratio"))


@query(r"""with m as (""" + r"""with """ + KEYED + r""", w as (select doc_id, list_filter(list_distinct(regexp_extract_all(lower(quote), '[a-z0-9]+')), lambda w: length(w) > 3 and w not in (
  'with', 'from', 'using', 'their', 'this', 'that', 'than', 'then', 'into', 'over', 'under', 'between', 'through', 'towards', 'toward', 'based', 'very', 'your', 'ours', 'about', 'which', 'while', 'were', 'have', 'been', 'does')) as words, lower(text) as hay, lang from keyed)
select doc_id, lang, case when len(words) > 0 then len(list_filter(words, lambda w: contains(hay, w))) / len(words) end as ratio from w) select doc_id, lang from m where coalesce(ratio, 0) >= 0.5""")
def q_title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown ratio counts as none."""
    return keyed(spark, sf_dir).where(F.coalesce(X.title_match(F.col("quote"), F.col("text")), F.lit(0.0)) >= 0.5).select("doc_id", "lang")


@query("select lang, count(*) as n from documents where lang <> '' group by 1 having count(*) > 0")
def q_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each field."""
    return table(spark, sf_dir, "documents").where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


PRICES = "(values ('large', 5.0::DOUBLE, 25.0::DOUBLE), ('medium', 3.0, 15.0), ('small', 1.0, 5.0)) as p(model, per_in, per_out)"


@query(f"""with t as (select sum(cast(floor(length(text) / 2.6) as bigint))::BIGINT as t_in, (count(*) * 350)::BIGINT as t_out from documents)
select model, t_in, t_out, round(t_in / 1e6 * per_in + t_out / 1e6 * per_out, 6) as usd, (t_in / 1e6 * per_in + t_out / 1e6 * per_out) > 1.0 as over_cap from t, {PRICES}""")
def q_cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every model would cost; one row of totals meets three prices."""
    totals = table(spark, sf_dir, "documents").agg(F.sum(X.estimate_tokens(F.length("text"))).alias("t_in"), (F.count("*") * 350).alias("t_out"))
    prices = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("per_in"), F.lit(b).alias("per_out")) for m, a, b in extract.PRICES))
    priced = totals.select("t_in", "t_out", F.inline(prices))
    usd = X.cost_usd(F.col("t_in"), F.col("t_out"), F.col("per_in"), F.col("per_out"))
    return priced.select("model", "t_in", "t_out", F.round(usd, 6).alias("usd"), (usd > 1.0).alias("over_cap"))


@query("select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by length(text) desc, doc_id) = 1")
def q_max_by_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of each source."""
    best = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("d"), "n_chars")).alias("b"))
    return best.select("source", (-F.col("b.d")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


@query(r"""with w as (select doc_id, string_split(text, ' ') as ws from documents),
x as (select doc_id, len(ws)::INTEGER as n_words, len(list_distinct(ws))::INTEGER as n_distinct, md5(array_to_string(ws, ' ')) as rebuilt from w)
select doc_id, n_words, n_distinct, rebuilt from x""")
def q_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word positions, and the text rebuilt from them."""
    own = table(spark, sf_dir, "documents").select("doc_id", X.inverted_index(F.col("text")).alias("index"))
    n = F.aggregate(F.map_values("index"), F.lit(0), lambda s, x: s + F.size(x))
    return own.select("doc_id", n.alias("n_words"), F.size("index").alias("n_distinct"), F.md5(X.from_inverted_index(F.col("index"))).alias("rebuilt"))


@query(r"""with n as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) as t from documents)
select doc_id, length(t)::INTEGER as n, md5(t) as hash, length(t) >= 201 as usable from n""")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text and the gate on its length."""
    own = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))
    return own.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("hash"), (F.length("t") >= 201).alias("usable"))


@query("select doc_id, md5(substring(text, 1, 40000)) as head, case when length(text) > 46 then substring(text, 1, 46) || '…' else text end as title from documents")
def q_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded prompt takes of a text, and an ellipsis for a table."""
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", F.md5(F.substring("text", 1, 40_000)).alias("head"), X.ellipsis(F.col("text"), 46).alias("title"))


@query(r"""select page_id, regexp_extract(url, '://([^/?#]+)', 1) as host, nullif(regexp_extract(url, '/([0-9]+)(?:\.html|/)?(?:[?#].*)?$', 1), '')::BIGINT as id,
lower(regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '[^A-Za-z0-9]+', '_', 'g')) as slug from pages""")
def q_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids and slugs out of URLs."""
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    number = F.nullif(F.regexp_extract("url", r"/([0-9]+)(?:\.html|/)?(?:[?#].*)?$", 1), F.lit("")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), number.alias("id"), X.slug(host).alias("slug"))


@query(r"""with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as t from pages)
select page_id, length(t)::INTEGER as n, md5(t) as hash from t""")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 for web pages."""
    own = table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return own.select("page_id", F.length("t").alias("n"), F.md5("t").alias("hash"))


IDS = """ids as (select o_orderkey, case when o_orderkey % 3 = 0 then 'cs/' || strftime(o_orderdate, '%y%m') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')
  when o_orderkey % 11 = 0 then 'none' else strftime(o_orderdate, '%y%m') || '.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') end as aid, case when o_orderkey % 5 = 0 then 0 else 1990 + o_orderkey % 20 end as y from orders)"""


@query(f"""with {IDS}, p as (select o_orderkey, aid, y, case when regexp_matches(aid, '^[0-9]{{4}}\\.[0-9]{{4,5}}$') then substring(aid, 1, 2)::INTEGER when regexp_matches(aid, '^[a-z.-]+/[0-9]{{7}}$') then substring(split_part(aid, '/', 2), 1, 2)::INTEGER end as yy,
  regexp_matches(aid, '^[0-9]{{4}}\\.') as new from ids),
q as (select o_orderkey, aid, y, (case when yy >= 91 then 1900 + yy else 2000 + yy end)::INTEGER as own, (case when new or yy < 91 then 2000 + yy else 1900 + yy end)::INTEGER as own2 from p)
select o_orderkey, aid, own as arxiv_year, least(own, nullif(y, 0))::BIGINT as earliest, (case when y > own2 then own2 else y end)::BIGINT as repaired, replace(aid, '/', '_') as stem from q""")
def q_arxiv_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years told by ids."""
    key, ym = F.col("o_orderkey"), F.date_format("o_orderdate", "yyMM")
    old = F.concat(F.lit("cs/"), ym, F.lpad((key % 1000).cast("string"), 3, "0"))
    new = F.concat(ym, F.lit("."), F.lpad((key % 100000).cast("string"), 5, "0"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 == 0, old).when(key % 11 == 0, "none").otherwise(new).alias("aid"), F.when(key % 5 == 0, 0).otherwise(1990 + key % 20).alias("y"))
    aid, y = F.col("aid"), F.col("y")
    return own.select("o_orderkey", "aid", X.arxiv_year(aid).alias("arxiv_year"), X.earliest_year(aid, y).cast("long").alias("earliest"), X.repaired_year(aid, y).cast("long").alias("repaired"), X.stem(aid).alias("stem"))


@query(r"""with c as (select c_custkey, regexp_replace(lower(trim('  ' || c_mktsegment || '   ' || c_name)), '\s+', ' ', 'g') as concept, c_custkey % 7 = 0 as owner, c_custkey % 400 as wanted, 'fields/' || c_nationkey as f from customer)
select c_custkey, concept, regexp_matches(concept, '^[a-z0-9][a-z0-9 -]{1,59}$') as valid, (case when owner then least(300, greatest(5, coalesce(nullif(wanted, 0), 150))) else 150 end)::BIGINT as corpus_limit,
case when regexp_matches(f, '^fields/\d{1,4}$') then f else 'fields/17' end as field, nullif(substring(trim(regexp_replace(concept || chr(9) || 'x', '[\x00-\x1f]', ' ', 'g')), 1, 200), '') as gloss from c""")
def q_request_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request form's fields become."""
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("   "), F.col("c_name"))
    own = table(spark, sf_dir, "customer").select("c_custkey", X.clean_concept(raw).alias("concept"), F.concat(F.lit("fields/"), F.col("c_nationkey").cast("string")).alias("f"))
    limit = X.corpus_limit(F.col("c_custkey") % 400, F.col("c_custkey") % 7 == 0).cast("long")
    return own.select("c_custkey", "concept", X.valid_concept(F.col("concept")).alias("valid"), limit.alias("corpus_limit"), X.valid_field(F.col("f")).alias("field"), X.clean_gloss(F.concat("concept", F.lit("\tx"))).alias("gloss"))


@query(r"""with c as (select conv_id, turn, role, text from conversations where trim(text) <> ''), n as (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from c)
select conv_id, string_agg(md5(text), '|' order by rn) as contexts from n where rn <= 4 group by 1""")
def q_context_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four contexts that aren't blank."""
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    first = F.slice(F.filter("t", lambda x: F.trim(x["text"]) != ""), 1, 4)
    return lists.select("conv_id", F.array_join(F.transform(first, lambda x: F.md5(x["text"])), "|").alias("contexts")).where("contexts <> ''")


BASES = r"""bases as (select p_partkey, regexp_replace(lower(regexp_extract(trim(p_name), '(\S+)$', 1)), '[^a-z0-9]', '', 'g') || coalesce(y::VARCHAR, '') ||
  coalesce(lower(list_filter(regexp_extract_all(p_type, '[A-Za-z]+'), lambda w: length(w) > 2 and lower(w) not in ('a', 'an', 'the', 'on', 'of', 'in', 'for', 'and', 'with', 'is', 'are', 'to', 'by'))[1]), 'paper') as base, p_name, p_type, y
  from part left join (select l_partkey, min(year(l_shipdate)) as y from lineitem group by 1) on l_partkey = p_partkey)"""


def _keyed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.year("l_shipdate")).alias("y"))
    name = F.regexp_extract(F.trim("p_name"), r"(\S+)$", 1)
    own = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").join(years, "p_partkey", "left")
    return export.cite_keys(own.withColumn("base", X.key_base(X.ascii_key_of_ascii(name), F.col("y"), F.col("p_type"))), "base", ["p_partkey"])


#: Keys given one after the other: the first of base, base a, base b, ... that no row before has.
WALK = f"""{BASES.replace("bases as", "recursive bases as", 1)}, r as (select *, regexp_replace(base, '[a-z]+$', '') as stem, row_number() over (partition by regexp_replace(base, '[a-z]+$', '') order by p_partkey) as i, count(*) over (partition by base) as c from bases),
walk as (select stem, i, p_partkey, base as key, [base] as taken from r where i = 1 union all
  select stem, i, p_partkey, k, list_append(taken, k) from (select r.stem, r.i, r.p_partkey, w.taken, list_filter(list_transform(range(0, r.c + 30), lambda j: r.base || case when j = 0 then '' else chr((96 + j)::INTEGER) end), lambda x: not list_contains(w.taken, x))[1] as k
    from walk w join r on r.stem = w.stem and r.i = w.i + 1))"""


@query(f"with {WALK} select p_partkey, key from walk")
def q_cite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation keys, collisions lettered."""
    return _keyed_parts(spark, sf_dir).select("p_partkey", "key")


@query(f"""with {WALK} select p_partkey, '@article{{' || key || ',' || chr(10) || '  title = {{' || replace(replace(p_type || ' & 5%', '&', '\\&'), '%', '\\%') || '}},' || chr(10) || '  author = {{' || p_name || '}},' || chr(10)
|| coalesce('  year = {{' || y || '}},' || chr(10), '') || '}}' as entry from walk join bases using (p_partkey)""")
def q_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography entries with TeX escapes."""
    return _keyed_parts(spark, sf_dir).select("p_partkey", export.bib_entry(F.col("key"), F.concat("p_type", F.lit(" & 5%")), F.col("y"), F.array("p_name")).alias("entry"))


@query()
def q_extract_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline extractor on every document."""
    return extract.extract(table(spark, sf_dir, "documents"), "tion")
