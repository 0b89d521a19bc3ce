"""Citation keys, bibliographies and JSON round trips."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.functions.text import tex_escape, year_span
from quillforge.operators.curation import record
from quillforge.schemas import EXPORT, EXPORTED_EDGE


def cite_keys(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """``key``: the base or, while a row before (by ``order``) has that key, the base with a, b, c, ...

    A base by itself needs only its number among equal ones. Bases that differ from another by one last
    letter may meet its suffixed keys; their rows are keyed one after the other, together with all
    bases that differ in last letters only, as no others can meet. Beyond z come the characters after it.
    """
    own = rows.select(base).distinct()
    short = own.select(F.col(base).alias("_long"), F.expr(f"left({base}, length({base}) - 1)").alias(base)).where(F.col("_long").rlike("[a-z]$")).join(own, base)
    mixed = short.select(base).union(short.select(F.col("_long").alias(base))).distinct().withColumn("_mixed", F.lit(True))
    marked = rows.join(mixed, base, "left")
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    alone = marked.where("_mixed is null").drop("_mixed").withColumn("key", F.concat(F.col(base), F.when(n > 1, F.chr(F.lit(95) + n)).otherwise("")))

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, keys = set(), []
        following: dict[str, int] = {}
        pdf = pdf.sort_values(order, ignore_index=True)
        for name in pdf[base]:
            i = following.get(name, 0)
            while (key := name + (chr(96 + i) if i else "")) in taken:
                i += 1
            taken.add(key)
            following[name] = i
            keys.append(key)
        return pdf.assign(key=keys).drop(columns="_stem")

    stems = marked.where("_mixed").drop("_mixed").select(*rows.columns, F.regexp_replace(base, "[a-z]+$", "").alias("_stem"))
    kind = T.StructType([*rows.schema.fields, T.StructField("key", T.StringType())])
    together = stems.groupBy("_stem").applyInPandas(one_by_one, kind)
    return alone.select(*rows.columns, "key").unionByName(together)


def bib_entry(key: Column, title: Column, year: Column, authors: Column) -> Column:
    """K9: one BibTeX entry; a missing year leaves its line out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@article{"), key, F.lit(",")),
        F.concat(F.lit("  title = {"), tex_escape(title), F.lit("},")),
        F.concat(F.lit("  author = {"), F.array_join(F.transform(authors, tex_escape), " and "), F.lit("},")),
        F.concat(F.lit("  year = {"), F.nullif(year, F.lit(0)).cast("string"), F.lit("},")),
        F.lit("}"),
    )


def group_by_type(edges: DataFrame, label: Column) -> DataFrame:
    """(edge_type, n, lines): each type's edges by year of the source, unknown years first."""
    line = F.struct(F.coalesce("year", F.lit(0)).alias("year"), F.col("id").alias("id"), label.alias("label"))
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["label"]).alias("lines"))


def assemble(genealogy: DataFrame, edges: DataFrame) -> DataFrame:
    """K8: one row of ``schemas.EXPORT`` for each genealogy (id, concept, prompt_version, nodes)."""
    columns = ("source_node", "target_node", "edge_type", "confidence", "verified", "source_paper", "target_paper", "source_quote", "target_quote")
    packed = F.struct("id", F.struct(*(F.col(c).cast("double").alias(c) if c == "confidence" else F.col(c) for c in columns)).alias("e"))
    own = edges.groupBy(F.col("genealogy_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["e"]).alias("edges"), F.count("*").alias("n"), F.count_if("verified").alias("v"))
    joined = genealogy.join(own, "id", "left")
    empty = F.expr(f"cast(array() as array<{EXPORTED_EDGE}>)")
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))
    stats = F.struct(F.size("nodes").cast("long").alias("nodes"), n.alias("edges"), v.alias("verified_edges"), (n - v).alias("inferred_edges"))
    return joined.select("concept", "prompt_version", "nodes", F.coalesce("edges", empty).alias("edges"), stats.alias("stats"))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def restored_genealogies(texts: DataFrame, genealogies: DataFrame, source: str, at: datetime) -> DataFrame:
    """``genealogies`` (id, concept, prompt_version, status, nodes, user_edits) with the exported ones
    (column json) as complete rows of their own, whose audit says where they came from.

    One that is there already ends the job with an error that names it. New ids follow the largest.
    """
    g = texts.select(F.from_json("json", EXPORT).alias("g")).select("g.concept", "g.prompt_version", "g.nodes")
    held = genealogies.select("concept", "prompt_version", F.col("id").alias("_held"))
    there = F.concat(F.lit("there is a genealogy of "), F.col("concept"), F.lit(" "), F.col("prompt_version"))
    fresh = g.join(held, ["concept", "prompt_version"], "left").withColumn("concept", F.when(F.col("_held").isNotNull(), F.raise_error(there)).otherwise(F.col("concept")))
    audit = record(F.lit(None), "restore", f'{{"from": "{source}"}}', at, "cli")
    # The window runs over the rows that are restored, not over the table.
    number = F.row_number().over(Window.orderBy("concept", "prompt_version")) + F.coalesce(genealogies.agg(F.max("id")).scalar(), F.lit(0))
    new = fresh.select(number.cast("long").alias("id"), "concept", "prompt_version", F.lit("complete").alias("status"), "nodes", audit.alias("user_edits"))
    return genealogies.select(*new.columns).unionByName(new)


def envelope(rows: DataFrame, now: datetime) -> DataFrame:
    """One JSON text {now, rows} of a list that was limited to what an answer may hold."""
    packed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return packed.select(F.to_json(F.struct(F.lit(now).cast("timestamp").alias("now"), "rows"), {"ignoreNullFields": "false"}).alias("json"))


def restore(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges of exported JSON (column json) with paper ids by ``papers`` (arxiv_id, id).

    An id that papers lack ends the job with an error that names it.
    """
    rows = texts.select(F.from_json("json", EXPORT).alias("g")).select("g.concept", "g.prompt_version", F.posexplode("g.edges").alias("pos", "e")).select("concept", "prompt_version", "pos", "e.*")
    for side in ("source", "target"):
        ids = papers.select(F.col("arxiv_id").alias(f"{side}_paper"), F.col("id").alias(f"{side}_paper_id"))
        rows = rows.join(ids, f"{side}_paper", "left")
        missing = F.col(f"{side}_paper").isNotNull() & F.col(f"{side}_paper_id").isNull()
        rows = rows.withColumn(f"{side}_paper_id", F.when(missing, F.raise_error(F.concat(F.lit("no paper "), F.col(f"{side}_paper")))).otherwise(F.col(f"{side}_paper_id")))
    return rows


def markdown(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """K9: (section, part, pos, line) of a Markdown outline; write the lines in that order.

    Section 1 has a numbered heading and the citations of each node (by first year, unknown last),
    section 2 the relationships by type and year of the cited paper, section 3 the nodes without any.
    nodes: schemas.NODE's fields. edges: source_node, target_node, edge_type, confidence, verified,
    source_paper, target_paper. keys: paper, key, year. A paper without a key is left out.
    """
    cite = lambda c: F.concat(F.lit("\\cite{"), c, F.lit("}"))
    order = Window.orderBy(F.asc_nulls_last("year_start"), "node_id")  # over the nodes of one outline
    member = nodes.select("node_id", F.posexplode_outer("members").alias("at", "m")).join(keys.select(F.col("paper").alias("_p"), "key"), F.col("m.arxiv_id") == F.col("_p"), "left")
    cited = member.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", cite(F.col("key")).alias("c")))), lambda x: x["c"]), ", ").alias("cites"))
    span = F.coalesce(year_span(F.col("year_start"), F.col("year_end")), F.lit("undated"))
    numbered = nodes.select("node_id", "label", "year_start", span.alias("span"), F.row_number().over(order).cast("long").alias("n")).join(cited, "node_id")
    first = numbered.select(F.lit(1).alias("section"), F.lit("").alias("part"), F.col("n").alias("pos"), F.concat_ws("\n", F.format_string("## %d. %s (%s)", F.col("n"), F.col("label"), F.col("span")), F.nullif("cites", F.lit(""))).alias("line"))
    label = nodes.select("node_id", "label")
    named = edges.join(label.toDF("source_node", "s"), "source_node").join(label.toDF("target_node", "t"), "target_node")
    named = named.join(keys.toDF("source_paper", "sk", "sy"), "source_paper").join(keys.select(F.col("paper").alias("target_paper"), F.col("key").alias("tk")), "target_paper")
    mark = F.when(F.col("verified"), "verified").otherwise("inferred")
    line = F.format_string("- %s: %s to %s, *%s* to *%s* (%.2f, %s)", "edge_type", cite(F.col("sk")), cite(F.col("tk")), "s", "t", F.col("confidence").cast("double"), mark)
    second = named.select(F.lit(2).alias("section"), F.col("edge_type").alias("part"), F.row_number().over(Window.partitionBy("edge_type").orderBy(F.coalesce("sy", F.lit(0)), "sk", "tk")).cast("long").alias("pos"), line.alias("line"))
    touched = edges.select(F.explode(F.array("source_node", "target_node")).alias("node_id")).distinct()
    third = numbered.join(touched, "node_id", "left_anti").select(F.lit(3).alias("section"), F.lit("").alias("part"), F.col("n").alias("pos"), F.concat(F.lit("- not connected: "), "label").alias("line"))
    return first.unionByName(second).unionByName(third)
