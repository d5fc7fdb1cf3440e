"""Queries pN_... over the test tables, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora.llm.leaks import leaked_items
from capsidora.llm.neardup import near_duplicate_groups, near_duplicates, record_pairs
from capsidora.llm.neighbours import nearest_vectors
from capsidora.llm.quota import category_key, draw
from capsidora.llm.residue import residue_documents
from capsidora.llm.tokens import byte_bpe_ids
from capsidora.llm.topn import top_n_per_group
from capsidora.session import table

BLANKS = r"^[\s ]+|[\s ]+$"


def source_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, BLANKS, ""))


def sequence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "swissprot_entries").select(F.col("accession").alias("id"), "sequence")
    return known.unionByName(table(spark, sf_dir, "prediction_results").select(F.col("sequence_id").alias("id"), F.col("aa_sequence").alias("sequence")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose common pieces are at least half of all their distinct pieces."""
    return record_pairs(*near_duplicates(sequence_records(spark, sf_dir), "id", "sequence"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the smallest record of its group of near-duplicates."""
    return near_duplicate_groups(sequence_records(spark, sf_dir), "id", "sequence")


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_set, record_id, category: a query_id with its latest run, a protein_id once."""
    runs = table(spark, sf_dir, "consensus_results").where("query_id is not null")
    runs = runs.groupBy("query_id").agg(F.max(F.struct("run_at", category_key(F.col("functional_category")).alias("c"))).alias("m"))
    gold = table(spark, sf_dir, "gold_standard").where("protein_id is not null")
    gold = gold.groupBy("protein_id").agg(F.max(category_key(F.col("true_category"))).alias("c"))
    runs = runs.select(F.lit("consensus_results").alias("record_set"), F.col("query_id").alias("record_id"), F.col("m.c").alias("category"))
    return runs.unionByName(gold.select(F.lit("gold_standard").alias("record_set"), F.col("protein_id").alias("record_id"), F.col("c").alias("category")))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, observed and taken records of each target, and what is missing."""
    return draw(sample_records(spark, sf_dir), table(spark, sf_dir, "sample_targets"))[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that fall short."""
    return p2_report(spark, sf_dir).where("deficit > 0").select("record_set", "category")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records themselves."""
    return draw(sample_records(spark, sf_dir), table(spark, sf_dir, "sample_targets"))[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best targets of each query and database; rows without query, source_db or evalue take no part."""
    hits = table(spark, sf_dir, "foldseek_hits").select("query", source_name(F.col("source_db")).alias("source_db"), "target", "evalue", "bits")
    return top_n_per_group(hits, ["query", "source_db"], [("evalue", "asc"), ("bits", "desc")], "target", 5, rank="hit_rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other embeddings of each usable one."""
    return nearest_vectors(table(spark, sf_dir, "protein_vectors"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document's text; an empty list for null and empty texts."""
    return byte_bpe_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold at least twelve words in a row."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, errors or notices in place of content."""
    return residue_documents(table(spark, sf_dir, "documents"))


P1_SQL = """
with seqs as (
  select id, max(upper(regexp_replace(coalesce(s, ''), '[^A-Za-z]', '', 'g'))) as s from (
    select accession as id, sequence as s from swissprot_entries union all select sequence_id, aa_sequence from prediction_results)
  where id is not null group by id),
pieces as (select distinct id, substr(s, k, 5) as g from (select id, s, unnest(range(1, length(s) - 3)) as k from seqs where length(s) >= 5)),
n as (select id, count(*) as n from pieces group by id),
common as (select a.id as id_a, b.id as id_b, count(*) as c from pieces a join pieces b on a.g = b.g and a.id < b.id group by all)
select id_a, id_b from common join n as x on x.id = id_a join n as y on y.id = id_b where 2 * c >= x.n + y.n - c
"""


P1_GROUPS_SQL = f"""
with recursive ids as (
  select id from (select accession as id, sequence as s from swissprot_entries union all select sequence_id, aa_sequence from prediction_results)
  where id is not null group by id having max(length(regexp_replace(coalesce(s, ''), '[^A-Za-z]', '', 'g'))) >= 5),
pairs as ({P1_SQL}),
edge as (select id_a as a, id_b as b from pairs union all select id_b, id_a from pairs),
reach as (select id, id as r from ids union select reach.id, b from reach join edge on a = r)
select id as record_id, min(r) as group_id from reach group by id
"""


def _key_sql(c: str) -> str:
    joined = f"regexp_replace(regexp_replace(lower({c}), '^[\\s\\x{{A0}}_-]+|[\\s\\x{{A0}}_-]+$', '', 'g'), '[\\s\\x{{A0}}_-]+', '_', 'g')"
    return f"case when coalesce({joined}, '') = '' then 'unknown' else {joined} end"


_P2_RECORDS = f"""
with runs as (
  select query_id, {_key_sql("functional_category")} as k,
    row_number() over (partition by query_id order by run_at desc nulls last, {_key_sql("functional_category")} desc) as o
  from consensus_results where query_id is not null),
records as (
  select 'consensus_results' as record_set, query_id as record_id, k from runs where o = 1
  union all
  select 'gold_standard', protein_id, max({_key_sql("true_category")}) from gold_standard where protein_id is not null group by protein_id),
wants as (
  select record_set, category, {_key_sql("category")} as k, cast(greatest(min_rows, floor(target_share * sample_size + 0.5)) as bigint) as wanted
  from sample_targets),
drawn as (
  select record_set, record_id, category, wanted from (
    select r.record_set, record_id, category, wanted, row_number() over (partition by r.record_set, category
      order by cast('0x' || substr(md5('17|' || r.record_set || '|' || record_id), 1, 13) as bigint), record_id) as o
    from records r join wants w on w.record_set = r.record_set and w.k = r.k)
  where o <= wanted)
"""

P2_SAMPLE_SQL = f"{_P2_RECORDS} select record_set, record_id, category from drawn"

P2_REPORT_SQL = f"""{_P2_RECORDS},
observed as (select record_set, k, count(*) as n from records group by all),
taken as (select record_set, category, count(*) as n from drawn group by all)
select w.record_set, w.category, wanted, cast(coalesce(o.n, 0) as bigint) as observed, cast(coalesce(t.n, 0) as bigint) as taken,
  cast(wanted - coalesce(t.n, 0) as bigint) as deficit
from wants w left join observed o on o.record_set = w.record_set and o.k = w.k
left join taken t on t.record_set = w.record_set and t.category = w.category
"""

P3_SQL = """
with hits as (
  select query, lower(regexp_replace(source_db, '^\\s+|\\s+$', '', 'g')) as source_db, target, evalue, bits
  from foldseek_hits where query is not null and source_db is not null and evalue is not null and target is not null),
own as (
  select *, row_number() over (partition by query, source_db, target order by evalue, bits desc nulls last) as o from hits),
ranked as (
  select query, source_db, target,
    row_number() over (partition by query, source_db order by evalue, bits desc nulls last, target) as hit_rank
  from own where o = 1)
select query, source_db, cast(hit_rank as integer) as hit_rank, target from ranked where hit_rank <= 5
"""


P5_SQL = """
with u as (
  select protein_id as p, source_db as s, max(embedding) as e from protein_vectors
  where protein_id is not null and source_db is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by all),
n as (select p, s, e::double[] as e, sqrt(list_inner_product(e::double[], e::double[])) as n from u),
c as (
  select a.p as protein_id, a.s as source_db, b.p as nb_protein_id, b.s as nb_source_db,
    round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) as c
  from n a join n b on a.p <> b.p or a.s <> b.s),
r as (
  select *, row_number() over (partition by protein_id, source_db order by c desc, nb_protein_id, nb_source_db) as nb_rank from c)
select protein_id, source_db, cast(nb_rank as integer) as nb_rank, nb_protein_id, nb_source_db from r where nb_rank <= 5
"""

P7_SQL = """
with d as (select doc_id as id, string_split(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ') as w from documents),
i as (select item_id as id, string_split(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ') as w from eval_items),
dw as (select id, array_to_string(w[k:k+11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from d)),
iw as (select id, array_to_string(w[k:k+11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct dw.id as doc_id, iw.id as item_id from dw join iw using (g)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample, "p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_groups": P1_GROUPS_SQL, "p2_found": f"select record_set, category from ({P2_REPORT_SQL}) where deficit > 0", "p2_report": P2_REPORT_SQL, "p2_sample": P2_SAMPLE_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL}
