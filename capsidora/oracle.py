"""The SQL that each query of the catalogue must agree with."""

from __future__ import annotations

from capsidora.functions import rules
from capsidora.functions.text import COMMON, COMMON_MORE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _label(c: str) -> str:
    key = f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[ _-]+', '_', 'g')"
    return f"case when coalesce({key}, '') = '' then 'unknown' else {key} end"


def _name(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def _steps(c: str, bounds: list[tuple[str, float]], rest: str) -> str:
    return "case " + " ".join(f"when {c} >= {b}::double then '{n}'" for n, b in bounds) + f" else '{rest}' end"


def _rules(table: dict[str, list[str]]) -> str:
    return "[" + ", ".join(f"{{'category': {_q(c)}, 'term': {_q(t)}}}" for c, t in rules.flat(table)) + "]"


def _first(text: str, table: dict[str, list[str]]) -> str:
    return f"list_filter({_rules(table)}, lambda r: contains({text}, r.term))[1]"


def _by_terms(text: str, table: dict[str, list[str]]) -> str:
    return f"case when length({text}) > 0 then {_first(f'lower({text})', table)}.category end"


def _by_keywords(rule: str, text: str) -> str:
    at = f"strpos({text}, {rule}.term)"
    behind = f"substr({text}, {at} + length({rule}.term), {rules.BEHIND})"
    before = f"substr({text}, greatest({at} - {rules.BEFORE}, 1), least({at} - 1, {rules.BEFORE}))"
    host = f"contains({behind}, 'inhibitor') or contains({behind}, 'inhibition') or contains({before}, 'host')"
    return f"case when {rule} is null then 'unknown' when {rule}.category <> 'host_interaction' and ({host}) then 'host_interaction' else {rule}.category end"


def _terms(c: str, common: list[str]) -> str:
    words = ", ".join(map(_q, common))
    return f"list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '-_', '  '), '\\s+'), lambda w: length(w) > 3 and w not in ({words})))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0::double else {both}::double / (len({a}) + len({b}) - {both}) end"


def _contig(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '^(.+\\|provirus_\\d+_\\d+)_\\d+$', 1), ''), nullif(regexp_extract({c}, '^(.+)_\\d+$', 1), ''), {c})"


_HITS = f"""hits as (
  select query, target, {_name("source_db")} as source_db, fident, evalue, bits, qstart, qend, qlen, qcov from foldseek_hits
  where query is not null and target is not null and source_db is not null and evalue is not null)"""
_RESULTS = f"""results as (
  select * exclude (o) from (
    select * replace ({_label("functional_category")} as functional_category),
      row_number() over (partition by query_id order by run_at desc nulls last, query_length desc nulls last, description desc nulls last,
        {_label("functional_category")} desc nulls last, confidence_level desc nulls last, consensus_score desc nulls last, primary_source desc nulls last, primary_target desc nulls last) as o
    from consensus_results where query_id is not null) where o = 1)"""
def _drawn(key: str, salt: str, values: list[str | None]) -> str:
    texts = ", ".join("null" if v is None else _q(v) for v in values)
    return f"([{texts}])[cast(cast('0x' || substr(md5('{salt}' || {key}), 1, 6) as bigint) % {len(values)} + 1 as integer)]"


def _drawn_texts(key: str) -> str:
    return (
        _drawn(key, "s", ["Zincins", "Ankyrin repeat", "P-loop containing nucleoside triphosphate hydrolases", "winged helix", "", None]) + " as superfamily, "
        + _drawn(key, "p", ["viral DNA genome packaging", "viral release from host cell", "metabolic process", "", None]) + " as go_bp, "
        + _drawn(key, "f", ["RNA-directed RNA polymerase activity", "structural molecule activity", "endonuclease activity", "binding", "", None]) + " as go_mf"
    )


_NOTES = f"""told_notes as (
  select primary_target as target, {_name("primary_source")} as source_db, max(description) as description, max(gene) as gene, max(pfam) as pfam, max(uniprot_id) as uniprot_id
  from results left join (select protein_id, max(gene) as gene, max(pfam_domains) as pfam, max(uniprot_id) as uniprot_id from gold_standard where protein_id is not null group by 1) g on g.protein_id = query_id
  where primary_target is not null and primary_source is not null group by all),
figured as (
  select *, case when source_db = 'bfvd' then (cast('0x' || substr(md5('plddt' || target), 1, 6) as bigint) % 101)::double end as p,
    case when cast('0x' || substr(md5('ptm' || target), 1, 6) as bigint) % 101 > 10 then (cast('0x' || substr(md5('ptm' || target), 1, 6) as bigint) % 101)::double / 100 end as t from told_notes),
notes as (
  select * exclude (p, t), {_drawn_texts("target")}, case when p is null then 'none' else 'bfvd_af2' end as structure_source, case when p is null then 1.0::double else
    0.7::double * (case when p >= 70 then 0.9::double + 0.1::double * ((p - 70) / 30) when p >= 50 then 0.7::double + 0.2::double * ((p - 50) / 20) when p >= 30 then 0.5::double + 0.2::double * ((p - 30) / 20) else 0.3::double + 0.2::double * (p / 30) end)
    + 0.3::double * (case when t is null then 0.8::double when t >= 0.5 then 0.85::double + 0.15::double * ((t - 0.5::double) / 0.5::double) when t >= 0.3 then 0.7::double + 0.15::double * ((t - 0.3::double) / 0.2::double) else 0.5::double + 0.2::double * (t / 0.3::double) end) end as structure_quality
  from figured)"""
_GOLD = f"""gold as (
  select protein_id, max({_label("true_category")}) as truth, max(true_function) as function, max(viral_family) as family, max(pfam_domains) as pfam,
    max(go_terms) as go, max(uniprot_id) as uniprot_id, max(gene) as gene from gold_standard where protein_id is not null group by protein_id)"""
_PROTEINS = """proteins as (
  select sequence_id, max(aa_sequence) as aa, max(three_di_sequence) as di, max(confidence_scores) as scores from prediction_results where sequence_id is not null group by sequence_id)"""
_ENTRIES = """entries as (
  select accession, max(organism) as organism, max(lineage) as lineage, max(sequence) as sequence from swissprot_entries where accession is not null group by accession)"""
_QUALITY = "0.5::double * case when evalue > 0 then least(1.0::double, -log10(case when evalue > 0 then evalue else 1 end) / 50) else 1.0::double end + 0.3::double * fident + 0.2::double * qcov"
_SCORED = f"""scored as (
  select h.*, n.* exclude (target, source_db), round(({_QUALITY}) * ((1::double - 0.15::double) + 0.15::double * coalesce(n.structure_quality, 1.0::double))
      * (case when h.source_db = 'viro3d' then 1.2::double else 1.0::double end
      * case when coalesce(n.description, '') <> '' and not contains(n.description, 'UniProt:') and not contains(lower(n.description), 'hypothetical') then 1.1::double else 1.0::double end), 9) as score
  from hits h left join notes n using (target, source_db))"""
_BEST = """best as (
  select * exclude (o) from (select *, row_number() over (partition by query, source_db order by score desc nulls last, evalue, target, fident, description) as o from scored) where o = 1)"""
_TOLD = f"""told as (select query, source_db, description, evalue, coalesce({_by_terms("description", rules.SIMPLE)}, 'unknown') as category, {_terms("description", COMMON_MORE)} as terms
  from best where coalesce(description, '') <> '')"""
_SEVERITY = (
    "case when c1 = c2 then case when similarity >= 0.5 then 'negligible' else 'minor' end when c1 = 'unknown' or c2 = 'unknown' then case when similarity >= 0.3 then 'minor' else 'major' end "
    + " ".join(f"when c1 in ('{x}', '{y}') and c2 in ('{x}', '{y}') then 'major'" for x, y in rules.RELATED)
    + " else 'critical' end"
)
_PAIRS = f"""raw as (
  select a.query, a.source_db as db1, b.source_db as db2, a.category as c1, b.category as c2, a.evalue as e1, b.evalue as e2, round({_jaccard("a.terms", "b.terms")}, 9) as similarity
  from told a join told b on a.query = b.query and a.source_db < b.source_db),
pairs as (select *, similarity < 0.2 or c1 <> c2 as conflict, {_SEVERITY} as severity from raw)"""
_VALIDATED = """counted as (select query, count(*) as databases, count(distinct category) as kinds from told group by query),
means as (select query, round(avg(similarity), 9) as s, count(*) filter (conflict) as conflicts from pairs group by query),
validated as (
  select query, databases, case when s is null then 'single_source' when s >= 0.5 then 'validated' when s >= 0.2 then 'partial' else 'conflicting' end as status,
    coalesce(s, 0.0::double) as similarity,
    round(case when s is null then 0.5::double else 0.3::double * least(1.0::double, databases / 3.0::double) + 0.5::double * s + 0.2::double * case when kinds = 1 then 1.0::double else 0.5::double end end, 6) as reliability,
    coalesce(conflicts, 0) as conflicts
  from counted left join means using (query))"""
_EVALUATED = """evaluated as (
  select g.*, coalesce(r.functional_category, 'unknown') as predicted, coalesce(r.consensus_score, 0.0::double) as score, r.primary_identity
  from gold g left join results r on r.query_id = g.protein_id)"""
_KNOWN_P, _KNOWN_T = "predicted not in ('', 'unknown')", "truth not in ('', 'unknown')"
_MATRIX = """round(case when tp + fn = 0 then 0 else tp::double / (tp + fn) end, 9) as sensitivity, round(case when tn + fp = 0 then 0 else tn::double / (tn + fp) end, 9) as specificity,
  round(case when tp + fp = 0 then 0 else tp::double / (tp + fp) end, 9) as precision,
  round(case when tp = 0 then 0 else 2.0::double * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)) end, 9) as f1,
  round((tp + tn)::double / (tp + tn + fp + fn), 9) as accuracy,
  round(case when (tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) end, 9) as mcc"""
_CATEGORY = f"""kinds as (select distinct category from (select predicted as category from evaluated union all select truth from evaluated) where category not in ('', 'unknown')),
matrices as (
  select category, cast(count(*) filter (predicted = category and truth = category) as bigint) as tp, cast(count(*) filter (predicted = category and truth <> category) as bigint) as fp,
    cast(count(*) filter (predicted <> category and truth = category) as bigint) as fn, cast(count(*) filter (predicted <> category and truth <> category) as bigint) as tn
  from kinds cross join evaluated group by category),
figures as (select category, tp, fp, fn, tn, {_MATRIX} from matrices)"""
_BINS = """held as (select least(floor(score * 10), 9)::integer as bin, count(*) as n, avg(case when predicted = truth then 1.0::double else 0 end) as a, avg(score) as c from evaluated where score between 0 and 1 group by 1),
bins as (select b::integer as bin, coalesce(n, 0) as n, round(coalesce(a, 0.0::double), 9) as accuracy, round(coalesce(c, (b + 0.5::double) / 10), 9) as confidence from range(10) t(b) left join held on held.bin = b)"""
_VECTORS = "vec as (select printf('v%07d', vec_id) as id, embedding::double[] as e, label, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)"
_NEAR = """near as (
  select query, target, similarity, place from (
    select a.id as query, b.id as target, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) as similarity,
      row_number() over (partition by a.id order by round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) desc, b.id) as place
    from vec a join vec b on a.id <> b.id))"""
_TRANSFER = """near as (select query, target, max(fident) as similarity from hits where fident >= 0.5 group by all),
own as (select h.target, min(g.uniprot_id) as accession from (select distinct query, target from hits) h join gold g on g.protein_id = h.query and g.uniprot_id is not null group by h.target),
matches as (select n.query, o.accession, max(n.similarity) as similarity from near n join own o using (target) group by all),
donors as (
  select accession, go_id, aspect, max(viral) as viral, max(go_term) as go_term, max(evidence_code) as evidence_code from (
    select accession, coalesce(starts_with(lineage, 'Viruses'), false) as viral, unnest(go_annotations, recursive := true) from swissprot_entries where accession is not null)
  where go_id is not null and aspect is not null group by all),
joined as (select m.query, m.similarity, d.* from matches m join donors d using (accession) where m.similarity >= 0.5 and (d.viral or m.similarity >= 0.95)),
transfer as (
  select query, go_id, aspect, round(1 - product(1 - similarity), 9) as reliability, count(*) as donors,
    arg_min(struct_pack(donor := accession, go_term := go_term, evidence_code := evidence_code, viral := viral), struct_pack(s := -similarity, a := accession)) as b
  from joined group by all having round(1 - product(1 - similarity), 9) >= 0.3)"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _agreement(a: str, b: str, ta: str, tb: str) -> str:
    j = _jaccard(ta, tb)
    return f"case when contains(lower(coalesce({a}, '')), 'uniprot:') or contains(lower(coalesce({b}, '')), 'uniprot:') or len({ta}) = 0 or len({tb}) = 0 then 'partial' when {j} >= 0.5 then 'agree' when {j} >= 0.2 then 'partial' else 'disagree' end"


NOVELTY = [("database_match", 0.95), ("close_homolog", 0.70), ("remote_homolog", 0.30)]
HIT_LEVELS = [("high", 0.9), ("medium", 0.7), ("low", 0.5)]
LEVELS = [("high", 0.8), ("medium", 0.5), ("low", 0.3)]


def _ladder(t: str, rule: str) -> tuple[str, str]:
    """Category and source by the rungs of evidence, from columns pfam, superfamily, go_bp, go_mf and a text for keywords."""
    rungs = {"pfam": rules.PFAM, "superfamily": rules.SUPERFAMILY, "go_bp": rules.GO_PROCESS, "go_mf": rules.GO_FUNCTION}
    first = ", ".join(_by_terms(n, r) for n, r in rungs.items())
    source = " ".join(f"when {_by_terms(n, r)} is not null then '{n}:' || {n}" for n, r in rungs.items())
    return f"coalesce({first}, {_by_keywords(rule, t)})", f"case {source} else 'keywords' end"


def _consensus() -> str:
    text = "lower(description || ' ' || coalesce(gene, ''))"
    category, source = _ladder("t", "rule")
    return _with(_PROTEINS, _HITS, _RESULTS, _NOTES, _SCORED, _BEST, f"""ranked as (
  select *, row_number() over (partition by query order by score desc, case source_db when 'bfvd' then 0 when 'viro3d' then 1 else 2 end, source_db) as p, {_terms("description", COMMON)} as terms from best),
paired as (
  select a.query, a.source_db as primary_source, a.target as primary_target, a.evalue as primary_evalue, a.fident as primary_identity, a.qcov as primary_coverage, coalesce(nullif(a.description, ''), 'hypothetical protein') as description,
    {_steps("a.fident", NOVELTY, "twilight_zone")} as novelty, b.source_db as secondary_source, b.target as secondary_target, b.evalue as secondary_evalue, b.fident as secondary_identity,
    round(coalesce(a.structure_quality, 1.0::double), 3) as structure_quality_score, coalesce(a.structure_source, 'none') as structure_quality_source, a.gene, a.uniprot_id, a.pfam, a.superfamily, a.go_bp, a.go_mf,
    case when b.query is null then 'single' else {_agreement("a.description", "b.description", "a.terms", "b.terms")} end as agreement, a.score
  from ranked a left join ranked b on a.query = b.query and b.p = 2 where a.p = 1),
raised as (
  select *, round(least(1.0::double, score * case agreement when 'agree' then 1.3::double when 'partial' then 1.15::double else 1.0::double end), 9) as c, {_first(text, rules.KEYWORDS)} as rule, {text} as t from paired),
named as (select *, {category} as functional_category, {source} as classification_source, {_steps("c", LEVELS, "very_low")} as level from raised),
held as (select query, string_agg(source_db, ',' order by source_db) as databases from best group by query),
sizes as (select query, cast(count(*) filter (source_db = 'bfvd') as bigint) as bfvd_hits, cast(count(*) filter (source_db = 'viro3d') as bigint) as viro3d_hits from hits group by query)
select sequence_id as query, cast(length(coalesce(aa, '')) as integer) as query_length, primary_source, primary_target, primary_evalue, primary_identity, primary_coverage,
  coalesce(description, 'hypothetical protein') as description, coalesce(functional_category, 'unknown') as functional_category, classification_source,
  novelty, structure_quality_score, structure_quality_source, gene, null::varchar as organism, uniprot_id, pfam, go_bp, go_mf, null::varchar as go_cc, superfamily,
  secondary_source, secondary_target, secondary_evalue, secondary_identity, coalesce(agreement, 'none') as agreement,
  case when n.query is null then 0.0::double else round(least(1.0::double, score * case agreement when 'agree' then 1.3::double when 'partial' then 1.15::double else 1.0::double end), 6) end as consensus_score,
  case when n.query is null then 'none' when agreement = 'agree' and level = 'medium' then 'high' when agreement = 'agree' and level = 'low' then 'medium' else level end as confidence_level, databases,
  coalesce(bfvd_hits, 0) as bfvd_hits, coalesce(viro3d_hits, 0) as viro3d_hits
from proteins left join named n on n.query = sequence_id left join held h on h.query = sequence_id left join sizes z on z.query = sequence_id""")


def _structure() -> str:
    return """
with r as (
  select p_partkey as k, (p_size * 2)::double as v, (p_partkey % 100) / 100.0::double as m, (p_partkey % 13 * 100)::double as depth, p_partkey % 3 = 0 as third, p_partkey % 2 = 0 as even, p_partkey % 5 <> 0 as five from part),
c as (select *, case when third then v end as ep, case when third and even then m end as et, case when even then v end as cp, case when even then m end as ct, case when not even and five then v end as bp from r),
s as (
  select *, cp is not null and depth >= 100 as deep, case when cp is not null and depth >= 100 then 'colabfold' when ep is not null then 'esmfold' when bp is not null then 'bfvd_af2' when cp is not null then 'colabfold_low_msa' else 'none' end as source from c),
x as (select *, case when deep then cp else coalesce(ep, bp, cp) end as p, case when deep then ct when ep is not null then et when bp is not null then m else ct end as t from s),
y as (
  select *, 0.7::double * (case when p >= 70 then 0.9::double + 0.1::double * ((p - 70) / 30) when p >= 50 then 0.7::double + 0.2::double * ((p - 50) / 20) when p >= 30 then 0.5::double + 0.2::double * ((p - 30) / 20) else 0.3::double + 0.2::double * (p / 30) end)
    + 0.3::double * (case when t is null then 0.8::double when t >= 0.5 then 0.85::double + 0.15::double * ((t - 0.5::double) / 0.5::double) when t >= 0.3 then 0.7::double + 0.15::double * ((t - 0.3::double) / 0.2::double) else 0.5::double + 0.2::double * (t / 0.3::double) end) as q from x)
select k as p_partkey, round(case when source = 'none' then 1.0::double when deep and depth >= 1000 then least(1.0::double, q * 1.05::double) when deep and depth >= 500 then least(1.0::double, q * 1.02::double) else q end, 9) as quality, source as quality_source from y"""


def _distribution(columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as field, cast({c} as varchar) as value, count(*) as n from results group by all" for c in columns)


def _dark() -> str:
    weak = "coalesce(primary_evalue > 1e-5 or primary_identity < 0.3, false)"
    return f"dark as (select * from (select *, case when primary_target is null then 'no_hits' when functional_category = 'unknown' and {weak} then 'weak_hits' when functional_category = 'unknown' then 'unknown_function' when consensus_score < 0.3 then 'weak_hits' end as dark_category from results) where dark_category is not null)"


def _families() -> str:
    lists = ", ".join(f"case when contains(t, {_q(k)}) then [{', '.join(map(_q, v))}] else []::varchar[] end" for k, v in rules.FAMILIES.items())
    return f"select query_id, array_to_string(list_sort(list_distinct(flatten([{lists}]))), ',') as families from (select query_id, lower(coalesce(description, '')) as t from results)"


def _hierarchy() -> str:
    text = "lower(coalesce(function, '') || ' ' || coalesce(gene, ''))"
    category, source = _ladder("t", "rule")
    return _with(_GOLD, f"e as (select *, {_drawn_texts('protein_id')} from gold)", f"r as (select *, {text} as t, {_first(text, rules.KEYWORDS)} as rule from e)") + f"select protein_id, {category} as category, {source} as classification_source from r"


def _votes() -> str:
    weight = "case confidence_level when 'high' then 1.0::double when 'medium' then 0.7::double when 'low' then 0.4::double when 'very_low' then 0.2::double else 0.1::double end"
    return _with(_RESULTS, f"""genes as (
  select query_id as query, {_contig("query_id")} as contig, try_cast(nullif(regexp_extract(query_id, '_(\\d+)$', 1), '') as integer) as start, functional_category, {weight} as w from results),
placed as (select *, row_number() over (partition by contig order by start nulls first, query) as i from genes),
sums as (
  select a.query, b.functional_category as category, round(sum(b.w / (1 + abs(b.i - a.i))), 9) as w, count(*) as n
  from placed a join placed b on a.contig = b.contig and b.i <> a.i and abs(b.i - a.i) <= 5 where a.functional_category = 'unknown' and b.functional_category <> 'unknown' group by all),
best as (select query, arg_min(category, struct_pack(w := -w, c := category)) as category, max(w) as w, sum(w) as total, sum(n) as n from sums group by query)
select query, category, round(round(w / total, 9), 3) as vote_share from best where n >= 2 and round(w / total, 9) >= 0.5""")


def _overlap() -> str:
    return _with(_HITS, """i as (select distinct query as contig, source_db, qstart as s, qend as e from hits where qstart is not null and qend is not null),
kept as (
  select contig, s, e from i where source_db = 'bfvd' union all
  select contig, s, e from i b where source_db = 'viro3d' and not exists (
    select 1 from i a where a.source_db = 'bfvd' and a.contig = b.contig and least(a.e, b.e) - greatest(a.s, b.s) + 1 > 0
      and (least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / (least(a.e - a.s, b.e - b.s) + 1) >= 0.5))
select contig, count(*) as n, min(s) as first_start, max(e) as last_end from kept group by contig""")


def _regions() -> str:
    return _with(_PROTEINS, """r as (select sequence_id, len(scores) as n, unnest(scores) as s, unnest(range(len(scores))) as i from proteins where scores is not null),
h as (select sequence_id, i, i - row_number() over (partition by sequence_id order by i) as g from r where s >= 0.5),
x as (select sequence_id, min(i) as a, max(i) + 1 as b from h group by sequence_id, g having count(*) >= 5),
y as (select sequence_id, string_agg(a || '-' || b, ';' order by a) as regions, sum(b - a) as covered from x group by sequence_id),
z as (select p.sequence_id, coalesce(regions, '') as regions, case when len(scores) > 0 then coalesce(covered, 0)::double / len(scores) else 0.0::double end as f from proteins p left join y using (sequence_id) where scores is not null)
select sequence_id, regions, round(f, 9) as fraction, case when f >= 0.40 then 'disordered' when f >= 0.15 then 'partial' else 'ordered' end as class from z""")


def _validate_sequences() -> str:
    return _with(_ENTRIES, """a as (select accession, regexp_replace(upper(regexp_replace(sequence, '[^!-~]', '', 'g')), '\\*+$', '') as b, upper(regexp_replace(sequence, '[^!-~]', '', 'g')) as u from entries where sequence is not null),
c as (select *, regexp_replace(b, '[^ACDEFGHIKLMNPQRSTVWYBXZUOJ]', 'X', 'g') as clean from a)
select accession, md5(clean) as digest, cast(length(clean) as integer) as length,
  array_to_string(list_filter([case when contains(b, '*') then 'internal_stop' end, case when regexp_matches(replace(b, '*', ''), '[^ACDEFGHIKLMNPQRSTVWYBXZUOJ]') then 'foreign_signs' end], lambda w: w is not null), ',') as warnings,
  regexp_matches(u, '[EFILPQZ]') as protein from c""")


def statements() -> dict[str, str]:
    level = "case when evalue < 1e-50 then 0.4::double when evalue < 1e-20 then 0.3::double when evalue < 1e-10 then 0.2::double when evalue < 1e-5 then 0.1::double else 0::double end + case when fident >= 0.7 then 0.3::double when fident >= 0.5 then 0.2::double when fident >= 0.3 then 0.1::double else 0::double end + case when qcov >= 0.8 then 0.3::double when qcov >= 0.6 then 0.2::double when qcov >= 0.4 then 0.1::double else 0::double end"
    told = (_HITS, _RESULTS, _NOTES, _SCORED, _BEST, _TOLD, _PAIRS)
    scores = (_HITS, _RESULTS, _NOTES, _SCORED)
    gold = (_GOLD, _RESULTS, _EVALUATED)
    text = "lower(coalesce(function, '') || ' ')"
    bins = "case when primary_identity < 0.2 then '0.0-0.2' when primary_identity < 0.3 then '0.2-0.3' when primary_identity < 0.4 then '0.3-0.4' when primary_identity < 0.5 then '0.4-0.5' when primary_identity < 1.0 then '0.5-1.0' else 'none' end"
    transfer = (_HITS, _GOLD, _TRANSFER)
    go_text = "lower(coalesce(b.go_term, ''))"
    return {
        "consensus_best_hits": _consensus(),
        "hit_scores": _with(*scores) + "select source_db, count(*) as n, round(avg(score), 6) as mean_score, max(score) as best_score, min(score) as least_score from scored group by source_db",
        "best_per_database": _with(*scores, _BEST) + "select query, source_db, target, score from best",
        "hit_merge_best": _with(_HITS) + "select query, evalue, target from (select *, row_number() over (partition by query order by evalue, target) as o from hits where source_db in ('bfvd', 'viro3d', 'esmatlas')) where o = 1",
        "best_hits_by_bits": _with(_HITS) + "select query, target, source_db from (select *, row_number() over (partition by query order by bits desc, target, source_db) as o from hits where bits is not null) where o = 1",
        "hit_levels": _with(_HITS) + f"select source_db, {_steps('(' + level + ')', HIT_LEVELS, 'very_low')} as level, count(*) as n from hits group by all",
        "novelty_distribution": _with(_HITS) + f"select source_db, {_steps('fident', NOVELTY, 'twilight_zone')} as novelty, count(*) as n, round(avg(fident), 6) as mean_identity from hits group by all",
        "run_summary": _with(_RESULTS) + _distribution(["functional_category", "confidence_level", "primary_source"]),
        "score_statistics": _with(_RESULTS, "o as (select *, row_number() over (partition by confidence_level order by consensus_score) - 1 as i, count(*) over (partition by confidence_level) as k from results where consensus_score is not null)")
        + "select r.confidence_level, min(r.consensus_score) as least, max(r.consensus_score) as greatest, round(avg(r.consensus_score), 6) as mean, any_value(o.consensus_score) as median from results r join o on o.confidence_level = r.confidence_level and o.i = o.k // 2 group by r.confidence_level",
        "structure_quality": _structure(),
        "keyword_classify": _with(_GOLD, f"r as (select *, {text} as t, {_first(text, rules.KEYWORDS)} as rule from gold)") + f"select protein_id, function, {_by_keywords('rule', 't')} as category from r",
        "evidence_hierarchy": _hierarchy(),
        "term_agreement": _with(_GOLD, _RESULTS, f"r as (select protein_id, function as a, description as b, {_terms('function', COMMON)} as ta, {_terms('description', COMMON)} as tb from gold join results on query_id = protein_id)")
        + f"select protein_id, {_agreement('a', 'b', 'ta', 'tb')} as agreement, round({_jaccard('ta', 'tb')}, 9) as similarity from r",
        "cross_db_validation": _with(*told, _VALIDATED) + "select * from validated",
        "cross_db_conflicts": _with(*told)
        + "select query, db1, db2, similarity, severity, case when e1 < e2 / 10 then 'Prefer ' || db1 || ' (better e-value)' when e2 < e1 / 10 then 'Prefer ' || db2 || ' (better e-value)' else 'Manual review recommended' end as resolution from pairs where conflict and severity <> 'negligible'",
        "db_consistency": _with(*told, "n as (select source_db, count(*) as n from told group by 1)", "t as (select count(distinct query) as total from best where description is not null)",
            "p as (select db1, db2, count(*) as b, count(*) filter (similarity >= 0.5) as agree, count(*) filter (similarity >= 0.2 and similarity < 0.5) as partial, count(*) filter (similarity < 0.2) as disagree, count(*) filter (c1 = c2) as same_category from pairs group by all)")
        + "select db1, db2, b as both, x.n - b as only1, y.n - b as only2, agree, partial, disagree, same_category, round(0.6::double * agree / b + 0.3::double * same_category / b + 0.1::double * least(1.0::double, b * 2::double / total), 9) as score from p join n x on x.source_db = db1 join n y on y.source_db = db2 cross join t",
        "validation_report": _with(*told, _VALIDATED) + "select status, count(*) as n, round(avg(reliability), 5) as mean_reliability, round(median(reliability), 5) as median_reliability, cast(sum(conflicts) as bigint) as conflicts from validated group by status",
        "dark_matter_report": _with(_RESULTS, _dark())
        + "select (select count(*) from results) as total, count(*) as dark, count(*) filter (dark_category = 'no_hits') as no_hits, count(*) filter (dark_category = 'weak_hits') as weak_hits, count(*) filter (dark_category = 'unknown_function') as unknown_function, min(query_length) as least, max(query_length) as greatest, round(avg(query_length), 6) as mean, list_sort(list(query_length))[count(query_length) // 2 + 1] as median, round(count(*)::double / (select count(*) from results), 9) as rate from dark",
        "dark_matter_proteins": _with(_RESULTS, _dark())
        + "select query_id, query_length, dark_category, round(case when dark_category = 'no_hits' then 0.4::double else 0 end + case when query_length between 100 and 500 then 0.1::double else 0 end + case when dark_category = 'unknown_function' and confidence_level in ('high', 'medium') then 0.2::double else 0 end, 9) as priority, array_to_string(list_filter([case when dark_category = 'no_hits' then 'No structural homologs detected' end, case when query_length between 100 and 500 then 'Optimal length for single-domain protein' end, case when dark_category = 'unknown_function' and confidence_level in ('high', 'medium') then 'Strong structural match but unknown function' end], lambda x: x is not null), '; ') as reasons from dark",
        "viral_families": _with(_RESULTS) + _families(),
        "metagenome_rollup": _with(_HITS) + "select query, count(*) as hits, min(evalue) as best_evalue, max(fident) as best_identity, bool_or(contains(target, 'ESM') or contains(target, 'MGY')) as novel, count(distinct case when contains(target, '_') then split_part(target, '_', 1) end) as clusters from hits where source_db = 'esmatlas' and fident >= 0.3 and qcov >= 0.5 group by query",
        "neighbourhood_vote": _votes(),
        "gene_overlap_merge": _overlap(),
        "multipart_merge": _with(_HITS) + "select query, target, min(qstart) as start, max(qend) as \"end\", cast(count(distinct struct_pack(a := qstart, b := qend)) as integer) as parts from hits where qstart is not null and qend is not null group by query, target",
        "duplicate_ids": "select case when o = 1 then accession else accession || '_dup' || (o - 1) end as name, count(*) as n from (select accession, row_number() over (partition by accession order by loaded_at nulls first) as o from swissprot_entries where accession is not null) group by 1",
        "disorder_regions": _regions(),
        "confidence_mask": _with(_PROTEINS) + "select sequence_id, case when scores is null or len(scores) = 0 then di else array_to_string(list_transform(range(1, length(di) + 1), lambda i: case when coalesce(scores[i], 0) >= 0.7::double then substr(di, i, 1) else 'X' end), '') end as masked from proteins where di is not null and (scores is null or len(scores) = length(di))",
        "confidence_stats": _with(_PROTEINS, "m as (select round(list_sum(list_transform(scores, lambda x: coalesce(x::double, 0.0::double))) / len(scores), 6) as m from proteins where len(scores) > 0)") + "select m >= 0.5 as kept, count(*) as n, round(avg(m), 5) as mean, min(m) as least, max(m) as greatest from m group by 1",
        "sequence_validate": _validate_sequences(),
        "sequence_identity": _with(_GOLD, _PROTEINS, _ENTRIES, "r as (select protein_id, accession, upper(regexp_replace(coalesce(aa, ''), '[^A-Za-z]', '', 'g')) as a, upper(regexp_replace(coalesce(sequence, ''), '[^A-Za-z]', '', 'g')) as b from gold join proteins on sequence_id = protein_id join entries on accession = uniprot_id)")
        + "select protein_id, accession, round(case when least(length(a), length(b)) > 0 then len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)))::double / least(length(a), length(b)) else 0.0::double end, 9) as identity from r",
        "viral_share": _with(_ENTRIES) + "select coalesce(starts_with(lineage, 'Viruses'), false) as viral, count(*) as n, count(distinct organism) as organisms from entries group by 1",
        "identifiers": "select distinct accession, accession as from_pipe, accession as from_cluster, accession as from_model, 'part of ' || accession as product from swissprot_entries where accession is not null",
        "go_identifiers": _with(_GOLD, "x as (select protein_id, unnest(regexp_extract_all(go, 'GO:\\d{7}')) as g, unnest(range(len(regexp_extract_all(go, 'GO:\\d{7}')))) as i from gold where go is not null)", "y as (select protein_id, g, min(i) as i from x group by all)", "z as (select protein_id, string_agg(g, '; ' order by i) as s from y group by 1)") + "select protein_id, coalesce(s, '') as go_ids from gold left join z using (protein_id)",
        "confusion_matrix": _with(*gold, f"m as (select count(*) filter ({_KNOWN_P} and {_KNOWN_T}) as tp, count(*) filter ({_KNOWN_P} and not ({_KNOWN_T})) as fp, count(*) filter (not ({_KNOWN_P}) and {_KNOWN_T}) as fn, count(*) filter (not ({_KNOWN_P}) and not ({_KNOWN_T})) as tn, count(*) filter ({_KNOWN_P} and predicted = truth) as correct from evaluated)") + f"select tp, fp, fn, tn, correct, {_MATRIX} from m",
        "category_metrics": _with(*gold, _CATEGORY) + "select * from figures",
        "calibration_bins": _with(*gold, _BINS) + "select * from bins",
        "calibration": _with(*gold, _BINS) + "select round(sum(n * abs(accuracy - confidence)) / sum(n), 8) as ece, round(max(case when n > 0 then abs(accuracy - confidence) end), 8) as mce, (select round(avg((score - case when predicted = truth then 1.0::double else 0 end) * (score - case when predicted = truth then 1.0::double else 0 end)), 8) from evaluated) as brier from bins",
        "stratified_metrics": _with(*gold, f"s as (select {bins} as identity_bin, truth as category, coalesce(family, '-') as family, predicted, truth from evaluated)") + f"select identity_bin, category, family, count(*) as n, count(*) filter ({_KNOWN_P}) as annotated, count(*) filter (predicted = truth) as correct, round(count(*) filter (predicted = truth)::double / count(*), 9) as accuracy from s group by grouping sets ((identity_bin), (category), (family), ())",
        "baseline_compare": _with(*gold, f"r as (select *, {text} as t, {_first(text, rules.KEYWORDS)} as rule from evaluated)", f"s as (select predicted = truth as a, {_by_keywords('rule', 't')} = truth as b from r)") + "select count(*) as n, count(*) filter (a and b) as both, count(*) filter (a and not b) as only_first, count(*) filter (not a and b) as only_second, count(*) filter (not a and not b) as neither from s",
        "holdout_split": _with(_GOLD) + "select protein_id, truth, row_number() over (partition by truth order by md5('42' || protein_id), protein_id) <= greatest(1, floor(count(*) over (partition by truth) * 0.2::double)) as held_out from gold",
        "class_weights": _with(_GOLD, "c as (select truth, count(*) as n from gold group by 1)") + "select truth, n, round((select sum(n) from c)::double / ((select count(*) from c) * n), 9) as weight from c",
        "macro_f1": _with(*gold, _CATEGORY) + "select round(avg(f1), 8) as macro_f1, count(*) as classes from figures where tp + fn > 0",
        "pfam_label_space": "with g as (select protein_id, max(pfam_domains) as p from gold_standard where protein_id is not null group by 1), f as (select regexp_extract(p, 'PF\\d{5}') as pfam from g where regexp_matches(p, 'PF\\d{5}')), c as (select pfam, count(*) as n from f group by 1 having count(*) >= 2) select pfam, n, cast(row_number() over (order by n desc, pfam) - 1 as integer) as index from c",
        "export_anvio": _with(_RESULTS, "r as (select *, row_number() over (order by query_id) - 1 as g from results)") + "select g as gene_callers_id, 'capsidora_category' as source, functional_category as accession, functional_category as function, 0.0::double as e_value from r union all select g, 'capsidora_structural', coalesce(primary_target, ''), description, coalesce(primary_evalue, 0.0::double) from r where coalesce(description, '') not in ('', 'hypothetical protein')",
        "export_genomes": _with(_RESULTS) + f"select {_contig('query_id')} as genome_id, cast(sum(coalesce(query_length, 0)) as bigint) as length from results group by 1",
        "export_dramv": _with(_RESULTS) + f"select {_contig('query_id')} as scaffold, cast(row_number() over (partition by {_contig('query_id')} order by query_id) as integer) as gene_position, coalesce(description, '') as description, functional_category as category, coalesce(confidence_level, 'none') as confidence from results",
        "export_network": _with(_RESULTS) + f"select query_id as protein_id, {_contig('query_id')} as contig_id, case when coalesce(description, 'hypothetical protein') in ('', 'hypothetical protein') then functional_category else description || '; ' || functional_category end as keywords from results",
        "export_gff": _with(_RESULTS) + f"select {_contig('query_id')} || chr(9) || 'capsidora' || chr(9) || 'CDS' || chr(9) || '1' || chr(9) || query_length || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'ID=' || query_id || ';Name=' || replace(replace(replace(coalesce(description, 'hypothetical protein'), ';', '%3B'), '=', '%3D'), ',', '%2C') || ';category=' || functional_category || ';confidence=' || coalesce(confidence_level, 'none') as line from results where query_length is not null",
        "embedding_topk": _with(_VECTORS, _NEAR) + "select query, cast(place as integer) as place, target, similarity from near where place <= 3",
        "triage_split": _with(_VECTORS, _NEAR) + "select id, coalesce(similarity >= 0.3, false) as matched, round(least(1.0::double, 0.95::double * similarity + 0.05::double), 8) as score, case when least(1.0::double, 0.95::double * similarity + 0.05::double) >= 0.8 then 'high' when least(1.0::double, 0.95::double * similarity + 0.05::double) >= 0.5 then 'medium' else 'low' end as level from vec left join near on query = id and place = 1",
        "retrieval_map_ndcg": _with(_VECTORS, _NEAR, "h as (select query, place, case when a.label = b.label then 1 else 0 end as rel from near join vec a on a.id = query join vec b on b.id = target where place <= 10)", "p as (select *, sum(rel) over (partition by query order by place)::double / place as p from h)", "s as (select query, sum(rel * p) as ap, sum(rel) as n, sum(rel / log2(place + 1)) as dcg from p group by 1)")
        + "select count(*) as queries, round(avg(case when n > 0 then ap / n else 0 end), 8) as map_at_10, round(avg(case when n > 0 then dcg / list_sum(list_transform(range(1, n::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end), 8) as ndcg_at_10 from s",
        "threshold_sweep": _with(_VECTORS, _NEAR, "o as (select similarity, a.label = b.label as ok from near join vec a on a.id = query join vec b on b.id = target where place = 1)", "t as (select unnest([0.3, 0.5, 0.7, 0.8, 0.9, 0.95]::double[]) as threshold)", "m as (select threshold, count(*) as n, count(*) filter (similarity >= threshold) as matched, count(*) filter (similarity >= threshold and ok) as correct from o cross join t group by 1)")
        + "select threshold, n, matched, correct, round(case when matched > 0 then correct::double / matched else 0 end, 9) as precision, round(correct::double / n, 9) as recall, round(case when correct > 0 then 2 * (correct::double / matched) * (correct::double / n) / (correct::double / matched + correct::double / n) else 0 end, 9) as f1 from m",
        "sim_histogram": _with(_VECTORS, _NEAR, "e as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]::double[]) as edge)", "b as (select (select max(edge) from e where edge <= similarity) as edge from near where place <= 5)") + "select edge, count(*) as n from b where edge is not null group by 1",
        "go_transfer": _with(*transfer) + "select query, go_id, aspect, reliability, donors, b.donor as donor, not b.viral as cross_domain from transfer",
        "go_filter": _with(*transfer, "known as (select distinct unnest(go_annotations).go_id as go_id from swissprot_entries where starts_with(lineage, 'Viruses'))") + "select not b.viral as cross_domain, aspect, count(*) as n from transfer where b.viral or go_id in (select go_id from known where go_id is not null) group by all",
        "dual_validation": _with(_RESULTS, *transfer, f"c as (select query, reliability, case when aspect = 'BP' then {_by_terms(go_text, rules.GO_PROCESS)} when aspect = 'MF' then {_by_terms(go_text, rules.GO_FUNCTION)} end as c from transfer)", "g as (select query, arg_min(c, struct_pack(r := -reliability, c := c)) as go_category from c where c is not null group by 1)",
            "v as (select query_id as query, functional_category as h, go_category, consensus_score as s, confidence_level as l, case when go_category is null then 'foldseek_only' when functional_category = 'unknown' then 'go_only' when functional_category = go_category then 'dual_agree' else 'dual_disagree' end as dual_validation from results left join g on g.query = query_id)")
        + "select query, dual_validation, go_category, coalesce(go_category, h) as final_category, round(case when dual_validation = 'dual_agree' then least(1.0::double, s * 1.3::double) else s end, 6) as final_score, case when dual_validation = 'dual_agree' and least(1.0::double, s * 1.3::double) >= 0.8 then 'high' when dual_validation = 'dual_agree' and least(1.0::double, s * 1.3::double) >= 0.5 then 'medium' else l end as final_level from v",
        "go_evidence_codes": _with(*transfer) + "select query, string_agg(distinct b.evidence_code, '|' order by b.evidence_code) as codes from transfer where b.evidence_code is not null group by query",
    }
