"""DuckDB SQL for the catalogue's queries, written apart from the engine's plans."""

from __future__ import annotations

from ..functions import status as X
from .catalogue import GEO_SUPPORT, MARKS, N_MODELS
from .lens import K, M, MIN_SUPPORT

CLEAN = "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')"

#: A k-mer as a number of digits 0 to 3, and the bucket of such a number.
NUMBER = f"translate(substr(seq, i, {K}), 'ACGT', '0123')::bigint"
BUCKET = f"translate(lpad((kmer // {10 ** (K - M)})::varchar, {M}, '0'), '0123', 'ACGT')"

#: Common table expressions, in the order in which they build on each other.
PARTS = {
    "rec": f"select doc_id rec_no, 'doc_' || doc_id header, {CLEAN} seq from documents",
    "qry": f"select item_id qid, 'item_' || item_id query, {CLEAN} seq from benchmark union all select -1 - rec_no, header, seq from rec where rec_no % 50 = 0",
    "lng": "select lang, dense_rank() over (order by lang)::bigint id from (select distinct lang from documents)",
    "src": """select lang, source, support, (dense_rank() over (order by lang, source) + 99)::bigint id, lng.id up
        from (select lang, source, 100 * avg(quality) support from documents left join labels using (doc_id) group by all) join lng using (lang)""",
    "nod": """select 0::bigint node_id, null::bigint parent_id, 'ROOT' kind, null::varchar name, null::double support union all select id, 0, 'NODE', null, null from lng
        union all select id, up, 'NODE', null, support from src union all select doc_id + 1000, src.id, 'LEAF', 'doc_' || doc_id, null from documents join src using (lang, source)""",
    "good": f"select *, support is null or support >= {MIN_SUPPORT} keep from src",
    "tre": f"""select node_id, parent_id, kind from nod where kind = 'ROOT' or parent_id = 0 union all select id, up, 'NODE' from good where keep
        union all select doc_id + 1000, case when keep then id else up end, 'LEAF' from documents join good using (lang, source)""",
    "inn": "select id node_id, 0::bigint parent_id, 1 depth, exists (select 1 from good where keep and up = lng.id) below from lng union all select id, up, 2, false from good where keep",
    "str": "select rec_no, header, seq from rec union all select rec_no, header, reverse(translate(seq, 'ACGT', 'TGCA')) from rec",
    "dkm": f"select distinct rec_no, {NUMBER} kmer from (select rec_no, seq, unnest(range(1, length(seq) - {K} + 2)) i from str)",
    "home": "select doc_id rec_no, lng.id l, case when keep then good.id end s from documents join good using (lang, source) join lng using (lang)",
    "ix": "select distinct kmer, node_id from (select kmer, unnest([0, l, s]) node_id from dkm join home using (rec_no)) where node_id is not null",
    "qst": "select qid, seq from qry union all select qid, reverse(translate(seq, 'ACGT', 'TGCA')) from qry",
    "qkm": f"select distinct qid, {NUMBER} kmer from (select qid, seq, unnest(range(1, length(seq) - {K} + 2)) i from qst)",
    "hit": "select qid, kmer, node_id from qkm join ix using (kmer)",
    "mat": "select qid, count(distinct kmer) matched from hit group by qid",
    "h": "select qid, parent_id, kmer, node_id from hit join inn using (node_id)",
    "kk": "select qid, parent_id, kmer, count(*) n, min(node_id) only_child from h group by all",
    "tot": "select qid, parent_id, count(*) total from kk group by all",
    "exc": "select qid, only_child node_id, count(*) exclusive from kk where n = 1 group by all",
    "adh": """select qid, parent_id, node_id, one::int one, (total - coalesce(exclusive, 0))::int rest, coalesce(exclusive, 0)::int one_x, (total - one)::int rest_x
        from (select qid, parent_id, node_id, count(*) one from h group by all) join tot using (qid, parent_id) left join exc using (qid, node_id)""",
    "win": "select *, inn.depth, inn.below from adh join inn using (node_id, parent_id) where one > rest",
    "rch": "select w.* from win w where w.depth = 1 or exists (select 1 from win p where p.qid = w.qid and p.node_id = w.parent_id)",
    "fin": "select qid, max_by(node_id, depth) clade, max(depth) depth, max_by(below, depth) below, max_by(one, depth) one, max_by(rest, depth) rest, max_by(one_x, depth) one_x, max_by(rest_x, depth) rest_x from rch group by qid",
    "geo": """select 0::bigint node_id, null::bigint parent_id, 'ROOT' kind, null::varchar name, null::double support union all select r_regionkey + 1, 0, 'NODE', null, 99 from region
        union all select n_nationkey + 100, n_regionkey + 1, 'NODE', null, s from nation left join (select c_nationkey, round(avg(c_acctbal) / 50) s from customer group by 1) on c_nationkey = n_nationkey
        union all select c_custkey + 1000, c_nationkey + 100, 'LEAF', c_name, null from customer""",
    "clo": "select node_id, parent_id anc_id, 1 dist from geo where parent_id is not null union all select c.node_id, g.parent_id, c.dist + 1 from clo c join geo g on g.node_id = c.anc_id where g.parent_id is not null",
}


def sql(select: str, last: str = "fin") -> str:
    """SQL with the expressions up to last in front."""
    names = list(PARTS)
    parts = [f"{n} as ({PARTS[n]})" for n in names[: names.index(last) + 1] if n not in ("geo", "clo") or last in ("geo", "clo")]
    if last in ("geo", "clo"):
        parts = [f"{n} as ({PARTS[n]})" for n in ("geo", "clo")[: 1 + (last == "clo")]]
    return f"with recursive {', '.join(parts)} {select}"


def placement(limit: int = 1000, one: str = "one", rest: str = "rest", few: str = "false", few_text: str = "null") -> str:
    """A query over fin that gives placements."""
    quoted = "'Query sequence SequenceHeader(\"' || query || '\") may not be related to the phylogeny'"
    return f"""
    select query, status, case status when 'IdentityFound' then null when 'MaxResolutionReached' then '{X.LCA_ACCEPTED}' else message end message,
      case when status in ('IdentityFound', 'MaxResolutionReached') then clade end clade_id,
      case when status = 'IdentityFound' then {one} end one, case when status = 'IdentityFound' then {rest} end rest, case when n >= {K} and matched is not null then iterations end iterations
    from (select *, case when n < {K} or iterations > {limit} and matched is not null and not ({few}) then 'Error' when matched is null or {few} or depth is null then 'Unclassifiable' when not below then 'IdentityFound' else 'MaxResolutionReached' end status,
        case when n < {K} then '{X.TOO_SHORT}' when matched is null then {quoted} when {few} then {few_text} when iterations > {limit} then '{X.TOO_MANY}' else '{X.NO_OVERLAP}' end message
      from (select query, length(seq) n, matched, clade, depth, below, one, rest, one_x, rest_x, (coalesce(depth, 0) + case when depth is null or below then 1 else 0 end)::int iterations,
          (select count(*) from qkm where qkm.qid = qry.qid) n_all
        from qry left join mat using (qid) left join fin using (qid)))
    """


def marker() -> str:
    return "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in MARKS.items()) + " end"


def oracle_sql() -> dict[str, str]:
    p, one_step = placement(), placement(1)
    few = "matched < round(n_all * 0.5)"
    code = "status || coalesce(': ' || message, '')"
    buckets = f"select {BUCKET} minimizer, count(distinct kmer) n_kmers from ix group by 1"
    tags = """select clade, string_agg(a || ':' || t || ':' || v, ',' order by a) tags from (
        select id clade, id a, 'SciName' t, lang v from lng union all select id, id, 'Rank', source from src union all select src.id, lng.id, 'SciName', lang from src join lng using (lang)) group by clade"""
    return {
        "seq_sanitize": sql("select header, seq from rec", "rec"),
        "seq_revcomp": sql("select header, reverse(translate(seq, 'ACGT', 'TGCA')) revcomp from rec", "rec"),
        "seq_kmers_forward": sql(f"select kmer, count(*) n from (select substr(seq, i, {K}) kmer from (select seq, unnest(range(1, length(seq) - {K} + 2)) i from rec)) group by kmer", "rec"),
        "seq_kmers_both": sql(f"select kmer, count(*) n from (select substr(seq, i, {K}) kmer from (select seq, unnest(range(1, length(seq) - {K} + 2)) i from str)) group by kmer", "str"),
        "kmer_minimizer_buckets": sql(buckets, "ix"),
        "kmer_minimizer_zero": sql("select '' minimizer, count(distinct kmer) n_kmers from ix", "ix"),
        "query_too_short": sql(f"select query, 'Error' status, '{X.TOO_SHORT}' message from qry where length(seq) < {K}", "qry"),
        "tree_nodes": sql("select * from nod", "nod"),
        "tree_collapse": sql("select * from tre", "tre"),
        "tree_collapse_geography": sql(f"""select g.node_id, case when p.kind = 'NODE' and p.support < {GEO_SUPPORT} then p.parent_id else g.parent_id end parent_id, g.kind
            from geo g left join geo p on p.node_id = g.parent_id where g.kind <> 'NODE' or g.support is null or g.support >= {GEO_SUPPORT}""", "geo"),
        "tree_closure": sql("select * from clo", "clo"),
        "tree_path_to_root": sql("select node_id, anc_id from clo where node_id in (select node_id from geo where kind <> 'LEAF') union all select node_id, node_id from geo where kind <> 'LEAF'", "clo"),
        "tree_leaf_paths": sql("select node_id, string_agg(anc_id::varchar, '/' order by dist desc) || '/' || node_id path from clo where node_id in (select node_id from geo where kind = 'LEAF') group by node_id", "clo"),
        "tree_kind_counts": sql("select kind, count(*) n from tre group by kind", "tre"),
        "tree_children_inner": sql("select parent_id node_id, count(*) n_children, count(*) filter (kind <> 'LEAF') n_inner from tre where parent_id is not null group by 1", "tre"),
        "header_leaf_join": sql("select 'doc_' || (node_id - 1000) header, node_id leaf_id, parent_id from tre where kind = 'LEAF'", "tre"),
        "header_leaf_missing": sql("select query header from qry where query not in (select name from nod where name is not null)", "nod"),
        "index_build": sql("select node_id, count(*) n_kmers from ix group by 1", "ix"),
        "index_build_shifted": sql("""select node_id, count(distinct kmer) n_kmers from (select kmer, unnest([0, l, s]) node_id from (select rec_no + 1 rec_no, kmer from dkm) join home using (rec_no)) where node_id is not null group by 1""", "home"),
        "describe_db": sql(f"select {K} kmer_size, {M} minimizer_size, sum(n_kmers)::bigint kmer_count, count(*) minimizer_count, max(n_kmers) largest_minimizer, min(n_kmers) smallest_minimizer, (sum(n_kmers) // count(*))::bigint minimizer_avg_kmers from ({buckets})", "ix"),
        "overlap_counts": sql("select query, matched from mat join qry using (qid)", "mat"),
        "root_coverage": sql("select query, matched, round(matched * 0.7)::bigint expected, matched >= round(matched * 0.7) enough from mat join qry using (qid)", "mat"),
        "node_hits": sql("select query, node_id, one from adh join qry using (qid)", "adh"),
        "one_vs_rest": sql("select query, parent_id, node_id, one, rest from adh join qry using (qid)", "adh"),
        "one_vs_rest_no_intersection": sql("select query, parent_id, node_id, one_x one, rest_x rest from adh join qry using (qid)", "adh"),
        "level_winners": sql("select query, parent_id, node_id, n_winners from (select qid, parent_id, max(node_id) node_id, count(*) n_winners from win group by 1, 2) join qry using (qid)", "win"),
        "place_sequences": sql(p),
        "place_remove_intersection": sql(placement(one="one_x", rest="rest_x")),
        "place_query_coverage": sql(f"select query, status, message, clade_id from ({placement(few=few, few_text=chr(39) + 'Insufficient kmers coverage: ' + chr(39) + ' || matched')})"),
        "place_max_iterations": sql(one_step),
        "place_status_summary": sql(f"select status, count(*) n from ({p}) group by 1"),
        "place_unclassifiable": sql(f"select query, {code} code from ({p}) where status = 'Unclassifiable'"),
        "place_annotated": sql(f"select query, status, clade_id, tags from ({p}) left join ({tags}) on clade = clade_id"),
        "place_json": sql(f"""select query, '{{"query":"' || query || '","code":"' || replace({code}, '"', '\\"') || '"' || case status when 'MaxResolutionReached' then ',"placement":' || clade_id
            when 'IdentityFound' then ',"placement":{{"clade":' || clade_id || ',"one":' || one || ',"rest":' || rest || '}}' else '' end || '}}' line from ({p}) where status <> 'Error'"""),
        "place_errors": sql(f"select query, message from ({one_step}) where status = 'Error'"),
        "jobs_pending": f"select distinct event_id // 3 job from events where event_id // 3 not in (select event_id // 3 from events where {marker()} is not null)",
        "jobs_model_lookup": f"""select event_id, n_name model_name, case when n_name is null then 'model not found: ' || user_id % 25 end error
            from events left join nation on n_nationkey = user_id % 25 and n_nationkey < {N_MODELS}""",
        "runtime_stats": "select count(value) n, round(avg(value), 6) average, max(value) longest, min(value) shortest from events",
        "fasta_roundtrip": sql("select header, seq from rec where seq <> ''", "rec"),
        "stream_jobs": f"""select event_id // 3 job, ['pending', 'running', 'error', 'success'][1 + max(case {marker()} when 'success' then 3 when 'error' then 2 when 'running' then 1 else 0 end)] state from events group by 1""",
        "model_roundtrip": sql(f"select {BUCKET} minimizer, count(*) n_rows, count(distinct kmer) n_kmers from ix group by 1", "ix"),
        "newick_parse": sql("select g.name, p.support parent_support, count(*) over (partition by g.parent_id) siblings from geo g join geo p on p.node_id = g.parent_id where g.kind = 'LEAF'", "geo"),
        "fasta_text": sql("select '>' || header || chr(10) || seq || chr(10) entry from rec", "rec"),
        "record_numbers": sql("select header, row_number() over (order by header) - 1 rec_no from rec", "rec"),
        "coverage_clamp": "select p_partkey, 0::bigint below, round(p_size * 0.7::double)::bigint inside, p_size::bigint above from part",
        "annotation_load": sql("select id clade, 'SciName' tag, lang value from lng union all select id, 'Rank', source from src", "src"),
        "tree_yaml_roundtrip": sql("select node_id, parent_id, kind, name, support from geo", "geo"),
        "place_outcomes": sql(f"select query, case status when 'MaxResolutionReached' then 'UCPLACE0015' when 'IdentityFound' then 'UCPLACE0016' end code from ({p})"),
        "adherence_texts": sql("""select query, parent_id, (row_number() over (partition by qid, parent_id order by one desc, node_id))::int place,
            'AdherenceTest: Clade: ' || node_id || ' - ' || one || ' - ' || rest as text from adh join qry using (qid)""", "adh"),
        "index_overlap": sql(f"select {BUCKET} minimizer, count(distinct kmer) n_kmers from ix where kmer in (select kmer from qkm) group by 1", "qkm"),
        "first_words": r"select p_partkey, regexp_extract(p_type, '^\s*(\S+)', 1) word from part",
        "place_yaml": sql(f"select query, {code} code from ({p}) where status <> 'Error'"),
    }
