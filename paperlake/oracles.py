"""SQL twins of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

_TOK = r"regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)"
_D = f"d as (select doc_id, {_TOK} as t from documents where text is not null), st as (select count(*)::double as n, avg(len(t)) as avgdl from d)"
_IDF = "(case when ln((n - {df} + 0.5) / ({df} + 0.5)) > 0 then ln((n - {df} + 0.5) / ({df} + 0.5)) else 1e-6 end)"


def _bm25(leaves: list[str], holds: str, limit: int = 20, extra: str = "", tail: str = "") -> str:
    """BM25 over hit-count expressions; holds is a condition over f0, f1, …"""
    counts = ", ".join(f"{e} as f{n}" for n, e in enumerate(leaves))
    dfs = ", ".join(f"count(*) filter (where f{n} > 0) as df{n}" for n in range(len(leaves)))
    score = " + ".join(f"{_IDF.format(df=f'df{n}')} * f{n} * 2.2::double / (f{n} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))" for n in range(len(leaves)))
    return f"""with {_D}, c as (select doc_id, len(t) as dl, {counts} from d), g as (select {dfs} from c),
    m as (select doc_id, round({score}, 6) as score from c, g, st where {holds} {extra}),
    top as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from m order by score desc, doc_id limit {limit})
    {tail or 'select doc_id, score, rank from top'}"""


def _is(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


_THREE = [_is(w) for w in ("glacier", "permafrost", "monsoon")]
_ANY = "(f0 > 0 or f1 > 0 or f2 > 0)"
_PHRASE = "len(list_filter(range(1, len(t) - 2), lambda i: t[i] = 'as' and t[i+1] = 'figure' and t[i+2] = '10' and t[i+3] = 'shows'))"
_NORM = "(sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double))))"
_COS = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double)) / (" + _NORM.format(v="{a}") + " * " + _NORM.format(v="{b}") + "), 4)"
_EMB = _COS.format(a="e.embedding", b="q.embedding")
_SC = f"s as (select e.vec_id as id, e.label, {_EMB} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q)"


def _knn(where: str, k: int) -> str:
    return f"""with s as (select q.vec_id as q_idx, e.vec_id as id, {_EMB} as score from embeddings e, (select * from embeddings where vec_id = 0) q where {where})
    select q_idx, id, score, rank from (select *, row_number() over (partition by q_idx order by score desc, id) as rank from s) where rank <= {k}"""


def _q(condition: str, source: str = "papers") -> str:
    return f"select id, filename from {source} where {condition}"


_INK = "coalesce(regexp_matches({c}, '\\S'), false)"
_DOI = "rtrim(case when instr(lower(trim({c}, ' ')), '10.') > 0 then substr(lower(trim({c}, ' ')), instr(lower(trim({c}, ' ')), '10.')) else lower(trim({c}, ' ')) end, '.,;:)]}}')"
_FILE = r"lower(regexp_extract(regexp_replace(regexp_replace(file, '^:', ''), ':[A-Za-z]+$', ''), '([^/\\]*)$', 1))"
_BIB = "coalesce(metadata_source ilike 'bib:%', false)"
_MISS = "coalesce(metadata_source ilike 'none:%', false)"
_MANUAL = f"(coalesce(metadata_source ilike '%manual%', false) and not {_BIB})"
_STOP = "('the','a','an','of','and','or','for','in','on','to','with','by','from','as','at','is','are','be','that','this','how','what','why','when','who','whose','which','its','their','our','not','no','new','using','use','toward','towards','between','within','into','over','under','after','before','more','most','less','least','case','study','studies','analysis','approach','evidence','role','impact','effects','effect')"
_WORDS = r"regexp_extract_all(lower({t}), '([a-z][a-z''\-]{{3,}})', 1)"


def _contain(title: str, text: str) -> str:
    w = _WORDS.format(t=title)
    own = f"(case when len(list_filter({w}, lambda x: x not in {_STOP})) > 0 then list_filter({w}, lambda x: x not in {_STOP}) else {w} end)"
    there = _WORDS.format(t=f"substr({text}, 1, 6000)")
    return f"coalesce(case when len({own}) > 0 then round(len(list_filter({own}, lambda x: list_contains({there}, x)))::double / len({own}), 3) end, 0.0::double)"


_DOI_LINK = f"(select id, {_DOI.format(c='doi')} as key from papers where {_INK.format(c='doi')})"
_DOI_BIB = f"(select {_DOI.format(c='doi')} as key, max(entry_id) as entry_id from bib where {_INK.format(c='doi')} group by 1)"
_FILE_BIB = f"(select {_FILE} as key, max(entry_id) as entry_id from bib where {_INK.format(c='file')} group by 1)"
_KEYBASE = r"""coalesce(regexp_replace(lower(regexp_extract(filename, '^([A-Za-z]+)_', 1)), '[^a-z]', '', 'g'), '') || coalesce(year::varchar, '')
  || coalesce(list_filter(regexp_extract_all(lower(title), '([a-z]+)', 1), lambda w: w not in ('a','an','the','of','in','on','for','and','to'))[1], '')"""
_INTERVAL = """case when {v} = 'done' then null when {v} = 'key' then greatest((case when {first} then 1.0::double else {p} end) * 3, 7.0::double)
  when {first} then 1.0::double when {v} = 'good' then {p} * 2 when {v} = 'later' then {p} * 1.5::double else least(greatest({p} * 0.5::double, 1.0::double), 2.0::double) end"""
_LIB = "(select p.*, t.text_length from papers p left join paper_text t on t.paper_id = p.id)"
_CV = "(select chunk_id as id, any_value(embedding) as v from chunk_vec where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1)"

ORACLES = {
    "fts_bm25_topk": _bm25(_THREE, _ANY),
    "fts_bool_and_not": _bm25([_is("referendum"), _is("ballot"), _is("petition")], "f0 > 0 and f1 > 0 and not f2 > 0"),
    "fts_phrase": _bm25([_PHRASE], "f0 > 0"),
    "fts_prefix": _bm25(["len(list_filter(t, lambda x: starts_with(x, 'delib')))"], "f0 > 0"),
    "fts_page_normalized": _bm25(_THREE, _ANY, tail="select doc_id, round(score / max(score) over (), 2) as score from top"),
    "fts_count": f"with {_D} select count(*) as matches from d where list_contains(t, 'glacier') or list_contains(t, 'permafrost') or list_contains(t, 'monsoon')",
    "fts_restricted": _bm25(_THREE, _ANY, extra="and doc_id in (select doc_id from documents where lang = 'en')"),
    "fts_multi_query": f"""with {_D}, q as (select item_id as q_idx, unnest({_TOK}) as term from eval_items where text is not null),
      qt as (select q_idx, term, count(*) as times from q group by 1, 2), w as (select doc_id, len(t) as dl, unnest(t) as term from d),
      f as (select term, doc_id, dl, count(*) as tf from w where term in (select term from qt) group by 1, 2, 3), df as (select term, count(*) as df from f group by 1),
      sc as (select q_idx, doc_id, round(sum({_IDF.format(df='df')} * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl)) * times), 6) as score from f join df using (term) join qt using (term), st group by 1, 2)
      select q_idx, doc_id, score, rank from (select *, row_number() over (partition by q_idx order by score desc, doc_id) as rank from sc) where rank <= 5""",
    "index_postings": f"with {_D}, w as (select doc_id, unnest(t) as term from d) select term, count(distinct doc_id) as df, count(*) as cf from w group by 1",
    "corpus_stats": f"with {_D} select count(*) as docs, round(avg(len(t)), 6) as avgdl from d",
    "vec_knn": _knn("true", 10),
    "vec_knn_restricted": _knn("e.label in (1, 2)", 10),
    "vec_knn_batch": f"""with s as (select q.vec_id as q_idx, e.vec_id as id, {_EMB} as score from embeddings e, (select * from embeddings where vec_id % 50 = 0) q)
      select q_idx, id, score, rank from (select *, row_number() over (partition by q_idx order by score desc, id) as rank from s) where rank <= 5""",
    "chunk_knn": f"""with v as {_CV}, s as (select q.id as q_idx, e.id, {_COS.format(a='e.v', b='q.v')} as score from v e, (select * from v where id % 50 = 0) q)
      select q_idx, id, score, rank from (select *, row_number() over (partition by q_idx order by score desc, id) as rank from s) where rank <= 5""",
    "best_chunk_per_doc": f"with {_SC} select label, id, score from (select *, row_number() over (partition by label order by score desc, id) as r from s) where r = 1",
    "chunk_pool_top3": f"with {_SC} select label, round(avg(score), 4) as score from (select *, row_number() over (partition by label order by score desc) as r from s) where r <= 3 group by 1",
    "cascade": f"""with {_SC}, h as (select label, min(vec_id) as id from embeddings group by 1), td as (select s.label as doc_id from s join h on h.id = s.id order by s.score desc, s.label limit 50),
      tc as (select id as chunk_id, label as doc_id, score from s where id not in (select id from h) order by score desc, id limit 100),
      ra as (select chunk_id, doc_id, case when doc_id in (select doc_id from td) then least(score + 0.05::double, 1.0::double) else score end as score from tc),
      rk as (select *, row_number() over (partition by doc_id order by score desc, chunk_id) as r from ra)
      select doc_id::bigint as doc_id, round(avg(score) filter (where r <= 3), 4) as score, max(chunk_id) filter (where r = 1) as best_chunk from rk group by 1 order by 2 desc, 3 limit 10""",
    "hybrid_rrf": _bm25(_THREE, _ANY, 40, "and doc_id in (select vec_id from embeddings)", f""", {_SC.replace('from embeddings e', 'from (select * from embeddings where vec_id in (select doc_id from documents)) e')},
      v as (select id as doc_id, score, row_number() over (order by score desc, id) as rank from s order by score desc, id limit 40)
      select coalesce(top.doc_id, v.doc_id) as doc_id, top.score as score_fts, top.rank as rank_fts, v.score as score_vector, v.rank as rank_vector,
      round(coalesce(1.0::double / (60 + top.rank), 0) + coalesce(1.0::double / (60 + v.rank), 0), 6) as score
      from top full join v on top.doc_id = v.doc_id order by score desc, coalesce(rank_fts, 2147483648), coalesce(rank_vector, 2147483648), doc_id limit 20"""),
    "hybrid_folded": _bm25(_THREE, _ANY, 60, tail=""", h as (select doc_id, min(doc_id) over (partition by text) as work_id from documents where text is not null),
      k as (select top.doc_id, work_id, score, rank, row_number() over (partition by work_id order by rank, top.doc_id) as r from top join h on h.doc_id = top.doc_id)
      select doc_id, work_id, score, rank from k where r = 1 order by rank, doc_id limit 20"""),
    "snippet_best_chunk": """with c as (select distinct doc_id, chunk_index, (instr(lower(text), 'deliberati') > 0)::bigint + (instr(lower(text), 'referend') > 0)::bigint + (instr(lower(text), 'legitima') > 0)::bigint + (instr(lower(text), 'ball') > 0)::bigint as hits from chunks where text is not null)
      select doc_id, chunk_index, hits from (select *, row_number() over (partition by doc_id order by hits desc, chunk_index) as r from c where hits > 0) where r = 1""",
    "snippet_window": """with p as (select doc_id, text, least(nullif(instr(lower(text), 'referend'), 0), nullif(instr(lower(text), 'ball'), 0)) as pos from documents where text is not null)
      select doc_id, greatest(1, coalesce(pos, 1) - 300)::bigint as start, substr(text, greatest(1, coalesce(pos, 1) - 300), 900) as "window" from p""",
    "find_tiers": """with p as (select id, filename as n, year::varchar as year, lower(coalesce(title, '')) as title, lower(coalesce(title_from_layout, '')) as layout, lower(coalesce(authors, '')) as authors, lower(coalesce(citekey, '')) as citekey, lower(coalesce(doi, '')) as doi, lower(coalesce(filename, '')) as filename from papers),
      f as (select *, w, (contains(title, w)) as m1, contains(layout, w) as m2, contains(authors, w) as m3, contains(citekey, w) as m4, coalesce(year = w, false) as m5, contains(doi, w) as m6, contains(filename, w) as m7 from p, (values ('referendum'), ('2014')) v(w)),
      g as (select id, n, bool_and(m1 or m2 or m3 or m4 or m5 or m6 or m7) as ok, bool_and(m1) as t1, bool_and(m1 or m2 or m3 or m4 or m5) as t2, any_value(contains(title, 'referendum 2014')) as t0, any_value(contains(layout, 'referendum 2014')) as l0,
        bool_or(m1) as u1, bool_or(m2) as u2, bool_or(m3) as u3, bool_or(m4) as u4, bool_or(m5) as u5, bool_or(m6) as u6, bool_or(m7) as u7 from f group by 1, 2)
      select id, case when t0 then 0 when t1 or l0 then 1 when t2 then 2 else 3 end as tier,
        concat_ws(',', case when u1 then 'title' end, case when u2 then 'title_from_layout' end, case when u3 then 'authors' end, case when u4 then 'citekey' end, case when u5 then 'year' end, case when u6 then 'doi' end, case when u7 then 'filename' end) as matched_fields
      from g where ok order by tier, n, id limit 50""",
    "grep_exact": "select distinct doc_id, chunk_index, (instr(text, 'has rarely asked who records the') - 1)::bigint as start from (select distinct doc_id, chunk_index, text from chunks) where contains(text, 'has rarely asked who records the')",
    "grep_ignore_case": "select distinct doc_id, chunk_index, (instr(lower(text), 'has rarely asked who records the') - 1)::bigint as start from (select distinct doc_id, chunk_index, text from chunks) where contains(lower(text), 'has rarely asked who records the')",
    "grep_prefilter": """select doc_id from documents where contains(text, 'debate over referendum records')
      or (contains(lower(text), 'referendum'))::int + (contains(lower(text), 'records'))::int + (contains(lower(text), 'debate'))::int >= 2""",
    "queue_needs": _q("needs_ocr and citekey is null"),
    "queue_has": _q("coalesce(error_count, 0) > 0 and has_text and not is_encrypted"),
    "queue_is": _q(f"{_MANUAL} and not coalesce(error_count, 0) >= 3"),
    "queue_miss": _q(_MISS),
    "queue_suspicious": _q("has_text and needs_ocr and coalesce(page_count, 0) > 0 and coalesce(text_length, 0) < page_count * 500", _LIB),
    "queue_quarantined": _q("coalesce(error_count, 0) >= 3"),
    "status_dashboard": """select count(*) as total, count(*) filter (where has_text) as has_text, count(*) filter (where has_markdown) as has_markdown, count(*) filter (where has_embeddings) as has_embeddings,
      count(*) filter (where has_chunk_embeddings) as has_chunk_embeddings, count(*) filter (where needs_ocr) as needs_ocr, count(*) filter (where is_encrypted) as is_encrypted, count(*) filter (where metadata_suspect) as metadata_suspect,
      count(*) filter (where error_count > 0) as errors, count(*) filter (where error_count >= 3) as quarantined, round(100.0::double * count(*) filter (where has_text) / count(*), 1) as pct_text, round(100.0::double * count(*) filter (where has_embeddings) / count(*), 1) as pct_embeddings from papers""",
    "pending_counts": f"""select count(*) filter (where not has_text and not is_encrypted and not coalesce(error_count, 0) >= 3) as needs_text,
      count(*) filter (where has_text and not has_embeddings and not coalesce(error_count, 0) >= 3) as needs_embeddings, count(*) filter (where has_text and not has_chunk_embeddings and not coalesce(error_count, 0) >= 3) as needs_chunk_embeddings,
      count(*) filter (where metadata_source is null) as needs_enrich, count(*) filter (where {_MISS}) as enrich_misses, count(*) filter (where metadata_suspect) as metadata_suspect, count(*) filter (where {_MANUAL}) as manual_metadata,
      count(*) filter (where {_BIB}) as bib_metadata, count(*) filter (where title_from_layout is null and not is_encrypted) as needs_layout_title, count(*) filter (where title_from_layout <> '') as layout_titled,
      count(*) filter (where coalesce(title, '') = '' and coalesce(title_from_layout, '') = '') as display_untitled from papers""",
    "field_completeness": f"""with p as (select metadata_source is null as never, {_MISS} as miss, title, authors, year, doi from papers),
      x as (select 'title' as field, never, miss, coalesce(title, '') = '' as gap from p union all select 'authors', never, miss, coalesce(authors, '') = '' or coalesce(authors = '[]', false) from p union all select 'year', never, miss, year is null from p union all select 'doi', never, miss, coalesce(doi, '') = '' from p)
      select field, count(*) filter (where gap) as missing, count(*) filter (where gap and never) as never_attempted, count(*) filter (where gap and miss) as provider_miss, count(*) filter (where gap and not never and not miss) as attempted_incomplete, count(*) filter (where not gap) as complete from x group by 1""",
    "gap_ids": "select id from papers where coalesce(doi, '') = '' and metadata_source is not null",
    "default_enrich": f"select id from papers where metadata_source is null or {_MISS}",
    "to_process": "select id from papers where not has_text and not coalesce(is_scanned, false) and not is_encrypted and not coalesce(error_count, 0) >= 3",
    "error_list": "select id, filename, error_count from papers where error_count > 0",
    "retry_ids": "select id from papers where error_count > 0 and error_count < 3",
    "missing_ids": "select doc_id + chunk_index * 7 as id, min(chunk_id) as pos from chunks where doc_id + chunk_index * 7 not in (select id from papers) group by 1",
    "resolve_identifiers": """with a as (select distinct upper(citekey) as ident from bib where citekey is not null),
      n as (select 1 as tier, id::varchar as key, false as low, id from papers union all select 2, filename, false, id from papers union all select 3, citekey, false, id from papers union all select 4, lower(citekey), true, id from papers union all select 5, lower(filename), true, id from papers),
      f as (select ident, tier, id, row_number() over (partition by ident order by tier, id) as r from a join n on (not low and key = ident) or (low and key = lower(ident)))
      select ident, id from f where r = 1""",
    "display_title": f"""select id, case when {_INK.format(c='title')} then title when {_INK.format(c='title_from_layout')} then title_from_layout else filename end as display_title,
      case when {_INK.format(c='title')} then 'metadata' when {_INK.format(c='title_from_layout')} then 'layout' else 'filename' end as title_source from papers""",
    "oneline": r"""select concat_ws(chr(9), id::varchar, coalesce(trim(regexp_replace(filename, '\s+', ' ', 'g')), ''), coalesce(year::varchar, ''), coalesce(trim(regexp_replace(citekey, '\s+', ' ', 'g')), '')) as value from papers""",
    "works_hash": "select file_hash, min(id) as work_id, count(*) as copies from papers where file_hash is not null group by 1",
    "works_components": """with recursive e as (select id as a, min(id) over (partition by file_hash) as b from papers where file_hash is not null union select id, min(id) over (partition by lower(title), year) from papers where title is not null and year is not null),
      s as (select a, b from e where a <> b union select b, a from e where a <> b), r as (select a as id, a as x from s union select r.id, s.b from r join s on s.a = r.x) select id, min(x) as component from r group by 1""",
    "works_canonical": f"""with g as (select *, min(id) over (partition by file_hash) as work_id from papers where file_hash is not null),
      r as (select work_id, id, row_number() over (partition by work_id order by (not {_INK.format(c='citekey')})::int, case when lower(coalesce(metadata_source, '')) like 'bib:%' then 1 when contains(lower(coalesce(metadata_source, '')), 'manual') then 0 when lower(coalesce(metadata_source, '')) like 'openalex%' then 2 else 3 end, metadata_suspect::int, (not has_text)::int, indexed_at desc nulls last, id) as n, count(*) over (partition by work_id) as copies from g)
      select work_id, id as canonical_id, copies from r where n = 1""",
    "boilerplate_lines": r"""with l as (select paper_id, unnest(string_split(raw_text, chr(10))[1:25]) as line from paper_text where raw_text is not null),
      n as (select distinct paper_id, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g') as line from l)
      select line, count(*) as documents from n where length(line) between 4 and 120 group by 1 having count(*) >= 3""",
    "title_containment": f"select id, {_contain('title', 'raw_text')} as score from papers left join paper_text on paper_id = id",
    "contained_titles": f"select *, score < 0.6::double as suspect from (select id, {_contain('title', 'raw_text')} as score from papers left join paper_text on paper_id = id where metadata_source is not null and not {_MISS})",
    "link_doi": f"select id, entry_id from {_DOI_LINK} p join {_DOI_BIB} b using (key)",
    "link_file": f"select id, entry_id from (select id, lower(filename) as key from papers) p join {_FILE_BIB} b using (key)",
    "link_exact_phases": f"""with m1 as (select id, entry_id from {_DOI_LINK} p join {_DOI_BIB} b using (key)), a1 as (select id, min(entry_id) as entry_id from (select entry_id, min(id) as id from m1 group by 1) group by 1),
      p2 as (select id, lower(filename) as key from papers where id not in (select id from a1)), b2 as (select {_FILE} as key, max(entry_id) as entry_id from bib where {_INK.format(c='file')} and entry_id not in (select entry_id from a1) group by 1),
      m2 as (select id, entry_id from p2 join b2 using (key)), a2 as (select id, min(entry_id) as entry_id from (select entry_id, min(id) as id from m2 group by 1) group by 1)
      select id, entry_id, 'doi' as phase from a1 union all select id, entry_id, 'file' from a2""",
    "bib_missing": f"""select entry_id, citekey from bib where not exists (select 1 from papers p where {_INK.format(c='p.citekey')} and lower(p.citekey) = lower(bib.citekey))
      and not exists (select 1 from papers p where lower(p.filename) = {_FILE.replace('file,', 'bib.file,')}) and not exists (select 1 from papers p where {_INK.format(c='p.doi')} and {_INK.format(c='bib.doi')} and {_DOI.format(c='p.doi')} = {_DOI.format(c='bib.doi')})""",
    "link_pull_fields": f"""with e as (select * from (select entry_id, lower(citekey) as key, title as bt, year as by_, doi as bd, row_number() over (partition by lower(citekey) order by entry_id) as r from bib where {_INK.format(c='citekey')}) where r = 1),
      l as (select p.id, e.entry_id, {_MANUAL} as manual, {_contain('bt', 'raw_text')} as held, concat_ws(',', case when bt <> '' and bt is distinct from title then 'title' end, case when by_ is not null and by_ is distinct from year then 'year' end,
        case when {_INK.format(c='bd')} and {_DOI.format(c='bd')} is distinct from (case when {_INK.format(c='doi')} then {_DOI.format(c='doi')} end)
          and not ({_INK.format(c='doi')} and coalesce(contains(lower(substr(raw_text, 1, 6000)), lower(doi)) and not contains(lower(substr(raw_text, 1, 6000)), {_DOI.format(c='bd')}), false)) then 'doi' end) as changed
        from papers p left join e on lower(p.citekey) = e.key left join paper_text t on t.paper_id = p.id where {_INK.format(c='p.citekey')}),
      a as (select id, case when entry_id is null then 'not_in_bib' when manual then 'manual' when held < 0.6::double then 'unverified' when changed = '' then 'no_change' else 'pull' end as action, changed from l)
      select id, action, case when action = 'pull' then changed else '' end as changed from a""",
    "citekey_base": f"select id, case when k = '' then 'unknown' else k end as base from (select id, {_KEYBASE} as k from papers)",
    "embedding_text": r"""select distinct chunk_id, (concat_ws(' | ', case when trim(p.title) <> '' then p.title end, case when trim(section_header) <> '' then section_header end, case when trim(c.text) <> '' then c.text end)) as embedded from chunks c left join papers p on p.id = c.doc_id""",
    "page_fill": """with c as (select doc_id, chunk_index, any_value(page_start) as page_start, any_value(page_end) as page_end from chunks group by 1, 2)
      select doc_id, chunk_index, coalesce(page_start, last_value(page_end ignore nulls) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), first_value(page_start ignore nulls) over (partition by doc_id order by chunk_index rows between 1 following and unbounded following)) as page_start from c""",
    "read_range": "select distinct doc_id, chunk_index, char_offset, char_offset + length(text) as char_end from chunks where chunk_index between 2 and 4",
    "read_range_missing": "select p.id as doc_id, i as chunk_index from papers p, (values (2), (3), (4)) v(i) where not exists (select 1 from chunks c where c.doc_id = p.id and c.chunk_index = i)",
    "inbox_next_interval": f"""with o as (select distinct open_id, coalesce(seconds / 60.0::double, 0) as p, (['key', 'good', 'later', 'doubt', 'done'])[open_id % 5 + 1] as v, open_id % 3 as n from opens)
      select open_id, round({_INTERVAL.format(v='v', p='p', first='(n = 0 or p = 0)')}, 6) as days from o""",
    "opens_state": "select file_hash, path, count(*) as opens, max(opened_at) as last_at from (select distinct * from opens) group by 1, 2",
    "ledger_fold": "select file_hash, open_id as last_open, opened_by from (select *, row_number() over (partition by file_hash order by open_id desc) as r from (select distinct * from opens where file_hash is not null)) where r = 1",
    "identity_match": """with k as (select distinct file_hash, path from opens where file_hash is not null and path is not null),
      f as (select k.file_hash, k.path, p.id, case when p.file_hash = k.file_hash and p.path = k.path then 0 when p.file_hash = k.file_hash then 1 else 2 end as tier from k join papers p on p.file_hash = k.file_hash or p.path = k.path),
      b as (select file_hash, path, min(tier) as tier from f group by 1, 2), t as (select f.file_hash, f.path, min(f.id) as id, count(distinct f.id) as n from f join b on f.file_hash = b.file_hash and f.path = b.path and f.tier = b.tier group by 1, 2)
      select k.file_hash, k.path, case when n = 1 then t.id end as paper_id, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'found' end as status from k left join t on t.file_hash = k.file_hash and t.path = k.path""",
    "collection_intersection": f"select o.pos, id from papers join (select path, min(open_id) as pos from opens where path is not null group by 1) o using (path) where {_INK.format(c='citekey')}",
    "prune_papers": "select paper_id from paper_text where paper_id not in (select id from papers where path is null or path not in (select path from opens where path is not null))",
    "stream_opens_hourly": "select date_trunc('hour', opened_at) as hour, count(*) as opens from (select distinct * from opens) where opened_at is not null group by 1",
}

_IDENTITY = ORACLES["identity_match"]
_OPENS = "(select distinct * from opens where file_hash is not null and path is not null)"
_MEMBERS = f"""(select collection_id, file_hash, path, arg_max(op, batch) as last_op, arg_max(batch_id, batch) filter (where op = 'add') as batch_id, bool_or(batch_id = 'b4' and op = 'add') as in_b4 from
  (select opened_by as collection_id, file_hash, path, open_id as batch, 'b' || (open_id % 10) as batch_id, case when page is null or open_id % 3 = 0 then 'remove' else 'add' end as op from {_OPENS}) group by 1, 2, 3)"""
_LIVE = f"(select * from {_MEMBERS} where last_op = 'add')"
_CHUNK_Q = "(select embedding as v from chunk_vec where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 order by chunk_id limit 1)"
_CHUNK_ONLY = f"""s as (select e.id as chunk_id, {_COS.format(a='e.v', b='q.v')} as score from {_CV} e, {_CHUNK_Q} q),
  c as (select chunk_id, min(doc_id) as doc_id from chunks where doc_id is not null group by 1), t as (select s.chunk_id, doc_id, score from s join c using (chunk_id) order by score desc, s.chunk_id limit 200),
  oy as (select doc_id, max(score) as score from t where doc_id in (select id from papers where not coalesce(has_embeddings, false) and coalesce(has_chunk_embeddings, false)) group by 1 order by score desc, doc_id limit 20)"""
_STEMS = "((instr(lower(text), 'deliberati') > 0)::bigint + (instr(lower(text), 'referend') > 0)::bigint + (instr(lower(text), 'legitima') > 0)::bigint + (instr(lower(text), 'ball') > 0)::bigint)"
_TOP_CHUNK = f"(select doc_id, chunk_index, text from (select doc_id, chunk_index, text, row_number() over (partition by doc_id order by {_STEMS} desc, chunk_index) as r from (select distinct doc_id, chunk_index, text from chunks where text is not null) where {_STEMS} > 0) where r = 1)"
_VEC_TOP = f"with {_SC.replace('from embeddings e', 'from (select * from embeddings where vec_id in (select doc_id from documents)) e')}, v as (select id as doc_id, row_number() over (order by score desc, id) as rank from s order by score desc, id limit 40)"
_SUFFIX = "(case when s = 0 then '' when s <= 26 then chr((96 + s)::int) else chr((96 + (s - 27) // 26 + 1)::int) || chr((97 + (s - 27) % 26)::int) end)"
_VERDICT = "case when seconds is null then 'later' when seconds > 600 then 'key' when seconds > 200 then 'good' when seconds > 60 then 'later' else 'doubt' end"
_REPLAY = f"""recursive o as (select path as item, open_id as seq, opened_at as tt, {_VERDICT} as v, row_number() over (partition by path order by opened_at, open_id) as k from (select distinct path, open_id, opened_at, seconds from opens where path is not null)),
  r as (select item, 0::bigint as k, 0.0::double as days, false as gone from (select distinct item from o)
    union all select o.item, o.k, coalesce({_INTERVAL.format(v='o.v', p='r.days', first='(r.k = 0 or r.days = 0)')}, 0.0::double), o.v = 'done' from r join o on o.item = r.item and o.k = r.k + 1),
  e as (select item, arg_max(days, k) as days, max(k) as reviews, arg_max(gone, k) as gone from r group by 1), l as (select item, arg_max(tt, k) as last_at from o group by 1),
  p as (select item, reviews, case when not gone then days end as interval_days, case when not gone then last_at + to_microseconds((days * 86400000000)::bigint) end as due_at, last_at from e join l using (item))"""
_ESC = "replace(replace(replace(replace(replace({c}, chr(92), chr(92) || 'textbackslash{{}}'), '&', chr(92) || '&'), '%', chr(92) || '%'), '#', chr(92) || '#'), '_', chr(92) || '_')"
_NAMES = """list_filter(list_transform(case when starts_with(trim(authors, ' '), '[') and json_valid(trim(authors, ' ')) then from_json(trim(authors, ' '), '["VARCHAR"]') else string_split(trim(authors, ' '), ';') end, lambda x: trim(x, ' ')), lambda x: x <> '')"""
_PEOPLE = f"array_to_string({_NAMES}, ' and ')"

ORACLES |= {
    "link_outcomes": f"select phase, count(*) as n from ({ORACLES['link_exact_phases']}) group by 1",
    "link_apply": f"select p.id, coalesce(p.citekey, b.citekey) as citekey from papers p left join ({ORACLES['link_exact_phases']}) m on m.id = p.id left join bib b on b.entry_id = m.entry_id",
    "queue_count": "select count(*) as n from papers where needs_ocr and citekey is null",
    "collection_members": f"select collection_id, file_hash, path, batch_id from {_LIVE}",
    "collection_resolved": f"""with i as ({_IDENTITY}) select collection_id, count(*) as count, count(*) filter (where status = 'found') as found, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) filter (where status = 'missing') as missing
      from {_LIVE} m join i using (file_hash, path) group by 1""",
    "collection_undo": f"select collection_id, file_hash, path, case when last_op = 'add' then 'reversed' else 'already_removed' end as outcome from {_MEMBERS} where in_b4",
    "collection_drift": f"""with i as ({_IDENTITY}), n as (select m.collection_id, p.file_hash, p.path from {_LIVE} m join i using (file_hash, path) join papers p on p.id = i.paper_id where p.file_hash is distinct from m.file_hash or p.path is distinct from m.path)
      select distinct n.* from n where not exists (select 1 from {_LIVE} m where m.collection_id = n.collection_id and m.file_hash = n.file_hash and m.path = n.path)""",
    "ledger_state_for": f"""with i as ({_IDENTITY}), t as (select open_id as item_id, file_hash, path, case when open_id % 2 = 0 then page end as page, opened_at as due_at, coalesce(seconds, 0) / 60.0::double as interval_days, case when open_id % 7 = 0 then logged_at end as retired_at from {_OPENS}),
      j as (select t.*, paper_id from t join i using (file_hash, path) where paper_id is not null),
      b as (select *, row_number() over (partition by paper_id order by (retired_at is not null)::int, case when retired_at is not null then -epoch_us(retired_at) else (page is not null)::int end, case when retired_at is not null then -item_id else epoch_us(due_at) end, item_id) as r, count(*) filter (where page is not null and retired_at is null) over (partition by paper_id) as passages from j),
      o as (select paper_id, count(*) as opens, max(opened_at) as last_opened from {_OPENS} join i using (file_hash, path) where paper_id is not null group by 1)
      select paper_id, item_id, case when retired_at is not null then 'done' when due_at <= timestamp '2026-01-01' then 'due' else 'scheduled' end as status, due_at, round(interval_days, 6) as interval_days, 'good' as last_verdict, passages, opens, last_opened from b join o using (paper_id) where r = 1""",
    "inbox_status": f"select case when open_id % 7 = 0 and logged_at is not null then 'done' when opened_at <= timestamp '2026-01-01' then 'due' else 'scheduled' end as status, count(*) as items from {_OPENS} group by 1",
    "inbox_replay": f"with {_REPLAY} select item, reviews, interval_days, due_at, last_at from p",
    "inbox_due": f"with {_REPLAY} select item, reviews, interval_days, due_at, last_at from p where due_at <= timestamp '2026-01-01'",
    "grep_fallback": """with r as (select distinct doc_id, chunk_index, text from chunks where text is not null union all select paper_id, null, raw_text from paper_text where raw_text <> '' and paper_id not in (select doc_id from chunks))
      select doc_id, chunk_index, (instr(text, 'has rarely asked who records the') - 1)::bigint as start from r where contains(text, 'has rarely asked who records the')""",
    "grep_not_found": """with r as (select doc_id, text from chunks union all select paper_id, raw_text from paper_text where paper_id not in (select doc_id from chunks))
      select id as doc_id from papers where id not in (select doc_id from r where contains(text, 'has rarely asked who records the'))""",
    "hybrid_chunk_only": f"with {_CHUNK_ONLY} select doc_id, score from oy",
    "vector_leg": f"""with {_CHUNK_ONLY}, d as (select e.vec_id as doc_id, {_EMB} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id in (select id from papers where has_embeddings)),
      t2 as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from d order by score desc, doc_id limit 40), u as (select doc_id, score, 0 as leg from t2 union all select doc_id, score, 1 from oy),
      o as (select doc_id, score, leg from (select *, row_number() over (partition by doc_id order by score desc, leg) as r from u) where r = 1)
      select doc_id, score, row_number() over (order by score desc, leg, doc_id) as rank from o order by score desc, leg, doc_id limit 40""",
    "search_modes": f"""select 'fts' as mode, doc_id, rank, (select matches from ({ORACLES['fts_count']})) as total from ({ORACLES['fts_bm25_topk'].replace('limit 20', 'limit 40')})
      where rank <= 20 union all select 'fts_only', doc_id, rank, (select matches from ({ORACLES['fts_count']})) from ({ORACLES['fts_bm25_topk'].replace('limit 20', 'limit 40')}) where rank <= 20
      union all select 'vector_fallback', doc_id, rank, 20 from ({_VEC_TOP} select doc_id, rank from v) where rank <= 20
      union all select 'hybrid', doc_id, row_number() over (order by score desc, coalesce(rank_fts, 2147483648), coalesce(rank_vector, 2147483648), doc_id), (select matches from ({ORACLES['fts_count']})) from ({ORACLES['hybrid_rrf'].replace('and doc_id in (select vec_id from embeddings)', '')})""",
    "fts_syntax": f"with {_D} select d.doc_id from d join documents x on x.doc_id = d.doc_id where list_contains(regexp_extract_all(lower(x.lang), '([\\p{{L}}\\p{{N}}]+)', 1), 'en') and (list_contains(t, 'glacier') or list_contains(t, 'monsoon')) and not list_contains(t, 'permafrost')",
    "fts_near": f"with {_D} select doc_id from d where len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'debate' and len(list_filter(range(1, len(t) + 1), lambda j: t[j] = 'records' and abs(j - i) <= 6)) > 0)) > 0",
    "info_batch": f"""with a as (select doc_id as id from chunks union select id * 2 from papers), n as (select doc_id as id, count(distinct chunk_index) as chunks from chunks group by 1)
      select a.id, p.id is not null as found, case when p.id is null then null when {_INK.format(c='p.title')} then p.title when {_INK.format(c='p.title_from_layout')} then p.title_from_layout else p.filename end as display_title,
        case when p.id is null then null when {_INK.format(c='p.title')} then 'metadata' when {_INK.format(c='p.title_from_layout')} then 'layout' else 'filename' end as title_source, substr(t.raw_text, 1, 300) as head, coalesce(n.chunks, 0) as chunks, b.chunk_index as top_chunk, b.text as top_text
      from a left join papers p on p.id = a.id left join paper_text t on t.paper_id = a.id left join n on n.id = a.id left join {_TOP_CHUNK} b on b.doc_id = a.id""",
    "snippet_sources": f"select p.id as doc_id, case when b.doc_id is not null then 'term_chunk' when t.raw_text is not null then 'text' end as source from papers p left join {_TOP_CHUNK} b on b.doc_id = p.id left join paper_text t on t.paper_id = p.id",
    "read_full_text": "select p.id, case when t.markdown <> '' then 'markdown' when t.raw_text is not null then 'raw' end as format, length(case when t.markdown <> '' then t.markdown else t.raw_text end) as n from papers p left join paper_text t on t.paper_id = p.id",
    "read_owned_chunk": """select distinct chunk_id, case when chunk_id % 3 = 0 then doc_id + 1 else doc_id end as doc_id, coalesce(chunk_id % 3 <> 0, false) as owned, case when chunk_id % 3 <> 0 then length(text) end as n from chunks""",
    "embedding_flags": f"select doc_id, count(*) filter (where id is null) = 0 as complete from (select distinct doc_id, chunk_id from chunks) c left join (select id from {_CV}) v on v.id = c.chunk_id group by 1",
    "author_lists": f"select id, to_json({_NAMES})::varchar as names from papers",
    "meta_repairs": "select id, 'authors' as repair from papers where authors is not null and not coalesce(starts_with(trim(authors, ' '), '[') and json_valid(trim(authors, ' ')), false)",
    "file_name_parts": r"""select id, nullif(lower(regexp_extract(filename, '^([A-Za-z]+)((?:-[A-Za-z]+)*)[-_](\d{4})[-_]', 1)), '') as surname, nullif(regexp_extract(filename, '^([A-Za-z]+)((?:-[A-Za-z]+)*)[-_](\d{4})[-_]', 3), '')::int as year from papers""",
    "cased_dois": r"""select id, regexp_replace(trim(doi, ' '), '^(https?://(dx\.)?doi\.org/|doi:\s*)(10\.)', '\3', 'i') as doi from papers where doi is not null""",
    "section_headers": r"""with h as (select paper_id as doc_id, regexp_extract_all(markdown, '(?m)^#{2,3}[ \t]+(.*)$', 1) as h from paper_text where markdown is not null), n as (select doc_id, h, unnest(range(1, len(h) + 1)) as i from h)
      select doc_id, (i - 1)::bigint as n, trim(h[i], ' ') as header from n""",
    "vault_refs": r"""with r as (select entry_id::varchar as note, list_concat(list_concat(regexp_extract_all(abstract, '\[\[([^\]|#]+\.pdf)', 1), regexp_extract_all(abstract, '\]\(([^)\s]+\.pdf)\)', 1)), regexp_extract_all(abstract, '(?m)^source:\s*(\S+\.pdf)\s*$', 1)) as l from bib where abstract is not null)
      select distinct note, string_split(x, '/')[-1] as ref from (select note, unnest(l) as x from r)""",
    "schema_tables": """select table_name, column_name, case data_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' else lower(data_type) end as type
      from duckdb_columns() where table_name in ('papers', 'paper_text', 'bib', 'chunks', 'chunk_vec', 'opens')""",
    "bib_export": f"""select id, '@' || case when {_INK.format(c='doi')} then 'article' else 'misc' end || '{{' || citekey || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_ESC.format(c='title')} || '}}', '  author = {{' || {_ESC.format(c=_PEOPLE)} || '}}',
      '  year = {{' || year || '}}', '  doi = {{' || doi || '}}', '  file = {{pdf/' || filename || '}}') || chr(10) || '}}' || chr(10) as entry from papers where {_INK.format(c='citekey')}""",
    "assign_citekeys": f"""with w as (select id, case when k = '' then 'unknown' else k end as base from (select id, {_KEYBASE} as k from papers where not {_INK.format(c='citekey')})), u as (select distinct lower(citekey) as k from papers where {_INK.format(c='citekey')}),
      b as (select lower(base) as low, count(*) as n from w group by 1), c as (select low, n + (select count(*) from u where starts_with(u.k, b.low)) + 1 as top from b), g as (select low, unnest(range(0, top)) as s from c),
      f as (select low, s, row_number() over (partition by low order by s) as place from g where low || {_SUFFIX} not in (select k from u)), a as (select id, base, lower(base) as low, row_number() over (partition by lower(base) order by id) as place from w)
      select id, base || {_SUFFIX} as citekey from a join f using (low, place)""",
    "process_outcomes": "select p.id, coalesce(has_text, false) or coalesce(t.raw_text is not null, false) as has_text, case when t.raw_text is not null then false else has_chunk_embeddings end as has_chunk_embeddings, case when t.paper_id is not null and t.raw_text is null then coalesce(error_count, 0) + 1 else error_count end as error_count from papers p left join paper_text t on t.paper_id = p.id",
}
