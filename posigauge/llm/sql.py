"""SQL checks of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LINE_WORDS = r"regexp_extract_all(line, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
with w as (select doc_id, {WORDS} as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w),
grams as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as gram from p where i + 12 <= len(words)),
first as (select gram, min(doc_id) as first from grams group by gram),
hit as (select distinct doc_id, i from grams join first using (gram) where first < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from hit),
kept as (
    select p.doc_id, string_agg(p.words[p.i], ' ' order by p.i) as text, count(*) as n
    from p anti join gone on gone.doc_id = p.doc_id and gone.i = p.i group by p.doc_id
)
select w.doc_id, cast(len(w.words) as bigint) as n_words,
    cast(len(w.words) - coalesce(kept.n, 0) as bigint) as n_removed,
    sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

LINE_QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host, {WORDS} as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3),
runs as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from p),
spots as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from runs where n > 1),
repeats as (select doc_id, count(*) as n_repeat_words from spots group by doc_id),
lines as (select doc_id, host, t, unnest(string_split(t, chr(10))) as line from d),
full_lines as (
    select doc_id, host, t, line,
        lower(array_to_string({LINE_WORDS}, ' ')) as plain,
        len({LINE_WORDS}) as n
    from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups as (select doc_id, count(*) - count(distinct line) as n_dup_lines from full_lines group by doc_id),
hosts as (select host, count(distinct t) as all_docs from d group by host),
frequent as (
    select host, plain from full_lines join hosts using (host) group by host, plain, all_docs
    having count(distinct t) > 30 or (count(distinct t) > 10 and count(distinct t) > 0.1 * all_docs)
),
removed as (select doc_id, sum(n) as n_removed from full_lines join frequent using (host, plain) group by doc_id),
m as (
    select doc_id, cast(len(words) as bigint) as n_words,
        cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
        cast(coalesce(n_removed, 0) as bigint) as n_removed
    from d left join repeats using (doc_id) left join dups using (doc_id) left join removed using (doc_id)
),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and 100 * n_removed <= 25 * n_words as kept from b
"""

TOP_K = """
with v as (
    select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
),
pairs as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
),
ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
