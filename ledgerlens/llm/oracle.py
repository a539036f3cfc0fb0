"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, t, r, '<|im_end|><|im_start|>assistant ok'
  from (values (0, 'user'), (1, 'assistant')) v(t, r)
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
         as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text)
                       filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + length('<|im_end|>') + 1)::bigint as formatted_chars
from rows
group by conv_id
"""

LINES = r"""
with docs as (
  select row_number() over () as rid, doc_id, text, source,
         string_split(text, chr(10)) as lines
  from documents
),
numbered as (
  select rid, source, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs
),
plain as (
  select *, regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') as bare from numbered
),
needed as (
  select greatest({least_sites}, ceil(round({sites_share} * count(distinct source), 6))) as sites
  from documents
),
spread as (
  select bare from plain
  where length(bare) >= {min_chars} and source is not null
  group by bare having count(distinct source) >= (select sites from needed)
),
kept as (
  select rid, count(*) as n, string_agg(line, chr(10) order by pos) as text
  from plain where bare not in (select bare from spread) group by rid
),
texts as (select text, count(distinct source) as sites from documents group by text),
judged as (
  select d.doc_id, d.text,
         len(d.lines) - coalesce(k.n, 0) as gone, coalesce(k.text, '') as cleaned,
         len(d.lines) - coalesce(k.n, 0) > 0
           and regexp_matches(coalesce(k.text, ''), '[^ \t\n\v\f\r]')
           and t.sites < (select sites from needed) as applies
  from docs d left join kept k using (rid) left join texts t on d.text = t.text
)
select doc_id,
       case when applies then gone else 0 end::bigint as n_removed,
       length(case when applies then cleaned else text end)::bigint as n_chars_kept,
       md5(case when applies then cleaned else text end) as text_md5
from judged
"""


#: A term of ranked search.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = r"""
with docs as (
  select row_number() over () as did, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{term}')) as term
  from documents
),
items as (
  select row_number() over () as iid, item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{term}')) as term
  from benchmark
),
sizes as (select did, count(*)::bigint as n from docs group by did),
corpus as (select count(*)::bigint as held, sum(n)::bigint as total from sizes),
counts as (select did, doc_id, term, count(*)::bigint as tf from docs group by all),
weights as (
  select term, floor(1000 * ln((2 * held + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts, corpus group by term, held
),
wanted as (select iid, item_id, term, count(*)::bigint as times from items group by all),
scored as (
  select iid, item_id, did, doc_id,
         sum(times * w * ((1000000000 * tf)
             // (1000 * tf + 12 * (75 + (25 * n * held) // total))))::bigint as score
  from wanted join counts using (term) join weights using (term) join sizes using (did), corpus
  group by all
),
ranked as (
  select *, row_number() over (partition by iid order by score desc, doc_id, did) as rank
  from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {best}
"""


def oracle_sql() -> dict[str, str]:
    from ledgerlens.llm import queries as q

    limits = {
        "min_chars": q.MIN_LINE_CHARS,
        "sites_share": q.SITES_SHARE,
        "least_sites": q.LEAST_SITES,
    }
    return {
        "op6_chat": CHAT,
        "op10_lines": LINES.format(**limits),
        "op11_search": SEARCH.format(term=TERM, best=q.BEST_DOCUMENTS),
    }
