"""SQL that gives the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

P1 = """
with s as (select doc_id, section_no, max(start_pos) as a, max(end_pos) as b from sections group by doc_id, section_no)
select s.doc_id, s.section_no from s join documents d on d.doc_id = s.doc_id
where least(coalesce(b, length(d.text)), length(d.text)) - greatest(coalesce(a, 0), 0) > 2000
"""

P1_CHECKS = """
with s as (select doc_id, section_no, max(start_pos) as a, max(end_pos) as b from sections group by doc_id, section_no),
t as (select s.doc_id, section_no, least(coalesce(b, length(d.text)), length(d.text)) - greatest(coalesce(a, 0), 0) as chars from s join documents d on d.doc_id = s.doc_id)
select doc_id, section_no, true as sized, true as ordered, true as shared, true as whole, chars from t where chars > 2000
"""

_PLAIN = "lower(text)"
for _ in range(2):
    for _entity, _char in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"
_WORDS = f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '</?[a-z][^>]*>|\\{{\\\\[^}}]*\\}}', ' ', 'g'), '[''`\\x{{2019}}\\x{{00AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), '')"
# runs over a CTE w of (video_id, pos, s, d, w)
_RUNS = """l as (select *, lag(w) over (partition by video_id order by pos) as p from w),
s as (select *, coalesce(w = p or (len(string_split(w, ' ')) = len(string_split(p, ' ')) and len(list_filter(list_zip(string_split(w, ' '), string_split(p, ' ')), lambda z: not (z[1] = z[2] or (
    not regexp_matches(z[1] || z[2], '[^\\p{L}]') and ((abs(length(z[1]) - length(z[2])) = 1 and levenshtein(z[1], z[2]) = 1)
    or (length(z[1]) = length(z[2]) and levenshtein(z[1], z[2]) = 2 and damerau_levenshtein(z[1], z[2]) = 1)))))) = 0), false) as same from l),
r as (select *, s + greatest(coalesce(d, 0), 0) as e, sum(case when same then 0 else 1 end) over (partition by video_id order by pos) as run from s)"""
_CUES = f"""c as (select video_id, seg_idx, any_value(text) as text, any_value(start) as start, any_value(duration) as duration from captions where video_id is not null and seg_idx is not null group by video_id, seg_idx),
w as (select video_id, seg_idx as pos, start as s, case when isnan(duration) then null else duration end as d, {_WORDS} as w from c)"""
_WINDOWS = f"""c as (select video_id, win_idx, any_value(segments) as g from windows where video_id is not null and win_idx is not null group by video_id, win_idx),
w as (select video_id, pos, g.start as s, case when isnan(g.duration) then null else g.duration end as d, {_WORDS.replace("text", "g.text")} as w from (select video_id, win_idx * 4294967296 + generate_subscripts(g, 1) - 1 as pos, unnest(g) as g from c))"""
P3 = f"""with {_CUES}, {_RUNS}
select video_id, min(pos) as first_idx, max(pos) as last_idx from r where w is not null group by video_id, run having count(*) > 1
"""
P3_RUNS = f"""with {_CUES}, {_RUNS}
select video_id, min(pos) as first_idx, max(pos) as last_idx, count(*) as cues, min(s) as start, max(e) - min(s) as duration, arg_min(w, pos) as words from r where w is not null group by video_id, run
"""
P3_WINDOWS = f"""with {_WINDOWS}, {_RUNS}
select video_id, min(pos) // 4294967296 as first_win, max(pos) // 4294967296 as last_win, min(pos) % 4294967296 as first_pos, max(pos) % 4294967296 as last_pos, count(*) as cues, min(s) as start, max(e) - min(s) as duration, arg_min(w, pos) as words
from r where w is not null group by video_id, run having count(*) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_checks": P1_CHECKS, "p3_found": P3, "p3_runs": P3_RUNS, "p3_window_runs": P3_WINDOWS}
