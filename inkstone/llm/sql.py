"""DuckDB SQL of the queries that SQL can express."""

import re

from inkstone.llm.chat import CONTROL
from inkstone.llm.licenses import TEMPLATES

_WORDS = r"string_split(trim(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"

OP1 = f"""
with d as (select doc_id, list_filter({_WORDS.format("text")}, lambda x: x <> '') w from documents),
b as (select item_id, list_filter({_WORDS.format("text")}, lambda x: x <> '') w from benchmark),
iw as (select distinct item_id, least(len(w), 8) k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') win
       from b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct k from iw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') win from d, sizes, unnest(range(1, len(w) - k + 2)) t(i)),
hits as (select doc_id, i, dw.k, item_id from dw join iw on dw.win = iw.win and dw.k = iw.k),
places as (select doc_id, count(distinct p) n_hit from hits, unnest(range(i, i + k)) t(p) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids
          from (select distinct doc_id, cast(item_id as varchar) s from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""

OP5 = r"""
with d as (select doc_id, text, string_split(text, chr(10)) l from documents),
w as (select doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] win from d, unnest(range(1, greatest(len(l) - 1, 1))) t(i)
      where len(l) >= 3 and regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^ \t\n\x0B\f\r]')),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) r from w) where r > 1),
gone as (select doc_id, list(distinct p) g from later, unnest(range(i, i + 3)) t(p) group by doc_id)
select doc_id, cast(coalesce(len(l), 0) as bigint) n_lines, cast(coalesce(len(g), 0) as bigint) n_removed,
       case when g is null then text else array_to_string([x for x, i in l if not list_contains(g, i)], chr(10)) end as text
from d left join gone using (doc_id)
"""


def _list(words: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


def _templates() -> str:
    """The templates as rows: number, label, words, least overlap, width of a block, naming phrases."""
    rows = []
    for k, t in enumerate(TEMPLATES):
        size = len(set(t.words))
        need, width = -(-size * 4 // 5), -(-len(t.words) * 5 // 4)  # threshold 0.8
        rows.append(f"({k}, '{t.label}', {_list(t.words)}, {need}, {width}, [{', '.join(map(_list, t.phrases))}])")
    return "values " + ",\n       ".join(rows)


OP4 = f"""
with t(k, name, said, need, width, naming) as ({_templates()}),
tw as (select k, unnest(list_distinct(said)) word from t),
tp as (select k, j, naming[j] phrase from t, unnest(range(1, len(naming) + 1)) x(j)),
d as (select doc_id, list_filter({_WORDS.format("text")}, lambda x: x <> '') w from documents),
p(label, phrase) as (values ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
base as (select doc_id, label, i - 1 place from d, p, unnest(range(1, len(w) - len(phrase) + 2)) x(i) where w[i] = phrase[1] and w[i : i + len(phrase) - 1] = phrase),
dw as (select doc_id, len(w) n, unnest(w) word, generate_subscripts(w, 1) - 1 pos from d),
occ as (select doc_id, n, k, word, pos from dw join tw using (word)),
may as (select doc_id, k from occ join t using (k) group by doc_id, k having count(distinct word) >= any_value(need)),
near as (select occ.*, need, width, name, len(naming) phrases from occ join may using (doc_id, k) join t using (k)),
starts as (select distinct doc_id, k, least(pos, greatest(n - width, 0)) s from near),
named as (select doc_id, k, j, i - 1 pos, len(phrase) size from may join d using (doc_id) join tp using (k), unnest(range(1, len(w) - len(phrase) + 2)) x(i)
          where w[i] = phrase[1] and w[i : i + len(phrase) - 1] = phrase),
full_ as (select doc_id, k, s, any_value(name) as name, any_value(width) width, any_value(phrases) phrases, count(distinct word) shared
          from starts join near using (doc_id, k) where pos between s and s + width - 1 group by doc_id, k, s having count(distinct word) >= any_value(need)),
hits as (select f.doc_id, f.k, f.s, any_value(f.name) as name, any_value(shared) shared
         from full_ f left join named m on f.doc_id = m.doc_id and f.k = m.k and m.pos >= f.s and m.pos + m.size <= f.s + f.width
         group by f.doc_id, f.k, f.s having count(distinct j) = any_value(phrases)),
sizes as (select k, count(*) size from tw group by k),
b as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word from base group by doc_id),
labelled as (select distinct doc_id, label, true is_base from base union all select distinct doc_id, name, false from hits),
l as (select doc_id, string_agg(distinct label, ',' order by label) labels, string_agg(distinct label, ',' order by label) filter (where is_base) base_labels from labelled group by doc_id),
s as (select doc_id, max(shared / size) score from hits join sizes using (k) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0) score
from d left join b using (doc_id) left join l using (doc_id) left join s using (doc_id)
"""

_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL)

OP10 = rf"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(text, '({_CONTROL})', '\1+', 'g')) n from c)
select cast(conv_id as bigint) conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
       cast(sum(length('<|im_start|>') + length(role) + 1 + n + length('<|im_end|>') + 1) as bigint) formatted_chars
from e group by conv_id
"""

ORACLE = {"op4_license_scan": OP4, "op10_chat_format": OP10, "op1_decontamination": OP1, "op5_line_dedup": OP5}
