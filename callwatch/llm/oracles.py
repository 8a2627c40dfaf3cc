"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from callwatch.llm import quality_rules as Q
from callwatch.llm import sharding as S

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _quality() -> str:
    words = sorted({w for x in Q.COMMON_WORDS.values() for w in x})
    classes = list(Q.CHARACTER_CLASSES.values())
    left = [f"length(t) - length(regexp_replace(t, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in classes]
    distance = "sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end / 2 + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end / 2)))"
    return f"""with d as (select doc_id, lang, coalesce(text, '') t, {_WORDS} w from documents),
 words as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d),
 win as (select doc_id, i, concat_ws(' ', x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o) g, lead(x, 4) over o z from words window o as (partition by doc_id order by i)),
 dup as (select doc_id, i from win where z is not null qualify count(*) over (partition by doc_id, g) > 1),
 rep as (select doc_id, count(distinct i + k) n_repeat_words from dup, generate_series(0, 4) s(k) group by 1),
 lines as (select doc_id, count(*) - count(distinct x) n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by 1),
 base as (select d.doc_id, lang, t, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
  coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words from d left join rep on d.doc_id = rep.doc_id left join lines on d.doc_id = lines.doc_id),
 facts as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base),
 chars as (select doc_id, unnest(range({len(classes) + 1})) k, unnest([{", ".join(left)}, length(t) - ({" + ".join(left)})]) n from facts),
 vocab as (select doc_id, case when lower(x) in {_listed(words)} then lower(x) else '' end k, count(*) n from words group by 1, 2),
 bins as (select unnest([''{"".join(", '" + w + "'" for w in words)}]) k),
 cref as (select lang l, k, sum(n) / sum(sum(n)) over (partition by lang) q from chars join facts using (doc_id) where not base_failed and lang in {_listed(sorted(Q.COMMON_WORDS))} group by 1, 2),
 wref as (select lang l, k, sum(n) / sum(sum(n)) over (partition by lang) q from vocab join facts using (doc_id) where not base_failed and lang in {_listed(sorted(Q.COMMON_WORDS))} group by 1, 2),
 cd as (select f.doc_id, {distance} character_distance from (select f.doc_id, n / length(t) p, q from facts f join chars c on c.doc_id = f.doc_id join cref r on r.l = f.lang and r.k = c.k where length(t) >= {Q.MIN_CHARACTERS}) f group by 1),
 wd as (select f.doc_id, {distance} word_distance from (select f.doc_id, coalesce(n, 0) / n_words p, coalesce(q, 0) q from facts f cross join bins b left join vocab v on v.doc_id = f.doc_id and v.k = b.k left join wref r on r.l = f.lang and r.k = b.k where n_words >= {Q.MIN_HISTOGRAM_WORDS} and f.lang in (select l from wref)) f group by 1)
 select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(character_distance, 0) <= {Q.MAX_CHARACTER_DISTANCE} and coalesce(word_distance, 0) <= {Q.MAX_WORD_DISTANCE} as kept, round(character_distance, 6) as character_distance, round(word_distance, 6) as word_distance
 from facts f left join cd on cd.doc_id = f.doc_id left join wd on wd.doc_id = f.doc_id"""


_REPEATS = f"""with d as (select doc_id, {_WORDS} w from documents),
 win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) i from d where len(w) >= 35)),
 again as (select doc_id, i from win qualify count(*) over (partition by g) > 1),
 gone as (select distinct doc_id, i + k i from again, generate_series(0, 34) s(k)),
 words as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d),
 kept as (select w.doc_id, string_agg(x, ' ' order by w.i) t, count(*) n from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i where g.i is null group by 1)
 select d.doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id"""

_NEAR = f"""with recursive d as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
 sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end s from d),
 one as (select doc_id, len(s) n, unnest(s) g from sets),
 met as (select a.doc_id x, b.doc_id y, any_value(a.n) n, any_value(b.n) m, count(*) k from one a join one b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
 links as (select x, y from met where 100 * k >= 80 * (n + m - k)),
 arcs as (select x, y from links union all select y, x from links),
 reach(x, y) as (select x, y from arcs union select r.x, a.y from reach r join arcs a on a.x = r.y)
 select s.doc_id, any_value(len(s))::bigint as n_shingles, least(s.doc_id, coalesce(min(y), s.doc_id)) as component_id, s.doc_id = least(s.doc_id, coalesce(min(y), s.doc_id)) as kept from sets s left join reach r on r.x = s.doc_id group by s.doc_id"""

_NUMBER = "('0x' || substr(md5({0}), 1, 8))::bigint"
_SHARDS = f"""with recursive prefs as (select list({_NUMBER.format("concat('offset:shard-', i)")} % {S.SLOTS} order by i) o, list({_NUMBER.format("concat('skip:shard-', i)")} % ({S.SLOTS} - 1) + 1 order by i) k from range({S.SHARDS}) t(i)),
 fill(turn, slot, free) as (
  select -1::bigint, -1::bigint, list_transform(range({S.SLOTS}), lambda x: true) from prefs
  union all
  select turn + 1, p, list_concat(free[1:p], [false], free[p + 2:]) from (
   select turn, free, (o[(turn + 1) % {S.SHARDS} + 1] + k[(turn + 1) % {S.SHARDS} + 1] * (list_position(list_transform(range({S.SLOTS}), lambda j: free[(o[(turn + 1) % {S.SHARDS} + 1] + k[(turn + 1) % {S.SHARDS} + 1] * j) % {S.SLOTS} + 1]), true) - 1)) % {S.SLOTS} p
   from fill, prefs where turn < {S.SLOTS} - 1)),
 owner as (select slot, (turn % {S.SHARDS})::int shard from fill where turn >= 0)
 select doc_id, o.slot, shard from documents d join owner o on o.slot = {_NUMBER.format("doc_id::varchar")} % {S.SLOTS}"""

ORACLES = {"op1_quality_rules": _quality(), "op2_substring_dedup": _REPEATS, "op6_near_dedup": _NEAR, "op8_sharding": _SHARDS}
