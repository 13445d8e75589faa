"""DuckDB SQL for the queries that SQL can express."""

from gristmill.llm.fill_in_middle import MARKS, RATE, SEED, SPM
from gristmill.llm.quality_rules import LOW, MIN_GROUP, SLACK, SPREAD
from gristmill.llm.spelling import DROP_EVERY, MIN_CHARS, MIN_COUNT, RATIO

_SPACE = r"[\x20\x09-\x0D]+"

_BASE = f"""
d as (select doc_id, lang, source, coalesce(text, '') as text,
        list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l,
        row_number() over () as r
      from documents),
p as (select r, w, unnest(range(len(w) - 2)) as i from d where len(w) >= 3),
g as (select r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as g from p),
cc as (select r, i, count(*) over (partition by r, g) as n from g),
h as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from cc where n > 1) group by r),
m as (select d.r, doc_id, lang, source, len(w) as n_words, length(list_aggregate(list_prepend('', w), 'string_agg', '')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper, length(text) - length(replace(text, '!', '')) as n_exclaim,
        len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from d left join h on d.r = h.r),
q as (select *, 1000 * n_symbols // greatest(word_chars, 1) as m_symbols, 1000 * n_upper // greatest(word_chars, 1) as m_upper,
        1000 * n_exclaim // greatest(word_chars, 1) as m_exclaim, 10 * word_chars // greatest(n_words, 1) as m_length,
        1000 * n_dup_lines // greatest(n_lines, 1) as m_dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) as m_repeats from m),
"""


def rules_sql() -> str:
    """quality_rules.query: the sketches' bins are whole numbers, so that SQL finds the same fences."""
    slack, low = (" ".join(f"when '{k}' then {v}" for k, v in of.items()) for of in (SLACK, LOW))
    q = lambda p: f"min(v) filter (where upto * 100 >= total * {p})"

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
{name}_h as (select {by}measure, b, count(*) as n from x group by {by}measure, b),
{name}_c as (select *, sum(n) over (partition by {by}measure order by b) as upto, sum(n) over (partition by {by}measure) as total,
        case when b < 64 then b else (b - (b // 32 - 1) * 32) << (b // 32 - 1)::int end as v from {name}_h),
{name} as (select {by}measure, max(total) as total, {{'high': {q(75)} + greatest(case measure {slack} end, {SPREAD} * ({q(75)} - {q(25)})),
          'low': case when measure in ({", ".join(f"'{k}'" for k in LOW)}) then {q(25)} - greatest(case measure {low} end, {SPREAD} * ({q(75)} - {q(25)})) end}} as fence
      from {name}_c group by {by}measure),"""

    return f"""with {_BASE}
v as (select lang, source, measure, v from (select lang, source, {", ".join(SLACK)} from q where n_words >= 50)
      unpivot (v for measure in ({", ".join(SLACK)}))),
x as (select lang, source, measure, case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::int) end as b from v),
{level("a", "lang, source")}{level("b", "lang")}{level("c", "")}
f as (select a.lang, a.source, a.measure, coalesce(case when a.total >= {MIN_GROUP} then a.fence end, case when b.total >= {MIN_GROUP} then b.fence end, c.fence) as fence
      from a join b on a.lang is not distinct from b.lang and a.measure = b.measure join c on a.measure = c.measure),
t as (select lang, source, {", ".join(f"max(fence.high) filter (where measure = '{k}') as f_{k}" for k in SLACK)}, {", ".join(f"max(fence.low) filter (where measure = '{k}') as low_{k}" for k in LOW)} from f group by lang, source),
z as (select q.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        list_filter([{", ".join([f"case when {k} > f_{k} then '{k}' end" for k in SLACK] + [f"case when {k} < low_{k} then '{k}_low' end" for k in LOW])}], lambda x: x is not null) as beyond
      from q left join t on q.lang is not distinct from t.lang and q.source is not distinct from t.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(beyond) = 0 as kept, beyond from z"""


def join_sql(k: int = 3, percent: int = 90) -> str:
    """ngram_join.join, by joining all classes on each shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_SPACE}'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {gram})) end as s from w),
n as (select doc_id, s, len(s) as n, case when len(s) > 0 then md5(array_to_string(list_sort(s), chr(10))) end as sig from s),
c as (select doc_id, s, n, case when sig is null then doc_id else min(doc_id) over (partition by sig) end as class_id from n),
g as (select doc_id, n, unnest(s) as g from c where doc_id = class_id),
p as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
t as (select a, b from l union select t.a, l.b from t join l on t.b = l.a),
m as (select a, least(a, min(b)) as component from t group by a),
d as (select a, count(*) as links from l group by a)
select doc_id, n as n_shingles, coalesce(component, class_id) as component_id, coalesce(links, 0) as links, class_id from c left join m on class_id = m.a left join d on class_id = d.a"""


def fim_sql(seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> str:
    """fill_in_middle.query, from lists of lines."""
    p, s, m = marks
    h = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))
    part = lambda of: f"array_to_string({of}, '')"
    return f"""with d as (select doc_id, coalesce(text, '') as t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, {h}, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as u from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
        case when t = '' or {" or ".join(f"contains(t, '{x}')" for x in marks)} or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form from u),
x as (select doc_id, t, n, form, {part("u[:a]")} as p, {part("u[a + 1:b]")} as m, {part("u[b + 1:]")} as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || p || '{s}' || s || '{m}' || m else '{s}' || s || '{p}' || p || '{m}' || m end) as output_sha256, sha256(t) as restored_sha256 from x"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, byte by byte with the table ``t`` of 256 values, a column."""
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def spelling_sql(drop_every: int = DROP_EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> str:
    """spelling.query, with words meeting by what is left of them without one code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""with recursive crc_bits as (select i as i, i::bigint as c, 0 as k from range(256) x(i) union all select i, {step}, k + 1 from crc_bits where k < 8),
crc_table as materialized (select list(c order by i) as t from crc_bits where k = 8),
r as (select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) as w from documents),
g as (select doc_id, w, count(*) as n from r group by doc_id, w),
h as (select w, n, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || w")} as h from g, crc_table),
d as (select case when h % {drop_every} = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as w, n from h),
v as materialized (select w, sum(n)::bigint as n from d where length(w) >= {min_chars} group by w having sum(n) >= {min_count}),
x as materialized (select w, i, left(w, i) || substr(w, i + 2) as s from (select w, unnest(range(length(w))) as i from v)),
p as (select a.w as a, b.w as b from x a join x b on a.s = b.s and a.i = b.i and a.w <> b.w union select w, s from x where s in (select w from v) union select s, w from x where s in (select w from v)),
b as (select a, count(*) as n_near, first(b order by n desc, b) as f, max(n) as form_n from p join v on b = v.w group by a),
f as materialized (select v.w, v.n, coalesce(n_near, 0) as n_near, case when form_n >= {ratio} * v.n then f end as form, case when form_n >= {ratio} * v.n then form_n end as form_n from v left join b on v.w = a),
t as (select w, form as r from f where form is not null union all select t.w, f.form from t join f on t.r = f.w where f.form is not null),
z as (select t.w, t.r from t join f on t.r = f.w where f.form is null)
select f.w as word, form, coalesce(z.r, f.w) as root, n, n_near, form_n from f left join z on f.w = z.w"""


def warc_sql(least_bytes: int = 0) -> str:
    """warc.query; base32 takes five bits of the digest at a time, four from each five hex digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = f"substr('{alphabet}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)"
    return f"""with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
f as (select t, min(page_id) as first from p where octet_length(encode(t)) >= {least_bytes} group by t),
x as (select p.*, case when first <> page_id or page_id is null then first end as refers_to from p left join f on p.t = f.t)
select page_id, octet_length(encode(t))::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from x"""


ORACLES = {"op11_fill_in_middle": fim_sql(), "op12_spelling_variants": spelling_sql(), "op13_warc": warc_sql(), "op3_quality_rules": rules_sql(), "op9_ngram_join": join_sql()}
