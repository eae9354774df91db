"""DuckDB SQL for each registered job (same column names, same fixed definitions).

Tables are the pre-registered fixture views.  Doubles the jobs round are
rounded here the same way.
"""

from __future__ import annotations

H = "md5('42:' || doc_id)"  # hash order, seed 42

LANG_CASE = "case lang when 'de' then 'German' when 'en' then 'English' when 'es' then 'Spanish' when 'fr' then 'French' end"

LABEL_CASE = (
    "case label when 0 then 'Company' when 1 then 'School' when 2 then 'Artist' when 3 then 'Athlete' "
    "when 4 then 'Polite' when 5 then 'Transportation' when 6 then 'Building' when 7 then 'Nature' "
    "when 8 then 'Village' when 9 then 'Animal' when 10 then 'Plant' when 11 then 'Album' "
    "when 12 then 'Film' when 13 then 'Book' end"
)

QUOTAS = """(select lang as label, n,
        cast(round_even(n * (cast({total} as double) / sum(n) over ()), 0) as bigint) as quota
   from (select lang, count(*) as n from documents group by lang))"""

LABELLED = "(select doc_id, lang || '/' || source as label from documents)"

SQL: dict[str, str] = {}

SQL["scan_corpus"] = "select doc_id, text, lang from documents where source = 'src3'"

SQL["scan_split"] = "select doc_id, text from documents where source = 'src3' and lang = 'en'"

SQL["csv_roundtrip"] = """
select case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'validation' else 'train' end as split,
       doc_id, text, lang as label from documents"""

SQL["run_metrics"] = """
select event_type || '-2.0-dp' as run, 'rows' as metric, cast(count(*) as double) as value from events group by event_type
union all
select event_type || '-2.0-dp' as run, 'value_sum' as metric, round(sum(value), 2) as value from events group by event_type"""

SQL["project_text_label"] = "select doc_id, text, lang as label from documents"

SQL["union_strata"] = f"select doc_id, text, {LANG_CASE} as label from documents where lang in ('de','en','es','fr')"

SQL["recode_label"] = f"select vec_id, {LABEL_CASE} as label from embeddings"

SQL["clean_rows"] = """
select doc_id, text, coalesce(cast(label as varchar), 'None') as label from (
  select doc_id, case when doc_id % 7 = 0 then null else text end as text,
         case when doc_id % 5 = 0 then null else lang end as label from documents) where text is not null"""

SQL["value_counts"] = """
select source, count(*) as n from (
  select case when doc_id % 7 = 0 then null else source end as source from documents)
where source is not null group by source"""

SQL["frequent_labels"] = f"select label, count(*) as n from {LABELLED} group by label having count(*) > 25"

SQL["filter_frequent"] = f"""
select doc_id, label from {LABELLED} where label in (select label from {LABELLED} group by label having count(*) > 25)"""

SQL["table_stats"] = f"""
select 'before' as stage, count(*) as n_rows, count(distinct label) as n_labels from {LABELLED}
union all
select 'after' as stage, count(*) as n_rows, count(distinct label) as n_labels from {LABELLED}
 where label in (select label from {LABELLED} group by label having count(*) > 25)"""

SQL["prompt_counts"] = "select lang || chr(9) || source || chr(10) || chr(10) as prompt, count(*) as n from documents group by 1"

SQL["allocate_quota"] = "select label, n, quota from " + QUOTAS.format(total=600) + " where quota > 0"

SQL["stratified_sample"] = f"""
with q as {QUOTAS.format(total=600)}
select doc_id, label from (
  select doc_id, lang as label, row_number() over (partition by lang order by {H}, doc_id) as r from documents) d
join q using (label) where r <= quota and quota > 0"""

SQL["stratum_prefix"] = f"""
with q as {QUOTAS.format(total=150)}
select doc_id, label, rn from (
  select doc_id, lang as label, row_number() over (partition by lang order by doc_id) as rn from documents) d
join q using (label) where rn <= quota and quota > 0"""

SQL["prefix_rows"] = "select doc_id from documents order by doc_id limit 300"

SQL["sample_exact"] = f"""
select doc_id from (select doc_id, row_number() over (order by {H}, doc_id) as r, count(*) over () as n from documents)
where r <= round_even(n * (200.0::double / 560.0::double), 0)"""

SQL["split_two_way"] = f"""
select doc_id, case when r <= ceil(n * (5.0::double / 200.0::double)) then 'test' else 'train' end as split
from (select doc_id, row_number() over (order by {H}, doc_id) as r, count(*) over () as n from documents)"""

SQL["split_three_way"] = f"""
with a as (select doc_id, row_number() over (order by {H}, doc_id) as r, count(*) over () as n from documents),
t as (select doc_id, r <= ceil(n * 0.02::double) as is_test from a),
b as (select doc_id, row_number() over (order by md5('43:' || doc_id), doc_id) as r, count(*) over () as n
      from t where not is_test)
select doc_id, 'test' as split from t where is_test
union all
select doc_id, case when r <= ceil(n * 0.02::double) then 'validation' else 'train' end as split from b"""

SQL["shuffle_rows"] = f"select doc_id, row_number() over (order by {H}, doc_id) as shuffle_key from documents"

TOKS = r"regexp_extract_all(text, '\S+')"

VOCAB = rf"""(with c as (select tok as token, count(*) as n
                  from (select unnest({TOKS}) as tok from documents) group by tok)
   select cast(row_number() over (order by n desc, token) - 1 as bigint) as token_id, token, n from c
   union all select (select count(*) from c) as token_id, '[PAD]' as token, 0 as n)"""

TOKROWS = f"""(select doc_id, unnest(range(len(toks))) as pos, unnest(toks) as token
   from (select doc_id, {TOKS} as toks from documents))"""

SQL["control_prompt"] = "select doc_id, lang || chr(9) || source || chr(10) || chr(10) as prompt from documents"

SQL["training_text"] = """
select doc_id, case when doc_id % 2 = 0 then lang || chr(9) || source || chr(10) || chr(10) || text || '<eos>'
                    else text end as train_text from documents"""

SQL["tokenize_pad"] = f"""
select doc_id, p as pos, coalesce(toks[p + 1], '[PAD]') as token,
       case when p < len(toks) then 1 else 0 end as mask,
       case when p < len(toks) then toks[p + 1] end as target
from (select doc_id, {TOKS} as toks from documents) cross join range(128) as r(p)"""

SQL["build_vocab"] = f"select token_id, token, n from {VOCAB}"

SQL["encode_tokens"] = f"""
select t.doc_id, t.pos, coalesce(v.token_id, -1) as token_id from {TOKROWS} t left join {VOCAB} v using (token)"""

SQL["decode_text"] = f"""
select t.doc_id, string_agg(t.token, ' ' order by t.pos) as text
from {TOKROWS} t join (select * from {VOCAB} where n > 0) v using (token) group by t.doc_id"""

SQL["pack_blocks"] = f"""
with d as (select doc_id, {TOKS} as toks, row_number() over (order by doc_id) as rn from documents),
t as (select doc_id, (rn - 1) // 1000 as batch, unnest(range(len(toks))) as p, unnest(toks) as token from d),
o as (select batch, token, row_number() over (partition by batch order by doc_id, p) - 1 as off from t),
b as (select batch, count(*) // 128 as nb from o group by batch),
bb as (select batch, nb, coalesce(sum(nb) over (order by batch rows between unbounded preceding and 1 preceding), 0) as before from b)
select cast(before + off // 128 as bigint) as block_id, cast(off % 128 as bigint) as pos, token
from o join bb using (batch) where off // 128 < nb"""

OFFSETS = f"""(select doc_id, n_tokens,
   cast(coalesce(sum(n_tokens) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_offset
   from (select doc_id, cast(len({TOKS}) as bigint) as n_tokens from documents))"""

SQL["corpus_offsets"] = f"select doc_id, n_tokens, start_offset from {OFFSETS}"

SQL["corpus_windows"] = f"""
with n as (select cast(sum(len({TOKS})) as bigint) as n from documents),
w as (select unnest(range(0, n, 128)) as i, n from n)
select cast(i // 128 as bigint) as window_id, i as "begin", least(i + 128, n) as "end",
       least(i + 128, n) - case when i = 0 then 0 else least(i, n) end as trg_len
from w where i = 0 or least(i, n) < n"""

SQL["windows_lookback"] = f"""
with w as (select doc_id, n, unnest(range(0, n, 512)) as i from (select doc_id, cast(len({TOKS}) as bigint) as n from documents))
select doc_id, greatest(i + 512 - 1024, 0) as "begin", least(i + 512, n) as "end", least(i + 512, n) - i as trg_len from w"""

SQL["windows_forward"] = f"""
with w as (select doc_id, n, unnest(range(0, n, 128)) as i from (select doc_id, cast(len({TOKS}) as bigint) as n from documents))
select doc_id, i as "begin", least(i + 256, n) as "end",
       least(i + 256, n) - case when i = 0 then 0 else least(i + 128, n) end as trg_len
from w where i = 0 or least(i + 128, n) < n"""

SQL["masked_windows"] = f"""
with n as (select doc_id, cast(len({TOKS}) as bigint) as n from documents),
w as (select doc_id, n, unnest(range(0, n, 32)) as b from n),
v as (select doc_id, b, n, least(b + 64, n) - b - (least(b + 64, n) - case when b = 0 then 0 else least(b + 32, n) end) as context
      from w where b = 0 or least(b + 32, n) < n),
enc as (select t.doc_id, t.pos, v.token_id from {TOKROWS} t join {VOCAB} v using (token))
select v.doc_id, v.b as "begin", r.p as pos,
       cast(case when r.p < v.context or v.b + r.p >= v.n then -100 else enc.token_id end as bigint) as target
from v cross join range(64) as r(p) left join enc on enc.doc_id = v.doc_id and enc.pos = v.b + r.p"""

SQL["parse_generated"] = r"""
with g as (select doc_id, lang || chr(9) || source || chr(10) || chr(10) || text as g,
                  length(lang || chr(9) || source || chr(10) || chr(10)) as n from documents)
select doc_id, string_split(trim(substring(g, 1, n), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), chr(9))[1] as label_lang,
       string_split(trim(substring(g, 1, n), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), chr(9))[2] as label_source,
       trim(regexp_replace(substring(g, n + 1), '\s+', ' ', 'g')) as text from g"""

SQL["expand_prompts"] = f"""
select label, unnest(range(1, (quota // 8 + 1) * 8 * 2 + 1)) as seq_no from {QUOTAS.format(total=600)} where quota > 0"""

EMB = "(select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding)::double as x from embeddings)"

SQL["softmax_t"] = f"""
with e as (select vec_id, pos, x / 2.0 as x from {EMB}),
m as (select vec_id, max(x) as m from e group by vec_id),
s as (select e.vec_id, e.pos, e.x - m.m as z from e join m using (vec_id)),
l as (select vec_id, ln(sum(exp(z))) as lse from s group by vec_id)
select s.vec_id, s.pos, round(exp(s.z - l.lse), 6) as p from s join l using (vec_id)"""

SQL["log_softmax_t"] = f"""
with e as (select vec_id, pos, x / 2.0 as x from {EMB}),
m as (select vec_id, max(x) as m from e group by vec_id),
s as (select e.vec_id, e.pos, e.x - m.m as z from e join m using (vec_id)),
l as (select vec_id, ln(sum(exp(z))) as lse from s group by vec_id)
select s.vec_id, s.pos, round(s.z - l.lse, 6) as logp from s join l using (vec_id)"""

SQL["mean_vector"] = f"select label, pos, round(avg(x), 6) as mean from {EMB} group by label, pos"

SQL["append_mean_vector"] = f"""
select vec_id, pos, round(x, 6) as value from {EMB}
union all
select (select max(vec_id) from embeddings) + 1 as vec_id, pos, round(avg(x), 6) as value from {EMB} group by pos"""

KD = f"""
e as {EMB},
t as (select label, pos, avg(x) as t from e group by label, pos),
j as (select e.vec_id, e.label, e.pos, e.x as s, t.t as t from e join t using (label, pos)),
z as (select vec_id, label, pos, s, t, s / 2.0 - max(s / 2.0) over (partition by vec_id) as zs,
             t / 2.0 - max(t / 2.0) over (partition by vec_id) as zt,
             s - max(s) over (partition by vec_id) as z1 from j),
lse as (select vec_id, ln(sum(exp(zs))) as ls, ln(sum(exp(zt))) as lt, ln(sum(exp(z1))) as l1 from z group by vec_id),
r as (select z.vec_id, z.label,
             sum(exp(zt - lt) * ((zt - lt) - (zs - ls))) as kl,
             sum((s - t) * (s - t)) as se, count(*) as dim,
             -max(case when z.pos = z.label then z1 - l1 end) as ce
      from z join lse using (vec_id) group by z.vec_id, z.label)"""

SQL["kd_kl"] = f"with {KD} select label, round(4.0 * sum(kl) / count(*), 6) as kl from r group by label"

SQL["kd_sequence_loss"] = f"""
with {KD}, q as (select *, row_number() over (partition by label order by vec_id) - 1 as seq_pos from r)
select label, round(4.0 * sum(kl), 6) as kl from q where seq_pos >= 5 group by label"""

SQL["hidden_mse"] = f"with {KD} select label, round(sum(se) / sum(dim), 6) as mse from r group by label"

SQL["kd_loss"] = f"""
with {KD}
select label, 0.4::double as lambda,
       round(0.6 * avg(ce) + 0.4 * (4.0 * sum(kl) / count(*)) + 0.1 * (sum(se) / sum(dim)), 6) as loss from r group by label
union all
select label, 0.0::double as lambda, round(1.0 * avg(ce), 6) as loss from r group by label"""

SQL["kd_loss_terms"] = f"""
with {KD}, nt as (select label, avg(sq) as term from (select vec_id, label, 0.01 * sum(x * x) as sq from {EMB} group by vec_id, label) group by label)
select label, round(avg(ce) + any_value(term), 6) as loss from r join nt using (label) group by label"""

SCALED = f"(select vec_id, label, pos, x * (1 + vec_id % 3) as x from {EMB})"

CLIPPED = f"""(select s.vec_id, s.label, s.pos, s.x * case when n.nrm > 1.5 then 1.5 / n.nrm else 1.0 end as x
   from {SCALED} s join (select vec_id, sqrt(sum(x * x)) as nrm from {SCALED} group by vec_id) n using (vec_id))"""

SQL["clip_vectors"] = f"select vec_id, pos, round(x, 6) as value from {CLIPPED}"

SQL["dp_clipped_mean"] = f"select label, pos, round(sum(x) / count(*), 6) as mean from {CLIPPED} group by label, pos"


def _u(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


def _normal(seed: int, key: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(seed, key)})) * cos(2 * pi() * {_u(seed + 1, key)}))"


def _sigma(epsilon: str, delta: str, sensitivity: str = "1.0::double") -> str:
    """Noise scale of one Gaussian release in closed form."""
    log_term = f"(2.0::double * ln(1.0::double / {delta}))"
    return f"({sensitivity} / (sqrt({log_term} + 2.0::double * {epsilon}) - sqrt({log_term})))"


SQL["dp_histogram"] = f"""
select label, round(greatest(0.0, n + {_sigma('2.0', '1e-5')} * {_normal(42, 'label')}), 6) as noisy_n
from (select lang as label, count(*) as n from documents group by lang)"""

SQL["dp_mean_noisy"] = f"""
select s.label, s.pos, round((s.x + {_sigma('2.0', '1e-5')} * 1.5 * {_normal(42, "s.label || ':' || s.pos")})
       / greatest(n.n + {_sigma('2.0', '1e-5')} * {_normal(44, 'n.label')}, 1.0), 6) as mean
from (select label, pos, sum(x) as x from {CLIPPED} group by label, pos) s
join (select label, count(*) as n from embeddings where len(embedding) > 0 group by label) n using (label)"""

SPENT = """(select node, sum(eps) as eps, sum(rho) as rho, sum(1e-9::double) as delta from (
  select unnest([event_type, event_type || '/user-' || user_id]) as node, 1.0 / (2.0 * s * s) as rho,
         1.0 / (2.0 * s * s) + sqrt(2.0 * ln(1.0 / 1e-9)) / s as eps
  from (select event_type, user_id, 50.0 + abs(value) as s from events)) group by node)"""

RDP = "list_min(list_transform(range(2, 65), lambda o: o * rho + ln(1.0 / delta) / (o - 1)))"

SQL["dp_sigma"] = f"""
with s as (select node as run, {RDP} as epsilon from {SPENT} where node not like '%/%'),
g as (select run, share, epsilon * (share - 1.0) as epsilon from s, (select unnest([1.25, 1.5, 2.0, 4.0]::double[]) as share)),
c as (select sqrt(2.0 * ln(1.0 / 1e-5)) as L)
select run, share, round(epsilon, 6) as epsilon, round(1.0 / (sqrt(L * L + 2.0 * epsilon) - L), 6) as sigma from g, c"""

SQL["bounded_contributions"] = """
select event_id, user_id from (
  select event_id, user_id, row_number() over (partition by user_id order by md5('42:' || event_id), event_id) as r from events)
where r <= 10"""

SQL["privacy_ledger"] = """
with p as (select event_type as run, sum(1.0 / (2.0 * (50.0 + abs(value)) * (50.0 + abs(value)))) as rho from events group by event_type)
select run, cast(o as integer) as "order", round(o * rho + ln(1.0 / 1e-5) / (o - 1), 6) as epsilon
from p, range(2, 65) as r(o)"""

SQL["budget_compose"] = f"""select node, round(eps, 6) as epsilon_basic, round({RDP}, 6) as epsilon_rdp,
round(delta, 12) as delta from {SPENT}"""

LANGTOK = f"(select lang as label, tok as token, count(*)::double as n from (select lang, unnest({TOKS}) as tok from documents) group by lang, tok)"

SQL["topk_candidates"] = f"""
select label, token, cast(n as bigint) as n, cast(rk as bigint) as rk from (
  select *, row_number() over (partition by label order by n desc, token) as rk from {LANGTOK}) where rk <= 50"""

SQL["topp_candidates"] = f"""
select label, token, cast(n as bigint) as n from (
  select *, coalesce(sum(n) over (partition by label order by n desc, token rows between unbounded preceding and 1 preceding), 0) as higher,
         sum(n) over (partition by label) as total from {LANGTOK}) where 10 * higher < 9 * total"""

SQL["penalised_candidates"] = f"""
with c as (select *, ln(n / sum(n) over (partition by label)) as s from {LANGTOK}),
f as (select lang as label, min(doc_id) as doc_id from documents group by lang),
seen as (select distinct f.label, unnest({TOKS}) as token from documents d join f using (doc_id))
select c.label, c.token, round(case when seen.token is not null then case when s < 0 then s * 1.2 else s / 1.2 end else s end, 6) as score
from c left join seen on seen.label = c.label and seen.token = c.token"""


def _pairs(where: str, extra: str = "") -> str:
    return f"""(select doc_id{extra}, i, case when i = 0 then null else toks[i] end as prev, toks[i + 1] as token
      from (select doc_id{extra}, toks, unnest(range(len(toks))) as i
            from (select doc_id{extra}, {TOKS} as toks from {where})))"""


def _dp_counts(where: str, by_label: bool) -> str:
    lab = "lang as label, " if by_label else ""
    grp = "lang, " if by_label else ""
    return f"""(with f as (select doc_id, lang, prev, token, min(i) as fi from {_pairs(where, ', lang')} group by doc_id, lang, prev, token),
      r as (select *, row_number() over (partition by doc_id order by fi) as rk from f)
    select {lab}prev, token, count(*)::double as n from r group by {grp}prev, token)"""


SQL["fit_bigram"] = f"select label, prev, token, n from {_dp_counts('documents', True)}"


SQL["fit_bigram_noisy"] = f"""
with t as (select lang, doc_id, {TOKS} as toks from documents),
p as (select doc_id, lang, md5(array_to_string(toks, ' ')) as h, toks, unnest(range(1, len(toks) + 1)) as i from t),
q as (select distinct doc_id, lang, h, case when i = 1 then '' else toks[i - 1] end as prev, toks[i] as token from p),
b as (select *, row_number() over (partition by doc_id order by md5(h || ':' || prev || ' ' || token), prev || ' ' || token) as r from q),
c as (select lang as label, prev, token, count(*)::double as n from b where r <= 100 group by lang, prev, token),
s as (select {_sigma('8.0', '5e-6', 'sqrt(100.0::double)')} as sigma),
z as (select label, prev, token, n + sigma * {_normal(42, "label || ':' || prev || ':' || token")} as n, sigma from c, s)
select label, case when prev = '' then null else prev end as prev, token, round(n, 6) as n
from z where n >= 1.0 + sigma * sqrt(2.0 * ln(100 / 5e-6))"""


def _raw_counts(where: str) -> str:
    return f"(select prev, token, count(*)::double as n from {_pairs(where)} group by prev, token)"


TRAIN_MODEL = f"""
bg as {_raw_counts('documents where doc_id % 10 <> 0')},
uni as (select token, sum(n) as n from bg group by token),
tot as (select sum(n) as big_n, count(*)::double as v from uni),
ctx as (select prev, sum(n) as ch from bg group by prev)"""

NLL = """-ln((coalesce(bg.n, 0.0) + 1.0 * ((coalesce(uni.n, 0.0) + 1.0) / (tot.big_n + 1.0 * (tot.v + 1.0))))
          / (coalesce(ctx.ch, 0.0) + 1.0))"""


def _scored(targets: str, cols: str) -> str:
    return f"""(select {cols}, {NLL} as nll from {targets} te
      left join uni on uni.token = te.token
      left join bg on bg.prev is not distinct from te.prev and bg.token = te.token
      left join ctx on ctx.prev is not distinct from te.prev
      cross join tot)"""


SQL["ngram_nll"] = f"""
with {TRAIN_MODEL}
select doc_id, count(*) as n_tokens, round(avg(nll), 6) as nll
from {_scored(_pairs('documents where doc_id % 10 = 0'), 'te.doc_id')} group by doc_id"""

STREAM = f"""(with d as (select doc_id, {TOKS} as toks from documents where doc_id % 10 = 0 and len({TOKS}) > 0),
     o as (select doc_id, toks, coalesce(sum(len(toks)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as so,
                  lag(toks[len(toks)]) over (order by doc_id) as carry from d),
     t as (select doc_id, so, carry, toks, unnest(range(len(toks))) as i from o),
     g as (select so + i as g, case when i = 0 then carry else toks[i] end as prev, toks[i + 1] as token from t),
     w as (select *, case when g < 128 then 0 else (g // 128) * 128 end as wi from g)
   select wi // 128 as "window", prev, token from w where g > wi)"""


def _exact(x: str) -> str:
    """Sum in whole units of 1e-12, as the library adds losses."""
    return f"(sum(floor(({x}) * 1e12::double + 0.5::double)::hugeint)::double / 1e12::double)"


def _exact_avg(x: str) -> str:
    return f"({_exact(x)} / count(*))"


SQL["ppl_macro"] = f"""
with {TRAIN_MODEL},
s as {_scored(STREAM, 'te."window"')},
w as (select "window", {_exact_avg('nll')} as nll from s group by "window")
select count(*) as n_windows, round(exp({_exact_avg('nll')}), 6) as ppl from w"""

LOOKBACK = f"""(with d as (select doc_id, {TOKS} as toks from documents where doc_id % 10 = 0),
     t as (select doc_id, len(toks) as n, toks, unnest(range(len(toks))) as i from d),
     w as (select doc_id, n, (i // 512) * 512 as wi, i, case when i = 0 then null else toks[i] end as prev, toks[i + 1] as token from t)
   select doc_id, wi, least(wi + 512, n) - wi as trg, n, prev, token from w where i > greatest(wi + 512 - 1024, 0))"""

PPLW = f"""(with {TRAIN_MODEL},
   s as {_scored(LOOKBACK, 'te.doc_id, te.wi, te.trg, te.n')},
   w as (select doc_id, wi, {_exact_avg('nll')} as nll, any_value(trg) as trg, any_value(n) as n from s group by doc_id, wi)
   select doc_id, exp({_exact('nll * trg')} / any_value(n)) as ppl from w group by doc_id)"""

SQL["ppl_weighted"] = f"""select t.doc_id, round(p.ppl, 6) as ppl
from (select doc_id from documents where doc_id % 10 = 0) t left join {PPLW} p using (doc_id)"""

SQL["ppl_mean_std"] = f"select round(avg(ppl), 6) as ppl_mean, round(stddev_pop(ppl), 6) as ppl_std from {PPLW}"


def _mix(teacher: str, student: str) -> str:
    return f"""
with tt as {teacher}, ss as {student},
qt as (select prev, token, n / sum(n) over (partition by prev) as q from tt),
qs as (select prev, token, n / sum(n) over (partition by prev) as q from ss)
select case when qt.token is null then qs.prev else qt.prev end as prev, coalesce(qt.token, qs.token) as token,
       round(0.4 * coalesce(qt.q, 0.0) + 0.6 * coalesce(qs.q, 0.0), 6) as p
from qt full outer join qs on qt.prev is not distinct from qs.prev and qt.token = qs.token"""


PRIVATE = "documents where source not in ('src0', 'src1')"
CONV = "(select turn as doc_id, text from conversations)"

SQL["distil_mix"] = _mix(_raw_counts(PRIVATE), _raw_counts(CONV))

SQL["dp_distil"] = _mix(f"(select prev, token, sum(n) as n from {_dp_counts(PRIVATE, True)} group by prev, token)",
                        _dp_counts(PRIVATE, False))

def _coded(code: str = "lang", where: str = "true") -> str:
    """Training texts by control code, end marker included."""
    return f"(select doc_id, {code} as lang, text || ' <eos>' as text from documents where {where})"


CODE2 = "lang || chr(9) || source"

SQL["fit_coded"] = f"select label, prev, token, n from {_dp_counts(_coded(CODE2), True)}"

SQL["generate_greedy"] = f"""
with recursive dpb as {_dp_counts(_coded(), True)},
best as (select label, prev, token from (select *, row_number() over (partition by label, prev order by n desc, token) as r from dpb) where r = 1),
seqs as (select label, s from (select distinct lang as label from documents) l cross join range(1, 4) as r(s)),
gen(label, s, step, prev, txt) as (
  select label, s, 0, NULL::varchar, ''::varchar from seqs
  union all
  select g.label, g.s, g.step + 1, b.token, case when g.step = 0 then b.token else g.txt || ' ' || b.token end
  from gen g join best b on b.label = g.label and b.prev is not distinct from g.prev
  where g.step < 127 and b.token <> '<eos>')
select label || ':' || s as seq_id, label, txt as text from gen
qualify row_number() over (partition by label, s order by step desc) = 1"""

SQL["synthetic_rows"] = r"""
with r as (select conv_id, turn, trim(regexp_replace(case when conv_id % 9 = 0 then '' else text end, '\s+', ' ', 'g')) as text,
                  role as label from conversations),
q as (select role as label, cast(round_even(n * (300.0::double / sum(n) over ()), 0) as bigint) as quota
      from (select role, count(*) as n from conversations group by role)),
k as (select *, row_number() over (partition by label order by md5('42:' || conv_id || ':' || turn), conv_id, turn) as rk
      from r where length(text) > 0)
select conv_id, turn, text, label from k join q using (label) where rk <= quota and quota > 0"""

SQL["map_batches"] = f"select doc_id, cast(len({TOKS}) as bigint) as n_words from documents"


SQL["map_batches_args"] = (f"select doc_id, cast(len(list_filter({TOKS}, lambda t: length(t) >= 5)) as bigint) as n_words "
                           "from documents")


def _uni_dp(where: str) -> str:
    return f"""(with p as (select doc_id, unnest(range(len(toks))) as i, unnest(toks) as token
                      from (select doc_id, {TOKS} as toks from {where})),
      f as (select doc_id, token, min(i) as fi from p group by doc_id, token),
      r as (select *, row_number() over (partition by doc_id order by fi) as rk from f)
    select token, count(*)::double as n from r group by token)"""


def _uni_raw(where: str) -> str:
    return f"(select tok as token, count(*)::double as n from (select unnest({TOKS}) as tok from {where}) group by tok)"


def _prob(tag: str, uni: str, bg: str | None) -> str:
    """p(token | prev) of one smoothed count model for every distinct target pair."""
    head = f"""{tag}_u as {uni}, {tag}_t as (select sum(n) as big_n, count(*)::double as v from {tag}_u)"""
    p1 = f"((coalesce({tag}_u.n, 0.0) + 1.0) / ({tag}_t.big_n + 1.0 * ({tag}_t.v + 1.0)))"
    if bg is None:
        body = f"""{tag}_p as (select tp.prev, tp.token, {p1} as p from tp left join {tag}_u on {tag}_u.token = tp.token cross join {tag}_t)"""
        return head + ",\n" + body
    head += f""", {tag}_b as {bg}, {tag}_c as (select prev, sum(n) as ch from {tag}_b group by prev)"""
    body = f"""{tag}_p as (select tp.prev, tp.token,
         (coalesce({tag}_b.n, 0.0) + 1.0 * {p1}) / (coalesce({tag}_c.ch, 0.0) + 1.0) as p
       from tp left join {tag}_u on {tag}_u.token = tp.token
       left join {tag}_b on {tag}_b.prev is not distinct from tp.prev and {tag}_b.token = tp.token
       left join {tag}_c on {tag}_c.prev is not distinct from tp.prev cross join {tag}_t)"""
    return head + ",\n" + body


def _mixp(tag: str, t: str, s: str) -> str:
    return f"""{tag}_p as (select a.prev, a.token, 0.4 * a.p + 0.6 * b.p as p from {t}_p a
       join {s}_p b on a.prev is not distinct from b.prev and a.token = b.token)"""


TRAIN_PRIV = "documents where doc_id % 10 <> 0 and source not in ('src0', 'src1')"
TRAIN_PUB = "documents where doc_id % 10 <> 0 and source in ('src0', 'src1')"


def _model_report_sql() -> str:
    gen_ctes = _synthesis_ctes("doc_id % 10 <> 0 and source not in ('src0', 'src1')")
    generated = "(select seq_id as doc_id, text from kept)"
    dp_uni = _uni_dp(TRAIN_PRIV)
    t_dpkd = _dp_counts(TRAIN_PRIV, False)
    t_cc = f"(select prev, token, sum(n) as n from {_dp_counts(TRAIN_PRIV, True)} group by prev, token)"
    syn = _raw_counts(generated)
    pub_bg = _raw_counts(TRAIN_PUB)
    ctes = [
        gen_ctes,
        f"tg as {STREAM}",
        "tp as (select distinct prev, token from tg)",
        _prob("m_dpsgd", dp_uni, None),
        _prob("m_tdpkd", f"(select token, sum(n) as n from {t_dpkd} group by token)", t_dpkd),
        _prob("m_tcc", f"(select token, sum(n) as n from {t_cc} group by token)", t_cc),
        _prob("m_syn", f"(select token, sum(n) as n from {syn} group by token)", syn),
        _prob("m_spre", _uni_raw(TRAIN_PUB), None),
        _prob("m_tpre", f"(select token, sum(n) as n from {pub_bg} group by token)", pub_bg),
        _mixp("m_sdpkd", "m_tdpkd", "m_dpsgd"),
        _mixp("m_ssynkd", "m_tcc", "m_syn"),
    ]
    rows = [("student_dpkd", "m_sdpkd", "2.0"), ("student_syn_kd", "m_ssynkd", "2.0"), ("student_syn", "m_syn", "2.0"),
            ("student_dpsgd", "m_dpsgd", "2.0"), ("student_pretrained", "m_spre", "NULL"),
            ("teacher_dpkd", "m_tdpkd", "1.0"), ("teacher_cc", "m_tcc", "2.0"), ("teacher_pretrained", "m_tpre", "NULL")]
    sel = []
    for name, tag, eps in rows:
        sel.append(f"""select '{name}' as model, cast({eps} as double) as epsilon, round(exp({_exact_avg('nll')}), 6) as ppl from (
      select tg."window", {_exact_avg(f"-ln({tag}_p.p)")} as nll from tg join {tag}_p on {tag}_p.prev is not distinct from tg.prev
      and {tag}_p.token = tg.token group by tg."window")""")
    return "with recursive " + ",\n".join(ctes) + "\n" + "\nunion all\n".join(sel)


SQL["prepared_splits"] = f"""
with k as (select * from {LABELLED} where label in (select label from {LABELLED} group by label having count(*) > 25)),
kk as (select k.doc_id, k.label, d.text from k join documents d using (doc_id)),
a as (select *, row_number() over (order by {H}, doc_id) as r, count(*) over () as n from kk),
t as (select doc_id, label, text, r <= ceil(n * 0.02::double) as is_test from a),
b as (select *, row_number() over (order by md5('43:' || doc_id), doc_id) as r, count(*) over () as n from t where not is_test)
select 'test' as split, text, label from t where is_test
union all
select case when r <= ceil(n * 0.02::double) then 'val' else 'train' end as split, text, label from b"""


def _gen_sampled_ctes(seqs: str, k: int = 50, temperature: str = "1.0", penalty: str = "1.0", code: str = "lang",
                      codes: int = 1, where: str = "true") -> str:
    """Recursive CTEs reproducing sampled generation (p 0.9, bigram ban, 128
    tokens with the ``codes`` of the prompt, end marker) for the ``(label, s)``
    rows of ``seqs``, with the same md5-derived uniforms and sequential sums as
    the Spark path.  One candidate (``k`` 1) is greedy.  Ends with a
    ``gtext(seq_id, label, text)`` CTE."""
    log_p = "ln(x.n / g.total)"
    score = (f"(case when list_contains(g.out, x.token) then case when {log_p} < 0 then {log_p} * {penalty}::double "
             f"else {log_p} / {penalty}::double end else {log_p} end) / {temperature}::double")
    return f"""dpb as {_dp_counts(_coded(code, where), True)},
cl as materialized (
  select label, coalesce(prev, '') as prev, n, token, tot
  from (select *, row_number() over (partition by label, prev order by n desc, token) as rk,
               sum(n) over (partition by label, prev) as tot from dpb)
  where rk <= {k + 128}),
seqs as {seqs},
gen(label, s, step, prev, out) as (
  select label, s, 0, NULL::varchar, []::varchar[] from seqs
  union all
  select label, s, step + 1, tok, list_append(out, tok) from (
    select g.label, g.s, g.step, g.out,
      (with
        f as (select list_sort(list_transform(list_filter(g.cands, lambda x: not list_contains(
                 list_transform(list_filter(range(1, len(g.out)), lambda i: g.out[i] = g.prev), lambda i: g.out[i + 1]),
                 x.token)), lambda x: struct_pack(minus := -({score}), token := x.token)))[1:{k}] as f),
        w as (select f, list_transform(f, lambda x: exp(f[1].minus - x.minus)) as w from f),
        b as (select f, w, list_transform(range(1, len(w) + 1), lambda j: coalesce(list_sum(w[1:j - 1]), 0.0)) as bf,
                     list_sum(w) as tot_w from w),
        k as (select f, w, bf, len(list_filter(bf, lambda v: v < 0.9::double * tot_w)) as kn from b),
        t as (select f, w, bf, kn, list_sum(w[1:kn]) as tk,
                     ((('0x' || substr(md5('42:' || g.label || ':' || g.s || ':' || g.step), 1, 13))::bigint + 0.5)
                      / 4503599627370496.0) as u from k)
       select case when len(f) = 0 then null
                   else f[coalesce(list_filter(range(1, kn + 1), lambda j: bf[j] + w[j] >= u * tk)[1], kn)].token end
       from t) as tok
    from (select g.label, g.s, g.step, any_value(g.prev) as prev, any_value(g.out) as out, any_value(cl.tot) as total,
                 list(struct_pack(n := cl.n, token := cl.token) order by cl.n desc, cl.token) as cands
          from gen g join cl on cl.label = g.label and cl.prev = coalesce(g.prev, '')
          where g.step < {128 - codes} group by g.label, g.s, g.step) g)
  where tok is not null and tok <> '<eos>'),
gtext as (select label || ':' || s as seq_id, label, array_to_string(out, ' ') as text from gen
          qualify row_number() over (partition by label, s order by step desc) = 1)"""


_SEQS50 = "(select label, s from (select distinct lang as label from documents) l cross join range(1, 51) as r(s))"

SQL["generate_text"] = f"with recursive {_gen_sampled_ctes(_SEQS50)}\nselect seq_id, label, text from gtext"

SQL["generate_warped"] = f"""with recursive {_gen_sampled_ctes(_SEQS50, temperature='0.7', penalty='1.2')}
select seq_id, label, text from gtext"""

SQL["generate_greedy_ruled"] = f"""with recursive {_gen_sampled_ctes(_SEQS50.replace('51', '4'), k=1, penalty='1.2')}
select seq_id, label, text from gtext"""

SQL["generated_no_repeat"] = f"""with recursive {_gen_sampled_ctes(_SEQS50)},
tk as (select seq_id, label, string_split(text, ' ') as t from gtext),
p as (select seq_id, label, unnest(case when len(t) >= 2 then list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                        else [NULL::varchar] end) as bg from tk),
c as (select seq_id, label, bg, count(*) as c from p group by seq_id, label, bg)
select label, count(distinct seq_id) as n_seq,
       cast(sum(case when bg is not null and c > 1 then 1 else 0 end) as bigint) as n_repeat from c group by label"""

def _quotas2(where: str = "true") -> str:
    return f"""(select label, n, cast(round_even(n * (cast(600 as double) / sum(n) over ()), 0) as bigint) as quota
   from (select {CODE2} as label, count(*) as n from documents where text is not null and {where} group by 1))"""


def _synthesis_ctes(where: str = "true") -> str:
    """CTEs of the synthesis chain on two labels, ending with ``kept(seq_id, label, text)``."""
    expanded = f"""(select label, unnest(range(1, (quota // 8 + 1) * 8 * 2 + 1)) as s
   from {_quotas2(where)} where quota > 0)"""
    return f"""{_gen_sampled_ctes(expanded, code=CODE2, codes=2, where=where)},
q as {_quotas2(where)},
kept as (select g.seq_id, g.label, g.text from (
           select *, row_number() over (partition by label order by md5('42:' || seq_id), seq_id) as r
           from gtext where length(text) > 0) g join q using (label) where r <= quota and quota > 0)"""


SQL["synthetic_table"] = f"""with recursive {_synthesis_ctes()}
select text, string_split(label, chr(9))[1] as label_lang, string_split(label, chr(9))[2] as label_source, seq_id,
       row_number() over (order by md5('43:' || seq_id), seq_id) as shuffle_key from kept"""

SQL["generated_ppl"] = f"""with recursive {_synthesis_ctes()},
m_b as (select prev, token, sum(n) as n from dpb group by prev, token),
m_u as (select token, sum(n) as n from m_b group by token),
m_t as (select sum(n) as big_n, count(*)::double as v from m_u),
m_c as (select prev, sum(n) as ch from m_b group by prev),
d as (select seq_id as doc_id, {TOKS} as toks from gtext),
t as (select doc_id, len(toks) as n, toks, unnest(range(len(toks))) as i from d),
w as (select doc_id, n, (i // 512) * 512 as wi, i, case when i = 0 then null else toks[i] end as prev, toks[i + 1] as token from t),
tg as (select doc_id, wi, least(wi + 512, n) - wi as trg, n, prev, token from w where i > greatest(wi + 512 - 1024, 0)),
s as (select tg.doc_id, tg.wi, tg.trg, tg.n,
        -ln((coalesce(m_b.n, 0.0) + 1.0 * ((coalesce(m_u.n, 0.0) + 1.0) / (m_t.big_n + 1.0 * (m_t.v + 1.0))))
            / (coalesce(m_c.ch, 0.0) + 1.0)) as nll
      from tg left join m_u on m_u.token = tg.token
      left join m_b on m_b.prev is not distinct from tg.prev and m_b.token = tg.token
      left join m_c on m_c.prev is not distinct from tg.prev cross join m_t),
pw as (select doc_id, wi, {_exact_avg('nll')} as nll, any_value(trg) as trg, any_value(n) as n from s group by doc_id, wi),
pp as (select doc_id, exp({_exact('nll * trg')} / any_value(n)) as ppl from pw group by doc_id)
select 'synthesis' as run, 'n_generated' as metric, count(*)::double as value from gtext
union all select 'synthesis', 'n_rows', count(*)::double from kept
union all select 'synthesis', 'ppl_mean', round(avg(ppl), 6) from pp
union all select 'synthesis', 'ppl_std', round(stddev_pop(ppl), 6) from pp"""

SQL["model_report"] = _model_report_sql()
