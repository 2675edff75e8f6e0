"""DuckDB SQL that gives the same results as the registered queries.

Written per tag and per message, straight from the rules, and not after the shape of the Spark plans.
Each query names the common table expressions it needs; ``_sql`` puts them in order.
"""

from __future__ import annotations

import re

DAY = "1998-09-22"

CTE: dict[str, str] = {}


def _cte(name: str, body: str) -> None:
    CTE[name] = body


def _uses(body: str) -> set[str]:
    return {word for word in re.findall(r"[a-z_0-9]+", body) if word in CTE}


def _sql(body: str, recursive: bool = False) -> str:
    """Prefix the body with the expressions it uses, in order of definition."""
    wanted, todo = set(), _uses(body)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _uses(CTE[name]) - {name}
    parts = [f"{name} as materialized ({CTE[name]})" for name in CTE if name in wanted]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


# ---- calendar pieces, as text to be put into SQL ----

def daily(d: str, delay: int = 2) -> str:
    return f"({d} - {delay})"


def last_month_first(d: str, delay: int = 2) -> str:
    base = f"{d} - {delay}" if delay >= 10 else f"case when day({d}) = {delay} then {d} else {d} - {delay} end"
    return f"cast(date_trunc('month', ({base}) - interval 1 month) as date)"


def last_month(d: str, delay: int = 2) -> str:
    return f"strftime({last_month_first(d, delay)}, '%Y%m')"


def iso(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def w_start(freq: str, d: str, started: str) -> str:
    return (f"case when upper({freq}) = 'M' then cast({last_month_first(d)} + to_months({started} + 1) as date) "
            f"else {daily(d)} + ({started} + 1) end")


def w_end(freq: str, start: str, traced: str) -> str:
    return (f"case when upper({freq}) = 'M' then last_day({start} + to_months({traced} - 1)) "
            f"else {start} + ({traced} - 1) end")


CYCLE_DAY_CUT = "cast(ts - interval '12 hours 7 minutes' as date)"

# ---- derived inputs ----

_cte("n_s", "select count(*) n from supplier")
_cte("n_p", "select count(*) m from part")

_cte("mapping", """
select s_suppkey row_seq,
  'VP_BANK.v_' || s_suppkey || case when s_suppkey%4=1 then '/VP_BANK.w_' || s_suppkey else '' end
    || case when s_suppkey%10=8 then '/orphan_' || s_suppkey else '' end view_id,
  'db' || (s_suppkey%3) db_id, 't_' || s_suppkey table_id,
  case when s_suppkey%5=4 then 'v' else '' end year_ind,
  case when s_suppkey%5 in (1,2) then 'v' else '' end month_ind,
  case when s_suppkey%5 in (2,3) then 'v' else '' end day_ind,
  case when s_suppkey%5=0 then 'v' else '' end ref_ind,
  case when s_suppkey%5=0 then '' else 'yyyymm' end partition_id,
  case when s_suppkey%10=7 then 'v' else '' end disabled_ind
from supplier
union all
select 100000+s_suppkey, 'VP_BANK.v_' || s_suppkey, 'db' || (s_suppkey%3), 't_' || s_suppkey, '', 'v', '', '', 'yyyymm', ''
from supplier where s_suppkey%10=3
union all
select 200000+s_suppkey, 'VP_BANK.u_' || s_suppkey, 'db' || (s_suppkey%3), 'u_' || s_suppkey, '', 'v', '', '', 'yyyymm', ''
from supplier where s_suppkey%20=0""")

_cte("dict", """
select p row_seq, 'TAG_' || p tag_id, p_brand source_type, p_type source_item,
  case when p%17=0 then null else [{'type_L1': p_brand, 'type_L2': p_type}] end tag_type,
  p_name tag_name,
  case when p%11=0 then 'select 1' else 'select c from VP_BANK.v_' || (p%n) || ' a join vp_bank.'
    || case when p%13=0 then 'w' else 'v' end || '_' || ((p*7+3)%n) || ' b on a.k=b.k' end
  || case when p%4<>0 or p%40=0 then ' where d between ''$start_date'' and ''$end_date''' else '' end sql,
  case when p%3=0 then 'M' when p%50=1 then 'd' else 'D' end update_frequency,
  case when p%4<>0 then cast(-(1+p%6) as integer) end started,
  case when p%4<>0 then cast(1+p%5%3 as integer) end traced,
  p_name description, '2018-01-01' create_time, '2018-09-22' update_time,
  case when p%5<>0 then p%7=0 end disable_flag,
  case when p%2=0 then 'sum' else 'count' end score_method, p_type attribute, 'fixture' creator,
  p%9=0 is_focus, case p%8 when 0 then 'ats' when 1 then 'OTHER' else 'ATS' end system_name,
  case when p%19<>0 then ['T' || p] end tickets
from (select *, p_partkey p from part), n_s""")

_cte("log", """
select event_id, ts, case when event_type='error' then 'hippo-finish' else 'frontier-adw' end topic,
  case when event_id%97=0 then 't_x' when event_id%91=0 then 'u_' || (event_id%n - event_id%n%20) else 't_' || (event_id%n) end tbl,
  'db' || (case when event_id%91=0 then event_id%n - event_id%n%20 else event_id%n end % 3) db,
  case when event_id%n%5=0 then '' else 'yyyymm' end pf,
  case when event_id%n%5=0 then '' else strftime(cast(ts as date) - 2
    + to_months(cast(case (event_id//n)%4 when 0 then 0 when 1 then -1 when 2 then -2 else 1 end as integer)), '%Y%m')
      || case when event_id%n%5=1 and event_id%3=0 then '01' else '' end end pv,
  event_type as method, cast(floor(epoch_us(ts) / 1000000) as bigint) exec_date
from events, n_s""")

_cte("log_json", """
select event_id, ts, topic, cast(to_json({'table': tbl, 'partition_fields': [pf], 'partition_values': [pv], 'db': db,
  'method': method, 'exec_date': exec_date}) as varchar) as value from log""")

_cte("log_broken", """
select event_id, ts, topic, case when event_id%101=0 then 'not-json'
  when event_id%103=0 then regexp_replace(value, '"partition_values":[^]]*', '"partition_values":[null')
  when event_id%107=0 then regexp_replace(value, '"partition_values":[^]]*', '\0,null') else value end as value from log_json""")

_cte("reports", """
select 'TAG_' || (o_custkey%m) tag_id, o_orderkey seq,
  case o_orderstatus when 'O' then 'Start' when 'F' then 'Finish' else 'NonFinish' end status,
  cast(epoch(o_orderdate) as bigint) start_time, cast(epoch(o_orderdate) as bigint) + o_orderkey%600 finish_time
from orders, n_p""")

_cte("recent", """
select tag_id, seq, status, s start_time, s + seq%600 finish_time
from (select *, 1704067200 + (start_time + seq*97) % 2592000 s from reports)""")

_cte("run_reports", """
select *, case when seq%2=0 then '1998-09-22' else '1998-09-23' end execute_date from reports""")

_cte("facts", """
select o_custkey entity_id, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) amount from orders""")

_cte("feed", """
select 1000000000+c row_seq, 'TAG_' || ((c*7)%(m+m//4)) target_id,
  case when c%29<>0 then 'TAG_' || ((c*7)%(m+m//4)) end tag_id,
  c_mktsegment source_type, 'n' || c_nationkey source_item,
  case when c%17<>0 then [{'type_L1': c_mktsegment, 'type_L2': 'new'}] end tag_type, c_name tag_name,
  'select c from VP_BANK.v_' || (c%n) || ' a, vp_bank.v_' || ((c*3)%n) || ' b where d >= ''$start_date''' sql,
  case c%3 when 0 then 'M' when 1 then 'd' else 'D' end update_frequency,
  case when c%4<>0 then cast(-(1+c%3) as integer) end started,
  case when c%4<>0 then 1 end traced, c_name description, '2024-01-01' create_time, '2024-01-02' update_time,
  cast(null as boolean) disable_flag, 'sum' score_method, case when c%23<>0 then c_mktsegment end attribute,
  'feed' creator, c%2=0 is_focus,
  case c%4 when 0 then 'ats' when 1 then null when 2 then 'CRM' else 'ATS' end system_name, ['C' || c] tickets
from (select *, c_custkey c from customer), n_s, n_p""")

_cte("feed_ok", """
select * from feed where tag_id is not null and tag_type is not null and attribute is not null and system_name is not null""")

_cte("history", "select * replace (target_id as tag_id) from feed")

# ---- mapping ----

_cte("classified", """
select * from (
  select row_seq, view_id, db_id || '.' || table_id dbt,
    case when ref_ind='v' then 'D' when month_ind='v' and day_ind='v' then 'D' when month_ind='v' then 'M'
         when day_ind='v' then 'D' end freq,
    case when ref_ind<>'v' and month_ind='v' and day_ind='v' then 'yyyymm' else nullif(partition_id, '') end part
  from mapping where disabled_ind='') where freq is not null""")
_cte("split", """
select row_seq, case when contains(v, '.') then split_part(v, '.', 2) end as "view"
from (select row_seq, unnest(string_split(view_id, '/')) v from mapping)""")
_cte("entries", """
select row_seq, case when contains(v, '.') then split_part(v, '.', 2) end as "view", freq, dbt, part
from (select row_seq, unnest(string_split(view_id, '/')) v, freq, dbt, part from classified)""")
_cte("views", """
select "view", freq, dbt, part from entries where "view" is not null
qualify row_number() over (partition by "view" order by row_seq desc) = 1""")
_cte("tfreq", """
select dbt, freq from entries qualify row_number() over (partition by dbt order by row_seq desc) = 1""")

# ---- dependencies ----

def _references(source: str) -> str:
    return f"""select distinct tag_id, upper(update_frequency) update_frequency,
  unnest(regexp_extract_all(sql, '(VP_BANK|vp_bank)[.]([a-z_A-Z0-9-]+)', 2)) as "view" from {source}"""


_cte("refs", _references("dict"))
_cte("deps", """
select distinct tag_id, update_frequency, freq, dbt, part from refs join views using ("view")""")
_cte("need_n", """
select tag_id, update_frequency, count(*) filter (freq='D') nd, count(*) filter (freq='M') nm from deps group by all""")
_cte("feed_refs", _references("feed_ok"))
_cte("feed_deps", """
select distinct tag_id, update_frequency, freq, dbt, part from feed_refs join views using ("view")""")
_cte("updated_deps", """
select * from deps where tag_id not in (select tag_id from feed_ok)
union all select * from feed_deps where tag_id in (select tag_id from dict)""")

# ---- messages ----

_cte("parsed", """
select event_id, ts, cast(ts as date) d, topic, db || '.' || tbl dbt, pf, pv, pf='' or pv='' bare, exec_date
from log where topic = 'frontier-adw'""")


def real_date(value: str, d: str) -> str:
    return (f"case when {value} = strftime({daily(d)}, '%Y%m') then {iso(daily(d))} "
            f"when {value} <> '' and {value} < strftime({daily(d)}, '%Y%m') "
            f"then {iso(f'''last_day(try_strptime({value} || '01', '%Y%m%d'))''')} end")


_cte("msgs", f"""
select event_id, ts, d, topic, freq, dbt, case when freq='D' and bare then null else pf end part,
  case when freq='D' and bare then null when freq='D' then {real_date('pv', 'd')} else pv end pvalue,
  exec_date finish_time
from parsed join tfreq using (dbt) where freq='M' or bare or regexp_matches(pv, '^[0-9]{{4}}(0[1-9]|1[0-2])$')""")
_cte("targets", f"""
select *, case when freq='D' then {iso(daily('d'))} else {last_month('d')} end target,
  {last_month('d')} lm from msgs""")
_cte("counted", """
select * from targets where (freq='D' and part is null and pvalue is null)
  or (part is not null and case when freq='M' then contains(pvalue, target) else pvalue = target end)""")
_cte("arrivals", f"""
select freq, dbt, part, case when freq='D' then {iso('d')} else lm end as cycle, min(ts) first_ts from counted group by all""")
_cte("got", """
select t.tag_id, a.freq, a.cycle, count(*) n, max(first_ts) t from deps t join arrivals a
on t.freq=a.freq and t.dbt=a.dbt and t.part is not distinct from a.part group by all""")
_cte("ready", f"""
select n.tag_id, n.update_frequency, cycle, t ready_ts from need_n n join got g on g.tag_id=n.tag_id and g.freq='D' and g.n=nd
where nm=0
union all
select n.tag_id, n.update_frequency, cycle, t from need_n n join got g on g.tag_id=n.tag_id and g.freq='M' and g.n=nm
where nd=0
union all
select n.tag_id, n.update_frequency, g.cycle, greatest(g.t, h.t) from need_n n
join got g on g.tag_id=n.tag_id and g.freq='D' and g.n=nd
join got h on h.tag_id=n.tag_id and h.freq='M' and h.n=nm
  and h.cycle = {last_month('cast(g.cycle as date)')} and cast(h.t as date) <= cast(g.cycle as date)
where nd>0 and nm>0""")
_cte("ready_m", f"""
select *, cast(ready_ts as date) as_of, {last_month('cast(ready_ts as date)')} target_month from ready""")
_cte("guarded", """
select * from ready_m where update_frequency='D'
union all
select * from ready_m where update_frequency='M'
qualify row_number() over (partition by tag_id, target_month order by ready_ts, cycle) = 1""")

_cte("clock", f"""
select max(ts) moment, cast(max(ts) as date) d, {iso('cast(max(ts) as date)')} today,
  {last_month('cast(max(ts) as date)')} lm from events""")
_cte("present", f"""
select freq, dbt, part, min(ts) first_ts, max(pvalue) pvalue, max(finish_time) finish_time from counted c, clock k
where case when freq='D' then {iso('c.d')} = today else c.lm = k.lm end group by all""")
_cte("flags", """
select t.*, p.pvalue, p.finish_time, p.freq is not null satisfied from deps t left join present p
on t.freq=p.freq and t.dbt=p.dbt and t.part is not distinct from p.part""")
_cte("awake", """
select distinct tag_id from deps t join (
  select freq, dbt, part from msgs m, clock k where m.d = k.d
  union select freq, dbt, part from counted c, clock k where freq='M' and c.lm = k.lm) s
on t.freq=s.freq and t.dbt=s.dbt and t.part is not distinct from s.part""")

# ---- runs ----

_cte("composed", f"""
select *, case when not contains(raw, '$') then 'plain' when started is null or traced is null then 'error' else 'dated' end status,
  case when contains(raw, '$') then s end sd, case when contains(raw, '$') then {w_end('update_frequency', 's', 'traced')} end ed
from (select * exclude (sql, update_frequency), sql raw, upper(update_frequency) update_frequency,
  {w_start('update_frequency', f"date '{DAY}'", 'started')} s from dict)""")
_cte("runs", f"""
select row_seq, tag_id, source_type, source_item, coalesce(tag_type, []) tag_type, tag_name,
  case when status='dated' then replace(replace(raw, '$start_date', {iso('sd')}), '$end_date', {iso('ed')}) else raw end sql,
  update_frequency, started, traced, score_method, attribute, {iso('sd')} start_date, {iso('ed')} end_date,
  '{DAY}' execute_date, system_name from composed where status <> 'error'""")
_cte("attempts", """
select tag_id, seq, cast((row_number() over (partition by tag_id, era order by seq) - 1) % 3 + 1 as integer) attempt
from (select *, coalesce(sum(case when status='Finish' then 1 else 0 end) over (partition by tag_id order by seq
        rows between unbounded preceding and current row), 0) era from reports where status <> 'Start')
where status='NonFinish'""")

_cte("needed", """
select tag_id, list({'update_frequency': freq, 'value': dbt, 'partition_fields': part}
  order by freq, dbt, part nulls first) need from deps group by tag_id""")
_cte("starts", """
select tag_id, seq, cast(to_json({'hippo_name': 'batchetl.tagging', 'job_name': tag_id, 'job_id': tag_id || '_' || start_time,
  'need_msgs': need, 'start_time': start_time}) as varchar) message
from reports join needed using (tag_id) where status='Start'""")
_cte("held_once", """
select r.tag_id, r.as_of run_day, {'kafkaTopic': c.topic, 'update_frequency': c.freq, 'value': c.dbt, 'partition_fields': c.part,
  'partition_values': c.pvalue, 'finish_time': c.finish_time} entry, min({'ts': c.ts, 'id': c.event_id}) first_place
from ready_m r join deps t on t.tag_id = r.tag_id
join counted c on t.freq=c.freq and t.dbt=c.dbt and t.part is not distinct from c.part and c.ts <= r.ready_ts
  and case when c.freq='D' then c.d = r.as_of else c.lm = r.target_month end
group by all""")
_cte("held_list", "select tag_id, run_day, list(entry order by first_place) received from held_once group by all")
_cte("finishes", f"""
select r.tag_id, seq, cast(to_json({{'hippo_name': 'batchetl.tagging', 'job_name': r.tag_id, 'job_id': r.tag_id || '_' || start_time,
  'update_frequency': upper(d.update_frequency), 'execute_time': {iso('cast(to_timestamp(finish_time) at time zone ' + "'UTC'" + ' as date)')},
  'duration_time': finish_time - start_time, 'finish_time': finish_time, 'is_success': r.status='Finish',
  'receive_msgs': coalesce(received, [])}}) as varchar) message
from recent r join (select tag_id, update_frequency from dict) d on d.tag_id = r.tag_id
left join held_list h on h.tag_id = r.tag_id and h.run_day = cast(to_timestamp(start_time) at time zone 'UTC' as date)
where r.status='Finish' or exists (select 1 from attempts a where a.tag_id=r.tag_id and a.seq=r.seq and attempt=3)""")

_cte("windowed", "select * from runs where start_date is not null")
_cte("scores", """
select start_date, end_date, entity_id, sum(amount) amount, count(*) n
from (select distinct start_date, end_date from windowed) join facts
on day between cast(start_date as date) and cast(end_date as date) group by all""")

ORACLE: dict[str, str] = {}


def _oracle(name: str, body: str, recursive: bool = False) -> None:
    ORACLE[name] = _sql(body, recursive)


def _json(column: str) -> str:
    return f"cast(to_json({column}) as varchar)"


SHOWN = f"""row_seq, tag_id, source_type, source_item, {_json('coalesce(tag_type, [])')} tag_type, tag_name, sql,
  update_frequency, started, traced, description, create_time, update_time, cast(disable_flag as varchar) disable_flag,
  score_method, attribute, creator, is_focus, system_name, {_json('coalesce(tickets, [])')} tickets"""
WRITTEN = "row_seq, tag_id, update_frequency, sql, attribute, system_name, started"
READABLE = "tag_id is not null and attribute is not null and system_name is not null"

_oracle("dict_scan", f"select {SHOWN} from dict")
_oracle("dict_get", """select t.tag_id, d.tag_id is not null as found, row_seq, update_frequency, sql
from (select distinct target_id tag_id from feed) t left join dict d on t.tag_id=d.tag_id""")
_oracle("dict_history_scan", f"""select row_seq, tag_id, {_json('coalesce(tag_type, [])')} tag_type, {_json('tickets')} tickets,
  sql, system_name from history where attribute is not null and system_name is not null""")
_oracle("dict_insert", f"select {WRITTEN} from dict union all select {WRITTEN} from feed")
_PAYLOAD = ["tag_id", "update_frequency", "sql", "attribute", "system_name", "started"]


def _replaced(stored: str, feed: str, target: str) -> str:
    columns = ", ".join(f"case when f.row_seq is null then s.{c} else f.{c} end {c}" for c in _PAYLOAD)
    return f"select s.row_seq, {columns} from {stored} s left join {feed} f on f.{target} = s.tag_id"


_oracle("dict_replace", _replaced("dict", "feed", "target_id"))
_oracle("dict_upsert", """select coalesce(d.row_seq, f.row_seq) row_seq, f.tag_id, f.update_frequency, f.sql, f.attribute,
  f.system_name, f.started from feed f left join dict d on d.tag_id = f.target_id""")
_oracle("dict_upsert_table", f"""{_replaced("dict", "feed", "target_id")}
union all select {WRITTEN} from feed where target_id not in (select tag_id from dict)""")
_oracle("dict_remove", f"select {WRITTEN} from dict where tag_id not in (select target_id from feed)")
_oracle("dict_missing", "select distinct target_id as tag_id from feed where target_id not in (select tag_id from dict)")
_oracle("history_insert", f"select {WRITTEN} from history union all select {WRITTEN} from dict")
_oracle("history_replace", _replaced("history", "dict", "tag_id"))
_oracle("history_remove", f"select {WRITTEN} from history where tag_id not in (select tag_id from dict)")
_oracle("dict_search", """select tag_id, source_type, tag_name from dict
where update_frequency='D' and score_method='sum' and source_item='ECONOMY'""")
_oracle("dict_search_type", """select tag_id, source_type, tag_name from dict
where score_method='sum' and tag_type = [{'type_L1': 'Brand#2', 'type_L2': 'ECONOMY'}]""")
_oracle("system_filter", "select row_seq, system_name from feed where lower(coalesce(system_name, 'none')) = 'ats'")
_oracle("dict_store_normalise", f"""select row_seq, tag_id, cast(coalesce(len(tag_type), 0) as integer) n_types,
  case when row_seq%13>0 then 1 else 0 end n_tickets from feed where {READABLE}""")
_oracle("dynamic_to_dictionary", f"select row_seq, {READABLE} and tag_type is not null as complete from feed")
_oracle("dict_json_validate", """
select row_seq, accepted, case when accepted then tag_id end tag_id, case when accepted then started end started from (
  select row_seq, tag_id, started, row_seq%41<>0 and not (row_seq%37=0 and started is not null)
    and not (row_seq%31=0 and (disable_flag is null or started is null or row_seq%37=0)) accepted from dict)""")
_oracle("dict_json_write", """select row_seq, cast(to_json({'tag_id': tag_id, 'source_type': source_type, 'source_item': source_item,
  'tag_type': coalesce(tag_type, []), 'tag_name': tag_name, 'sql': sql, 'update_frequency': update_frequency,
  'started': started, 'traced': traced, 'description': description, 'create_time': create_time,
  'update_time': update_time, 'disable_flag': disable_flag, 'score_method': score_method, 'attribute': attribute,
  'creator': creator, 'is_focus': is_focus, 'system_name': system_name, 'tickets': coalesce(tickets, [])}) as varchar) as value
from dict""")

_oracle("mapping_scan", "select * from mapping")
_oracle("mapping_enabled", "select row_seq, view_id from mapping where disabled_ind=''")
_oracle("mapping_classify", "select row_seq, freq, dbt, part from classified")
_oracle("view_split", "select * from split")
_oracle("view_map_last_wins", "select * from views")
_oracle("table_freq_last_wins", "select * from tfreq")
_oracle("frequency_conflicts", """select dbt, tfreq.freq used_freq, string_agg(distinct e.freq, ',' order by e.freq) freqs
from entries e join tfreq using (dbt) group by all having count(distinct e.freq) > 1""")

_oracle("sql_table_refs", """select tag_id, cast(generate_subscripts(r, 1) - 1 as integer) pos, unnest(r) as "view"
from (select tag_id, regexp_extract_all(sql, '(VP_BANK|vp_bank)[.]([a-z_A-Z0-9-]+)', 2) r from dict)""")
_oracle("dependency_resolve", "select * from deps")
_oracle("dependency_unresolved", """select tag_id, "view" from refs where "view" not in (select "view" from views)""")
_oracle("requirement_null_guard", "select tag_id from dict where tag_id not in (select tag_id from deps)")
_oracle("reverse_index", "select freq, dbt, part, tag_id from deps")
_oracle("reverse_index_sizes", "select freq, dbt, part, count(*) n_tags from deps group by all")
_oracle("forward_index", """select tag_id, update_frequency, cast(to_json(list({'freq': freq, 'dbt': dbt, 'part': part}
  order by freq, dbt, part nulls first)) as varchar) need from deps group by all""")
_oracle("registry_counts", """select (select count(*) from dict) n_tags,
  (select count(*) from (select distinct freq, dbt, part from deps)) n_tables""")
_oracle("need_messages", f"select tag_id, {_json('need')} need_msgs from needed")
_oracle("registry_lookup", "select distinct target_id as tag_id from feed where target_id in (select tag_id from dict)")
_oracle("registry_lookup_message", """select distinct m.freq, m.dbt, m.part from msgs m join deps t
on t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part""")
_oracle("requirement_update", """select u.tag_id, u.freq, u.dbt, u.part, coalesce(f.satisfied, false) satisfied
from updated_deps u left join flags f on f.tag_id=u.tag_id and f.freq=u.freq and f.dbt=u.dbt and f.part is not distinct from u.part""")
_oracle("registry_add", """select * from deps
union all select * from feed_deps where tag_id not in (select tag_id from dict)""")
_oracle("registry_update", "select * from updated_deps")
_oracle("registry_remove", "select * from deps where tag_id not in (select target_id from feed)")
_oracle("registry_stop", """select tag_id, case when tag_id in (select target_id from feed) then 'inactive'
  when tag_id in (select tag_id from awake) then 'active' else 'inactive' end status from dict""")
_oracle("tag_change_flow", """select * from deps where tag_id not in (select tag_id from feed_ok where upper(system_name) = 'ATS')
union all select * from feed_deps where tag_id in (select tag_id from feed_ok where upper(system_name) = 'ATS')""")
_oracle("registry_diff", """select tag_id, freq, dbt, part,
  case when max(o) = 0 then 'added' when max(n) = 0 then 'removed' else 'kept' end change
from (select tag_id, freq, dbt, part, 1 o, 0 n from deps union all select tag_id, freq, dbt, part, 0, 1 from updated_deps)
group by all""")

_oracle("frontier_source", "select event_id, epoch_us(ts) us, topic, value from log_json")
_oracle("frontier_topic_filter", "select event_id, topic from log where topic='frontier-adw'")
_oracle("message_json_parse", """select event_id, tbl as "table", db, method, exec_date,
  cast(to_json([pf]) as varchar) partition_fields, cast(to_json([pv]) as varchar) partition_values
from log where event_id%101 <> 0 and event_id%103 <> 0 and event_id%107 <> 0""")
_oracle("message_frequency_lookup", "select event_id, dbt, freq from parsed join tfreq using (dbt)")
_oracle("message_unmatched", """select * from (
  select event_id, case when event_id%101=0 or event_id%103=0 or event_id%107=0 then 'bad_json' when freq is null then 'unknown_table'
    when freq='D' and not bare and not regexp_matches(pv, '^[0-9]{4}(0[1-9]|1[0-2])$') then 'bad_month' end reason
  from parsed left join tfreq using (dbt)) where reason is not null""")
_oracle("message_normalise", "select event_id, epoch_us(ts) ts, topic, freq, dbt, part, pvalue, finish_time from msgs")
_oracle("message_key", "select event_id, freq, dbt, part from msgs")
_oracle("message_views", """select event_id,
  cast(to_json({'topic': cast(null as varchar), 'freq': freq, 'dbt': dbt, 'part': part, 'pvalue': cast(null as varchar)}) as varchar) blank,
  cast(to_json({'kafkaTopic': topic, 'update_frequency': freq, 'value': dbt, 'partition_fields': part,
    'partition_values': pvalue, 'finish_time': finish_time}) as varchar) shown from msgs""")
_oracle("message_gate", "select event_id, freq, dbt, part, pvalue from counted")
_oracle("late_messages", """select event_id, freq, pvalue, case when part is null then 'unpartitioned_monthly'
  when pvalue is null then 'future_month' when pvalue < target then 'behind_target' else 'ahead_of_target' end reason
from targets where event_id not in (select event_id from counted)""")
_oracle("message_route", """select event_id, tag_id, m.freq, m.dbt, m.part from msgs m join deps t
on t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part""")
_oracle("message_no_subscriber", """select event_id, freq, dbt, part from msgs m where not exists (
  select 1 from deps t where t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part)""")
_oracle("activate_on_message", """select tag_id, epoch_us(ts) first_message_ts, event_id from (
  select tag_id, ts, event_id from msgs m join deps t
  on t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part)
qualify row_number() over (partition by tag_id order by ts, event_id) = 1""")

_oracle("as_of_date", f"select event_id, {iso('ts')} as_of, '{DAY}' as_of_fixed from events")
_oracle("daily_date", f"select o_orderkey, {iso(daily('cast(o_orderdate as date)'))} daily_date from orders")
_oracle("last_month", f"""select o_orderkey, {last_month('cast(o_orderdate as date)')} last_month,
  {last_month('cast(o_orderdate as date)', 12)} last_month_12 from orders""")
_oracle("month_to_date", f"""select event_id, pv as value,
  case when regexp_matches(pv, '^[0-9]{{4}}(0[1-9]|1[0-2])$') then {real_date('pv', 'd')} end real_date from parsed""")
_RUN_DAY = """(select r.tag_id, seq, cast(to_timestamp(start_time) at time zone 'UTC' as date) d, update_frequency, started, traced
  from reports r join dict using (tag_id))"""
_oracle("window_start", f"select tag_id, seq, {iso(w_start('update_frequency', 'd', 'started'))} window_start from {_RUN_DAY}")
_oracle("window_end", f"""select tag_id, seq, {iso(w_end('update_frequency', 's', 'traced'))} window_end
from (select *, {w_start('update_frequency', 'd', 'started')} s from {_RUN_DAY})""")
_oracle("current_month", "select event_id, strftime(ts, '%Y%m') current_month from events")
_oracle("day_of_month", """select event_id, strftime(make_date(year(ts), month(ts), event_id%28+1), '%Y-%m-%d') day_of_month
from events""")
_oracle("reset_day_flag", """select o_orderkey, day(o_orderdate)=2 reset_day, day(o_orderdate)=12 reset_day_12 from orders""")

_oracle("readiness", "select tag_id, update_frequency, cycle, epoch_us(ready_ts) ready_us from ready")
_oracle("readiness_now", """select tag_id, coalesce(bool_and(satisfied) filter (freq='D'), true)
  and coalesce(bool_and(satisfied) filter (freq='M'), true) is_ready from flags group by tag_id""")
_oracle("monthly_clear", """select tag_id, not coalesce(bool_or(satisfied) filter (freq='M'), false) monthly_clear
from flags group by tag_id""")
_oracle("active_tags", "select tag_id from awake")
_oracle("receive_message", """select tag_id, t.freq, t.dbt, t.part, cycle, epoch_us(first_ts) first_us from deps t join arrivals a
on t.freq=a.freq and t.dbt=a.dbt and t.part is not distinct from a.part""")
_oracle("receive_messages", f"""select r.tag_id, r.cycle, c.event_id, c.freq, c.dbt, c.part, c.pvalue, c.finish_time
from ready_m r join deps t on t.tag_id = r.tag_id
join counted c on t.freq=c.freq and t.dbt=c.dbt and t.part is not distinct from c.part and c.ts <= r.ready_ts
  and case when c.freq='D' then c.d = r.as_of else c.lm = r.target_month end""")
_oracle("stale_reset", f"""select tag_id, freq, dbt, part, f.pvalue, satisfied, case when f.pvalue is null or f.pvalue =
  case when freq='D' then {iso(daily('(d + 1)'))} else {last_month('(d + 1)')} end then satisfied else false end revived
from flags f, clock k""")
_oracle("cutoff_reset", f"""select event_id, {iso('d')} as_of, {iso('cd + 1')} cycle_close, {last_month('cd')} cycle_month,
  case when day(cd + 1) = 2 then 'both' else 'daily' end cleared from (select *, {CYCLE_DAY_CUT} cd from msgs)""")

# with a cutoff inside the day
_cte("c_hits", f"select *, {CYCLE_DAY_CUT} cd from counted")
_cte("c_arrivals", f"""
select freq, dbt, part, case when freq='D' then {iso('cd')} else {last_month('cd')} end as cycle, min(ts) first_ts
from c_hits group by all""")
_cte("c_got", """
select t.tag_id, a.freq, a.cycle, count(*) n, max(first_ts) ts from deps t join c_arrivals a
on t.freq=a.freq and t.dbt=a.dbt and t.part is not distinct from a.part group by all""")
_cte("c_days", f"select *, {CYCLE_DAY_CUT} cd from c_got")
_cte("c_ready", f"""
select n.tag_id, n.update_frequency, cycle, ts ready_ts from need_n n join c_days g on g.tag_id=n.tag_id
  and ((g.freq='D' and g.n=nd and nm=0) or (g.freq='M' and g.n=nm and nd=0))
union all
select n.tag_id, n.update_frequency, g.cycle, greatest(g.ts, h.ts) from need_n n
join c_days g on g.tag_id=n.tag_id and g.freq='D' and g.n=nd
join c_days h on h.tag_id=n.tag_id and h.freq='M' and h.n=nm
  and h.cycle = {last_month('cast(g.cycle as date)')} and h.cd <= cast(g.cycle as date)
where nd>0 and nm>0""")
_oracle("readiness_cutoff", f"""select tag_id, update_frequency, cycle, epoch_us(ready_ts) ready_us, target_month from (
  select *, {last_month('cast(ready_ts as date)')} target_month from c_ready)
qualify update_frequency='D' or row_number() over (partition by tag_id, target_month order by ready_ts, cycle) = 1""")
_cte("wakes", f"""
select distinct freq, dbt, part, cd, ts, event_id in (select event_id from counted) as hit from (select *, {CYCLE_DAY_CUT} cd from msgs)""")
_cte("report_days", f"""
select distinct t.tag_id, d.report_day, d.report_day + interval '12 hours 5 minutes' report_ts
from (select distinct cast(unnest(generate_series((select min(d) from msgs), (select max(d) from msgs), interval 1 day)) as date) report_day) d
join wakes w on w.ts <= d.report_day + interval '12 hours 5 minutes'
  and (w.cd = d.report_day - 1 or w.hit and w.freq='M' and {last_month('w.cd')} = {last_month('(d.report_day - 1)')})
join deps t on t.freq=w.freq and t.dbt=w.dbt and t.part is not distinct from w.part""")
_oracle("unfinished_report", f"""select r.tag_id, {iso('report_day')} report_day, string_agg(distinct t.dbt, ',' order by t.dbt) missing
from report_days r join deps t on t.tag_id=r.tag_id
left join c_arrivals a on t.freq=a.freq and t.dbt=a.dbt and t.part is not distinct from a.part and a.first_ts <= report_ts
  and a.cycle = case when t.freq='D' then {iso('report_day - 1')} else {last_month('(report_day - 1)')} end
where a.dbt is null group by r.tag_id, report_day""")
_cte("monthly_runs", f"""
select r.tag_id, seq, status, {last_month("cast(to_timestamp(start_time) at time zone 'UTC' as date)")} target_month
from reports r join dict using (tag_id) where update_frequency='M'""")
_oracle("monthly_once_guard", """select tag_id, target_month, seq from monthly_runs a where status='Start' and not exists (
  select 1 from monthly_runs b where b.status='Finish' and b.tag_id=a.tag_id and b.target_month=a.target_month and b.seq < a.seq)""")

_oracle("sql_compose", f"""select tag_id, status, case when status='dated' then
  replace(replace(raw, '$start_date', {iso('sd')}), '$end_date', {iso('ed')}) when status='plain' then raw end sql,
  case when status='dated' then {iso('sd')} end start_date, case when status='dated' then {iso('ed')} end end_date from composed""")
_RUN_COLUMNS = ["tag_id", "source_type", "source_item", "tag_type", "tag_name", "sql", "update_frequency", "started",
                "traced", "score_method", "attribute", "start_date", "end_date", "execute_date", "system_name"]
_oracle("compose_projection", "select " + ", ".join(
    f"{_json('tag_type')} tag_type" if c == "tag_type" else c for c in _RUN_COLUMNS) + " from runs")
_SPOOL = "cast(to_json({" + ", ".join(f"'{c}': {c}" for c in _RUN_COLUMNS) + "}) as varchar) as value"
_oracle("composed_run_sink", f"select tag_id || '_' || execute_date as name, {_SPOOL}, execute_date from runs")
_oracle("compose_json_validate", """select tag_id || '_' || execute_date as name,
  (started is null) = (start_date is null) accepted from runs""")
_cte("two_days", "select tag_id, e.d execute_date from runs, (values ('1998-09-22'), ('1998-09-23')) e(d)")
_oracle("spool_cleanup", """select tag_id || '_' || execute_date as name from two_days w
where not exists (select 1 from run_reports r where status='Finish' and r.tag_id=w.tag_id and r.execute_date=w.execute_date)""")
_oracle("run_report_join", "select tag_id, seq, status, execute_date, start_time from two_days join run_reports using (tag_id, execute_date)")
_oracle("run_duration", """select tag_id, count(*) n_runs, min(finish_time-start_time) min_seconds,
  max(finish_time-start_time) max_seconds, cast(sum(finish_time-start_time) as bigint) sum_seconds
from reports where status='Finish' group by tag_id""")
_oracle("retry_accounting", "select tag_id, seq, attempt, case when attempt=3 then 'give_up' else 'retry' end as action from attempts")
_oracle("schedule_batches", """select update_frequency, min(us) first_us, max(us) last_us, cast(sum(c) as bigint) n, max(us) + 20000000 submit_us from (
  select update_frequency, us, c, sum(o) over (partition by update_frequency order by us rows unbounded preceding) b from (
    select update_frequency, us, c, case when us - lag(us) over (partition by update_frequency order by us) >= 20000000 then 1 else 0 end o
    from (select update_frequency, epoch_us(ready_ts) us, count(*) c from guarded group by all)))
group by update_frequency, b""")
_oracle("messages_ignored", """select distinct m.event_id, t.tag_id from msgs m
join deps t on t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part
join recent r on r.tag_id=t.tag_id and r.status <> 'Start'
  and epoch_us(m.ts) >= r.start_time*1000000 and epoch_us(m.ts) < r.finish_time*1000000""")
_oracle("post_success_reset", f"""select tag_id, seq, t.freq, t.dbt, t.part,
  not (n.update_frequency='D' and nd>0 and nm>0 and t.freq='M') cleared,
  case when n.update_frequency='M' then {last_month("cast(to_timestamp(finish_time) at time zone 'UTC' as date)")} end remembered
from reports r join deps t using (tag_id) join need_n n using (tag_id) where r.status='Finish'""")
_oracle("failed_reset", """select tag_id, seq, freq, dbt, part, freq='D' cleared from attempts join deps using (tag_id) where attempt=3""")
_oracle("start_message", "select * from starts")
_oracle("finish_message", "select * from finishes")
_oracle("start_message_sink", "select 'hippo-start' topic, 'tagKey' as key, message as value from starts")
_oracle("finish_message_sink", "select 'hippo-finish' topic, 'tagKey' as key, message as value from finishes")

# rounds: follow, from each round's end, the next message that completes the set again
_cte("u_need", "select tag_id, freq, dbt, part, nd, nm, update_frequency from deps join need_n using (tag_id, update_frequency)")
_cte("u_month", f"""
select tag_id, cycle as month, max({{'ts': first_ts, 'id': id}}) done from (
  select tag_id, nm, lm as cycle, c.dbt, c.part, min(ts) first_ts, arg_min(event_id, (ts, event_id)) id
  from u_need u join counted c on u.freq=c.freq and u.dbt=c.dbt and u.part is not distinct from c.part
  where u.freq='M' and nd>0 group by all) group by tag_id, nm, cycle having count(*) = nm""")
_cte("u_side", """
select tag_id, nd, nm, freq, dbt, part, case when nd>0 then nd else nm end k from u_need where freq='D' or nd=0""")
_cte("u_hits", f"""
select tag_id, case when c.freq='D' then {iso('d')} else lm end as cycle, c.dbt, c.part, ts, event_id, k,
  case when c.freq='D' and nm>0 then lm end as month
from u_side u join counted c on u.freq=c.freq and u.dbt=c.dbt and u.part is not distinct from c.part""")
_cte("u_events", f"""
select h.*, done, row_number() over (partition by h.tag_id, cycle order by h.ts, h.event_id) pos,
  coalesce((h.ts < done.ts) or (h.ts = done.ts and h.event_id < done.id), false) waiting
from u_hits h left join u_month m on m.tag_id=h.tag_id and m.month=h.month where h.month is null or done is not null""")
_cte("u_next", """
select i.tag_id, i.cycle, i.pos, max(nxt) as next_pos from (
  select a.tag_id, a.cycle, a.pos, a.k, b.dbt, b.part, min(b.pos) nxt
  from (select tag_id, cycle, pos, k from u_events union all select distinct tag_id, cycle, 0, k from u_events) a
  join u_events b on b.tag_id=a.tag_id and b.cycle=a.cycle and b.pos > a.pos group by all) i
group by i.tag_id, i.cycle, i.pos, i.k having count(*) = i.k""")
_cte("u_first", """
select tag_id, cycle, case when next_pos > last_waiting then next_pos else last_waiting + 0.5 end pos, done, last_waiting from (
  select n.tag_id, n.cycle, n.next_pos, w.last_waiting, w.done from u_next n join (
    select tag_id, cycle, coalesce(max(pos) filter (waiting), 0) last_waiting, any_value(done) done from u_events group by all) w
  using (tag_id, cycle) where n.pos = 0)
where next_pos > last_waiting or strftime(done.ts, '%Y-%m-%d') = cycle""")
_ROUNDS = f"""
select tag_id, update_frequency, cycle, event_id, epoch_us(ts) ready_us from (
  select c.tag_id, n.update_frequency, c.cycle, coalesce(e.event_id, c.done.id) event_id, coalesce(e.ts, c.done.ts) ts,
    {last_month('cast(coalesce(e.ts, c.done.ts) as date)')} as month
  from u_chain c join need_n n using (tag_id) left join u_events e on e.tag_id=c.tag_id and e.cycle=c.cycle and e.pos=c.pos)
qualify update_frequency='D' or row_number() over (partition by tag_id, month order by ts, event_id) = 1"""
_CHAIN = """u_chain as (
  select tag_id, cycle, pos, done from u_first
  union all
  select c.tag_id, c.cycle, cast(n.next_pos as double), c.done from u_chain c join u_next n
  on n.tag_id=c.tag_id and n.cycle=c.cycle and n.pos = floor(c.pos))"""
_head = _sql("select 1 from u_first, u_next, need_n, u_events", recursive=True)
_rounds_sql = _head[: _head.rindex("\nselect 1 from")] + ",\n" + _CHAIN + _ROUNDS
ORACLE["readiness_rounds"] = _rounds_sql
ORACLE["readiness_stream"] = _rounds_sql
_oracle("status_stream", f"""
select tag_id, update_frequency, cycle, event_id, status,
  case when status='dated' then replace(replace(raw, '$start_date', {iso('s')}), '$end_date', {iso('e')})
       when status='plain' then raw end sql,
  case when status='dated' then {iso('s')} end start_date, case when status='dated' then {iso('e')} end end_date
from (select *, {w_end('update_frequency', 's', 'traced')} e from (
  select r.*, d.sql raw, started, traced, {w_start('r.update_frequency', 'cast(make_timestamp(ready_us) as date)', 'started')} s,
    case when not contains(d.sql, '$') then 'plain' when started is null or traced is null then 'error' else 'dated' end status
  from ({_rounds_sql}) r join ({_sql("select tag_id, sql, started, traced from dict")}) d using (tag_id)))""")

# transitions: each tag's messages and reports in order of time, one row after the other
_cte("t_events", f"""
select *, row_number() over (partition by tag_id order by us, id) pos from (
  select t.tag_id, t.update_frequency uf, nd, nm, epoch_us(m.ts) us, m.event_id id, '' status, m.freq, m.dbt || '|' || coalesce(m.part, '~') k,
    m.event_id in (select event_id from counted) hit, {iso('m.d')} dy, {last_month('m.d')} mo, '' rd
  from msgs m join deps t on t.freq=m.freq and t.dbt=m.dbt and t.part is not distinct from m.part
  join need_n n on n.tag_id=t.tag_id
  union all
  select r.tag_id, n.update_frequency, nd, nm, finish_time * 1000000, seq, status, '', '', false, {iso('f')}, {last_month('f')}, {iso('b')}
  from (select *, cast(to_timestamp(finish_time) at time zone 'UTC' as date) f,
    cast(to_timestamp(start_time) at time zone 'UTC' as date) b from recent) r join need_n n on n.tag_id=r.tag_id)""")


def _step(f: str, t: str, r: str) -> str:
    return f"{{'f': {f}, 't': {t}, 'r': {r}}}"


_HELD = "case when len({0}) > 0 then 'Receiving' else 'Waiting' end"
_WHY = "case when len({0}) > 0 then 'monthly_held' else 'stopped' end"
# the state before a row, the row, and what the cutoffs between them leave
_AFTER_CUTOFF = f"""
select *, case when cut then {_HELD.format('ml1')} else st end st1, case when cut then 0 else fl end fl1,
  case when cut then [{_step('st', "'Verifying'", "'cutoff'")}, {_step("'Verifying'", _HELD.format('ml1'), _WHY.format('ml1'))}] else [] end s1 from (
  select *, later and dy <> '' and st in ('Receiving', 'Running') cut, case when later then [] else dl end dl1,
    case when later and mo <> e_mo then [] else ml end ml1, case when later then e_dy else dy end dy1,
    case when later and mo <> e_mo then e_mo else mo end mo1 from (
    select c.*, e.uf, e.nd, e.nm, e.us, e.id, e.status, e.freq, e.k, e.hit, e.dy e_dy, e.mo e_mo, e.rd e_rd, e.dy > c.dy later
    from t_chain c join t_events e on e.tag_id=c.tag_id and e.pos=c.pos + 1))"""
_KIND = f"""
select *, case when status = '' and (st1 = 'Running' or st1 = 'Waiting' and uf = 'M' and rm = e_mo) then 'none' when status = '' then 'message'
    when status = 'Start' then 'none' when st1 <> 'Running' or rd <> e_rd then 'other' when status = 'Finish' then 'finish' else 'fail' end kind,
  case when hit and freq = 'D' then list_distinct(list_append(dl1, k)) else dl1 end dl2,
  case when hit and freq = 'M' then list_distinct(list_append(ml1, k)) else ml1 end ml2,
  case when uf = 'M' or not (nd > 0 and nm > 0) then [] else ml1 end ml3 from ({_AFTER_CUTOFF})"""
_CHAIN_T = f"""t_chain as (
  select distinct tag_id, cast(0 as bigint) pos, 'Waiting' st, cast([] as varchar[]) dl, cast([] as varchar[]) ml, '' dy, '' mo, '' rm,
    0 fl, '' rd, cast(0 as bigint) at_us, cast(0 as bigint) at_id, cast([] as struct(f varchar, t varchar, r varchar)[]) steps from t_events
  union all
  select tag_id, pos + 1,
    case kind when 'message' then case when ready then 'Running' else 'Receiving' end when 'finish' then {_HELD.format('ml3')}
      when 'fail' then case when fl1 = 2 then 'Receiving' else 'Running' end else st1 end,
    case kind when 'message' then dl2 when 'finish' then [] when 'fail' then case when fl1 = 2 then [] else dl1 end else dl1 end,
    case kind when 'message' then ml2 when 'finish' then ml3 else ml1 end, dy1, mo1,
    case when kind = 'finish' and uf = 'M' then e_mo else rm end,
    case kind when 'finish' then 0 when 'fail' then (fl1 + 1) % 3 else fl1 end,
    case when kind = 'message' and ready then e_dy else rd end, us, id,
    list_concat(s1, case kind
      when 'message' then list_concat(case when st1 = 'Waiting' then [{_step("'Waiting'", "'Receiving'", "'first_message'")}] else [] end,
        case when ready then [{_step("'Receiving'", "'Running'", "'ready'")}] else [] end)
      when 'finish' then [{_step("'Running'", "'Verifying'", "'finished'")}, {_step("'Verifying'", _HELD.format('ml3'), _WHY.format('ml3'))}]
      when 'fail' then [case when fl1 = 2 then {_step("'Running'", "'Receiving'", "'gave_up'")} else {_step("'Running'", "'Running'", "'retry'")} end]
      when 'other' then [{_step('st1', 'st1', "'other_run'")}] else [] end)
  from (select *, kind = 'message' and hit and len(dl2) = nd and len(ml2) = nm ready from ({_KIND})))
select tag_id, at_us us, at_id event_id, cast(generate_subscripts(steps, 1) - 1 as integer) seq, unnest(steps).f from_state,
  unnest(steps).t to_state, unnest(steps).r reason from t_chain where len(steps) > 0"""
_head = _sql("select 1 from t_events", recursive=True)
ORACLE["transition_log"] = _head[: _head.rindex("\nselect 1 from")] + ",\n" + _CHAIN_T

# tags that run their own SQL wait for one view each
_cte("nation_runs", f"""
select * from (
  select t.*, a.first_ts ready_ts, cast(a.first_ts as date) as_of, {last_month('cast(a.first_ts as date)')} target_month, a.cycle
  from (select n_nationkey k, 'NATION_' || n_nationkey tag_id, case when n_nationkey%3=0 then 'M' else 'D' end f,
    'v_' || (n_nationkey%n) v from nation, n_s) t
  join views on views."view" = t.v
  join arrivals a on a.freq=views.freq and a.dbt=views.dbt and a.part is not distinct from views.part)
qualify f='D' or row_number() over (partition by tag_id, target_month order by ready_ts, cycle) = 1""")
_oracle("run_ready_tags", f"""select entity_id, tag_id, round(score, 2) score, start_date, end_date, execute_date from (
  select o_custkey entity_id, tag_id, case when k%2=0 then cast(sum(cast(o_totalprice as decimal(18,2))) as double)
    else cast(count(*) as double) end score, {iso('s')} start_date, {iso('e')} end_date, {iso('as_of')} execute_date
  from (select *, {w_end('f', 's', '(1 + k%3)')} e from (select *, {w_start('f', 'as_of', '(-(1 + k%6))')} s from nation_runs where k%7<>3))
  join customer on c_nationkey=k
  join orders on o_custkey=c_custkey and date '2023-06-01' + cast(o_orderkey%245 as integer) between s and e
  group by o_custkey, tag_id, k, s, e, as_of)""")
_oracle("run_ready_tags_report", f"""select tag_id, execute_date, unnest(steps) status from (
  select tag_id, {iso('as_of')} execute_date, case when k%7=3
    then ['Start', 'NonFinish', 'Start', 'NonFinish', 'Start', 'NonFinish'] else ['Start', 'Finish'] end steps from nation_runs)""")
_oracle("run_windowed_tags", """select entity_id, tag_id, cast(case when score_method='sum' then cast(amount as double) else n end as double) score,
  start_date, end_date, execute_date, cast(amount as double) amount from windowed join scores using (start_date, end_date)""")
_oracle("tag_coverage", """
select level, name, count(distinct tag_id) n_tags, count(distinct entity_id) n_entities from (
  select 'tag' as level, tag_id as name, tag_id, start_date, end_date from windowed
  union all select 'source_type', source_type, tag_id, start_date, end_date from windowed
  union all select 'tag_type', t.type_L1 || '/' || t.type_L2, tag_id, start_date, end_date from (
    select unnest(tag_type) t, tag_id, start_date, end_date from windowed))
left join scores using (start_date, end_date) group by level, name""")
_oracle("tag_status_flow", f"""
select tag_id, update_frequency, cycle, epoch_us(ready_ts) ready_us, target_month, status,
  case when status='dated' then {iso('s')} end start_date, case when status='dated' then {iso('e')} end end_date,
  case when status='dated' then replace(replace(raw, '$start_date', {iso('s')}), '$end_date', {iso('e')})
       when status='plain' then raw end sql
from (select *, {w_end('update_frequency', 's', 'traced')} e from (
  select g.*, d.sql raw, started, traced, {w_start('g.update_frequency', 'g.as_of', 'started')} s,
    case when not contains(d.sql, '$') then 'plain' when started is null or traced is null then 'error' else 'dated' end status
  from guarded g join dict d using (tag_id)))""")

ORACLE["live_transitions"] = ORACLE["transition_log"]
ORACLE["messages_ignored_stream"] = ORACLE["messages_ignored"]
ORACLE["submit_batches_stream"] = f"""select update_frequency, min(us) first_us, max(us) last_us, cast(sum(c) as bigint) n, max(us) + 20000000 submit_us from (
  select update_frequency, us, c, sum(o) over (partition by update_frequency order by us rows unbounded preceding) b from (
    select update_frequency, us, c, case when us - lag(us) over (partition by update_frequency order by us) >= 20000000 then 1 else 0 end o
    from (select update_frequency, ready_us us, count(*) c from ({_rounds_sql}) group by all)))
group by update_frequency, b"""
ORACLE["live_unfinished"] = ORACLE["unfinished_report"]
ORACLE["live_runs"] = f"select tag_id, event_id, reason, us from ({ORACLE['transition_log']}) where reason in ('ready', 'retry')"
_oracle("live_late", """select event_id, 'message' source, us, watermark_us from (
  select event_id, epoch_us(ts) us, cast(max(greatest_us) over (order by file range between unbounded preceding and 1 preceding) as bigint) top,
    top // 1000 * 1000 - 3600000000 watermark_us
  from (select event_id, ts, epoch_us(ts) greatest_us, epoch_us(ts) // 259200000000 + case when event_id % 50 = 0 then event_id % 2 + 1 else 0 end file
        from log where topic = 'frontier-adw')) join (select event_id from msgs) using (event_id) where us <= watermark_us""")
