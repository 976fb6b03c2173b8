"""Reference SQL (DuckDB) for the registered queries. Each statement starts from the driver's tables.

Windows are plain RANGE or ROWS frames and the cooldown is a recursion here: short and slow forms of what the
operators do with growing sums and chunks, so the two sides share no method.
"""

from __future__ import annotations

from math import log

from fileguard.plans.settings import BURST_US, DELAY_SECONDS, HMM, PARAMS, PARTS, SINCE_ID
from fileguard.schemas import FEATURES

EVENTS = """
b as (select event_id as id, user_id, event_type as et, cast(epoch_us(ts) as double)/1000000.0 as t,
             user_id%2 as drive_id, user_id*5+event_id%5 as stable_id from events),
c as (select *, floor(t/86400) as dy from b),
d as (select *, (dy - floor(dy/5)*5)=0 as burst from c),
e as (select id, drive_id, stable_id,
        case et when 'click' then 'MODIFIED' when 'view' then 'CREATED' when 'purchase' then 'RENAMED'
                when 'signup' then 'TRASHED' else 'DELETED' end as event_type,
        case when burst then dy*86400+(t-dy*86400)/1200 else t end as ts_s,
        concat('document_', cast(stable_id as varchar(20)),
          case when burst and drive_id=0 and et='purchase' then '.encrypted' when id%5=0 then '.docx'
               when id%5=1 then '.txt' when id%5=2 then '.exe' when id%5=3 then '' else '.tar.gz' end) as local_title,
        case when id%3=0 then 'MyProject/SubFolder/' when id%3=1 then 'Users/AppData/' else 'Photos/' end as folder from d),
fe as (select id, ts_s as "timestamp", cast(round(ts_s*1000000) as bigint) as ts_us, drive_id, stable_id, event_type,
              local_title, concat(folder,local_title) as full_path from e)
"""

_TRAIL = "over (partition by drive_id order by ts_us range between 60000000 preceding and current row)"
_WRITE = "event_type in ('MODIFIED','CREATED','RENAMED')"
_TOKEN = "case when event_type='RENAMED' then regexp_extract(local_title,'([^.]*)$',1) end"

MEASURES = f"""
m as (select *, sum(case when {_WRITE} then 1 else 0 end) {_TRAIL} as recent_writes,
             sum(case when event_type='RENAMED' then 1 else 0 end) {_TRAIL} as recent_renames,
             count(distinct {_TOKEN}) {_TRAIL} as rename_extensions,
             count(distinct stable_id) {_TRAIL} as recent_files from fe),
fl as (select *, recent_writes > 50 as high_velocity,
              recent_renames >= 5 and rename_extensions = 1 as systematic_rename from m)
"""


def _extension(name: str) -> str:
    return rf"regexp_extract({name}, '(?s)^(?:.*[/\\])?\.*[^./\\][^/\\]*?(\.[^./\\]*)$', 1)"


# Entropy per distinct name, summed over repeat counts in order so that equal repeats give equal numbers; the longest common subsequence by trying every subsequence of every extension.
FEATURE_STEPS = f"""
ch as (select local_title, length(local_title) as n, unnest(string_split(local_title,'')) as x
       from (select distinct local_title from fe)),
rep as (select local_title, n, k, count(*) as m from (select local_title, x, any_value(n) as n, count(*) as k
        from ch group by local_title, x) group by local_title, n, k),
ent as (select local_title, greatest(log2(n)-sum(m*(k*log2(k)) order by k)/n, 0) as h from rep group by local_title, n),
pv as (select *, case when stable_id<>0 then lag(local_title) over (partition by drive_id, stable_id order by id) end
                   as previous_title from fl),
ex as (select *, {_extension('previous_title')} as old_ext, {_extension('local_title')} as new_ext from pv),
exts as (select distinct x from (select old_ext as x from ex where old_ext is not null union select new_ext from ex)),
subs as (select x, unnest(range(cast(pow(2,length(x)) as bigint))) as mask from exts),
sub as (select x, array_to_string(list_transform(list_filter(range(1,length(x)+1), lambda i: (mask >> (i-1)) & 1 = 1),
                                                 lambda i: substr(x,i,1)),'') as s from subs),
lcs as (select l.x as a, r.x as b, max(length(l.s)) as n from (select distinct * from sub) l
        join (select distinct * from sub) r on l.s=r.s group by l.x, r.x),
ft as (select ex.id, ex."timestamp", ex.ts_us, ex.drive_id, ex.stable_id, ex.event_type, ex.local_title, ex.full_path,
  ex.recent_writes, ex.recent_renames, ex.rename_extensions, ex.recent_files, ex.high_velocity, ex.systematic_rename,
  ex.previous_title,
  cast(event_type in ('DELETED','TRASHED') as int) as file_delete_archived,
  cast(event_type='CREATED' as int) as file_created,
  cast(regexp_matches(lower(ex.local_title),'(\\.exe|\\.bat|\\.ps1)$') as int) as process_related,
  1 as network_related, 1 as file_related,
  cast(regexp_matches(lower(full_path),'appdata|temp|tmp|programdata|userprofile') as int) as suspicious_path,
  cast(regexp_matches(lower(ex.local_title),'(\\.exe|\\.dll)$') as int) as system_executable,
  length(full_path) as path_length, length(full_path)-length(replace(full_path,'/','')) as directory_depth,
  length(ex.local_title) as process_name_length,
  case when event_type<>'RENAMED' or coalesce(previous_title,'')='' then 1.0
       when length(old_ext)+length(new_ext)=0 then 1.0
       else 2.0*lcs.n/(length(old_ext)+length(new_ext)) end as extension_similarity,
  coalesce(ent.h, 0) as file_name_entropy
  from ex left join ent on ent.local_title=ex.local_title left join lcs on lcs.a=ex.old_ext and lcs.b=ex.new_ext)
"""

_CARD = PARAMS.scorecard
_LINEAR = " + ".join([repr(_CARD.intercept) + "::double", *[f"({w!r}::double*{n})" for n, w in _CARD.weights.items()]])

SCORES = f"""
sc as (select *, 1.0::double/(1.0::double+exp(-({_LINEAR}))) as score from ft),
fu0 as (select *, score/(1.0::double-score+1e-9::double)*(case when high_velocity then 3.0 else 1.0 end)::double
                 *(case when systematic_rename then 4.0 else 1.0 end)::double as odds from sc),
fu as (select *, odds/(1.0::double+odds) as fused from fu0)
"""


def _density(state: int) -> str:
    mu, var = HMM.mu[state], HMM.var[state]
    return (
        f"(-(file_name_entropy-{mu!r}::double)*(file_name_entropy-{mu!r}::double)/{2 * var!r}::double"
        f"-({0.5 * log(var)!r}::double))"
    )


_A = [[f"({log(p)!r}::double)" for p in row] for row in HMM.a]
_PI = [f"({log(p)!r}::double)" for p in HMM.pi]

STATES = f"""
em as (select *, {{'d0': {_density(0)}, 'd1': {_density(1)}}} as o from fu),
sq as (select *, list(o) over (partition by drive_id order by id rows 14 preceding) as obs,
              list(file_name_entropy) over (partition by drive_id order by id rows 14 preceding) as entropies from em),
vt as (select *, case when length(obs)=15 then list_reduce(
         list_transform(obs, lambda x, i: case when i=1 then {{'d0': x.d0+{_PI[0]}, 'd1': x.d1+{_PI[1]}}} else x end),
         lambda acc, x: {{'d0': greatest(acc.d0+{_A[0][0]}, acc.d1+{_A[1][0]})+x.d0,
                         'd1': greatest(acc.d0+{_A[0][1]}, acc.d1+{_A[1][1]})+x.d1}}) end as v from sq),
hm as (select *, case when v is not null then cast(v.d1>v.d0 as int) end as state,
              case when v is not null then v.d1>v.d0 end as malicious from vt)
"""

BATCHES = """
bt0 as (select *, cast(floor(ts_us/3000000.0) as bigint) as batch from hm),
bt1 as (select *, coalesce(max(greatest(fused, case when malicious then 0.85::double else 0.0::double end)) over (
                    partition by drive_id, batch order by id rows between unbounded preceding and 1 preceding), 0) as before
        from bt0),
bt as (select drive_id, batch, count(*) as events, max(ts_us) as ts_us,
              arg_max(recent_files, ts_us) as affected_files_count, coalesce(bool_or(malicious), false) as hmm_hit,
              greatest(max(fused), max(case when malicious then 0.85::double end)) as threat,
              max(case when fused > before then id end) as trigger_id
       from bt1 group by drive_id, batch)
"""

LEVEL = """case when threat >= 0.9 then 'CRITICAL' when threat >= 0.75 then 'HIGH'
                when threat >= 0.5 then 'MEDIUM' else 'LOW' end"""

ALERTS = f"""
ga as (select *, min(ts_us) over (partition by drive_id order by ts_us
                   range between 30000000 following and unbounded following) as next_us from bt where threat >= 0.5),
keep as (select drive_id, min(ts_us) as ts_us from ga group by drive_id
         union all select keep.drive_id, ga.next_us from keep join ga on ga.drive_id=keep.drive_id and ga.ts_us=keep.ts_us
                   where ga.next_us is not null),
al0 as (select ga.*, {LEVEL} as threat_level from ga join keep on ga.drive_id=keep.drive_id and ga.ts_us=keep.ts_us),
al as (select *, coalesce(bool_or(threat_level in ('HIGH','CRITICAL')) over (partition by drive_id order by ts_us
                   rows between unbounded preceding and 1 preceding), false) as sync_paused from al0)
"""

ATTACKS = """
su as (select *, fused >= 0.5 or coalesce(malicious,false) as suspicious from hm),
s1 as (select drive_id, ts_us, stable_id, fused, ts_us - lag(ts_us) over (partition by drive_id order by ts_us, id) as gap,
              id from su where suspicious),
s2 as (select *, sum(case when gap is null or gap > 60000000 then 1 else 0 end) over (
                   partition by drive_id order by ts_us, id) as attack_no from s1),
ses as (select drive_id, cast(attack_no as bigint) as attack_no, min(ts_us) as start_us, max(ts_us) as end_us,
               max(ts_us)-min(ts_us) as duration_us, count(*) as events, count(distinct stable_id) as files,
               max(fused) as peak_score from s2 group by drive_id, attack_no),
ae as (select su.*, ses.attack_no, ses.start_us, ses.end_us from su join ses
       on su.drive_id=ses.drive_id and su.ts_us between ses.start_us and ses.end_us)
"""

SNAPS = """
cu as (select 0::bigint as drive_id, p_partkey stable_id,
       case when p_partkey%7=3 then concat(p_name,'.encrypted') else concat(p_name,'.docx') end local_title,
       case when p_partkey%5=2 then 2 else 1 end modified_date,
       case when p_partkey%13=0 then null else p_size+(case when p_partkey%11=4 then 1 else 0 end) end file_size,
       case when p_partkey%17=5 then 1 else 0 end trashed,
       case when p_partkey%19=0 then null else p_brand end parent from part where p_partkey%23<>1),
pr as (select 0::bigint as drive_id, p_partkey stable_id, concat(p_name,'.docx') local_title, 1 modified_date,
       case when p_partkey%13=0 then null else p_size end file_size, 0 trashed,
       case when p_partkey%19=0 then null else p_brand end parent from part where p_partkey%29<>2)
"""

RAW_SNAP = """
it as (select cast(l_orderkey%3 as bigint) as drive_id, cast(l_orderkey*10+l_linenumber as bigint) as stable_id,
              concat('file_', cast(l_orderkey*10+l_linenumber as varchar), '.docx') as local_title,
              cast(l_partkey as bigint) as modified_date,
              case when (l_orderkey*10+l_linenumber)%13<>0 then cast(l_quantity as bigint) end as file_size,
              case when (l_orderkey*10+l_linenumber)%17=5 then 1 else 0 end as trashed from lineitem),
fo as (select cast(dr as bigint) as drive_id, cast(-1-s_suppkey as bigint) as stable_id, s_name as folder
       from supplier, (select unnest([0,1,2]) as dr)),
pa as (select cast(l_orderkey%3 as bigint) as drive_id, cast(l_orderkey*10+l_linenumber as bigint) as stable_id,
              cast(unnest(case when (l_orderkey*10+l_linenumber)%5=0 then [-1-l_suppkey, -1-l_suppkey-l_linenumber]
                               else [-1-l_suppkey] end) as bigint) as parent_stable_id
       from lineitem where (l_orderkey*10+l_linenumber)%19<>0),
sf as (select it.*, pa.parent_stable_id from it left join pa on it.drive_id=pa.drive_id and it.stable_id=pa.stable_id),
dd as (select drive_id, stable_id, any_value(local_title) as local_title, arg_min(modified_date, (coalesce(parent_stable_id,0), modified_date)) as modified_date,
              arg_min(file_size, (coalesce(parent_stable_id,0), file_size)) as file_size,
              arg_min(trashed, (coalesce(parent_stable_id,0), trashed)) as trashed, min(parent_stable_id) as parent_stable_id
       from sf group by drive_id, stable_id)
"""

LABELLED = """
lf as (select l.doc_id as row_id, cast(l.toxic as int) as label,
       cast(d.doc_id%7=0 as int) file_delete_archived, cast(d.doc_id%3=0 as int) file_created,
       cast(d.lang='en' as int) process_related, 1 network_related, 1 file_related,
       cast(d.doc_id%4=0 as int) suspicious_path, cast(d.lang='de' as int) system_executable,
       length(d.text) path_length, length(d.text)-length(replace(d.text,' ','')) directory_depth,
       length(d.source) process_name_length, cast(d.doc_id%11 as double)/cast(10 as double) extension_similarity,
       cast(d.n_chars%97 as double)/cast(20 as double)+cast(l.toxic as double) file_name_entropy
       from documents d join labels l on d.doc_id=l.doc_id),
sp0 as (select *, row_number() over (partition by label order by md5(concat(row_id,'|42')), row_id) as rk,
               count(*) over (partition by label) as n from lf),
sp as (select *, case when rk <= ceil(n*0.2::double) then 'test' else 'train' end as split from sp0),
scd as (select *, file_name_entropy/8.0::double as score, cast(file_name_entropy >= 3.0 as int) as prediction from lf),
cr as (select label, file_name_entropy, row_number() over (partition by label order by row_id)-1 as pos,
              count(*) over (partition by label) as n from lf)
"""


def _with(*steps: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(s.strip() for s in steps)


_FEATURED = [EVENTS, MEASURES, FEATURE_STEPS]
_SCORED = [*_FEATURED, SCORES]
_STATED = [*_SCORED, STATES]
_BATCHED = [*_STATED, BATCHES]
_ALERTED = [*_BATCHED, ALERTS]
_ATTACKED = [*_STATED, ATTACKS]

ALERT_COLUMNS = """al.drive_id, al.batch, al.ts_us,
 strftime(make_timestamp(al.ts_us), '%Y-%m-%dT%H:%M:%S.%f') as "timestamp", threat_level,
 round(threat,6) as probability, affected_files_count, sync_paused"""

_F1 = "case when p+r=0 then 0.0 else 2.0*p*r/(p+r) end"


# What alert_messages must say, written down here and not taken from it.
_TITLES = """case threat_level when 'LOW' then 'Drive under watch' when 'MEDIUM' then 'Changes look like encryption'
 when 'HIGH' then 'Sync on hold' else 'Sync stopped, act now' end"""
_MESSAGES = """case threat_level
 when 'LOW' then printf('Some changes are out of the ordinary (score %.1f of 100).', round(threat*100,1))
 when 'MEDIUM' then printf('The pattern fits encryption of files: %d so far (score %.1f of 100).', affected_files_count, round(threat*100,1))
 when 'HIGH' then printf('Uploads wait until someone has looked at %d changed files (score %.1f of 100).', affected_files_count, round(threat*100,1))
 else printf('Files are being rewritten in bulk, %d by now; nothing is uploaded (score %.1f of 100).', affected_files_count, round(threat*100,1)) end"""


def build() -> dict[str, str]:
    features = ", ".join(f for f in FEATURES if f not in ("extension_similarity", "file_name_entropy"))
    q: dict[str, str] = {}
    q["level_counts"] = _with(*_BATCHED) + f""" select drive_id, {LEVEL} as threat_level, count(*) as batches,
        cast(sum(events) as bigint) as events, cast(sum(cast(hmm_hit as int)) as bigint) as hmm_hits,
        round(max(threat),6) as max_threat from bt group by 1,2"""
    q["events_since"] = _with(EVENTS) + f" select id, drive_id, stable_id, event_type, local_title from fe where id > {SINCE_ID}"
    q["events_recent"] = _with(EVENTS) + """ select id, drive_id, event_type, ts_us from fe
        where "timestamp" >= (select max("timestamp") from fe) - 7*86400"""
    q["snapshot_files"] = _with(RAW_SNAP) + " select * from sf"
    q["dedupe_parents"] = _with(RAW_SNAP) + " select * from dd"
    q["snapshot_paths"] = _with(RAW_SNAP) + """ select dd.drive_id, dd.stable_id, dd.parent_stable_id,
        case when folder is null then local_title else concat(folder,'/',local_title) end as full_path
        from dd left join fo on dd.drive_id=fo.drive_id and dd.parent_stable_id=fo.stable_id"""
    q["snapshot_diff"] = _with(SNAPS) + """, j as (select coalesce(c.drive_id,p.drive_id) drive_id,
        coalesce(c.stable_id,p.stable_id) stable_id,
        case when p.stable_id is null then 'CREATED' when c.stable_id is null then 'DELETED'
             when c.local_title is distinct from p.local_title then 'RENAMED'
             when c.modified_date is distinct from p.modified_date or c.file_size is distinct from p.file_size then 'MODIFIED'
             when p.trashed=0 and c.trashed=1 then 'TRASHED' end as event_type,
        coalesce(c.local_title,p.local_title) local_title, p.local_title as old_title, c.file_size,
        case when c.stable_id is null then concat_ws('/',p.parent,p.local_title) else concat_ws('/',c.parent,c.local_title) end full_path
        from pr p full outer join cu c on p.stable_id=c.stable_id)
        select drive_id, stable_id, event_type, local_title,
          cast(case when event_type in ('CREATED','MODIFIED') then coalesce(file_size,0) else 0 end as bigint) as file_size,
          case when event_type='RENAMED' then old_title else '' end as old_local_title, full_path
        from j where event_type is not null"""
    q["id_sets"] = _with(SNAPS) + """ select 0::bigint as drive_id, stable_id, case when min(s)=2 then 'created' when max(s)=1 then 'deleted'
        else 'common' end as side from (select stable_id, 1 as s from pr union all select stable_id, 2 from cu) group by stable_id"""
    q["snapshot_chain"] = """with sn as (select cast(p_partkey%2 as bigint) as drive_id, s as snapshot_id, p_partkey as stable_id,
        case when p_partkey%11=4 and s>6 then concat(p_name,'.encrypted') else concat(p_name,'.docx') end as local_title,
        cast(case when p_partkey%5=2 then floor(s/4) else 1 end as bigint) as modified_date,
        cast(case when p_partkey%13<>0 then p_size end as bigint) as file_size,
        case when p_partkey%17=5 and s>=9 then 1 else 0 end as trashed
        from part, (select unnest(range(1,13)) as s) where (p_partkey+s)%7<>3),
      po as (select distinct drive_id, snapshot_id from sn),
      pq as (select *, lag(snapshot_id) over (partition by drive_id order by snapshot_id) as before from po),
      pairs as (
        select c.drive_id, c.snapshot_id, c.stable_id, case when p.stable_id is null then 'CREATED'
             when c.local_title is distinct from p.local_title then 'RENAMED'
             when c.modified_date is distinct from p.modified_date or c.file_size is distinct from p.file_size then 'MODIFIED'
             when p.trashed=0 and c.trashed=1 then 'TRASHED' end as event_type, c.local_title, c.file_size, p.local_title as old_title
        from sn c join pq on pq.drive_id=c.drive_id and pq.snapshot_id=c.snapshot_id and pq.before is not null
             left join sn p on p.drive_id=c.drive_id and p.snapshot_id=pq.before and p.stable_id=c.stable_id
        union all
        select p.drive_id, pq.snapshot_id, p.stable_id, 'DELETED', p.local_title, null, null
        from sn p join pq on pq.drive_id=p.drive_id and pq.before=p.snapshot_id
             left join sn c on c.drive_id=p.drive_id and c.snapshot_id=pq.snapshot_id and c.stable_id=p.stable_id
        where c.stable_id is null)
      select drive_id, snapshot_id, snapshot_id*5 as snapshot_ts, stable_id, event_type, local_title,
        case when event_type in ('CREATED','MODIFIED') then coalesce(file_size,0) else 0 end as file_size,
        case when event_type='RENAMED' then old_title else '' end as old_local_title, local_title as full_path
      from pairs where event_type is not null"""
    q["text_functions"] = _with(EVENTS) + rf""", nm as (select distinct full_path, local_title from fe)
      select full_path, local_title, {_extension('full_path')} as extension,
        regexp_extract(local_title,'([^.]*)$',1) as last_token,
        length(full_path)-length(replace(full_path,'/','')) as separators,
        regexp_extract(full_path,'(?s)^(.*)[/\\][^/\\]*$',1) as folder,
        length(local_title) as name_length,
        round((select -sum(p*log2(p)) from (select count(*)/cast(length(local_title) as double) as p
          from (select unnest(string_split(local_title,'')) as x) group by x)),6) as entropy,
        concat_ws('/', case when length(local_title)%2=0 then 'parent' end, local_title) as joined from nm"""
    q["file_features"] = _with(*_FEATURED) + f""" select id, drive_id, stable_id, {features},
        round(extension_similarity,6) as extension_similarity, round(file_name_entropy,6) as file_name_entropy from ft"""
    q["previous_title"] = _with(EVENTS) + """ select id, drive_id, stable_id, case when stable_id<>0 then
        lag(local_title) over (partition by drive_id, stable_id order by id) end as previous_title from fe"""
    q["high_velocity"] = _with(EVENTS, MEASURES) + " select id, drive_id, cast(recent_writes as bigint) as recent_writes, high_velocity from fl"
    q["systematic_rename"] = _with(EVENTS, MEASURES) + """ select id, drive_id, cast(recent_renames as bigint) as recent_renames,
        rename_extensions, systematic_rename from fl"""
    q["recent_files_affected"] = _with(EVENTS, MEASURES) + " select id, drive_id, recent_files from fl"
    q["entropy_sequence"] = _with(*_STATED) + """ select id, drive_id, case when length(entropies)=15 then
        array_to_string(list_transform(entropies, lambda x: cast(cast(round(x*1000) as bigint) as varchar)),',') end as entropies from sq"""
    q["batch_flags"] = _with(EVENTS, MEASURES) + """ select drive_id, cast(floor(ts_us/3000000.0) as bigint) as batch, count(*) as events,
        arg_max(high_velocity, ts_us) as high_velocity, arg_max(systematic_rename, ts_us) as systematic_rename
        from fl group by 1,2"""
    q["event_scores"] = _with(*_SCORED) + " select id, drive_id, round(score,6) as score from sc"
    q["fused_scores"] = _with(*_SCORED) + """ select id, drive_id, round(score,6) as score, high_velocity, systematic_rename,
        round(fused,6) as fused from fu"""
    q["poll_scores"] = _with(*_SCORED) + """, pb as (select *, cast(floor(ts_us/3000000.0) as bigint) as batch from fu),
      pf as (select drive_id, batch, arg_max(high_velocity, ts_us) as hv, arg_max(systematic_rename, ts_us) as sr from pb group by 1,2),
      po as (select id, pb.drive_id, pb.batch, hv, sr, score/(1.0::double-score+1e-9::double)*(case when hv then 3.0 else 1.0 end)::double
             *(case when sr then 4.0 else 1.0 end)::double as o from pb join pf on pb.drive_id=pf.drive_id and pb.batch=pf.batch)
      select id, drive_id, hv as high_velocity, sr as systematic_rename, round(o/(1.0::double+o),6) as fused from po"""
    q["hmm_state"] = _with(*_STATED) + " select id, drive_id, state, malicious from hm"
    q["hmm_path"] = _with(*_STATED) + f""", st as (select id, drive_id, list_transform(obs, lambda x, i:
          case when i=1 then {{'d0': x.d0+{_PI[0]}, 'd1': x.d1+{_PI[1]}, 'p0': '0', 'p1': '1'}}
               else {{'d0': x.d0, 'd1': x.d1, 'p0': '', 'p1': ''}} end) as o from vt where length(obs)=15),
      pt as (select id, drive_id, list_reduce(o, lambda acc, x: {{
          'd0': greatest(acc.d0+{_A[0][0]}, acc.d1+{_A[1][0]})+x.d0, 'd1': greatest(acc.d0+{_A[0][1]}, acc.d1+{_A[1][1]})+x.d1,
          'p0': concat(case when acc.d1+{_A[1][0]} > acc.d0+{_A[0][0]} then acc.p1 else acc.p0 end,'0'),
          'p1': concat(case when acc.d1+{_A[1][1]} > acc.d0+{_A[0][1]} then acc.p1 else acc.p0 end,'1')}}) as v from st)
      select id, drive_id, case when v.d1>v.d0 then v.p1 else v.p0 end as path from pt"""
    q["state_alignment"] = _with(LABELLED) + """, mm as (select d.lang as model_id, avg(case when label=0 then file_name_entropy end) as m0,
        avg(case when label=1 then file_name_entropy end) as m1 from lf join documents d on d.doc_id=lf.row_id group by d.lang
        having count(case when label=0 then 1 end)>0 and count(case when label=1 then 1 end)>0)
      select model_id, state, case when (case when m0>=m1 then 0 else 1 end)=state then 'malicious' else 'benign' end as role,
        round(case when state=0 then m0 else m1 end,6) as mean from mm, (select unnest([0,1]) as state)"""
    q["batch_threat"] = _with(*_BATCHED) + """ select drive_id, batch, events, ts_us, affected_files_count, hmm_hit,
        round(threat,6) as threat from bt"""
    q["trigger_event"] = _with(*_BATCHED) + """ select bt.drive_id, batch, trigger_id, fe.event_type as trigger_type,
        fe.full_path as trigger_path from bt left join fe on fe.id=bt.trigger_id"""
    q["threat_level"] = _with(*_BATCHED) + f" select drive_id, batch, {LEVEL} as threat_level from bt"
    q["alert_gate"] = _with(*_BATCHED) + " select drive_id, batch, round(threat,6) as threat from bt where threat >= 0.5"
    q["alert_cooldown"] = _with(*_ALERTED, recursive=True) + " select drive_id, batch, ts_us from al"
    q["alerts"] = _with(*_ALERTED, recursive=True) + f""" select {ALERT_COLUMNS}, trigger_id, fe.event_type as trigger_type,
        fe.full_path as trigger_path from al left join fe on fe.id=al.trigger_id"""
    q["response_plan"] = _with(*_ALERTED, recursive=True) + """ select al.drive_id, al.batch, threat_level, true as notify,
        threat_level in ('HIGH','CRITICAL') as pause_sync, threat_level='CRITICAL' as recovery_report,
        case when threat_level='CRITICAL' and full_path<>'' then full_path end as quarantine_path
        from al left join fe on fe.id=al.trigger_id"""
    q["alert_messages"] = _with(*_ALERTED, recursive=True) + f" select drive_id, batch, {_TITLES} as title, {_MESSAGES} as message from al"
    q["latest_alert"] = _with(*_ALERTED, recursive=True) + f""" select drive_id, "timestamp", threat_level, probability, affected_files_count
        from (select {ALERT_COLUMNS}, row_number() over (partition by drive_id order by ts_us desc) as r from al) where r=1"""
    q["activity_baseline"] = _with(EVENTS) + """, mi as (select drive_id, floor("timestamp"/60) as mn, count(*) as n from fe group by 1,2),
      tx as (select drive_id, regexp_extract(local_title,'([^.]*)$',1) as x, count(*) as n from fe group by 1,2),
      tr as (select *, row_number() over (partition by drive_id order by n desc, x) as rk from tx),
      co as (select drive_id, string_agg(x, ',' order by rk) as common from tr where rk<=10 group by 1)
      select fe.drive_id, count(*) as events, round(count(*)/greatest(max("timestamp")-min("timestamp"),1.0),6) as event_rate,
        round((select quantile_cont(cast(n as double),0.95) from mi where mi.drive_id=fe.drive_id),6) as typical_burst_size,
        any_value(co.common) as common_extensions from fe join co on co.drive_id=fe.drive_id group by fe.drive_id"""
    q["top_extensions"] = _with(EVENTS) + """, tx as (select drive_id, regexp_extract(local_title,'([^.]*)$',1) as extension, count(*) as n
        from fe group by 1,2) select * from (select drive_id, extension, n,
        row_number() over (partition by drive_id order by n desc, extension) as rank from tx) where rank<=10"""
    q["events_per_minute"] = _with(EVENTS) + """ select drive_id, cast(floor(ts_us/60000000.0) as bigint)*60000000 as minute_us, event_type,
        count(*) as n from fe group by 1,2,3"""
    q["stream_events_per_minute"] = q["events_per_minute"]
    q["training_prepare"] = """select d.doc_id as row_id, l.toxic as label, cast(d.doc_id%7=0 as int) file_delete_archived,
        cast(d.doc_id%3=0 as int) file_created, cast(d.lang='en' as int) process_related, 1 network_related, 1 file_related,
        cast(d.doc_id%4=0 as int) suspicious_path, cast(d.lang='de' as int) system_executable, length(d.text) path_length,
        2 directory_depth, length(d.source) process_name_length, round(cast(d.doc_id%11 as double)/cast(10 as double),6) extension_similarity,
        round(cast(d.n_chars%97 as double)/cast(20 as double),6) file_name_entropy
        from documents d left join labels l on d.doc_id=l.doc_id"""
    q["rejected_labels"] = """select 'unknown' as class, count(*) as n from documents d left join labels l on d.doc_id=l.doc_id
        where l.toxic is null or l.toxic not in (0,1) having count(*)>0"""
    q["class_split"] = _with(LABELLED) + """ select 'benign' as subset, row_id, label from lf where label=0 union all
        select 'malicious', row_id, label from lf where label=1"""
    q["class_counts"] = _with(LABELLED) + " select label, count(*) as n from lf group by label"
    q["seeded_sample"] = _with(LABELLED) + " select row_id, label from lf order by md5(concat(row_id,'|42')), row_id limit 100"
    q["stratified_split"] = _with(LABELLED) + " select row_id, label, split from sp"
    q["confusion_matrix"] = _with(LABELLED) + """ select a as label, b as prediction, count(row_id) as n
        from (select unnest([0,1]) as a) cross join (select unnest([0,1]) as b) left join scd on label=a and prediction=b group by a,b"""
    tallies = """, ty as (select sum(case when label=1 and prediction=1 then 1 else 0 end) as tp,
        sum(case when label=0 and prediction=1 then 1 else 0 end) as fp, sum(case when label=1 and prediction=0 then 1 else 0 end) as fn,
        sum(case when label=0 and prediction=0 then 1 else 0 end) as tn from scd)"""
    q["precision_recall_f1"] = _with(LABELLED) + tallies + f""", pq as (select *, tp/nullif(tp+fp,0)::double as p, tp/nullif(tp+fn,0)::double as r from ty)
      select cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tn as bigint) tn, round(coalesce(p,0),6) as "precision",
        round(coalesce(r,0),6) as recall, round({_F1},6) as f1 from pq"""
    q["classification_report"] = _with(LABELLED) + tallies + f""", rw as (
        select 'good' as "row", tn/nullif(tn+fn,0)::double as p, tn/nullif(tn+fp,0)::double as r, tn+fp as support from ty
        union all select 'ransom', tp/nullif(tp+fp,0)::double, tp/nullif(tp+fn,0)::double, tp+fn from ty),
      rf as (select "row", coalesce(p,0) as p, coalesce(r,0) as r, {_F1} as f, support from rw)
      select "row", round(p,6) as "precision", round(r,6) as recall, round(f,6) as f1, cast(support as bigint) as support from rf
      union all select 'accuracy', round((tp+tn)/(tp+fp+fn+tn)::double,6), round((tp+tn)/(tp+fp+fn+tn)::double,6),
        round((tp+tn)/(tp+fp+fn+tn)::double,6), cast(tp+fp+fn+tn as bigint) from ty
      union all select 'macro avg', round(avg(p),6), round(avg(r),6), round(avg(f),6), cast(sum(support) as bigint) from rf
      union all select 'weighted avg', round(sum(p*support)/sum(support),6), round(sum(r*support)/sum(support),6),
        round(sum(f*support)/sum(support),6), cast(sum(support) as bigint) from rf"""
    q["roc_auc"] = _with(LABELLED) + """, rk as (select label, rank() over (order by score) + (count(*) over (partition by score)-1)/2.0::double as r from scd)
      select round((sum(case when label=1 then r end) - sum(label)*(sum(label)+1)/2.0::double)/(sum(label)*(count(*)-sum(label)))::double,6) as auc from rk"""
    q["ks_statistic"] = _with(LABELLED) + """ select round(max(abs(a-b)),6) as ks from (select
        (select count(*) from scd y where y.label=1 and y.score<=x.score)/(select count(*) from scd where label=1)::double as a,
        (select count(*) from scd y where y.label=0 and y.score<=x.score)/(select count(*) from scd where label=0)::double as b
        from (select distinct score from scd) x)"""
    q["hmm_sequences"] = _with(LABELLED) + """, sz as (select distinct label, n from cr),
      wi as (select label, n, unnest(range(0,500)) as seq from sz where n>15),
      wd as (select label, seq, cast('0x'||substr(md5(concat(label,'|',seq,'|42')),1,8) as bigint) % (n-15) as start from wi)
      select wd.label, cast(seq as int) as seq, string_agg(cast(cast(round(file_name_entropy*1000) as bigint) as varchar), ',' order by pos) as sequence
      from wd join cr on cr.label=wd.label and cr.pos between start and start+14 group by wd.label, seq"""
    q["likelihood_ratios"] = _with(EVENTS, MEASURES) + """, lb as (select *, cast(drive_id=0 as int) as label from fl),
      ct as (select label, count(*) as n, sum(cast(high_velocity as int)) as hv, sum(cast(systematic_rename as int)) as sr from lb group by label),
      rt as (select max(case when label=1 then (hv+1.0)/(n+2.0) end)/max(case when label=0 then (hv+1.0)/(n+2.0) end) as hv,
                    max(case when label=1 then (sr+1.0)/(n+2.0) end)/max(case when label=0 then (sr+1.0)/(n+2.0) end) as sr
             from (select label, n::double as n, hv::double as hv, sr::double as sr from ct))
      select 'high_velocity' as pattern, round(hv,6) as ratio from rt union all select 'systematic_rename', round(sr,6) from rt"""
    q["micropattern_sweep"] = _with(EVENTS, LABELLED) + f""", mi as (select drive_id, floor("timestamp"/60) as mn, count(*) as n from fe group by 1,2),
      ub as (select quantile_cont(cast(n as double),0.95) as b from mi group by drive_id),
      g as (select v, w from (select unnest(range(15,101,5)) as v), (select unnest(range(3,21)) as w)),
      ct as (select v, w, sum(case when label=1 and (row_id%3)*60>=v then 1 else 0 end)
               + cast(sum(case when label=1 and extension_similarity<0.5 then 1 else 0 end) >= w as int) as tp,
             sum(case when label=0 and (row_id%3)*60>=v then 1 else 0 end)
               + cast(sum(case when label=0 and extension_similarity<0.5 then 1 else 0 end) >= w as int) as fp,
             sum(label) as n from g, lf group by v, w),
      pr0 as (select v, w, coalesce(tp/nullif(tp+fp,0)::double,0) as p, coalesce(tp/nullif(n,0)::double,0) as r from ct)
      select cast(v as int) as velocity_threshold, cast(w as int) as rename_threshold,
        round({_F1} - case when v < (select max(b) from ub) then 0.1 else 0.0 end,6) as f1, round(p,6) as "precision" from pr0"""
    q["detector_sweep"] = _with(EVENTS, MEASURES) + f""", lb as (select *, cast(drive_id=0 as int) as label,
        case when rename_extensions=1 then recent_renames else 0 end as rr from fl),
      g as (select v, w from (select unnest(range(15,101,5)) as v), (select unnest(range(3,21)) as w)),
      ct as (select v, w, sum(case when label=1 and (recent_writes>v or rr>=w) then 1 else 0 end) as tp,
               sum(case when label=0 and (recent_writes>v or rr>=w) then 1 else 0 end) as fp, sum(label) as n from g, lb group by v, w),
      pr0 as (select v, w, coalesce(tp/nullif(tp+fp,0)::double,0) as p, coalesce(tp/nullif(n,0)::double,0) as r from ct)
      select cast(v as int) as velocity_threshold, cast(w as int) as rename_threshold, round({_F1},6) as f1, round(p,6) as "precision",
        round(r,6) as recall from pr0"""
    q["alert_threshold_sweep"] = _with(LABELLED) + f""", g as (select a, p as ps, c from (select unnest(range(30,66,5)) as a), (select unnest(range(35,86,5)) as p),
        (select unnest(range(40,96,5)) as c) where a+5<=p and p+5<=c),
      sb as (select label, 5*len(list_filter(range(5,101,5), lambda b: b/100.0::double <= score)) as pct from scd),
      ct as (select ps, sum(case when label=1 and pct>=ps then 1 else 0 end) as tp, sum(case when label=0 and pct>=ps then 1 else 0 end) as fp,
             sum(label) as n from (select unnest(range(35,86,5)) as ps), sb group by ps),
      pr0 as (select ps, coalesce(tp/nullif(tp+fp,0)::double,0) as p, coalesce(tp/nullif(n,0)::double,0) as r from ct)
      select cast(a as int) as alert_pct, cast(g.ps as int) as pause_pct, cast(c as int) as critical_pct,
        round({_F1} + least((c-a)/100.0::double/0.4::double,1.0::double)*0.05::double,6) as f1, round(r,6) as recall from g join pr0 on g.ps=pr0.ps"""
    q["hmm_separability"] = _with(LABELLED) + """, ln as (select unnest(range(10,36,5)) as len), ns as (select unnest(range(300,1501,100)) as ns),
      cm as (select len, label, pos//len as chunk, avg(file_name_entropy) as mean from cr, ln group by len, label, pos//len having count(*)=len),
      tr as (select * from cm, ns where chunk<ns),
      st as (select len, ns, avg(case when label=1 then mean end) as m1, avg(case when label=0 then mean end) as m0,
             var_pop(case when label=1 then mean end) as v1, var_pop(case when label=0 then mean end) as v0,
             count(case when label=1 then 1 end) as n1, count(case when label=0 then 1 end) as n0 from tr group by len, ns),
      cu as (select tr.len, tr.ns,
             sum(case when label=0 then 1 else 0 end) over (partition by tr.len, tr.ns order by mean)/st.n0::double as f0,
             sum(case when label=1 then 1 else 0 end) over (partition by tr.len, tr.ns order by mean)/st.n1::double as f1
        from tr join st on st.len=tr.len and st.ns=tr.ns where st.n0>0 and st.n1>0),
      gp as (select len, ns, max(abs(f0-f1)) as ks from cu group by len, ns)
      select cast(st.len as int) as sequence_length, cast(st.ns as int) as n_sequences, round(coalesce(ks,0.0),6) as ks,
        round(case when ks is null then 0.0 else (m1-m0)/(sqrt((v0+v1)/2.0)+1e-10) end,4) as cohens_d
      from st left join gp on gp.len=st.len and gp.ns=st.ns"""
    q["hmm_separability_all_chunks"] = q["hmm_separability"].replace("select unnest(range(300,1501,100)) as ns", "select 0 as ns").replace(
        "from cm, ns where chunk<ns", "from cm, ns"
    ).replace("cast(st.ns as int) as n_sequences", "cast(null as int) as n_sequences")
    q["likelihood_sweep"] = _with(*_SCORED) + f""", bn as (select high_velocity as hv, systematic_rename as sr,
        cast(floor((ln(greatest(score,1e-12::double))-ln(1.0::double-score+1e-9::double))/0.001::double) as bigint) as b,
        sum(cast(drive_id=0 as int)) as pos, sum(cast(drive_id<>0 as int)) as neg from fu group by 1,2,3),
      g as (select v, w from (select 1.5+0.5*unnest(range(18)) as v), (select 2.0+unnest(range(14)) as w)),
      vl as (select cast(v as double) as v, cast(w as double) as w, pos, neg, b*0.001::double+(case when hv then ln(cast(v as double)) else 0 end
             +case when sr then ln(cast(w as double)) else 0 end) as x from bn, g),
      cu as (select v, w, x, sum(pos) as pos, sum(neg) as neg from vl group by v, w, x),
      rk as (select *, sum(neg) over (partition by v, w order by x) - neg/2.0 as below from cu),
      ar as (select v, w, sum(pos*below)/nullif(sum(pos)*sum(neg),0) as auc, sum(case when x>=0 then pos else 0 end) as tp,
             sum(case when x>=0 then neg else 0 end) as fp, sum(pos) as n from rk group by v, w),
      pr0 as (select *, coalesce(tp/nullif(tp+fp,0)::double,0) as p, coalesce(tp/nullif(n,0)::double,0) as r from ar)
      select v as velocity_ratio, w as rename_ratio, round({_F1},6) as f1, round(auc,6) as auc from pr0"""
    best = lambda name, first, second, *rest: f"(select * from ({q[name]}) order by {first} desc, {second} desc, {', '.join(rest)} limit 1)"
    q["tuning_config"] = f"""select velocity_ratio, rename_ratio, velocity_threshold, rename_threshold, alert_pct/100.0::double as alert,
        pause_pct/100.0::double as pause, critical_pct/100.0::double as critical, sequence_length, n_sequences,
        (select count(*) from documents d join labels l on d.doc_id=l.doc_id) as training_samples, (select count(*) from events) as user_events
      from {best("likelihood_sweep", "f1", "auc", "velocity_ratio", "rename_ratio")},
        {best("micropattern_sweep", "f1", '"precision"', "velocity_threshold", "rename_threshold")},
        {best("alert_threshold_sweep", "f1", "recall", "alert_pct", "pause_pct", "critical_pct")},
        {best("hmm_separability", "ks", "cohens_d", "sequence_length", "n_sequences")}"""
    trials = "with t as (select p_partkey as trial, cast(p_size as double) as f1, p_retailprice as f2 from part)"
    q["snapshot_chain_emptied"] = q["snapshot_chain"].replace("with sn as", "with sn0 as").replace(
        "po as (select distinct drive_id, snapshot_id from sn)",
        "sn as (select * from sn0 where snapshot_id<>5), po as (select distinct drive_id, snapshot_id from sn0)",
    )
    q["rejected_events"] = _with(EVENTS) + """, g as (select case when id%1000=8 then null else drive_id end as drive_id,
        case id%1000 when 9 then 'id' when 7 then 'timestamp' when 8 then 'drive_id' end as missing from fe)
      select drive_id, missing, count(*) as n from g where missing is not null group by 1,2"""
    q["train_classifier"] = _with(LABELLED) + """ select case label when 1 then 'ransom' else 'good' end as "row", count(*) as support, true as f1_reached
        from sp where split='test' group by label"""
    q["feature_attribution"] = f"""select unnest({list(FEATURES)!r}) as feature, false as constant_moves,
        feature = '{FEATURES[11]}' as strongest"""
    q["train_hmm"] = "select true as rises, true as settled, true as ordered, 15 as length"
    q["pareto_front"] = trials + """ select trial, f1, f2 from t where not exists (select 1 from t o where o.f1>=t.f1 and o.f2>=t.f2
        and (o.f1>t.f1 or o.f2>t.f2))"""
    q["best_trial"] = trials + " select trial, f1, f2 from t order by f1 desc, f2 desc, trial limit 1"
    q["new_trials"] = trials + " select cast(trial as double) as trial from t where trial%3<>0"
    q["attack_sessions"] = _with(*_ATTACKED) + """ select drive_id, attack_no, start_us, end_us, duration_us, events, files,
        round(peak_score,6) as peak_score from ses"""
    q["attack_timeline"] = _with(*_ATTACKED) + """ select drive_id, attack_no, cast(floor(ts_us/1000000.0) as bigint) as second, event_type,
        count(*) as n from ae group by 1,2,3,4"""
    q["attack_rate"] = _with(*_ATTACKED) + """, ps as (select drive_id, attack_no, cast(floor(ts_us/1000000.0) as bigint) as s,
        count(distinct stable_id) as files, any_value(start_us) as a, any_value(end_us) as b from ae group by 1,2,3)
      select drive_id, attack_no, max(files) as peak_per_second,
        round(sum(files)/greatest((max(b)-min(a))/1000000.0::double,1.0::double),6) as mean_per_second from ps group by 1,2"""
    q["attack_folders"] = _with(*_ATTACKED) + """ select drive_id, attack_no, regexp_extract(full_path,'^(.*)/[^/]*$',1) as folder,
        count(*) as events, count(distinct stable_id) as files from ae group by 1,2,3"""
    q["attack_extensions"] = _with(*_ATTACKED) + f""" select drive_id, attack_no, {_extension("coalesce(previous_title,'')")} as old_extension,
        {_extension('local_title')} as new_extension, count(*) as n from ae where event_type='RENAMED' group by 1,2,3,4"""
    q["attack_profile"] = _with(*_ATTACKED) + f""", xe as (select drive_id, attack_no, {_extension('local_title')} as x, count(*) as n from ae group by 1,2,3),
      dx as (select drive_id, attack_no, x from (select *, row_number() over (partition by drive_id, attack_no order by n desc, x) as r from xe) where r=1)
      select ae.drive_id, ae.attack_no, round(count(*)/greatest((max(end_us)-min(start_us))/1000000.0::double,1.0::double),6) as events_per_second,
        round(sum(cast(event_type='RENAMED' as int))/count(*)::double,6) as rename_share, round(avg(file_name_entropy),6) as mean_entropy,
        any_value(dx.x) as dominant_extension from ae join dx on dx.drive_id=ae.drive_id and dx.attack_no=ae.attack_no group by 1,2"""
    q["restore_points"] = _with(*_ATTACKED) + """, af as (select distinct drive_id, attack_no, stable_id, start_us from ae),
      rp as (select af.*, fe.id as i, fe.ts_us as t, fe.event_type as k, fe.local_title as n, fe.full_path as p,
             row_number() over (partition by af.drive_id, af.attack_no, af.stable_id order by fe.ts_us desc, fe.id desc) as r
             from af left join fe on fe.drive_id=af.drive_id and fe.stable_id=af.stable_id and fe.ts_us<af.start_us)
      select drive_id, attack_no, stable_id, start_us, i as restore_id, t as restore_ts_us, k as restore_event_type,
        n as restore_local_title, p as restore_full_path from rp where r=1"""
    q["audit_trail"] = _with(*_STATED) + f""" select id, drive_id, event_type, round(score,6) as score, high_velocity, systematic_rename,
        round(fused,6) as fused, malicious, {LEVEL.replace('threat','fused')} as threat_level,
        fused>=0.5 or coalesce(malicious,false) as suspicious from hm"""
    q["recent_timeline"] = _with(*_SCORED) + f""" select drive_id, rank, id, event_type, full_path, round(fused,6) as fused,
        {LEVEL.replace('threat','fused')} as threat_level from (select *, row_number() over (partition by drive_id order by id desc) as rank from fu)
        where rank<=50"""
    q["previous_title_chunked"] = q["previous_title"]
    q["restore_points_chunked"] = q["restore_points"]
    q["batch_threat_chunked"] = _with(*_BATCHED) + """ select drive_id, batch, round(threat,6) as threat, cast(events as bigint) as events
        from bt"""
    q["stream_flags"] = _with(EVENTS, MEASURES) + """ select drive_id, id, ts_us, cast(recent_writes as bigint) as recent_writes,
        cast(recent_renames as bigint) as recent_renames, rename_extensions, recent_files, high_velocity, systematic_rename from fl"""
    mins = """, mi as (select drive_id, floor("timestamp"/60) as mn, count(*) as n from fe group by 1,2)"""
    q["burst_sketches"] = _with(EVENTS) + mins + """, st as (select drive_id, case when n<=128 then n
        else ceil(n/pow(2,floor(log2(n))-6))*pow(2,floor(log2(n))-6) end as step from mi),
      rk as (select *, row_number() over (partition by drive_id order by step) as i, count(*) over (partition by drive_id) as c from st)
      select drive_id, c as minutes, cast(min(step) as bigint) as typical_burst_size, cast(min(step) as bigint) as merged from rk where i>=c*0.95::double group by drive_id, c"""
    weights = "[" + ", ".join(f"{{'f': '{f}', 'w': {_CARD.weights.get(f, 0.0)!r}::double, 'bg': {1.0 if f == 'extension_similarity' else 0.0}::double}}" for f in FEATURES) + "]"
    linear = repr(_CARD.intercept + _CARD.weights["extension_similarity"])
    q["shapley_contributions"] = _with(LABELLED) + f""", wt as (select unnest({weights}) as s),
      pm as (select m, s.f as f, s.w as w, s.bg as bg, row_number() over (partition by m order by md5('42|'||m||'|'||s.f)) as k from wt, range(4) as r(m)),
      lo as (select row_id, unnest([{", ".join(f"{{'f': '{f}', 'x': {f}::double}}" for f in FEATURES)}]) as v from lf),
      ch as (select row_id, m, pm.f, k, w*(v.x-bg) as step, sum(w*(v.x-bg)) over (partition by row_id, m order by k) as until from lo join pm on pm.f = v.f),
      ga as (select row_id, f, (1.0::double/(1.0::double+exp(-({linear}::double+until))) - 1.0::double/(1.0::double+exp(-({linear}::double+until-step))))/4 as g from ch)
      select row_id, true as sums, {", ".join(f"round(sum(case when f='{f}' then g else 0 end),6) as phi_{f}" for f in FEATURES)} from ga group by row_id"""
    q["parameters_as_of"] = _with(EVENTS, MEASURES) + """, md as (select (min(ts_us)+max(ts_us))//2 as middle from fe),
      vr as (select fl.*, ts_us >= middle as late, case when ts_us >= middle then 20 else 50 end as vt, case when ts_us >= middle then 3 else 5 end as rt
             from fl, md),
      ff as (select *, recent_writes > vt as hv, recent_renames >= rt and rename_extensions = 1 as sr from vr)
      select id, hv as high_velocity, sr as systematic_rename,
        (case when hv then case when late then 2.0 else 3.0 end else 1.0 end * case when sr then case when late then 6.0 else 4.0 end else 1.0 end)::double as evidence,
        cast(regexp_matches(lower(full_path), 'appdata|temp|tmp|programdata|userprofile') or (late and contains(lower(full_path), 'photos')) as int) as suspicious_path,
        cast(regexp_matches(lower(local_title),'(\\.exe|\\.bat|\\.ps1)$') as int) as process_related,
        cast(regexp_matches(lower(local_title),'(\\.exe|\\.dll)$') as int) as system_executable from ff"""
    q["scored_events_accepted"] = _with(EVENTS.replace("fe as (", "fe0 as (") + """,
      fe as (select * from fe0 where id%1000 not in (7,8,9))""", *_STATED[1:]) + """ select id, drive_id, previous_title, round(score,6) as score,
        round(fused,6) as fused, state from hm"""
    q["window_measures_in_pieces"] = _with(EVENTS.replace("fe as (", "fe0 as (") + f""",
      fe as (select * replace (case when id%10<>0 then {BURST_US}+ts_us%1000000 else ts_us end as ts_us) from fe0)""", MEASURES) + """
      select id, drive_id, ts_us, cast(recent_writes as bigint) as recent_writes, cast(recent_renames as bigint) as recent_renames,
        rename_extensions, recent_files, high_velocity, systematic_rename from fl"""
    q["stream_attacks"] = q["attack_sessions"]
    q["stream_snapshot_events"] = q["snapshot_chain_emptied"]
    q["late_events"] = _with(EVENTS) + f""", sp as (select min(ts_us) as lo, max(ts_us) as hi from fe),
      p0 as (select id, drive_id, ts_us, id%1000=7 as lacks, least({PARTS - 1}, (ts_us-lo)*{PARTS}//(hi-lo+1)) as part from fe, sp),
      p1 as (select id, drive_id, ts_us, lacks, case when id%97=0 then least(part+2, {PARTS - 1}) else part end as batch_id from p0),
      nw as (select b as batch_id, (select max(ts_us) from p1 where not lacks and p1.batch_id < b) as newest from range({PARTS}) as x(b)),
      gt as (select p1.*, case when lacks then 'rejected' when ts_us <= (newest-{DELAY_SECONDS}*1000000)//1000*1000 then 'late'
             else 'on_time' end as gate from p1 join nw using (batch_id))
      select id, drive_id, ts_us, cast(batch_id as bigint) as batch_id, (select count(*) from gt where gate='on_time') as on_time,
        (select count(*) from gt where gate='late') as late, (select count(*) from gt where gate='rejected') as rejected from gt where gate='late'"""
    q["alert_log_replayed"] = _with(*_ALERTED, recursive=True) + f""" select drive_id, cast(batch%4 as bigint) as batch_id, "timestamp",
        threat_level, probability, affected_files_count, sync_paused, trigger_id from (select {ALERT_COLUMNS}, trigger_id from al)"""
    return q
