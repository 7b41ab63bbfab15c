"""Problem 4: one surviving value for each field of each group of duplicate records.

Rows are ranked by state of verification, then the day they were last verified, then the trust in
their source, then popularity bucket, then row number, by a window over (group, field) that sees only
rows with a real value in that field. Only rank 1 is kept, so Spark limits each group to one row in
every task before the shuffle: a group with a third of all rows sends one row a task and field.

Rows with a null group id belong to no group. A field in which no row has a real value has no row.
Unreadable dates count as none, unknown states as last, unknown sources as least trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for no value.
PLACEHOLDERS = ["", "-", "—", "–", "n/a", "na", "null", "none", "?", "無資料"]
#: Written forms of the states, best first.
STATES = [
    ["verified", "已驗證", "已验证", "vérifié", "verifiziert", "verificado", "確認済み"],
    ["connected", "已連線", "已连接", "已連結", "connecté", "verbunden", "conectado", "接続済み"],
    ["blocked", "已封鎖", "已屏蔽", "封鎖", "bloqué", "blockiert", "bloqueado", "ブロック"],
    ["unverified", "未驗證", "未验证", "non vérifié", "nicht verifiziert", "no verificado", "未確認"],
]
FIELDS = ["name_zh", "name_en", "category", "official_url", "description", "popularity_bucket"]
_EDGE = r"^[\s 　​]+|[\s 　​]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_real(c: Column) -> Column:
    """Neither null nor blank nor a placeholder."""
    return F.coalesce(~F.lower(trimmed(c)).isin(PLACEHOLDERS), F.lit(False))


def state_rank(c: Column) -> Column:
    """0 (best) .. 4 (anything else or none)."""
    s, out = F.lower(trimmed(c)), F
    for i, forms in enumerate(STATES):
        out = out.when(s.isin(forms), i)
    return out.otherwise(len(STATES))


def written_day(c: Column) -> Column:
    """The day a text names: ISO with - or /, compact, RFC 3339, day-month-year, minguo, Unix seconds."""
    s = trimmed(c)
    part = lambda k: F.regexp_extract(s, r"^民國\s*(\d{1,3})年\s*(\d{1,2})月\s*(\d{1,2})日$", k)
    as_iso = F.concat_ws("-", F.lpad((part(1).try_cast("int") + 1911).cast("string"), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"), F.try_to_date(F.regexp_extract(s, r"^(\d+-\d+-\d+)", 1), "y-M-d"))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(s, "y/M/d"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{9,10}$"), F.timestamp_seconds(s.try_cast("bigint")).cast("date"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(s), "d MMM y"))
        .when(s.rlike(r"^民國"), F.try_to_date(as_iso, "y-M-d"))
    )


def survivors(rows: DataFrame, trust: DataFrame, fields: list[str] = FIELDS, group: str = "id", row_no: str = "rec_no", bucket_field: str = "popularity_bucket") -> DataFrame:
    """(group, field, row_no): the row whose value survives, for each group of two rows or more.

    ``trust`` (source, trust) is the table of named sources; the number of names is fixed by the
    deliverers, not by the rows.
    """
    by_source = trust.select(F.lower(trimmed(F.col("source"))).alias("__s"), F.col("trust").alias("__trust")).groupBy("__s").agg(F.max("__trust").alias("__trust"))
    real = [
        F.struct(F.lit(f).alias("field"), F.coalesce((F.col(f) > 0) if f == bucket_field else is_real(F.col(f)), F.lit(False)).alias("real"))
        for f in fields
    ]
    keyed = rows.where(F.col(group).isNotNull()).select(
        F.col(group), F.col(row_no),
        state_rank(F.col("verify_status")).alias("__state"), written_day(F.col("last_verified")).alias("__day"),
        F.lower(trimmed(F.col("source"))).alias("__s"),
        F.when(F.col(bucket_field) > 0, F.col(bucket_field)).alias("__bucket"),
        F.filter(F.array(*real), lambda x: x.real).alias("__real"),
    ).join(by_source, "__s", "left")
    each = keyed.select("*", F.explode("__real.field").alias("field"))
    best = Window.partitionBy(group, "field").orderBy(
        F.asc("__state"), F.desc_nulls_last("__day"), F.desc_nulls_last("__trust"), F.asc_nulls_last("__bucket"), F.asc(row_no))
    won = each.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(group, "field", row_no)
    several = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(group)
    return won.join(several, group, "left_semi")


#: The same in SQL.
SQL = """
with r as (
  select id, rec_no, name_zh, name_en, category, official_url, description, popularity_bucket,
    case when lower(trim(verify_status)) in ('verified','已驗證') then 0 when lower(trim(verify_status)) = 'connected' then 1
         when lower(trim(verify_status)) = 'blocked' then 2 when lower(trim(verify_status)) in ('unverified','未驗證') then 3 else 4 end as st,
    case when regexp_full_match(trim(last_verified), '\\d{4}-\\d{2}-\\d{2}.*') then try_cast(substr(trim(last_verified),1,10) as date)
         when regexp_full_match(trim(last_verified), '\\d{4}/\\d{2}/\\d{2}') then try_strptime(trim(last_verified), '%Y/%m/%d')::date
         when regexp_full_match(trim(last_verified), '\\d{8}') then try_strptime(trim(last_verified), '%Y%m%d')::date
         when regexp_full_match(trim(last_verified), '\\d{9,10}') then make_timestamp(trim(last_verified)::bigint * 1000000)::date
         when regexp_full_match(trim(last_verified), '\\d{1,2} [A-Za-z]{3} \\d{4}') then try_strptime(trim(last_verified), '%d %b %Y')::date
         when last_verified like '%民國%' then try_cast(
            (regexp_extract(last_verified, '(\\d+)年', 1)::int + 1911)::varchar || '-' || regexp_extract(last_verified, '(\\d+)月', 1) || '-' || regexp_extract(last_verified, '(\\d+)日', 1) as date)
    end as day,
    t.trust, case when popularity_bucket > 0 then popularity_bucket end as bucket
  from kb_records k left join kb_sources t on lower(trim(k.source)) = t.source),
f as (
  select *, 'name_zh' as field, name_zh as v from r union all select *, 'name_en', name_en from r
  union all select *, 'category', category from r union all select *, 'official_url', official_url from r
  union all select *, 'description', description from r
  union all select *, 'popularity_bucket', case when popularity_bucket > 0 then 'x' end from r),
w as (
  select id, field, rec_no, row_number() over (partition by id, field order by st, day desc nulls last, trust desc nulls last, bucket nulls last, rec_no) as n
  from f where v is not null and lower(trim(v)) not in ('', '-', '—', '–', 'n/a', 'na', 'null', 'none', '?', '無資料'))
select id, field, rec_no from w where n = 1 and id in (select id from kb_records group by id having count(*) > 1)
"""
