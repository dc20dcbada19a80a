"""Every registered query: the operator over the driver's whole tables, and the SQL it is checked
against, written independently of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions import contract, registry
from wayfare.operators import cdc, dedupe, gates, marts, star, trips
from wayfare.plans import adapters, runner
from wayfare.sources import lake

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Shared beginnings of the SQL: conformed events, deduplicated events, violations, facts, staging.
_TE = """te as (select cast(event_id as varchar) as event_id, concat(user_id, '-', strftime(ts, '%Y-%m-%d')) as trip_id,
  concat('O-', user_id) as order_id, case when event_id % 50 <> 0 then concat('D-', user_id % 40) end as driver_id, concat('S', user_id % 3) as store_id,
  case event_type when 'signup' then 'assigned' when 'view' then 'reached_pickup' when 'click' then 'picked_up' when 'purchase' then 'delivered'
    when 'error' then 'cancelled' end as event_type, ts as event_ts, ts as ingested_at, cast(floor(value * 100) as bigint) as distance_m,
  cast(240 + 60 * (user_id % 5) as bigint) as promised_minutes from events)"""
_DD = f"""{_TE}, dd as (select * from te qualify row_number() over (partition by trip_id, event_type order by ingested_at desc, event_ts desc, event_id desc) = 1)"""
_VI = f"""{_DD}, rk as (select *, case event_type when 'assigned' then 0 when 'reached_pickup' then 1 when 'picked_up' then 2 when 'delivered' then 5 end as rank from dd),
vi as (select *, case when rank is not null and event_ts < lag(event_ts) over w then event_type || '_before_' || lag(event_type) over w end as violation
  from rk window w as (partition by trip_id, rank is null order by rank, event_ts, event_type))"""


def _carry(name: str) -> str:
    return f"arg_min({name}, row(event_ts, coalesce(rank, 99), event_type)) filter (where {name} is not null) as {name}"


_FA = f"""{_VI}, ag as (select trip_id, {', '.join(map(_carry, trips.CARRIED))},
  min(event_ts) filter (where event_type = 'assigned') as assigned_at, min(event_ts) filter (where event_type = 'picked_up') as picked_up_at,
  min(event_ts) filter (where event_type = 'delivered') as delivered_at,
  arg_max(event_type, row(event_ts, coalesce(rank, 99), event_type)) filter (where event_type in ('delivered', 'cancelled')) as terminal_event,
  max(event_ts) as last_ts, count(*) as event_count, count(violation) as violations,
  coalesce(array_to_string(list_sort(list_distinct(list(violation) filter (where violation is not null))), ','), '') as issues from vi group by trip_id),
fb as (select *, case when violations > 0 then 'broken' when terminal_event is not null then 'complete'
  when last_ts >= timestamp '{AS_OF}' - interval 6 hours then 'open' else 'stalled' end as completeness from ag),
fc as (select *, case when completeness = 'complete' then ((epoch_us(delivered_at) - epoch_us(assigned_at) + 30000) // 60000) / 1000.0 end as tat_minutes,
  case when picked_up_at >= assigned_at then ((epoch_us(picked_up_at) - epoch_us(assigned_at) + 30000) // 60000) / 1000.0 end as pickup_minutes from fb),
fa as (select *, tat_minutes > promised_minutes as is_breach, coalesce(strftime(assigned_at, '%Y-%m-%d'), 'unknown') as date_key from fc)"""
_ST = f"""{_FA}, st as (select *, coalesce(completeness = 'complete' and tat_minutes is not null and tat_minutes >= 2, false) as is_measurable,
  tat_minutes - promised_minutes as promise_error_minutes from fa)"""
def _mean_sql(total: str, n: str) -> str:
    """The mean of n values that make total thousandths, to two digits, halves away from zero."""
    return f"sign({total}) * ((2 * abs({total}) + 10 * {n}) // nullif(20 * {n}, 0)) / 100.0"


def _share_sql(part: str, whole: str) -> str:
    return f"((20000 * {part} + {whole}) // nullif(2 * {whole}, 0)) / 10000.0"


_PE = f"""{_ST}, pr as (select *, round(promise_error_minutes * 1000)::hugeint as e, round(tat_minutes * 1000)::hugeint as t, 1000 * promised_minutes::hugeint as q,
    row_number() over (partition by store_id order by round(promise_error_minutes * 1000), trip_id) as rn, count(*) over (partition by store_id) as n
  from st where is_measurable and promise_error_minutes is not null),
ps as (select store_id, count(*) as c, sum(e) as e, sum(abs(e)) as ea, sum(t) as t, sum(q) as q, max(e) filter (where rn = floor(n * 0.5)) as p50,
  max(e) filter (where rn = floor(n * 0.9)) as p90, count(*) filter (where e > 0) as late from pr group by store_id),
pe as (select store_id, c as trips_measured, {_mean_sql('e', 'c')} as mean_signed_error_minutes, {_mean_sql('ea', 'c')} as mean_absolute_error_minutes,
  {_mean_sql('p50', '1')} as p50_error_minutes, {_mean_sql('p90', '1')} as p90_error_minutes, {_mean_sql('t', 'c')} as mean_tat_minutes,
  {_mean_sql('q', 'c')} as mean_promised_minutes, late as trips_late, {_share_sql('late', 'c')} as breach_rate from ps),
po as (select count(*) as trips_measured, {_mean_sql('sum(e)', 'count(*)')} as mean_signed_error_minutes, {_mean_sql('sum(abs(e))', 'count(*)')} as mean_absolute_error_minutes from pr)"""
_TIME = "%Y-%m-%d %H:%M:%S.%f"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _events(spark, sf):
    return adapters.trip_events(spark, sf)


def _kept(spark, sf):
    return dedupe.latest(_events(spark, sf))


def _facts(spark, sf):
    return trips.build_facts(_kept(spark, sf), AS_OF)


def _stg(spark, sf):
    return marts.staging(star.fact_table(_facts(spark, sf)))


def _normal(spark, sf):
    return contract.normalise(adapters.raw_events(spark, sf).select("value", "ingested_at"))


# ---- contract -------------------------------------------------------------------------------------

#: The messages as the adapter spells them, read from the table they are made of.
_RAW = """r as (select event_id as n, user_id, ts, event_id % 103 = 0 as bad_json, event_id % 101 = 0 as no_id, event_id % 89 = 0 as no_trip, event_id % 97 = 0 as bad_type,
  (event_id % 83 = 0 or event_id % 79 = 0) as bad_ts, case when event_id % 2 = 0 then '1.1.0' when event_id % 9 = 0 then '9.9.9' end as version from events),
m as (select *, case when bad_json then 'not_an_object' when no_id then 'missing_event_id' when no_trip then 'missing_trip_id' when bad_type then 'unknown_event_type'
  when bad_ts then 'bad_event_ts' end as reason from r)"""


@query(f"""with {_RAW} select n as event_no, case n % 7 when 1 then epoch_us(ts) when 5 then epoch_us(ts) // 1000 * 1000 else epoch_us(date_trunc('second', ts)) end as micros
  from m where not bad_json and not bad_ts""")
def ts_spellings(spark, sf) -> DataFrame:
    v = F.try_parse_json("value")
    raw = adapters.raw_events(spark, sf).select("event_no", F.try_variant_get(v, "$.event_ts", "string").alias("t"))
    return raw.select("event_no", F.unix_micros(contract.parse_timestamp(F.col("t"))).alias("micros")).where("micros is not null")


@query("""select event_id as event_no, false as parsed from events""")
def ts_reject_lenient(spark, sf) -> DataFrame:
    odd = F.element_at(F.array(*map(F.lit, ["2026", "12:30:00", "around noon", "", "20-26-01", "17875622"])), (F.col("event_id") % 6 + 1).cast("int"))
    return adapters.table(spark, sf, "events").select(F.col("event_id").alias("event_no"), contract.parse_timestamp(odd).isNotNull().alias("parsed"))


@query("""select event_id, case event_id % 5 when 0 then trunc(value)::bigint when 1 then null when 2 then null when 3 then trunc(value)::bigint else null end as as_int,
  case event_id % 5 when 0 then value when 2 then null when 3 then value when 4 then 'inf'::double end as as_float from events""")
def coerce_numeric(spark, sf) -> DataFrame:
    value, n = F.col("value").cast("string"), F.col("event_id")
    text = F.when(n % 5 == 0, value).when(n % 5 == 1, F.lit("about a mile")).when(n % 5 == 2, F.lit("nan")).when(n % 5 == 3, F.concat(F.lit(" "), value, F.lit(" "))).when(n % 5 == 4, F.lit("Infinity"))
    return adapters.table(spark, sf, "events").select("event_id", contract.as_int(text).alias("as_int"), contract.as_float(text).alias("as_float"))


@query("""select event_id, case when event_id % 3 = 0 then null else event_type end as text from events""")
def coerce_text(spark, sf) -> DataFrame:
    padded = F.when(F.col("event_id") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" \n")))
    return adapters.table(spark, sf, "events").select("event_id", contract.as_text(padded).alias("text"))


@query(f"with {_RAW} select case when n % 3 = 0 then 'delivered' else 'picked_up' end as event_type, count(*) as n from m where reason is null group by 1")
def event_vocab_filter(spark, sf) -> DataFrame:
    return contract.split_valid(_normal(spark, sf))[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"with {_RAW} select coalesce(reason, 'valid') as reason, count(*) as n from m group by 1")
def fatal_reason_counts(spark, sf) -> DataFrame:
    return _normal(spark, sf).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


_LIVE = f"{_RAW}, v as (select * from m where reason is null)"
_ISSUES = f"""{_LIVE}, i as (
  select n, 'null_driver_id' as issue from v where n % 11 = 0 union all select n, 'null_store_id' from v where n % 13 = 0
  union all select n, 'lat_out_of_range' from v where n % 17 = 0
  union all select n, 'mistyped:distance_m' from v where n % 71 = 0 or (n % 61 <> 0 and n % 59 = 0)
  union all select n, 'negative_distance' from v where n % 71 <> 0 and n % 61 = 0
  union all select n, 'non_positive_promise' from v where n % 67 = 0
  union all select n, 'undeclared_fields' from v where n % 53 = 0 or (n % 6 = 0 and coalesce(version, '1.0.0') <> '1.1.0'))"""


@query(f"with {_ISSUES} select issue, count(*) as n from i group by issue")
def issue_flag_counts(spark, sf) -> DataFrame:
    valid = contract.split_valid(_normal(spark, sf))[0]
    return valid.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"""with {_LIVE} select cast(n as varchar) as event_id, case when n % 17 = 0 then null else 12.5::double end as lat,
  case when n % 71 = 0 then null when n % 61 = 0 then null when n % 59 = 0 then 12 else n % 5000 end::bigint as distance_m,
  case when n % 67 = 0 then null else 45 end::bigint as promised_minutes from v""")
def range_nulling(spark, sf) -> DataFrame:
    return contract.split_valid(_normal(spark, sf))[0].select("event_id", "lat", "distance_m", "promised_minutes")


@query(f"""with {_LIVE} select cast(n as varchar) as event_id, case when n % 6 = 0 then 'bike' when version = '1.1.0' then 'unknown' end as vehicle_type,
  case when n % 53 = 0 then '7' end as road_code from v""")
def extra_fields(spark, sf) -> DataFrame:
    valid = contract.split_valid(_normal(spark, sf))[0]
    return valid.select("event_id", contract.get_field("vehicle_type").alias("vehicle_type"), contract.get_field("road_code").alias("road_code"))


@query(f"with {_LIVE} select coalesce(version, '1.0.0') as schema_version, count(*) as n, count(*) filter (where n % 53 = 0 or n % 6 = 0 or version = '1.1.0') as with_extra from v group by 1")
def version_fallback(spark, sf) -> DataFrame:
    valid = contract.split_valid(_normal(spark, sf))[0]
    return valid.groupBy("schema_version").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("""select * from (values ('1.0.0', 12, 4, 1), ('1.1.0', 14, 4, 2)) t(version, fields, required_fields, with_default)""")
def registry_fields(spark, sf) -> DataFrame:
    f = registry.as_frame(spark).groupBy("version")
    return f.agg(F.count("*").cast("int").alias("fields"), F.count_if("required").cast("int").alias("required_fields"), F.count("default_value").cast("int").alias("with_default"))


@query("""select 'FULL' as verdict, 'battery_pct,vehicle_type' as added, '' as removed""")
def registry_compatibility(spark, sf) -> DataFrame:
    c = registry.check_compatibility(registry.VERSIONS["1.0.0"], registry.VERSIONS["1.1.0"])
    return spark.createDataFrame([(c.verdict, ",".join(c.added), ",".join(c.removed))], "verdict string, added string, removed string")


@query(f"with {_RAW} select reason, coalesce(case when bad_json or no_id then null else cast(n as varchar) end, '') as event_id from m where reason is not null")
def quarantine_rows(spark, sf) -> DataFrame:
    return contract.split_valid(_normal(spark, sf))[1].select("reason", F.coalesce("event_id", F.lit("")).alias("event_id"))


_KEPT_COUNTS = """(select count(*) from m) as bronze, (select count(*) from m where reason is not null) as quarantined,
  (select count(*) from m where reason is null) as valid, (select count(*) from (select distinct user_id, n % 3 = 0 from m where reason is null)) as silver"""


@query(f"with {_RAW} select bronze, silver, bronze - silver as collapsed from (select {_KEPT_COUNTS})")
def report_counts(spark, sf) -> DataFrame:
    """Messages landed, rows kept, and what came between."""
    kept = dedupe.latest(contract.split_valid(_normal(spark, sf))[0])
    counts = adapters.raw_events(spark, sf).agg(F.count("*").alias("bronze")).crossJoin(kept.agg(F.count("*").alias("silver")))
    return counts.withColumn("collapsed", F.col("bronze") - F.col("silver"))


# ---- dedupe ---------------------------------------------------------------------------------------


@query(f"with {_DD} select trip_id, event_type, event_id, strftime(event_ts, '{_TIME}') as event_ts, distance_m from dd")
def dedupe_latest(spark, sf) -> DataFrame:
    return _kept(spark, sf).select("trip_id", "event_type", "event_id", _time("event_ts"), "distance_m")


@query("""select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) = 1""")
def dedupe_lineitem(spark, sf) -> DataFrame:
    li = adapters.table(spark, sf, "lineitem")
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return dedupe.latest(li, ("l_orderkey", "l_linenumber"), order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""with {_TE}, p as (select *, row_number() over w as place, lag(event_ts) over w as t, lag(order_id) over w as o, lag(driver_id) over w as d,
  lag(store_id) over w as s, lag(distance_m) over w as m, lag(promised_minutes) over w as q from te window w as (partition by trip_id, event_type order by ingested_at, event_ts, event_id))
  select count(*) as n_rows, count(*) filter (where place = 1) as kept, count(*) filter (where place > 1) as duplicates_removed,
  count(*) filter (where place > 1 and (event_ts is distinct from t or order_id is distinct from o or driver_id is distinct from d or store_id is distinct from s
    or distance_m is distinct from m or promised_minutes is distinct from q)) as corrected from p""")
def dedupe_counters(spark, sf) -> DataFrame:
    return dedupe.counters(_events(spark, sf))


@query(f"with {_DD} select event_type, count(*) as n, max(event_id) as last_id from dd group by event_type")
def late_merge(spark, sf) -> DataFrame:
    e = _events(spark, sf)
    merged = dedupe.merge_late(dedupe.latest(e.where("event_id % 2 = 0")), e.where("event_id % 2 = 1"))
    return merged.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


# ---- trips ----------------------------------------------------------------------------------------


@query(f"with {_FA} select trip_id, strftime(assigned_at, '{_TIME}') as assigned_at, strftime(picked_up_at, '{_TIME}') as picked_up_at, strftime(delivered_at, '{_TIME}') as delivered_at from fa")
def trip_milestones(spark, sf) -> DataFrame:
    return _facts(spark, sf).select("trip_id", _time("assigned_at"), _time("picked_up_at"), _time("delivered_at"))


@query(f"with {_FA} select coalesce(terminal_event, 'none') as terminal_event, count(*) as trips from fa group by 1")
def trip_terminal(spark, sf) -> DataFrame:
    return _facts(spark, sf).groupBy(F.coalesce("terminal_event", F.lit("none")).alias("terminal_event")).agg(F.count("*").alias("trips"))


@query(f"with {_VI} select violation, count(*) as n from vi where violation is not null group by violation")
def trip_violations(spark, sf) -> DataFrame:
    return trips.with_violations(_kept(spark, sf)).where("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


@query(f"with {_FA} select trip_id, completeness from fa")
def trip_completeness(spark, sf) -> DataFrame:
    return _facts(spark, sf).select("trip_id", "completeness")


@query(f"with {_FA} select trip_id, tat_minutes, is_breach from fa where tat_minutes is not null")
def trip_tat(spark, sf) -> DataFrame:
    return _facts(spark, sf).where("tat_minutes is not null").select("trip_id", "tat_minutes", "is_breach")


@query(f"with {_FA} select trip_id, pickup_minutes from fa where pickup_minutes is not null")
def trip_pickup(spark, sf) -> DataFrame:
    return _facts(spark, sf).where("pickup_minutes is not null").select("trip_id", "pickup_minutes")


@query(f"with {_FA} select trip_id, {', '.join(trips.CARRIED)} from fa")
def trip_carried(spark, sf) -> DataFrame:
    return _facts(spark, sf).select("trip_id", *trips.CARRIED)


@query(f"with {_FA} select trip_id, issues, event_count from fa where issues <> ''")
def trip_issues(spark, sf) -> DataFrame:
    return _facts(spark, sf).select("trip_id", F.array_join("issues", ",").alias("issues"), "event_count").where("issues <> ''")


@query(f"""with {_FA} select trip_id, order_id, driver_id, store_id, strftime(assigned_at, '{_TIME}') as assigned_at, strftime(delivered_at, '{_TIME}') as delivered_at,
  terminal_event, completeness, tat_minutes, pickup_minutes, distance_m, promised_minutes, is_breach, event_count, issues from fa""")
def trip_fact(spark, sf) -> DataFrame:
    f = _facts(spark, sf).withColumn("issues", F.array_join("issues", ","))
    return f.select(*[_time(c) if c in ("assigned_at", "delivered_at") else F.col(c) for c in trips.FACT_COLUMNS if c != "picked_up_at"])


@query(f"with {_FA} select completeness, count(*) as trips from fa group by completeness")
def completeness_histogram(spark, sf) -> DataFrame:
    return trips.completeness_histogram(_facts(spark, sf))


@query(f"""with {_FA.replace(AS_OF, '2024-03-01 00:00:00')} select completeness, count(*) as trips, count(tat_minutes) as with_tat from fa group by completeness""")
def completeness_later_run(spark, sf) -> DataFrame:
    later = trips.build_facts(_kept(spark, sf), "2024-03-01 00:00:00")
    return later.groupBy("completeness").agg(F.count("*").alias("trips"), F.count("tat_minutes").alias("with_tat"))


# ---- star -----------------------------------------------------------------------------------------


@query(f"with {_FA} select driver_id, strftime(min(assigned_at), '{_TIME}') as first_seen_at, count(*) as trips_total from fa where driver_id is not null group by driver_id")
def dim_driver(spark, sf) -> DataFrame:
    return star.dim_driver(_facts(spark, sf)).select("driver_id", _time("first_seen_at"), "trips_total")


@query(f"with {_FA} select distinct store_id, store_id || ' Depot' as store_name, 'Mirefield' as city from fa where store_id is not null")
def dim_store(spark, sf) -> DataFrame:
    return star.dim_store(_facts(spark, sf))


@query(f"""with {_FA} select distinct date_key, cast(isodow(cast(date_key as date)) - 1 as integer) as day_of_week,
  cast(isodow(cast(date_key as date)) >= 6 as integer) as is_weekend from fa where date_key <> 'unknown'""")
def dim_date(spark, sf) -> DataFrame:
    return star.dim_date(_facts(spark, sf))


@query(f"with {_FA} select trip_id, date_key, cast(is_breach as integer) as is_breach, nullif(issues, '') as issues from fa")
def fct_trip(spark, sf) -> DataFrame:
    return star.fact_table(_facts(spark, sf)).select("trip_id", "date_key", "is_breach", "issues")


@query(f"with {_FA} select date_key, count(*) as trips from fa group by date_key")
def fact_date_key(spark, sf) -> DataFrame:
    return _facts(spark, sf).groupBy(star.date_key().alias("date_key")).agg(F.count("*").alias("trips"))


# ---- marts ----------------------------------------------------------------------------------------


@query(f"with {_ST} select trip_id, is_breach, is_measurable, round(promise_error_minutes, 3) as promise_error_minutes from st")
def stg_trip(spark, sf) -> DataFrame:
    return _stg(spark, sf).select("trip_id", "is_breach", "is_measurable", F.round("promise_error_minutes", 3).alias("promise_error_minutes"))


_MEASURED = "count(*) filter (where is_measurable)"
_TAT = "sum(round(tat_minutes * 1000)::hugeint) filter (where is_measurable)"
_PICKUP = "sum(round(pickup_minutes * 1000)::hugeint) filter (where is_measurable)"


@query(f"""with {_ST} select store_id, date_key, count(*) as trips_total, count(*) filter (where is_measurable) as trips_measured,
  count(*) filter (where completeness = 'open') as trips_open, count(*) filter (where completeness = 'stalled') as trips_stalled, count(*) filter (where completeness = 'broken') as trips_broken,
  {_mean_sql(_TAT, _MEASURED)} as mean_tat_minutes, {_mean_sql(_PICKUP, 'count(pickup_minutes) filter (where is_measurable)')} as mean_pickup_minutes,
  round(avg(distance_m::double) filter (where is_measurable), 0) as mean_distance_m, count(*) filter (where is_measurable and is_breach) as breaches,
  {_share_sql('count(*) filter (where is_measurable and is_breach)', _MEASURED)} as breach_rate,
  {_share_sql(_MEASURED, 'count(*)')} as measured_share, store_id || '|' || date_key as store_day_key from st group by store_id, date_key""")
def mart_store_daily(spark, sf) -> DataFrame:
    return marts.store_daily(_stg(spark, sf))


@query(f"with {_PE} select * from pe")
def mart_promise_error(spark, sf) -> DataFrame:
    return marts.promise_error(_stg(spark, sf))


@query(f"with {_PE} select * from po")
def pooled_error(spark, sf) -> DataFrame:
    return marts.pooled_error(_stg(spark, sf))


@query(f"""with {_PE} select store_id, pe.mean_signed_error_minutes, po.mean_signed_error_minutes as pooled_error_minutes,
  round(pe.mean_signed_error_minutes - po.mean_signed_error_minutes, 2) as gap_minutes from pe, po""")
def error_gap_vs_pooled(spark, sf) -> DataFrame:
    return marts.gap_vs_pooled(_stg(spark, sf))


@query(f"with {_ST} select date_key, count(distinct store_id) as stores from st where store_id is not null group by date_key having count(distinct store_id) >= 2")
def shared_days(spark, sf) -> DataFrame:
    return marts.shared_days(marts.store_daily(_stg(spark, sf)))


@query(f"with {_PE} select store_id, mean_signed_error_minutes from pe order by mean_signed_error_minutes desc, store_id limit 2")
def top2_stores(spark, sf) -> DataFrame:
    return marts.worst_stores(marts.promise_error(_stg(spark, sf)).select("store_id", "mean_signed_error_minutes"))


# ---- gates ----------------------------------------------------------------------------------------


def _gate_sql(gate: str, passed: str, observed: str, expected: str, severity: str = "'BLOCK'", source: str = "") -> str:
    return f"select '{gate}' as gate, {passed} as passed, {severity} as severity, cast({observed} as varchar) as observed, cast({expected} as varchar) as expected {source}"


@query(_gate_sql("row_conservation:orders_lineitem", "j = l", "j", "l", source="from (select (select count(*) from orders) as l, (select count(*) from orders left join (select distinct l_orderkey from lineitem) on o_orderkey = l_orderkey) as j)"))
def gate_row_conservation(spark, sf) -> DataFrame:
    o, li = adapters.table(spark, sf, "orders").select("o_orderkey"), adapters.table(spark, sf, "lineitem").select("l_orderkey").distinct()
    return gates.row_conservation(o, o.join(li, o.o_orderkey == li.l_orderkey, "left"), "orders_lineitem")


@query(_gate_sql("row_conservation:orders_lineitem", "j = l", "j", "l", source="from (select (select count(*) from orders) as l, (select count(*) from orders left join lineitem on o_orderkey = l_orderkey) as j)"))
def gate_fanout(spark, sf) -> DataFrame:
    o, li = adapters.table(spark, sf, "orders").select("o_orderkey"), adapters.table(spark, sf, "lineitem").select("l_orderkey")
    return gates.row_conservation(o, o.join(li, o.o_orderkey == li.l_orderkey, "left"), "orders_lineitem")


@query(f"with {_RAW} " + _gate_sql("reconciliation", "silver + (valid - silver) + quarantined = bronze", "silver + (valid - silver) + quarantined", "bronze", source=f"from (select {_KEPT_COUNTS})"))
def gate_reconciliation(spark, sf) -> DataFrame:
    valid, bad = contract.split_valid(_normal(spark, sf))
    collapsed = dedupe.counters(valid).select("duplicates_removed")
    return gates.reconciliation(adapters.raw_events(spark, sf), dedupe.latest(valid), bad, collapsed)


@query(_gate_sql("unique_key:l_orderkey,l_linenumber", "count(*) = 0", "count(*)", "0", source="from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)"))
def gate_unique_key(spark, sf) -> DataFrame:
    return gates.unique_key(adapters.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"with {_FA} " + _gate_sql("not_null:assigned_at", "count(*) = 0", "count(*)", "0", "'WARN'", "from fa where assigned_at is null"))
def gate_not_null(spark, sf) -> DataFrame:
    return gates.not_null(_facts(spark, sf), "assigned_at", gates.WARN)


@query(_gate_sql("fk:o_orderkey", "count(*) = 0", "count(*)", "0", source="from (select distinct o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem))"))
def gate_fk_orphans(spark, sf) -> DataFrame:
    return gates.foreign_key(adapters.table(spark, sf, "orders"), "o_orderkey", adapters.table(spark, sf, "lineitem"), "l_orderkey")


@query("select distinct cast(o_orderkey as varchar) as example from orders where o_orderkey not in (select l_orderkey from lineitem) order by example limit 3")
def gate_fk_examples(spark, sf) -> DataFrame:
    return gates.orphan_examples(adapters.table(spark, sf, "orders"), "o_orderkey", adapters.table(spark, sf, "lineitem"), "l_orderkey")


@query(f"""select 'freshness:ts' as gate, (epoch_us(timestamp '{AS_OF}') - epoch_us(max(ts))) / 3.6e9 <= 12 as passed, 'BLOCK' as severity,
  cast(round((epoch_us(timestamp '{AS_OF}') - epoch_us(max(ts))) / 3.6e9, 3) as varchar) as observed, '12.0' as expected from events""")
def gate_freshness(spark, sf) -> DataFrame:
    return gates.freshness(adapters.table(spark, sf, "events"), "ts", AS_OF, 12.0)


_DAYS = f"{_FA}, dy as (select date_key, count(*) as n from fa where date_key <> 'unknown' group by date_key), ld as (select max(date_key) as d from dy)"


@query(f"""with {_DAYS}, ot as (select list_sort(list(n))[cast(floor(count(*) / 2) as bigint) + 1] as m, count(*) as days from dy where date_key <> (select d from ld)), ow as (select n from dy where date_key = (select d from ld))
  select 'volume_band' as gate, days < 3 or n between m * 0.5 and m * 1.5 as passed, case when days < 3 then 'WARN' else 'BLOCK' end as severity, cast(n as varchar) as observed, cast(coalesce(m, 0) as varchar) as expected from ot, ow""")
def gate_volume_band(spark, sf) -> DataFrame:
    daily = _facts(spark, sf).groupBy(star.date_key().alias("date_key")).agg(F.count("*").alias("n")).where("date_key <> 'unknown'")
    last = daily.agg(F.max("date_key")).first()[0]
    return gates.volume_band(daily, last)


@query(f"""with {_DAYS}, rw as (select date_key from dy order by date_key desc limit 3)
  select date_key, n from dy where date_key not in (select date_key from rw)""")
def volume_baseline(spark, sf) -> DataFrame:
    """Daily counts of the days that a batch of the last three doesn't rewrite."""
    daily = _facts(spark, sf).groupBy(star.date_key().alias("date_key")).agg(F.count("*").alias("n")).where("date_key <> 'unknown'")
    return daily.join(F.broadcast(daily.select("date_key").orderBy(F.desc("date_key")).limit(3)), "date_key", "left_anti")


@query(f"""with {_FA} select 'measurable_share' as gate, avg((completeness = 'complete' and tat_minutes is not null)::int) >= 0.5 as passed, 'BLOCK' as severity,
  cast(round(avg((completeness = 'complete' and tat_minutes is not null)::int), 4) as varchar) as observed, '0.5' as expected from fa""")
def gate_measurable_share(spark, sf) -> DataFrame:
    f = _facts(spark, sf)
    return gates.measurable_share(f, trips.measurable(f))


@query(f"with {_FA} select completeness as value, count(*) as n from fa where completeness not in ('complete', 'open', 'stalled') group by 1")
def test_accepted_values(spark, sf) -> DataFrame:
    return gates.accepted_values(_facts(spark, sf), "completeness", ["complete", "open", "stalled"])


@query(f"with {_FA} select count(*) as outside from fa where tat_minutes < 60 or tat_minutes > 1000")
def test_accepted_range(spark, sf) -> DataFrame:
    return gates.accepted_range(_facts(spark, sf), "tat_minutes", 60, 1000)


@query(f"with {_ST} select trip_id, count(distinct date_key) as day_count from st group by trip_id having count(distinct date_key) > 1")
def test_trip_in_one_day(spark, sf) -> DataFrame:
    return _stg(spark, sf).groupBy("trip_id").agg(F.count_distinct("date_key").alias("day_count")).where("day_count > 1")


@query("select user_id, count(distinct ts::date) as day_count from events group by user_id having count(distinct ts::date) > 1")
def test_single_day(spark, sf) -> DataFrame:
    """The same test on events, where many fail it."""
    days = adapters.table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("day_count"))
    return days.where("day_count > 1")


def _declared_sql() -> str:
    daily, errors = "select " + ORACLE_SQL["mart_store_daily"].removeprefix(f"with {_ST} select "), "select * from pe"
    counts = {
        "stg_trip.trip_id.unique": "from (select 1 from st group by trip_id having count(*) > 1)",
        "stg_trip.trip_id.not_null": "from st where trip_id is null",
        "stg_trip.store_id.not_null": "from st where store_id is null",
        "stg_trip.store_id.relationships": "from (select distinct store_id from st where store_id not in (select store_id from events, lateral (select concat('S', user_id % 3) as store_id)))",
        "stg_trip.completeness.accepted_values": "from st where completeness not in ('complete', 'open', 'stalled', 'broken')",
        "stg_trip.is_measurable.not_null": "from st where is_measurable is null",
        "mart_store_daily.store_day_key.unique": "from (select 1 from da group by store_day_key having count(*) > 1)",
        "mart_store_daily.store_day_key.not_null": "from da where store_day_key is null",
        "mart_store_daily.trips_measured.not_null": "from da where trips_measured is null",
        "mart_store_daily.trips_measured.accepted_range": "from da where trips_measured < 0",
        "mart_store_daily.breach_rate.accepted_range": "from da where breach_rate < 0 or breach_rate > 1",
        "mart_store_daily.mean_tat_minutes.accepted_range": "from da where mean_tat_minutes <= 0",
        "mart_promise_error.store_id.unique": "from (select 1 from er group by store_id having count(*) > 1)",
        "mart_promise_error.store_id.not_null": "from er where store_id is null",
        "mart_promise_error.trips_measured.not_null": "from er where trips_measured is null",
        "mart_promise_error.mean_signed_error_minutes.not_null": "from er where mean_signed_error_minutes is null",
        "rate_has_its_denominator": "from da where breach_rate is not null and coalesce(trips_measured, 0) = 0",
        "measurable_is_complete": "from st where is_measurable and (completeness <> 'complete' or tat_minutes is null)",
        "trip_in_one_day": "from (select 1 from st group by trip_id having count(distinct date_key) > 1)",
    }
    rows = " union all ".join(f"select 'test:{k}' as gate, (select count(*) {v}) as n" for k, v in counts.items())
    return f"""with {_PE}, da as ({daily}), er as ({errors}), ts as ({rows})
      select gate, n = 0 as passed, 'BLOCK' as severity, cast(n as varchar) as observed, '0' as expected from ts"""


@query(_declared_sql())
def declared_tests(spark, sf) -> DataFrame:
    facts = _facts(spark, sf)
    stg = marts.staging(star.fact_table(facts))
    verdicts = marts.declared_tests(stg, star.dim_store(facts), marts.store_daily(stg), marts.promise_error(stg))
    return reduce(DataFrame.unionByName, verdicts)


@query(f"with {_ST} select store_id, date_key from st group by store_id, date_key having count(*) filter (where is_measurable) = 0")
def test_denominator(spark, sf) -> DataFrame:
    return marts.store_daily(_stg(spark, sf)).where("trips_measured = 0 and breach_rate is null").select("store_id", "date_key")


@query(f"with {_ST} select trip_id from st where is_measurable and not (completeness = 'complete' and tat_minutes is not null)")
def test_measurable_drift(spark, sf) -> DataFrame:
    s = _stg(spark, sf)
    return s.where(F.col("is_measurable") & ~trips.measurable(s)).select("trip_id")


# ---- change data capture ---------------------------------------------------------------------------

_MSG = """c as (select o_orderkey as n, o_custkey, o_orderpriority as vehicle, case when o_orderkey % 37 = 0 then 'tombstone' when o_orderkey % 47 = 0 then 'not_json'
  when o_orderkey % 41 = 0 then 'unknown_op' when o_orderkey % 43 = 0 then 'null_key' else 'ok' end as state,
  case when o_orderstatus = 'F' then 'd' when o_orderstatus = 'O' then 'u' when o_orderkey % 2 = 0 then 'c' else 'r' end as op from orders),
k as (select * from c where state = 'ok' qualify row_number() over (partition by o_custkey order by op <> 'r' desc, n desc, op desc, vehicle desc) = 1)"""


def _parsed(spark, sf):
    return cdc.parse(adapters.change_messages(spark, sf), ["driver_id"])


@query(f"""with {_MSG} select case when state = 'ok' then 'record' when state = 'tombstone' then state else 'error' end as kind, case when state not in ('ok', 'tombstone') then state end as reason,
  count(*) as n from c group by 1, 2""")
def cdc_parse(spark, sf) -> DataFrame:
    return _parsed(spark, sf).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(f"with {_MSG} select cast(o_custkey as varchar) as driver_id, op = 'd' as deleted, n as lsn from k")
def cdc_collapse_latest(spark, sf) -> DataFrame:
    return cdc.collapse(_parsed(spark, sf)).select(F.col("key")[0].alias("driver_id"), "deleted", "lsn")


@query(f"""with {_MSG} select count(*) as messages, count(*) filter (where state = 'ok') as records, count(*) filter (where state = 'tombstone') as tombstones,
  count(*) filter (where state not in ('ok', 'tombstone')) as errors, 0::bigint as truncates, count(*) filter (where state = 'ok') - (select count(*) from k) as superseded from c""")
def cdc_tombstones(spark, sf) -> DataFrame:
    return cdc.counters(_parsed(spark, sf))


@query(f"with {_MSG} select op = 'r' as snapshot, count(*) as keys from k group by 1")
def cdc_snapshot_rank(spark, sf) -> DataFrame:
    return cdc.collapse(_parsed(spark, sf)).groupBy("snapshot").agg(F.count("*").alias("keys"))


@query(f"with {_MSG}, t as (select max(o_orderkey) // 2 as cleared from orders) select op = 'd' or n < cleared as deleted, count(*) as keys from k, t group by 1")
def cdc_truncate(spark, sf) -> DataFrame:
    at = adapters.table(spark, sf, "orders").agg(F.floor(F.max("o_orderkey") / 2).alias("lsn"))
    source = F.struct(F.lit("drivers").alias("table"), F.col("lsn"), F.lit("false").alias("snapshot"))
    truncate = at.select(F.lit(0).cast("long").alias("message_no"), F.to_json(F.struct(F.lit("t").alias("op"), source.alias("source"))).alias("value"))
    both = adapters.change_messages(spark, sf).union(truncate)
    return cdc.collapse(cdc.parse(both, ["driver_id"])).groupBy("deleted").agg(F.count("*").alias("keys"))


@query(f"""with {_MSG} select cast(c_custkey as varchar) as driver_id, case when k.n is null then c_mktsegment else vehicle end as vehicle, coalesce(k.n, 0) as _lsn
  from customer left join k on c_custkey = o_custkey where k.n is null or op <> 'd'
  union all select cast(o_custkey as varchar), vehicle, n from k where op <> 'd' and o_custkey not in (select c_custkey from customer)""")
def cdc_merge_dimension(spark, sf) -> DataFrame:
    dim = adapters.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("driver_id"), F.col("c_mktsegment").alias("vehicle"), F.lit(0).cast("long").alias("_lsn"))
    vehicle = F.try_variant_get(F.parse_json("image"), "$.vehicle", "string")
    state = cdc.collapse(_parsed(spark, sf)).select(F.col("key")[0].alias("driver_id"), vehicle.alias("vehicle"), "deleted", "lsn")
    return cdc.merge(dim, state, "driver_id", ["vehicle"])


@query("""select c_custkey as id, c_name as person_name, c_acctbal as person_account_balance, '["' || c_mktsegment || '"]' as person_tags from customer""")
def cdc_flatten(spark, sf) -> DataFrame:
    account = F.struct(F.col("c_acctbal").alias("balance")).alias("account")
    person = F.struct(F.col("c_name").alias("name"), account, F.array("c_mktsegment").alias("tags"))
    return cdc.flatten(adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), person.alias("person")))


@query(f"""with {_MSG}, y as (select *, vehicle as v2 from c where state = 'ok'), z as (select * from y qualify row_number() over (partition by o_custkey, v2 order by op <> 'r' desc, n desc, op desc) = 1)
  select cast(o_custkey as varchar) as driver_id, v2 as vehicle, n as lsn from z where op <> 'd'""")
def cdc_composite_key(spark, sf) -> DataFrame:
    state = cdc.collapse(cdc.parse(adapters.change_messages(spark, sf), ["driver_id", "vehicle"]))
    return cdc.live(state).select(F.col("key")[0].alias("driver_id"), F.col("key")[1].alias("vehicle"), "lsn")


# ---- lake -----------------------------------------------------------------------------------------


@query(f"with {_RAW} select case when bad_json or bad_ts then 'unknown' else strftime(ts, '%Y-%m-%d') end as dt, count(*) as n from m group by 1")
def bronze_partition_counts(spark, sf) -> DataFrame:
    return lake.with_day(adapters.raw_events(spark, sf)).groupBy("dt").agg(F.count("*").alias("n"))


@query("""select distinct strftime(d, '%Y-%m-%d') as dt from (select ts::date as d from events
  union all select unnest(generate_series((select max(ts)::date from events) - 1, (select max(ts)::date from events) + 2, interval 1 day)))""")
def reprocess_window(spark, sf) -> DataFrame:
    """The days that events touches, and those up to two days after the last of them."""
    days = [r[0] for r in adapters.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("dt")).distinct().orderBy("dt").collect()]
    as_of = spark.range(1).select(F.date_format(F.date_add(F.lit(days[-1]).cast("date"), 2), "yyyy-MM-dd")).first()[0]
    return runner.reprocess_days(days, as_of, spark)
