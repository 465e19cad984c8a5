"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions import labels as L
from flowlab.functions import scalars as S
from flowlab.functions.vectors import assemble
from flowlab.operators import clean, encode, joins, learn, metrics, privacy, sample, windows
from flowlab.plans.experiments import experiment_report
from flowlab.plans.flow_tables import prepare_csv_flows, prepare_flows
from flowlab.plans.merge import merge_scenarios
from flowlab.plans.window_table import window_table
from flowlab.scratch import materialize, scratch_path
from flowlab.sources import flows as flow_io
from flowlab.sources import telemetry as tele
from flowlab.sources import zeek
from flowlab.streaming import flows as streams

from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round floating results the way the SQL side does."""
    chosen = set(cols)
    return df.select(*[
        F.round(S.quoted(c).cast("double"), digits).alias(c) if c in chosen else S.quoted(c) for c in df.columns
    ])


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return A.view(spark, folder, A.FLOWS, "events")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return A.view(spark, folder, A.PARSED, "events")


def csv_flows(spark: SparkSession, folder: str) -> DataFrame:
    return A.view(spark, folder, A.CSV_FLOWS, "lineitem")


def telemetry_text(spark: SparkSession, folder: str) -> DataFrame:
    return A.view(spark, folder, A.TELEMETRY, "events")


COARSE_SQL = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in L.COARSE_CLASSES.items()) + ") dim(fine, coarse)"


def md5_sql(key: str, seed: int | str = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', {key}))"


EVENT_HASH = md5_sql("cast(event_id as varchar)")

# whole lineitem rows as text, formatted alike in both engines
LINE_KEY = [
    "cast(l_orderkey as varchar(20))", "cast(l_partkey as varchar(20))", "cast(l_suppkey as varchar(20))",
    "cast(l_linenumber as varchar(20))", "cast(cast(round(l_quantity * 100) as bigint) as varchar(20))",
    "cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))",
    "cast(cast(round(l_discount * 100) as bigint) as varchar(20))",
    "cast(cast(round(l_tax * 100) as bigint) as varchar(20))",
    "l_returnflag", "l_linestatus", "cast(cast(l_shipdate as date) as varchar(20))",
]
LINE_HASH = md5_sql(", ".join(LINE_KEY))


def line_key() -> list:
    return [F.expr(k) for k in LINE_KEY]


CLASS_SQL = """case event_type when 'error' then 'DDoS' when 'signup' then 'PartOfAHorizontalPortScan'
       else 'Benign' end"""


# --- scans, sources, sinks -------------------------------------------------------


@query("select * from events")
def q_scan(spark, folder):
    return flow_io.read_flows(spark, f"{folder}/events.parquet")


@query('select count(*) as "rows" from lineitem')
def q_row_count(spark, folder):
    return flow_io.row_count(flow_io.read_flows(spark, f"{folder}/lineitem.parquet"))


@query(f"""
with f as ({A.CSV_FLOWS})
select cast(l_orderkey as double) as l_orderkey, cast(l_linenumber as double) as l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, label_raw from f
""")
def q_csv_roundtrip(spark, folder):
    rows = csv_flows(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "label_raw"
    )
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return flow_io.read_flow_csv(spark, path, "*.csv", "label_raw")


@query(f"""
with f as ({A.FLOWS})
select uid, cast(event_id as varchar) as event_id, duration, proto,
  nullif(orig_bytes_raw, '-') as orig_bytes, raw_label as label from f
""")
def q_zeek_scan(spark, folder):
    path = scratch_path(spark, "zeek")
    rows = flows(spark, folder)
    line = F.concat_ws("\t", "uid", F.col("event_id").cast("string"), F.col("duration").cast("string"), "proto",
                       "orig_bytes_raw", F.concat(F.lit("x   "), "raw_label"))
    head = "#separator \\x09\n#fields\tuid\tevent_id\tduration\tproto\torig_bytes\ttunnel_parents   label   detailed-label"
    spark.range(1).select(F.explode(F.split(F.lit(head), "\n")).alias("value")).write.mode("append").text(path)
    rows.select(line.alias("value")).write.mode("append").text(path)
    log = zeek.name_label_column(zeek.read_zeek_log(spark, path, "conn", corrupt=None))
    return log.withColumn("duration", S.to_num(F.col("duration"))).withColumn(
        "label", F.substring("label", 5, 1000)
    )


@query(f"""
with f as ({A.FLOWS})
select case when event_id % 10 > 0 then uid end as uid, case when event_id % 10 > 0 then proto end as proto,
  case when event_id % 10 > 0 and event_id % 2 = 1 then cast(event_id as varchar) end as event_id,
  case when event_id % 10 = 0 then concat_ws(chr(9), uid, proto, 'too', 'many', 'fields') end as _corrupt from f
""")
def q_zeek_corrupt(spark, folder):
    # two files with fields in different orders, and rows longer than their header
    path, rows = scratch_path(spark, "zeek"), flows(spark, folder)
    long = F.when(F.col("event_id") % 10 == 0, F.concat_ws("\t", "uid", "proto", F.lit("too"), F.lit("many"), F.lit("fields")))
    odd = F.concat_ws("\t", F.col("event_id").cast("string"), "proto", "uid")
    even = F.concat_ws("\t", "uid", "proto")
    for head, line, rest in (("#fields\tevent_id\tproto\tuid", odd, 1), ("#fields\tuid\tproto", F.coalesce(long, even), 0)):
        part = rows.filter(F.col("event_id") % 2 == rest).select(line.alias("value"))
        # every task writes its own file, which starts with the header
        part.mapInPandas(_headed(head), "value string").write.mode("append").text(path)
    return zeek.read_zeek_log(spark, path)


def _headed(head: str):
    def run(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        yield from batches

    return run


TELEMETRY_SQL = f"""
with t as ({A.TELEMETRY})
select condition, cast(run as int) as run, cast(server_round as int) as server_round, client_id,
  try_cast(train_time_ms as double) as train_time_ms, try_cast(pqc_total_overhead_ms as double) as pqc_total_overhead_ms,
  try_cast(pqc_encap_ms as double) as pqc_encap_ms, try_cast(sym_enc_ms as double) as sym_enc_ms,
  try_cast(encrypted_payload_bytes as bigint) as encrypted_payload_bytes,
  try_cast(plaintext_payload_bytes as bigint) as plaintext_payload_bytes,
  try_cast(is_encrypted as boolean) as is_encrypted, try_cast(dp_enabled as boolean) as dp_enabled,
  try_cast(epsilon_consumed as double) as epsilon_consumed,
  try_cast(global_loss as double) as global_loss, try_cast(global_accuracy as double) as global_accuracy,
  nullif(eval_client_id, '') as eval_client_id,
  try_cast(eval_loss as double) as eval_loss, try_cast(eval_accuracy as double) as eval_accuracy
from t
"""


@query(TELEMETRY_SQL)
def q_telemetry_scan(spark, folder):
    path = scratch_path(spark, "telemetry")
    telemetry_text(spark, folder).write.option("header", True).option("emptyValue", "").csv(path)
    return tele.read_telemetry(spark, path)


@query(TELEMETRY_SQL)
def q_union_runs(spark, folder):
    rows = telemetry_text(spark, folder)
    paths = []
    for condition in ("A_baseline", "B_pqc_only", "C_pqc_dp"):
        paths.append(scratch_path(spark, "runs"))
        tele.append_telemetry(rows.filter(F.col("condition") == condition), paths[-1], "csv")
    return tele.combine_telemetry(spark, paths, scratch_path(spark, "combined"))


@query("select * from orders")
def q_parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "parquet")
    flow_io.write_table(spark.read.parquet(f"{folder}/orders.parquet"), path)
    return flow_io.read_flows(spark, path)


# --- projections, filters, pruning -----------------------------------------------


@query(f"with f as ({A.FLOWS}) select event_id, user_id, proto, duration, orig_bytes_raw, local_orig, raw_label from f")
def q_drop_identifiers(spark, folder):
    joined = flows(spark, folder).select("*", F.col("ts").alias("ts_http"), F.col("uid").alias("id.orig_h_ssl"))
    return clean.drop_identifiers(joined)


@query(f"with f as ({A.PARSED}) select event_id, duration, orig_bytes from f")
def q_select_features(spark, folder):
    return clean.select_features(parsed(spark, folder), clean.FLOW_NUMBERS, keep=["event_id"])


@query(f"with f as ({A.PARSED}) select event_id, ts, label from f where label = 'Benign'")
def q_filter_benign(spark, folder):
    return parsed(spark, folder).filter("label = 'Benign'").select("event_id", "ts", "label")


@query(f"with f as ({A.PARSED}) select * from f where orig_bytes is not null and service is not null")
def q_drop_incomplete(spark, folder):
    return clean.drop_incomplete(parsed(spark, folder), ["orig_bytes", "service"])


@query(f"with f as ({A.CSV_FLOWS}) select l_orderkey, l_linenumber, label_raw as found from f")
def q_find_label(spark, folder):
    rows = csv_flows(spark, folder).withColumnRenamed("label_raw", "Label")
    return rows.select("l_orderkey", "l_linenumber", F.col(clean.find_label_column(rows)).alias("found"))


@query(f"""
with d as (select distinct {CLASS_SQL} as label_str from events)
select label_str, row_number() over (order by label_str <> 'Benign', label_str) - 1 as label from d
""")
def q_label_map(spark, folder):
    rows = flows(spark, folder).select(L.parse_zeek_label(F.col("raw_label")).alias("label_str"))
    path = scratch_path(spark, "label_map")
    flow_io.write_label_map(encode.fit_label_encoder(rows, "label_str"), path)
    return flow_io.read_label_map(spark, path)


@query(f"with f as ({A.PARSED}) select event_id, orig_bytes, service from f where orig_bytes is not null or service is not null")
def q_drop_empty(spark, folder):
    rows = parsed(spark, folder).select("event_id", "orig_bytes", "service")
    return clean.drop_incomplete(rows, ["orig_bytes", "service"], how="all")


@query("select l_orderkey, l_linenumber, true as varies from lineitem")
def q_assert_varying(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("flat", F.lit(1))
    kept, gone = clean.drop_constant_columns(rows)
    clean.assert_varying(kept, kept.columns)
    return kept.select("l_orderkey", "l_linenumber", F.lit(gone == ["flat"]).alias("varies"))


PROFILED = ["user_id", "proto", "duration", "orig_bytes_raw", "local_orig", "service"]
PROFILE_VIEW = f"select f.*, case when proto = 'view' then cast('up' as varchar(20)) end as service from ({A.FLOWS}) f"


def _profiled(spark, folder):
    return A.view(spark, folder, PROFILE_VIEW, "events")


@query(f"with f as ({PROFILE_VIEW}) " + " union all ".join(
    f"select '{c}' as col, count({c}) as non_null, "
    f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 1 as is_constant from f" for c in PROFILED
))
def q_constant_profile(spark, folder):
    return clean.constant_profile(_profiled(spark, folder), PROFILED)


@query(f"with f as ({PROFILE_VIEW}) " + " union all ".join(
    f"select '{c}' as col, cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) "
    "as distinct_values from f" for c in PROFILED
))
def q_null_distinct_profile(spark, folder):
    return clean.distinct_profile(_profiled(spark, folder), PROFILED)


@query(f"with f as ({A.PARSED}) select event_id, uid from f where event_id % 17 <> 0 and service is not null")
def q_valid_payloads(spark, folder):
    full = F.array("uid", "service", "label")
    parts = F.when(F.col("orig_bytes").isNull(), F.slice(full, 1, 2)).otherwise(full)
    return metrics.valid_payloads(parsed(spark, folder).withColumn("parts", parts)).select("event_id", "uid")


# --- joins -----------------------------------------------------------------------


LOGS_SQL = """
with c as ({conn}), h as ({http}), d as ({dns}), s as ({ssl})
select c.uid, host, c.duration, proto, method, h.duration as duration_http, query, d.duration as duration_dns, server
from c left join h on c.uid {eq} h.uid left join d on c.uid {eq} d.uid left join s on c.uid {eq} s.uid
"""
# the same logs with a fifth of the connections on one id and a seventh without any; the
# logs are read whole and hold that id and a missing one in one row each, so fan-out stays
# that of the connections
HOT = "case when {n} % 5 = 0 then 'C5' when {n} % 7 = 0 then null else concat('C', cast({n} as varchar(20))) end as uid"
HOT_LOG = "case when {n} = 5 then 'C5' when {n} = 7 then null else concat('C', cast({n} as varchar(20))) end as uid"
HOT_CONN = f"select {HOT.format(n='c_custkey')}, c_name as host, c_acctbal as duration, c_mktsegment as proto from customer"
HOT_HTTP = f"select {HOT_LOG.format(n='o_orderkey')}, o_orderpriority as method, o_totalprice as duration from orders"
HOT_DNS = f"select {HOT_LOG.format(n='s_suppkey')}, s_name as query, s_acctbal as duration from supplier"


def _logs(spark, folder, conn, http, dns):
    base = A.view(spark, folder, conn, "customer")
    return base, {
        "http": A.view(spark, folder, http, "orders"), "dns": A.view(spark, folder, dns, "supplier"),
        "ssl": A.view(spark, folder, A.SSL, "nation"),
    }


@query(LOGS_SQL.format(conn=A.CONN, http=A.HTTP, dns=A.DNS, ssl=A.SSL, eq="="))
def q_merge_logs(spark, folder):
    return joins.merge_logs(*_logs(spark, folder, A.CONN, A.HTTP, A.DNS))


@query(LOGS_SQL.format(conn=HOT_CONN, http=HOT_HTTP, dns=HOT_DNS, ssl=A.SSL, eq="="))
def q_merge_hot_logs(spark, folder):
    return joins.merge_logs(*_logs(spark, folder, HOT_CONN, HOT_HTTP, HOT_DNS))


@query(LOGS_SQL.format(conn=HOT_CONN, http=HOT_HTTP, dns=HOT_DNS, ssl=A.SSL, eq="is not distinct from"))
def q_merge_null_keys(spark, folder):
    return joins.merge_logs(*_logs(spark, folder, HOT_CONN, HOT_HTTP, HOT_DNS), null_safe=True)


COARSE_ROWS = f"""
with f as ({A.CSV_FLOWS})
select l_orderkey, l_linenumber, label_raw, coalesce(coarse, '') as label_str
from f left join {COARSE_SQL} on upper(trim(label_raw)) = fine
"""


@query(COARSE_ROWS)
def q_coarse_label(spark, folder):
    return joins.map_labels(csv_flows(spark, folder), L.class_table(spark), "label_raw").select(
        "l_orderkey", "l_linenumber", "label_raw", "label_str"
    )


@query(f"""
with f as ({A.CSV_FLOWS})
select label_raw as label, count(*) as "rows" from f left join {COARSE_SQL} on upper(trim(label_raw)) = fine
where fine is null group by 1
""")
def q_unmapped_labels(spark, folder):
    return joins.unmapped_labels(csv_flows(spark, folder), L.class_table(spark), "label_raw")


@query(f"""
with f as ({A.CSV_FLOWS})
select l_orderkey, l_linenumber, label_raw from f join {COARSE_SQL} on upper(trim(label_raw)) = fine
""")
def q_keep_mapped(spark, folder):
    return joins.keep_mapped(csv_flows(spark, folder), L.class_table(spark), "label_raw").select(
        "l_orderkey", "l_linenumber", "label_raw"
    )


@query(f"""
with f as ({A.PARSED}),
w as (select time_bucket(interval '5 minutes', ts) as window_start, round(avg(duration), 6) as duration_mean,
  count(*) as packet_count from f group by 1),
d as (select unnest(generate_series(min(window_start), max(window_start), interval '5 minutes')) as window_start from w)
select d.window_start, duration_mean, coalesce(packet_count, 0) as packet_count
from d left join w on d.window_start = w.window_start
""")
def q_dense_windows(spark, folder):
    table = windows.window_features(parsed(spark, folder), "5 minutes", ["duration"], uid="uid").select(
        "window_start", "duration_mean", "packet_count"
    )
    return rounded(windows.densify_windows(table, "5 minutes", counts=["packet_count"]), 6, "duration_mean")


@query(f"""
with f as ({A.PARSED}),
w as (select time_bucket(interval '7 minutes', ts, timestamp '1970-01-01') as window_start, count(*) as packet_count from f group by 1),
d as (select unnest(generate_series(min(window_start), max(window_start), interval '7 minutes')) as window_start from w)
select d.window_start, coalesce(packet_count, 0) as packet_count from d left join w on d.window_start = w.window_start
""")
def q_dense_windows_uneven(spark, folder):
    table = windows.window_features(parsed(spark, folder), "7 minutes", uid="uid").select("window_start", "packet_count")
    return windows.densify_windows(table, "7 minutes", counts=["packet_count"])


@query(f"""
with t as ({A.TELEMETRY}), c as (select distinct condition from t),
p as (select condition, cast(unnest(range(1, 8)) as int) as run from c),
done as (select condition, cast(run as int) as run from t group by 1, 2 having max(cast(server_round as int)) >= 40)
select p.condition, p.run from p left join done on p.condition = done.condition and p.run = done.run
where done.run is null
""")
def q_missing_sessions(spark, folder):
    log = tele.to_telemetry(telemetry_text(spark, folder))
    return joins.missing_sessions(joins.planned_sessions(log.select("condition").distinct(), 7), log, 40)


# --- aggregates ------------------------------------------------------------------

@query(f"""
select {CLASS_SQL} as label_str, count(*) as "rows",
  round(count(*) * 100.0::double / (select count(*) from events), 6) as percent
from events group by 1
""")
def q_class_distribution(spark, folder):
    rows = flows(spark, folder).select(L.parse_zeek_label(F.col("raw_label")).alias("label_str"))
    return rounded(metrics.class_distribution(rows, "label_str"), 6, "percent")


@query(f"""
with d as (select distinct {CLASS_SQL} as label_str from events)
select label_str, row_number() over (order by label_str <> 'Benign', label_str) - 1 as label from d
""")
def q_label_encoder(spark, folder):
    rows = flows(spark, folder).select(L.parse_zeek_label(F.col("raw_label")).alias("label_str"))
    return encode.fit_label_encoder(rows, "label_str")


DIRTY = """
select event_id, case when event_id % 13 = 0 then cast('Infinity' as double) when event_id % 19 = 0 then
  cast('NaN' as double) else value end as rate,
  case when event_id % 11 = 0 then null when event_id % 23 = 0 then cast('-Infinity' as double)
       else cast(event_id % 1000 as double) / 7 end as ratio
from events
"""


@query(f"""
with f as ({DIRTY})
select 'rate' as col, count(*) filter (where rate is null or isnan(rate)) as missing,
  count(*) filter (where isinf(rate)) as infinite from f
union all select 'ratio', count(*) filter (where ratio is null or isnan(ratio)),
  count(*) filter (where isinf(ratio)) from f
""")
def q_quality_profile(spark, folder):
    return clean.quality_profile(A.view(spark, folder, DIRTY, "events"), ["rate", "ratio"])


@query(f"""
with f as ({DIRTY})
select event_id,
  round(case when rate is null or isnan(rate) or isinf(rate) then 0 else cast(cast(rate as float) as double) end, 4) as rate,
  round(case when ratio is null or isnan(ratio) or isinf(ratio) then 0 else cast(cast(ratio as float) as double) end, 4) as ratio
from f
""")
def q_clean_numeric(spark, folder):
    return rounded(clean.clean_numeric(A.view(spark, folder, DIRTY, "events"), ["rate", "ratio"]), 4, "rate", "ratio")


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) as {c}" for c in SCALED
) + " from lineitem")
def q_standardize(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", *SCALED)
    return rounded(encode.apply_scaler(rows, encode.fit_scaler(rows, SCALED), SCALED), 5, *SCALED)


@query(f"""
with f as ({A.PARSED})
select count(*) filter (where label <> 'Benign') as attacks, count(*) filter (where label = 'Benign') as normal,
  round(100.0::double * count(*) filter (where label <> 'Benign') / count(*), 6) as attack_percent from f
""")
def q_attack_ratio(spark, folder):
    return rounded(metrics.attack_ratio(parsed(spark, folder), F.col("label") != "Benign"), 6, "attack_percent")


def _elements(df: DataFrame, keys: list[str], vec: str, digits: int = 6) -> DataFrame:
    cells = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    return cells.select(*keys, "pos", F.round("x", digits).alias("x"))


VECTOR_CELLS = f"""
u as ({A.UPDATES}),
c as (select server_round, num_examples, generate_subscripts(weights, 1) - 1 as pos, unnest(weights)::double as w from u)
"""


@query(f"""
with {VECTOR_CELLS}
select server_round, cast(pos as int) as pos, round(sum(w * num_examples) / sum(num_examples), 6) as x
from c group by 1, 2
""")
def q_weighted_vector_mean(spark, folder):
    updates = A.view(spark, folder, A.UPDATES, "embeddings")
    return _elements(
        metrics.weighted_vector_mean(updates, ["server_round"], "weights", "num_examples"),
        ["server_round"], "weights",
    )


@query(f"""
with e as ({A.EVALUATIONS})
select server_round, round(sum(loss * num_examples) / sum(num_examples), 6) as global_loss,
  round(sum(coalesce(accuracy, 0) * num_examples) / sum(num_examples), 6) as global_accuracy,
  cast(sum(num_examples) as bigint) as num_examples
from e group by 1
""")
def q_weighted_metrics(spark, folder):
    rows = A.view(spark, folder, A.EVALUATIONS, "events")
    return rounded(metrics.weighted_metrics(rows, ["server_round"]), 6, "global_loss", "global_accuracy")


SUMMARY_SQL = f"""
with t as ({TELEMETRY_SQL}),
per_round as (
  {" union all ".join(f"select condition, '{m}' as metric, cast({m} as double) as value from t" for m in metrics.ROUND_METRICS if m != "eval_accuracy")}
  union all select condition, 'eval_accuracy', eval_accuracy from t
    where eval_client_id is null or eval_client_id <> 'aggregate'),
finals as (
  {" union all ".join(f"select condition, run, server_round, '{m}' as metric, {m} as value from t where {m} is not null" for m in metrics.FINAL_METRICS)}),
last_one as (
  select condition, metric, value from (
    select *, row_number() over (partition by condition, run, metric order by server_round desc, value desc) as rn from finals)
  where rn = 1 and (metric <> 'epsilon_consumed' or value >= 0)),
everything as (select * from per_round where value is not null union all select * from last_one)
select condition, metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std
from everything group by 1, 2
"""


@query(SUMMARY_SQL)
def q_experiment_summary(spark, folder):
    return rounded(metrics.summarise_experiments(telemetry_text(spark, folder)), 6, "mean", "std")


@query(SUMMARY_SQL.replace("""
    where eval_client_id is null or eval_client_id <> 'aggregate'""", ""))
def q_summary_with_joint_rows(spark, folder):
    return rounded(metrics.summarise_experiments(telemetry_text(spark, folder), include_aggregate=True), 6, "mean", "std")


@query(SUMMARY_SQL)
def q_experiment_report(spark, folder):
    # from one CSV file per condition
    rows, paths = telemetry_text(spark, folder), []
    for condition in ("A_baseline", "B_pqc_only", "C_pqc_dp"):
        paths.append(scratch_path(spark, "runs"))
        tele.append_telemetry(rows.filter(F.col("condition") == condition), paths[-1], "csv")
    return rounded(experiment_report(spark, paths).summary, 6, "mean", "std")


@query(f"""
with t as ({TELEMETRY_SQL}),
s as (select condition, server_round, avg(global_accuracy) as mean, coalesce(stddev_samp(global_accuracy), 0) as std
  from t where client_id = 'aggregate' group by 1, 2)
select condition, server_round, round(mean, 6) as mean, round(std, 6) as std,
  round(mean - std, 6) as low, round(mean + std, 6) as high from s
""")
def q_convergence(spark, folder):
    return rounded(metrics.convergence(telemetry_text(spark, folder)), 6, "mean", "std", "low", "high")


@query(f"""
with t as ({TELEMETRY_SQL}),
s as (
  select 'train_time_ms' as metric, avg(train_time_ms) filter (where condition = 'A_baseline') as b,
    avg(train_time_ms) filter (where condition = 'B_pqc_only') as o from t
  union all select 'pqc_total_overhead_ms', avg(pqc_total_overhead_ms) filter (where condition = 'A_baseline'),
    avg(pqc_total_overhead_ms) filter (where condition = 'B_pqc_only') from t)
select metric, round(b, 6) as base_mean, round(o, 6) as other_mean,
  round(case when b = 0 then null else (o - b) * 100 / b end, 6) as overhead_percent from s
""")
def q_overhead_pct(spark, folder):
    found = metrics.overhead_pct(
        telemetry_text(spark, folder), "A_baseline", "B_pqc_only", ["train_time_ms", "pqc_total_overhead_ms"]
    )
    return rounded(found, 6, "base_mean", "other_mean", "overhead_percent")


@query(f"""
with p as ({A.PREDICTIONS}),
c as (select count(*) filter (where label = 1 and score > 0.5) as tp, count(*) filter (where label <> 1 and score > 0.5) as fp,
  count(*) filter (where label = 1 and score <= 0.5) as fn, count(*) filter (where label <> 1 and score <= 0.5) as tn from p)
select tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy,
  round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall,
  round(fp::double / nullif(fp + tn, 0), 6) as false_positive_rate,
  round(2 * tp::double / nullif(2 * tp + fp + fn, 0), 6) as f1 from c
""")
def q_binary_metrics(spark, folder):
    scores = A.view(spark, folder, A.PREDICTIONS, "documents", "labels")
    return rounded(metrics.binary_metrics(scores), 6, "accuracy", "precision", "recall", "false_positive_rate", "f1")


@query(f"""
with p as ({A.PREDICTIONS}), r as (select label, rank() over (order by score) +
  (count(*) over (partition by score) - 1) / 2.0::double as rk from p),
c as (select sum(case when label = 1 then 1 else 0 end)::bigint as np, sum(case when label = 1 then 0 else 1 end)::bigint as nn,
  sum(case when label = 1 then rk else 0 end) as s from r)
select np as positives, nn as negatives, round((s - np * (np + 1) / 2.0::double) / (np * nn), 6) as auc from c
""")
def q_roc_auc(spark, folder):
    scores = A.view(spark, folder, A.PREDICTIONS, "documents", "labels")
    return rounded(metrics.roc_auc(scores), 6, "auc")


def _secret(spark, folder):
    return spark.read.parquet(f"{folder}/region.parquet").agg(
        F.sha2(F.concat_ws("|", F.min("r_name"), F.max("r_name")), 256).alias("secret")
    )


def _payloads(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", (F.col("doc_id") % 40 + 1).cast("int").alias("server_round"), "text")


@query("""
select cast(doc_id % 40 + 1 as int) as server_round, count(*) as payloads, cast(sum(strlen(text)) as bigint) as plain_bytes,
  cast(sum(strlen(text) + 28) as bigint) as sealed_bytes, cast(28 * count(*) as bigint) as overhead_bytes
from documents group by 1
""")
def q_payload_stats(spark, folder):
    payloads = _payloads(spark, folder)
    key = privacy.round_key(_secret(spark, folder), F.col("server_round"))
    sealed = privacy.seal(payloads.withColumn("plain", F.col("text")), "text", key)
    return metrics.payload_stats(sealed, ["server_round"])


@query("""
select case when doc_id % 3 = 0 then 'A_baseline' else 'B_pqc_only' end as condition, 1 as run,
  cast(doc_id % 40 + 1 as int) as server_round, cast(doc_id as varchar) as client_id,
  n_chars / 1e6 as train_time_ms,
  case when doc_id % 3 = 0 then 0 else 3000 / 1e6 end as pqc_total_overhead_ms,
  case when doc_id % 3 = 0 then 0 else 2000 / 1e6 end as pqc_encap_ms,
  case when doc_id % 3 = 0 then 0 else 1000 / 1e6 end as sym_enc_ms,
  cast(strlen(text) + case when doc_id % 3 = 0 then 0 else 28 end as bigint) as encrypted_payload_bytes,
  cast(strlen(text) as bigint) as plaintext_payload_bytes, doc_id % 3 <> 0 as is_encrypted, false as dp_enabled,
  cast(-1 as double) as epsilon_consumed, cast(null as double) as global_loss, cast(null as double) as global_accuracy,
  cast(null as varchar) as eval_client_id, cast(null as double) as eval_loss, cast(null as double) as eval_accuracy
from documents
""")
def q_round_metrics(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = F.col("doc_id") % 3 == 0
    size = F.octet_length("text").cast("bigint")
    return tele.round_metrics(docs.select(
        F.when(plain, "A_baseline").otherwise("B_pqc_only").alias("condition"), F.lit(1).alias("run"),
        (F.col("doc_id") % 40 + 1).cast("int").alias("server_round"), F.col("doc_id").alias("client_id"),
        F.col("n_chars").alias("train_ns"), size.alias("plain_bytes"), F.when(~plain, size + 28).alias("sealed_bytes"),
        F.when(~plain, 2000).alias("encap_ns"), F.when(~plain, 1000).alias("sym_enc_ns"),
        F.lit(None).cast("double").alias("epsilon"),
    ))


# --- windows ---------------------------------------------------------------------

BUCKET = "time_bucket(interval '5 minutes', ts) as window_start"


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, min(duration) as duration_min, max(duration) as duration_max, round(avg(duration), 6) as duration_mean,
  min(orig_bytes) as orig_bytes_min, max(orig_bytes) as orig_bytes_max, round(avg(orig_bytes), 6) as orig_bytes_mean
from f group by 1
""")
def q_window_numeric(spark, folder):
    table = windows.window_features(parsed(spark, folder), "5 minutes", ["duration", "orig_bytes"])
    return rounded(table, 6, "duration_mean", "orig_bytes_mean")


@query(f"with f as ({A.PARSED}) select {BUCKET}, count(distinct uid) as flow_count, count(*) as packet_count from f group by 1")
def q_window_counts(spark, folder):
    return windows.window_features(parsed(spark, folder), "5 minutes", uid="uid")


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, count(proto) as proto_count, count(distinct proto) as proto_nunique,
  count(service) as service_count, count(distinct service) as service_nunique from f group by 1
""")
def q_window_categorical(spark, folder):
    return windows.window_features(parsed(spark, folder), "5 minutes", text=["proto", "service"])


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, (array_agg(service order by ts, event_id) filter (where service is not null))[1] as service_first,
  (array_agg(service order by ts desc, event_id desc) filter (where service is not null))[1] as service_last,
  count(distinct service) as service_nunique from f group by 1
""")
def q_window_first_last(spark, folder):
    return windows.window_features(parsed(spark, folder), "5 minutes", edges=["service"], order=["ts", "event_id"])


@query(f"with f as ({A.PARSED}) select {BUCKET}, max(case when label <> 'Benign' then 1 else 0 end) as label from f group by 1")
def q_window_label_any(spark, folder):
    return windows.window_label(parsed(spark, folder), "5 minutes", "any", is_attack=F.col("label") != "Benign")


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, coalesce(arg_min(label, row(ts, event_id)) filter (where label <> 'Benign'), 'Benign') as label
from f group by 1
""")
def q_window_label_first(spark, folder):
    return windows.window_label(parsed(spark, folder), "5 minutes", "first_attack", order=["ts", "event_id"])


MODE_SQL = f"""
with f as ({A.PARSED}), c as (select {BUCKET}, label, count(*) as n from f group by 1, 2)
select window_start, label from (
  select *, row_number() over (partition by window_start order by n desc, label) as rn from c) where rn = 1
"""


@query(MODE_SQL)
def q_window_label_mode(spark, folder):
    return windows.window_label(parsed(spark, folder), "5 minutes", "mode")


# --- samples and splits ----------------------------------------------------------


@query(f"""
with f as ({A.PARSED})
select event_id, label from (
  select *, row_number() over (partition by label order by {EVENT_HASH}) as rn from f) where rn <= 1000
""")
def q_stratified_sample(spark, folder):
    return sample.stratified_sample(parsed(spark, folder), "label", 1000, 200, ["event_id"]).select("event_id", "label")


@query(f"""
with m as (select f.*, coarse from ({A.CSV_FLOWS}) f join {COARSE_SQL} on upper(trim(label_raw)) = fine)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, coarse as label_str from (
  select *, row_number() over (partition by coarse order by {LINE_HASH}) as rn from m)
where rn <= 2000 or coarse = 'Recon'
""")
def q_two_step_sample(spark, folder):
    rows = csv_flows(spark, folder).withColumn("label_str", L.coarse_label(F.col("label_raw"))).filter("label_str <> ''")
    taken = sample.take_all_or_sample(rows, "label_str", 2000, 500, line_key(), whole=["Recon"])
    return taken.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label_str")


@query(f"select event_id from events where substr({EVENT_HASH}, 1, 8) < '{int(0.1 * 16**8):08x}'")
def q_fraction_sample(spark, folder):
    return sample.fraction_sample(flows(spark, folder), 0.1, ["event_id"]).select("event_id")


@query(f"select event_id, row_number() over (order by {EVENT_HASH}) - 1 as row from events")
def q_shuffle_rows(spark, folder):
    return sample.shuffle_rows(flows(spark, folder).select("event_id"), ["event_id"], index="row")


@query(f"""
with f as ({A.PARSED}), r as (select *, row_number() over (partition by label order by {EVENT_HASH}) as rn,
  count(*) over (partition by label) as n from f)
select event_id, label, rn <= ceil(round(n * 0.2, 6)) as is_test from r
""")
def q_stratified_split(spark, folder):
    return sample.stratified_split(parsed(spark, folder), "label", 0.2, ["event_id"]).select("event_id", "label", "is_test")


@query(f"""
with r as (select *, row_number() over (order by {EVENT_HASH}) as rn, count(*) over () as n from events)
select event_id, rn <= ceil(round(n * 0.1, 6)) as is_validation from r
""")
def q_validation_tail(spark, folder):
    return sample.validation_tail(flows(spark, folder), 0.1, ["event_id"]).select("event_id", "is_validation")


@query(f"with f as ({A.FLOWS}) select distinct raw_label from f order by 1 limit 10")
def q_topk_labels(spark, folder):
    return sample.peek_values(flows(spark, folder), "raw_label")


@query('select cast(event_id % 5 as int) as client_id, count(*) as "rows" from events group by 1')
def q_client_counts(spark, folder):
    return sample.assign_clients(flows(spark, folder), 5, "event_id").groupBy("client_id").agg(F.count("*").alias("rows"))


@query(f"""
with r as (select event_id, cast(event_id % 2 as int) as client_id,
  row_number() over (partition by event_id % 2 order by {EVENT_HASH}) as rn, count(*) over (partition by event_id % 2) as n
  from events)
select event_id, client_id, cast((rn - 1) // 32 as bigint) as batch_id from r where (rn - 1) // 32 < n // 32
""")
def q_batches(spark, folder):
    rows = sample.assign_clients(flows(spark, folder), 2, "event_id").select("event_id", "client_id")
    return sample.assign_batches(rows, 32, ["event_id"])


# --- scalar functions ------------------------------------------------------------

# fixed values: forms of raw labels, and what they stand for
LABEL_CASES = [
    ("(empty)   Malicious   PartOfAHorizontalPortScan", "PartOfAHorizontalPortScan"),
    ("(empty)\tBenign\t-", "Benign"),
    ("-   benign   -", "Benign"),
    ("Benign", "Benign"),
    ("benign", "benign"),
    ("(empty)   Malicious   -", "Malicious_Unknown"),
    ("-", "Benign"),
    ("", "Benign"),
    (" NaN ", "Benign"),
    ("  \tx ", "x"),
    ("(empty)\tMalicious\tC&C", "C&C"),
    ("   -   (empty)   ", "Benign"),
]


def _label_case(side: int) -> str:
    cases = " ".join(f"when {i} then '{c[side]}'" for i, c in enumerate(LABEL_CASES))
    other = "cast(null as varchar(9))" if side == 0 else "'Benign'"
    return f"case event_id % {len(LABEL_CASES) + 1} {cases} else {other} end"


@query(f"select event_id, {_label_case(1)} as label_str from events")
def q_parse_label(spark, folder):
    rows = A.view(spark, folder, f"select event_id, {_label_case(0)} as raw from events", "events")
    return rows.select("event_id", L.parse_zeek_label(F.col("raw")).alias("label_str"))


@query(f"with f as ({A.FLOWS}) select event_id, nullif(orig_bytes_raw, '-') as orig_bytes_raw, nullif(raw_label, '-') as raw_label from f")
def q_null_sentinels(spark, folder):
    rows = flows(spark, folder).select("event_id", "orig_bytes_raw", "raw_label")
    return clean.null_text_sentinels(rows, ["orig_bytes_raw", "raw_label"])


@query("""
select event_id, case when event_id % 17 <> 0 then epoch_ms(cast(1525879831000 + event_id * 250 as bigint)) end as ts from events
""")
def q_epoch_ts(spark, folder):
    text = """select event_id, case when event_id % 17 = 0 then 'bad'
      else cast(1525879831 + cast(event_id as double) / 4 as string) end as raw from events"""
    rows = A.view(spark, folder, text, "events")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return rows.select("event_id", S.to_ts(F.col("raw")).cast("timestamp_ntz").alias("ts"))


@query(f"""
with f as ({A.FLOWS})
select event_id, try_cast(orig_bytes_raw as double) as number, coalesce(try_cast(orig_bytes_raw as double), 0) as filled from f
""")
def q_to_num(spark, folder):
    raw = F.col("orig_bytes_raw")
    return flows(spark, folder).select("event_id", S.to_num(raw).alias("number"), S.to_num(raw, 0.0).alias("filled"))


CODED = ["proto", "service", "uid"]


@query(f"with f as ({A.PARSED}) select event_id, " + ", ".join(
    f"cast(case when {c} is null then -1 else dense_rank() over (order by {c} nulls last) - 1 end as bigint) as {c}" for c in CODED
) + " from f")
def q_ordinal_encode(spark, folder):
    return encode.ordinal_encode(parsed(spark, folder).select("event_id", *CODED), CODED)


@query(f"""
with f as ({A.PARSED})
select event_id, coalesce(orig_bytes, 0) as orig_bytes, coalesce(service, 'None') as service, label from (
  select event_id, orig_bytes, service, coalesce(case when event_id % 29 <> 0 then label end, 'Benign') as label from f)
""")
def q_fill_defaults(spark, folder):
    rows = parsed(spark, folder).select(
        "event_id", "orig_bytes", "service", F.when(F.col("event_id") % 29 != 0, F.col("label")).alias("label")
    )
    return clean.fill_defaults(rows)


@query("""
select l_orderkey, l_linenumber, p.pos, p.x from lineitem,
  lateral (values (0, l_quantity), (1, l_extendedprice), (2, l_discount), (3, l_tax)) p(pos, x)
""")
def q_assemble(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(assemble(SCALED)).alias("pos", "x"))


def _factor_sql(name: str) -> str:
    return f"(3 + 7 * cast(('0x' || substr(md5('42:{name}'), 1, 8))::bigint as double) / 4294967296)"


@query(f"""
with f as (select event_id, duration, orig_bytes, service, event_id % 100 as packet_count,
  case when label = 'Benign' then 0 else 1 end as label from ({A.PARSED})),
s as (select * from (select *, row_number() over (order by {EVENT_HASH}) as rn from f where label = 0) where rn <= 3000)
select event_id, round(duration, 6) as duration, round(orig_bytes, 6) as orig_bytes, service, packet_count, 0 as label from s
union all
select event_id, round(duration * {_factor_sql("duration")}, 6), round(orig_bytes * {_factor_sql("orig_bytes")}, 6),
  service, packet_count, 1 from s
""")
def q_inject_attacks(spark, folder):
    rows = parsed(spark, folder).select(
        "event_id", "duration", "orig_bytes", "service", (F.col("event_id") % 100).alias("packet_count"),
        F.when(F.col("label") == "Benign", 0).otherwise(1).alias("label"),
    )
    return rounded(sample.inject_attacks(rows, "label", 3000, ["event_id"]), 6, "duration", "orig_bytes")


# --- privacy ---------------------------------------------------------------------

CLIENTS = """
select cast(user_id % 5 as int) as client_id, count(*) as n, cast(1.1 as double) as sigma, cast(0.00001 as double) as delta,
  user_id % 5 <> 4 as dp_enabled from events group by user_id % 5
"""


@query(f"""
with c as (select *, cast(32 as double) / n as q from ({CLIENTS})),
o as (select unnest(list_concat(range(11, 64), [128, 256, 512, 1024])) as alpha),
t as (select distinct q, sigma, alpha, unnest(range(0, alpha + 1)) as k from c cross join o where dp_enabled),
whole as (select q, sigma, cast(alpha as double) as alpha, lgamma(alpha + 1) - lgamma(k + 1) - lgamma(alpha - k + 1)
  + (alpha - k) * ln(1 - q) + k * ln(q) + (k * k - k) / (2 * sigma * sigma) as v from t),
g as (select distinct q, sigma, tenth / 10.0::double as alpha, (tenth / 10.0::double + 30 * sigma) / 500 as step,
  unnest(range(0, 501)) as i from c cross join (select unnest(range(11, 110)) as tenth) where dp_enabled),
p as (select *, i * step - 15 * sigma as x, (2 * (i * step - 15 * sigma) - 1) / (2 * sigma * sigma) as shift from g),
tenth as (select q, sigma, alpha, -(x * x) / (2 * sigma * sigma) - ln(sigma * sqrt(2 * pi())) + ln(step)
  + alpha * case when shift > 0 then shift + ln(q + (1 - q) * exp(-shift)) else ln((1 - q) + q * exp(shift)) end as v from p),
l as (select * from whole union all select * from tenth),
m as (select *, max(v) over (partition by q, sigma, alpha) as top from l),
r as (select q, sigma, alpha, (max(top) + ln(sum(exp(v - top)))) / (alpha - 1) as rdp from m group by 1, 2, 3),
s as (select *, cast(sr * (n // 32) as bigint) as steps from (select *, unnest(range(1, 41)) as sr from c))
select client_id, cast(sr as int) as server_round, steps, round(min(steps * rdp + ln(1 - 1 / alpha)
  - (ln(delta) + ln(alpha)) / (alpha - 1)), 5) as epsilon
from s join r on s.q = r.q and s.sigma = r.sigma where dp_enabled group by 1, 2, 3
union all select client_id, cast(sr as int), steps, cast(-1 as double) from s where not dp_enabled
""")
def q_privacy_ledger(spark, folder):
    clients = A.view(spark, folder, CLIENTS, "events")
    return rounded(privacy.privacy_ledger(clients, rounds=40, epochs=1), 5, "epsilon")


@query(f"""
with u as ({A.UPDATES}),
c as (select client_id, server_round, generate_subscripts(weights, 1) - 1 as pos, unnest(weights)::double as w from u),
n as (select client_id, sqrt(sum(w * w)) as len from c group by 1)
select server_round, cast(pos as int) as pos, round(avg(w * least(1, 1 / len)), 6) as x
from c join n on c.client_id = n.client_id group by 1, 2
""")
def q_clipped_vector_sum(spark, folder):
    updates = A.view(spark, folder, A.UPDATES, "embeddings")
    mean = privacy.dp_vector_mean(updates, ["server_round"], "weights", clip=1.0, sigma=0.0, seed=1)
    return _elements(mean, ["server_round"], "weights")


@query("select doc_id, text, cast(strlen(text) as bigint) as plain_bytes from documents")
def q_seal_open(spark, folder):
    payloads = _payloads(spark, folder)
    key = privacy.round_key(_secret(spark, folder), F.col("server_round"))
    opened = privacy.open_sealed(privacy.seal(payloads, "text", key), "sealed", key)
    return opened.select("doc_id", F.col("plain").cast("string").alias("text"), "plain_bytes")


@query("select doc_id, cast(doc_id % 40 + 1 as int) as server_round, case when doc_id % 40 + 1 >= 21 then text end as text from documents")
def q_seal_per_round(spark, folder):
    payloads = _payloads(spark, folder)
    secret = _secret(spark, folder)
    number = F.col("server_round")
    sealed = privacy.seal(payloads, "text", privacy.round_key(secret, number))
    opened = privacy.open_sealed(sealed, "sealed", privacy.round_key(secret, number, keep_from=21))
    return opened.select("doc_id", "server_round", F.col("plain").cast("string").alias("text"))


# --- learning --------------------------------------------------------------------

DIM, CLASSES = 64, 10


def _client_rows(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    cells = [F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(DIM)]
    return vectors.select("vec_id", "label", F.pmod("vec_id", F.lit(4)).cast("int").alias("client_id"), *cells)


FEATURES = [f"f{i}" for i in range(DIM)]


@query(f"""
with v as (select vec_id % 4 as client_id, label, list_append(embedding::double[], 1.0::double) as x from embeddings),
c as (select client_id, label, generate_subscripts(x, 1) - 1 as j, unnest(x) as x from v),
g as (select client_id, k, j, sum((0.1::double - case when label = k then 1 else 0 end) * x) as s
  from c, (select unnest(range(0, 10)) as k) group by 1, 2, 3),
n as (select vec_id % 4 as client_id, count(*) as n from embeddings group by 1)
select cast(g.client_id as int) as client_id, cast(k * 65 + j as int) as pos, n as num_examples,
  round(-0.5::double * s / n, 6) as x
from g join n on g.client_id = n.client_id
""")
def q_local_update(spark, folder):
    # one full-batch step, which SQL can follow
    shards = learn.prepare_shards(_client_rows(spark, folder), FEATURES, "label", "vec_id")
    start = learn.initial_weights(DIM, CLASSES)
    updates = learn.local_update(shards, start, CLASSES, epochs=1, rate=0.5, batch=None)
    return _elements(updates, ["client_id", "num_examples"], "weights")


@query()
def q_minibatch_update(spark, folder):
    # two epochs of mini-batches of 32 per client, streamed in order; sequential steps have
    # no SQL form, so tests hold this trainer against the plain loop
    shards = learn.prepare_shards(_client_rows(spark, folder), FEATURES, "label", "vec_id")
    start = learn.initial_weights(DIM, CLASSES)
    updates = learn.local_update(shards, start, CLASSES, epochs=2, rate=0.1, batch=32)
    return rounded(_elements(updates, ["client_id", "num_examples"], "weights"), 6, "x")


def rounds_sql(condition: str, rounds: int, epochs: int, rate: float, mu: float = 0.0, clip: float = 0.0, test: float = 0.0) -> str:
    """Full-batch federated rounds written out: every epoch is one gradient step per client."""
    vec_hash = md5_sql("cast(vec_id as varchar)")
    steps = [f"""v as (
  select vec_id, label, cast(vec_id % 4 as int) as client_id, list_append(embedding::double[], 1.0::double) as e,
    row_number() over (partition by label order by {vec_hash}) <= ceil(round(count(*) over (partition by label) * {test}, 6)) as is_test
  from embeddings),
x as materialized (
  select vec_id, label, client_id, is_test, generate_subscripts(e, 1) - 1 as j, unnest(e) as x from v),
norms as (select vec_id, sqrt(sum(x * x)) as long from x group by 1),
n as (select client_id, count(*) as n from v where not is_test group by 1),
g0 as (select c, j, 0.0::double as w from (select unnest(range(0, {CLASSES})) as c), (select unnest(range(0, {DIM + 1})) as j))"""]
    logs = []
    for r in range(1, rounds + 1):
        steps.append(f"l{r}_0 as (select client_id, c, j, w from n cross join g{r - 1})")
        for e in range(1, epochs + 1):
            name, before = f"l{r}_{e}", f"l{r}_{e - 1}"
            error = "err / greatest(1, sqrt(sum(err * err) over (partition by p.vec_id)) * long / " + f"{clip})" if clip else "err"
            steps.append(f"""z{name} as (
  select vec_id, x.client_id, label, c, sum(x * w) as s from x join {before} l on x.client_id = l.client_id and x.j = l.j
  where not is_test group by 1, 2, 3, 4),
u{name} as (select *, exp(s - max(s) over (partition by vec_id)) as u from z{name}),
p{name} as (select vec_id, client_id, c, u / sum(u) over (partition by vec_id) - case when c = label then 1 else 0 end as err from u{name}),
e{name} as (select p.vec_id, client_id, c, {error} as err from p{name} p join norms on p.vec_id = norms.vec_id),
d{name} as (select e.client_id, c, j, sum(err * x) as d from e{name} e join x on e.vec_id = x.vec_id group by 1, 2, 3),
{name} as materialized (
  select l.client_id, l.c, l.j, l.w - {rate}::double * (d / n + {mu}::double * (l.w - g.w)) as w
  from {before} l join d{name} d on l.client_id = d.client_id and l.c = d.c and l.j = d.j
  join n on l.client_id = n.client_id join g{r - 1} g on l.c = g.c and l.j = g.j)""")
        steps.append(f"""g{r} as materialized (
  select c, j, sum(w * n) / sum(n) as w from l{r}_{epochs} l join n on l.client_id = n.client_id group by 1, 2),
s{r} as (select vec_id, client_id, label, c, sum(x * w) as s from x join g{r} g on x.j = g.j
  where {"is_test" if test else "true"} group by 1, 2, 3, 4),
t{r} as (select *, max(s) over (partition by vec_id) as top from s{r}),
o{r} as (select vec_id, client_id, max(top) + ln(sum(exp(s - top))) - max(case when c = label then s end) as loss,
  case when arg_max(c, s) = max(label) then 1.0::double else 0 end as hit from t{r} group by 1, 2),
c{r} as (select client_id, avg(loss) as loss, avg(hit) as accuracy from o{r} group by 1),
a{r} as (select avg(loss) as loss, avg(hit) as accuracy from o{r})""")
        nothing = ", ".join(["cast(null as double)"] * 2)
        logs.append(f"""select {r} as server_round, cast(client_id as varchar) as client_id, {nothing}, cast(null as varchar), {nothing} from n
union all select {r}, 'aggregate', loss, accuracy, 'aggregate', loss, accuracy from a{r}
union all select {r}, cast(client_id as varchar), a.loss, a.accuracy, cast(client_id as varchar), c.loss, c.accuracy from c{r} c, a{r} a""")
    names = "server_round, client_id, global_loss, global_accuracy, eval_client_id, eval_loss, eval_accuracy"
    return f"""with {", ".join(steps)},
log({names}) as ({" union all ".join(logs)})
select '{condition}' as condition, 1 as run, server_round, client_id, round(global_loss, 5) as global_loss,
  round(global_accuracy, 5) as global_accuracy, eval_client_id, round(eval_loss, 5) as eval_loss, round(eval_accuracy, 5) as eval_accuracy
from log"""


ROUND_COLUMNS = ["condition", "run", "server_round", "client_id", "global_loss", "global_accuracy", "eval_client_id",
                 "eval_loss", "eval_accuracy"]


def _rounds(spark, folder, **how) -> DataFrame:
    _, log = learn.federated_fit(_client_rows(spark, folder), FEATURES, "label", CLASSES, "vec_id", batch=None, **how)
    return rounded(log.select(*ROUND_COLUMNS), 5, "global_loss", "global_accuracy", "eval_loss", "eval_accuracy")


# rounds with one step per epoch over all rows of a client, which SQL can follow


@query(rounds_sql("A_baseline", 3, 1, 0.5))
def q_federated_rounds(spark, folder):
    return _rounds(spark, folder, rounds=3, epochs=1, rate=0.5)


@query(rounds_sql("A_baseline", 2, 2, 0.5, mu=0.1))
def q_fedprox(spark, folder):
    return _rounds(spark, folder, rounds=2, epochs=2, rate=0.5, mu=0.1)


def _fixed_weight(c: int, i: int) -> float:
    return ((c * 7 + i * 3) % 11 - 5) / 10


@query(f"""
with v as (select vec_id, label, cast(vec_id % 4 as int) as client_id, list_append(embedding::double[], 1.0::double) as e
  from embeddings),
x as (select vec_id, label, client_id, generate_subscripts(e, 1) - 1 as i, unnest(e) as x from v),
z as (select vec_id, label, client_id, c, sum(x * (((c * 7 + i * 3) % 11 - 5) / 10.0::double)) as s
  from x, (select unnest(range(0, {CLASSES})) as c) group by 1, 2, 3, 4),
t as (select *, max(s) over (partition by vec_id) as top from z),
p as (select vec_id, client_id, max(top) + ln(sum(exp(s - top))) - max(case when c = label then s end) as loss,
  case when arg_max(c, s) = max(label) then 1.0::double else 0 end as hit from t group by 1, 2)
select client_id, round(avg(loss), 5) as loss, round(avg(hit), 6) as accuracy, count(*) as num_examples from p group by 1
""")
def q_evaluate_clients(spark, folder):
    rows = _client_rows(spark, folder).withColumn("x", assemble(FEATURES))
    weights = [_fixed_weight(c, i) for c in range(CLASSES) for i in range(DIM + 1)]
    scores = learn.evaluate_clients(rows, weights, CLASSES, DIM)
    return rounded(rounded(scores, 5, "loss"), 6, "accuracy")


@query(rounds_sql("C_pqc_dp", 2, 1, 0.5, clip=0.7, test=0.2))
def q_private_rounds(spark, folder):
    # clipped steps on a split; noise would leave nothing to compare
    noise = learn.Noise(learn.secret_seed(_secret(spark, folder)), sigma=0.0, clip=0.7)
    return _rounds(spark, folder, rounds=2, epochs=1, rate=0.5, noise=noise, test=0.2, condition="C_pqc_dp")


@query(f"""
with r as (select {"concat_ws('|', " + ", ".join(LINE_KEY) + ")"} as row_key, case when l_quantity > 25 then 1 else 0 end as label from lineitem),
k as (select *, row_number() over (partition by label order by md5(concat_ws(':', '42', row_key))) as rn,
  count(*) over (partition by label) as n from r)
select row_key, label, true as accurate from k where rn <= ceil(round(n * 0.2, 6))
""")
def q_baseline_scores(spark, folder):
    # the label follows from a feature, so nearly all test rows must be told right
    days = (F.unix_timestamp("l_shipdate") / 86400.0).alias("days")
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat_ws("|", *line_key()).alias("row_key"), *SCALED, days,
        (F.col("l_quantity") > 25).cast("int").alias("label"),
    )
    scores = materialize(learn.fit_baseline(rows, [*SCALED, "days"], "label", "row_key"), "baseline")
    right = scores.select(F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("double")).alias("share"))
    return scores.select("row_key", "label", (right.scalar() > 0.95).alias("accurate"))


# --- streams ---------------------------------------------------------------------


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, min(duration) as duration_min, max(duration) as duration_max, round(avg(duration), 6) as duration_mean,
  count(*) as packet_count, max(case when label <> 'Benign' then 1 else 0 end) as label, true as flow_count_near
from f group by 1
""")
def q_stream_windows(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    batch = spark.read.parquet(f"{folder}/events.parquet")
    source = streams.stream_files(spark, folder, batch.schema, pattern="events.parquet")
    rows = source.select(
        "ts", F.col("value").alias("duration"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("uid"),
        F.col("event_type").isin("error", "signup").alias("attack"),
    )
    out = streams.stream_window_features(
        rows, "5 minutes", "10 minutes", ["duration"], uid="uid", extra=[windows.any_attack(F.col("attack")).alias("label")]
    )
    done = streams.run_to_end(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    # a stream counts flows approximately: within one or a tenth of the exact number
    exact = windows.window_features(parsed(spark, folder), "5 minutes", uid="uid").select(
        "window_start", F.col("flow_count").alias("exact"))
    near = F.abs(F.col("flow_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") / 10)
    return rounded(done.join(exact, "window_start").withColumn("flow_count_near", near).drop("flow_count", "exact"), 6, "duration_mean")


KEYED = f"""
select condition, run, server_round, client_id, eval_client_id, count(*) as n from ({A.TELEMETRY}) group by 1, 2, 3, 4, 5
"""


@query(f"""
select condition, cast(run as int) as run, cast(server_round as int) as server_round, client_id,
  nullif(eval_client_id, '') as eval_client_id,
  cast(n + case when cast(server_round as int) % 2 = 0 then 1000 else 0 end as double) as global_accuracy
from ({KEYED})
""")
def q_stream_dedup(spark, folder):
    # rows of even rounds come again, in a later batch and with another value
    feed, table, progress = (scratch_path(spark, n) for n in ("feed", "table", "progress"))
    rows = A.view(spark, folder, KEYED, "events").withColumn("global_accuracy", F.col("n").cast("string")).withColumn(
        "eval_client_id", F.nullif("eval_client_id", F.lit("")))
    again = rows.filter(F.col("server_round").cast("int") % 2 == 0).withColumn(
        "global_accuracy", (F.col("n") + 1000).cast("string"))
    for part in (rows, again):
        part.drop("n").write.mode("append").parquet(feed)
        streams.append_telemetry_stream(streams.stream_files(spark, feed, tele.TEXT_SCHEMA), table, progress)
    return streams.read_telemetry_table(spark, table).select(
        "condition", "run", "server_round", "client_id", "eval_client_id", "global_accuracy")


@query(f"""
with t as ({TELEMETRY_SQL}),
k as (select condition, run, server_round, max(global_accuracy) as acc, max(row(global_accuracy, global_loss)) as s
  from t where client_id = 'aggregate' group by 1, 2, 3),
r as (select *, row_number() over (partition by condition, run order by server_round desc) as rn from k)
select condition, run, server_round, round(acc, 6) as global_accuracy from r where rn = 1
""")
def q_stream_telemetry(spark, folder):
    raw = scratch_path(spark, "feed")
    telemetry_text(spark, folder).write.parquet(raw)
    feed = streams.stream_files(spark, raw, tele.TEXT_SCHEMA)
    table, progress = scratch_path(spark, "table"), scratch_path(spark, "progress")
    streams.append_telemetry_stream(feed, table, progress)
    latest = streams.latest_round(tele.to_telemetry(spark.read.parquet(table)))
    return rounded(latest.select("condition", "run", "server_round", "global_accuracy"), 6, "global_accuracy")


# --- flows from end to end -------------------------------------------------------


@query(f"""
with f as (select event_id, user_id, proto, duration, try_cast(orig_bytes_raw as double) as orig_bytes, {CLASS_SQL} as label_str
  from ({A.FLOWS}) join (select event_id as e, event_type from events) on event_id = e),
d as (select *, dense_rank() over (order by proto) - 1 as proto_code from f),
r as (select *, row_number() over (partition by label_str order by {EVENT_HASH}) as rn from d)
select event_id, cast(user_id as double) as user_id, cast(proto_code as double) as proto,
  round(cast(cast(duration as float) as double), 3) as duration, coalesce(orig_bytes, 0) as orig_bytes,
  cast(case label_str when 'Benign' then 0 when 'DDoS' then 1 else 2 end as bigint) as label
from r where rn <= 1000
""")
def q_prepare_flows(spark, folder):
    rows = flows(spark, folder).withColumnRenamed("orig_bytes_raw", "orig_bytes")
    made = prepare_flows(
        rows, ["event_id"], label="raw_label", target=1000, minimum=200, exclude=["event_id"], keep=["event_id"]
    )
    return rounded(made.table, 3, *made.features)


CSV_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
with m as (select f.*, coarse from ({A.CSV_FLOWS}) f join {COARSE_SQL} on upper(trim(label_raw)) = fine),
r as (select *, row_number() over (partition by coarse order by {LINE_HASH}) as rn from m),
s as (select l_orderkey, l_partkey, l_suppkey, coarse, {", ".join(f"cast(cast({c} as float) as double) as {c}" for c in CSV_FEATURES)},
  case when l_linestatus = 'F' then 0 else 1 end as status_code from r where rn <= 2000)
select l_orderkey, l_partkey, l_suppkey,
  {", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 3) as {c}" for c in CSV_FEATURES)},
  round((status_code - avg(status_code) over ()) / stddev_pop(status_code) over (), 3) as l_linestatus,
  cast(case coarse when 'Benign' then 0 when 'DDoS' then 1 when 'Recon' then 2 else 3 end as bigint) as label
from s
""")
def q_prepare_csv_flows(spark, folder):
    rows = csv_flows(spark, folder).select(
        "l_orderkey", "l_partkey", "l_suppkey", *CSV_FEATURES, "l_linestatus", F.lit(1.0).alias("flat"), "label_raw",
        F.concat_ws(":", *line_key()).alias("row_key"),
    )
    made = prepare_csv_flows(
        rows, ["row_key"], "label_raw", target=2000, minimum=500, keep=["l_orderkey", "l_partkey", "l_suppkey", "row_key"]
    )
    return rounded(made.table.drop("row_key"), 3, *made.features)


@query(f"""
with m as (select f.*, coarse from ({A.CSV_FLOWS}) f join {COARSE_SQL} on upper(trim(label_raw)) = fine),
r as (select *, row_number() over (partition by coarse order by {LINE_HASH}) as rn from m),
s as (select *, concat_ws(':', {", ".join(LINE_KEY)}) as row_key from r where rn <= 2000)
select l_orderkey, l_partkey, l_suppkey, row_number() over (order by {md5_sql("row_key")}) - 1 as row,
  cast(case coarse when 'Benign' then 0 when 'DDoS' then 1 when 'Recon' then 2 else 3 end as bigint) as label
from s
""")
def q_training_table(spark, folder):
    # the whole flow: balanced table in random order, its label map beside it, both read back
    rows = csv_flows(spark, folder).select(
        "l_orderkey", "l_partkey", "l_suppkey", *CSV_FEATURES, "label_raw", F.concat_ws(":", *line_key()).alias("row_key"),
    )
    made = prepare_csv_flows(
        rows, ["row_key"], "label_raw", target=2000, minimum=500, keep=["l_orderkey", "l_partkey", "l_suppkey", "row_key"]
    )
    table, labels = scratch_path(spark, "table"), scratch_path(spark, "label_map")
    flow_io.write_table(sample.shuffle_rows(made.table, ["row_key"], index="row"), table)
    flow_io.write_label_map(made.labels, labels)
    known = flow_io.read_label_map(spark, labels).select("label")
    return flow_io.read_flows(spark, table).join(known, "label").select("l_orderkey", "l_partkey", "l_suppkey", "row", "label")


@query(f"""
with f as (select event_id, proto, orig_bytes_raw, {CLASS_SQL} as label_str
  from ({A.FLOWS}) join (select event_id as e, event_type from events) on event_id = e),
d as (select *, dense_rank() over (order by proto) - 1 as proto_code, dense_rank() over (order by orig_bytes_raw) - 1 as bytes_code from f),
r as (select *, row_number() over (partition by label_str order by {EVENT_HASH}) as rn from d)
select event_id, cast(proto_code as double) as proto, cast(bytes_code as double) as orig_bytes,
  cast(case label_str when 'Benign' then 0 when 'DDoS' then 1 else 2 end as bigint) as label
from r where rn <= 1000
""")
def q_prepare_flows_codes(spark, folder):
    rows = flows(spark, folder).withColumnRenamed("orig_bytes_raw", "orig_bytes").select(
        "event_id", "proto", "orig_bytes", "raw_label")
    made = prepare_flows(rows, ["event_id"], label="raw_label", target=1000, minimum=200, numeric_strings="codes",
                         exclude=["event_id"], keep=["event_id"])
    return rounded(made.table, 3, *made.features)


SCENARIO_SQL = f"""
with c as (select uid, host, cast(duration as varchar) as duration, proto, cast('Benign' as varchar) as label from ({A.CONN})),
h as ({A.HTTP}),
one as (select c.uid, host, c.duration, proto, c.label, coalesce(method, 'None') as method
  from c left join h on c.uid = h.uid where proto in ('AUTOMOBILE', 'BUILDING')),
two as (select uid, host, duration, proto, label, cast(null as varchar) as method from c
  where proto not in ('AUTOMOBILE', 'BUILDING'))
select uid, host, cast(duration as double) as duration, proto, 'x   Benign   -' as label, method from one
union all select uid, host, cast(duration as double), proto, 'x   Benign   -', method from two
"""


@query(SCENARIO_SQL)
def q_merge_scenarios(spark, folder):
    def write_log(df: DataFrame, fields: list[str]) -> str:
        path = scratch_path(spark, "log")
        spark.range(1).select(F.lit("#fields\t" + "\t".join(fields)).alias("value")).write.mode("append").text(path)
        df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("append").text(path)
        return path

    conn = A.view(spark, folder, A.CONN, "customer").select(
        F.lit("1525879831.5").alias("ts"), "uid", "host", "duration", "proto", F.lit("x   Benign   -").alias("last")
    )
    fields = ["ts", "uid", "host", "duration", "proto", "tunnel_parents   label   detailed-label"]
    first = F.col("proto").isin("AUTOMOBILE", "BUILDING")
    http = write_log(A.view(spark, folder, A.HTTP, "orders").select("uid", "method"), ["uid", "method"])
    missing = scratch_path(spark, "absent")
    merged = merge_scenarios(spark, {
        "one": (write_log(conn.filter(first), fields), {"http": http, "dns": missing}),
        "two": (write_log(conn.filter(~first), fields), {"http": missing}),
        "three": (missing, {"http": http}),
    })
    return merged.drop("ts", "_corrupt").withColumn("duration", F.col("duration").cast("double"))


@query(f"""
with f as ({A.PARSED})
select {BUCKET}, min(duration) as duration_min, max(duration) as duration_max, round(avg(duration), 6) as duration_mean,
  count(distinct uid) as flow_count, count(*) as packet_count,
  (array_agg(service order by ts, event_id) filter (where service is not null))[1] as service_first,
  (array_agg(service order by ts desc, event_id desc) filter (where service is not null))[1] as service_last,
  count(distinct service) as service_nunique,
  coalesce(arg_min(label, row(ts, event_id)) filter (where label <> 'Benign'), 'Benign') as label
from f group by 1
""")
def q_window_table_first_attack(spark, folder):
    table = window_table(
        parsed(spark, folder), "5 minutes", numbers=["duration"], edges=["service"], rule="first_attack", order=["ts", "event_id"],
    )
    return rounded(table, 6, "duration_mean")


@query(f"""
with f as (select * from ({A.PARSED}) where substr({EVENT_HASH}, 1, 8) < '{int(0.5 * 16**8):08x}'),
w as (select {BUCKET}, min(duration) as duration_min, max(duration) as duration_max, avg(duration) as duration_mean,
  min(coalesce(orig_bytes, 0)) as orig_bytes_min, max(coalesce(orig_bytes, 0)) as orig_bytes_max,
  avg(coalesce(orig_bytes, 0)) as orig_bytes_mean, count(distinct uid) as flow_count, count(*) as packet_count,
  count(service) as service_count, count(distinct service) as service_nunique from f group by 1),
c as (select {BUCKET}, label, count(*) as n from f group by 1, 2),
m as (select window_start, label from (select *, row_number() over (partition by window_start order by n desc, label) as rn from c)
  where rn = 1),
d as (select unnest(generate_series(min(window_start), max(window_start), interval '5 minutes')) as window_start from w)
select d.window_start, coalesce(duration_min, 0) as duration_min, coalesce(duration_max, 0) as duration_max,
  round(coalesce(duration_mean, 0), 6) as duration_mean, coalesce(orig_bytes_min, 0) as orig_bytes_min,
  coalesce(orig_bytes_max, 0) as orig_bytes_max, round(coalesce(orig_bytes_mean, 0), 6) as orig_bytes_mean,
  coalesce(flow_count, 0) as flow_count, coalesce(packet_count, 0) as packet_count,
  coalesce(service_count, 0) as service_count, coalesce(service_nunique, 0) as service_nunique, label
from d left join w on d.window_start = w.window_start left join m on d.window_start = m.window_start
""")
def q_window_table(spark, folder):
    table = window_table(
        parsed(spark, folder), "5 minutes", text=["service"], rule="mode", fraction=0.5, key=["event_id"],
        densify=True, fill=0.0,
    )
    return rounded(table, 6, "duration_mean", "orig_bytes_mean")
