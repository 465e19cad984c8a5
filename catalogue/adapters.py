"""Views of the given tables in the shapes the operators read.

The same SQL text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FLOWS = """
select event_id, concat('C', cast(event_id as varchar(20))) as uid, ts, user_id,
  event_type as proto, value as duration,
  case when event_id % 17 = 0 then '-'
       else cast(event_id % 1000 as varchar(20)) end as orig_bytes_raw,
  cast(0 as double) as local_orig,
  case event_type
    when 'error'    then '(empty)   Malicious   DDoS'
    when 'signup'   then '(empty)   Malicious   PartOfAHorizontalPortScan'
    when 'view'     then '(empty)   Benign   -'
    when 'purchase' then '-'
    else 'Benign' end as raw_label
from events
"""

# flows with a finished class name and the numeric fields under their log names
PARSED = """
select event_id, concat('C', cast(user_id as varchar(20))) as uid, ts, user_id,
  event_type as proto, value as duration,
  case when event_id % 17 = 0 then null else cast(event_id % 1000 as double) end as orig_bytes,
  case when event_id % 5 = 0 then null else event_type end as service,
  case event_type when 'error' then 'DDoS' when 'signup' then 'PartOfAHorizontalPortScan'
       else 'Benign' end as label
from events
"""

CSV_FLOWS = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_shipdate, l_returnflag, l_linestatus,
  case when l_orderkey % 101 = 0 then 'Unknown_X'
       when l_returnflag = 'A' then ' DDoS-SYN_Flood'
       when l_returnflag = 'N' and l_linestatus = 'O' then 'BenignTraffic'
       when l_returnflag = 'N' then 'BENIGN'
       when l_linestatus = 'O' then 'Recon-PortScan'
       else 'XSS' end as label_raw
from lineitem
"""

# all 18 telemetry columns as text; every event is one fit, client or aggregate row
TELEMETRY = """
select case when user_id % 3 = 0 then 'A_baseline'
            when user_id % 3 = 1 then 'B_pqc_only' else 'C_pqc_dp' end as condition,
  cast(user_id % 5 + 1 as varchar(20)) as run,
  cast(event_id % 40 + 1 as varchar(20)) as server_round,
  case when event_id % 7 = 0 then 'aggregate' else cast(event_id % 2 as varchar(20)) end as client_id,
  case when event_id % 7 = 1 then cast(value as varchar(20)) when event_id % 7 = 2 then 'n/a' else '' end as train_time_ms,
  case when event_id % 7 <> 1 then '' when user_id % 3 = 0 then '0.0' else cast(value / 10 as varchar(30)) end as pqc_total_overhead_ms,
  case when event_id % 7 = 1 then cast(value / 20 as varchar(30)) else '' end as pqc_encap_ms,
  case when event_id % 7 = 1 then cast(value / 40 as varchar(30)) else '' end as sym_enc_ms,
  case when event_id % 7 = 1 then cast(event_id % 1000 + 28 as varchar(20)) else '' end as encrypted_payload_bytes,
  case when event_id % 7 = 1 then cast(event_id % 1000 as varchar(20)) else '' end as plaintext_payload_bytes,
  case when event_id % 7 = 1 then case when user_id % 3 = 0 then 'False' else 'True' end else '' end as is_encrypted,
  case when event_id % 7 = 1 then case when user_id % 3 = 2 then 'True' else 'False' end else '' end as dp_enabled,
  case when event_id % 7 <> 1 then '' when user_id % 3 = 2 then cast(value / 100 as varchar(30)) else '-1.0' end as epsilon_consumed,
  case when event_id % 7 = 0 then cast(value / 500 as varchar(30)) else '' end as global_loss,
  case when event_id % 7 = 0 then cast(value / 1000 as varchar(30)) else '' end as global_accuracy,
  case when event_id % 7 = 0 then 'aggregate' when event_id % 7 > 2 then cast(event_id % 2 as varchar(20)) else '' end as eval_client_id,
  case when event_id % 7 = 1 then '' else cast(value / 250 as varchar(30)) end as eval_loss,
  case when event_id % 7 = 1 then '' else cast(value / 2000 as varchar(30)) end as eval_accuracy
from events
"""

# local model updates: one vector per embedding row, clients are its labels
UPDATES = """
select label as server_round, vec_id as client_id, embedding as weights, vec_id % 100 + 1 as num_examples
from embeddings
"""

EVALUATIONS = """
select cast(event_id % 40 + 1 as int) as server_round, cast(event_id % 2 as int) as client_id,
  value / 500 as loss,
  case when event_id % 11 = 0 then null else value / 1000 end as accuracy,
  event_id % 100 + 1 as num_examples
from events
"""

# a score for labelled documents: their length, squashed
PREDICTIONS = """
select d.doc_id, l.quality as label, cast(d.n_chars as double) / (d.n_chars + 1000) as score
from documents d join labels l on d.doc_id = l.doc_id
"""

CONN = """
select concat('C', cast(c_custkey as varchar(20))) as uid, c_name as host, c_acctbal as duration, c_mktsegment as proto
from customer
"""

HTTP = """
select concat('C', cast(o_custkey as varchar(20))) as uid, o_orderpriority as method, o_totalprice as duration
from orders
"""

DNS = """
select concat('C', cast(s_suppkey as varchar(20))) as uid, s_name as query, s_acctbal as duration
from supplier
"""

SSL = """
select concat('C', cast(n_nationkey as varchar(20))) as uid, n_name as server from nation
"""


def tables(spark: SparkSession, folder: str, *names: str) -> None:
    """Register the given Parquet tables as views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """An adapter's rows; ``names`` are the tables it reads."""
    tables(spark, folder, *names)
    return spark.sql(sql)
