import json

import pytest
from pyspark.sql import functions as F

from flowlab.operators import encode
from flowlab.plans.experiments import experiment_report
from flowlab.plans.merge import merge_scenarios
from flowlab.functions.labels import class_table
from flowlab.sources import flows, telemetry, zeek

CONN = """#separator \\x09
#fields\tts\tuid\tid.orig_h\tduration\ttunnel_parents   label   detailed-label
#types\ttime\tstring\taddr\tstring
1525879831.5\tC1\t192.168.1.1\t0.5\t(empty)   Malicious   DDoS
#fields\tignored\theader
1525879832.5\tC2\t-\t(empty)\t-   Benign   -
bad\tC3\t10.0.0.1
1525879833.5\t-\t10.0.0.2\t1\t-   Benign   -
1\t2\t3\t4\t5\t6
#close
"""
HTTP = "#fields\tts\tuid\tmethod\n1\tC1\tGET\n2\tC1\tPUT\n"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_zeek_log(spark, tmp_path):
    log = zeek.read_zeek_log(spark, put(tmp_path, "conn.log", CONN))
    assert log.columns[:4] == ["ts", "uid", "id.orig_h", "duration"] and log.columns[-1] == "_corrupt"
    got = {r["uid"]: r for r in log.filter("_corrupt is null").collect()}
    assert got["C2"]["id.orig_h"] is None and got["C2"]["duration"] is None
    assert got["C3"]["duration"] is None and got[None]["ts"] == "1525879833.5"
    assert [r["_corrupt"] for r in log.filter("_corrupt is not null").collect()] == ["1\t2\t3\t4\t5\t6"]
    cut = zeek.read_zeek_log(spark, str(tmp_path / "conn.log"), corrupt=None)
    assert cut.count() == 5 and "_corrupt" not in cut.columns
    named = zeek.name_label_column(log)
    assert named.columns[-2] == "label"
    assert zeek.typed_time(named).filter("ts is null and uid = 'C3'").count() == 1


def test_zeek_log_without_header_or_data(spark, tmp_path):
    log = zeek.read_zeek_log(spark, put(tmp_path, "bare.log", "a\tb\tc\n"), "dns")
    assert log.columns == ["dns_0", "dns_1", "dns_2", "_corrupt"]
    assert zeek.read_optional(spark, str(tmp_path / "nowhere.log")) is None
    assert zeek.read_optional(spark, put(tmp_path, "empty.log", "#fields\ta\n")) is None
    assert zeek.read_optional(spark, put(tmp_path, "void.log", "")) is None


def test_merge_scenarios(spark, tmp_path):
    conn, http = put(tmp_path, "conn.log", CONN), put(tmp_path, "http.log", HTTP)
    gone = str(tmp_path / "gone.log")
    merged = merge_scenarios(spark, {"one": (conn, {"http": http}), "two": (conn, {"dns": gone}), "three": (gone, {})})
    assert {"ts_http", "method", "label"} <= set(merged.columns)
    rows = merged.collect()
    # one fans out for C1, the second scenario has no http log
    assert len(rows) == 6 + 5
    assert sorted(r["method"] or "" for r in rows if r["uid"] == "C1") == ["", "GET", "PUT"]
    assert all(r["method"] == "None" for r in rows if r["uid"] == "C2" and r["method"])
    assert {r["label"] for r in rows if r["uid"] == "C3"} == {"Benign"}
    with pytest.raises(ValueError):
        merge_scenarios(spark, {"x": (gone, {})})


def test_csv_set(spark, tmp_path):
    put(tmp_path, "Merged01.csv", "Rate,Protocol Type,Label\n1,tcp,XSS\ninf,udp, Benign\n")
    put(tmp_path, "Merged02.csv", "Rate,Protocol Type,Label\nx,,DDoS\n")
    put(tmp_path, "Other.csv", "Rate,Protocol Type,Label\n9,9,9\n")
    got = flows.read_flow_csv(spark, str(tmp_path), text=["Protocol Type"])
    assert got.dtypes == [("Rate", "double"), ("Protocol Type", "string"), ("Label", "string")]
    assert sorted((r["Rate"] is None, r["Rate"] or 0) for r in got.collect()) == [(False, 1.0), (False, float("inf")), (True, 0)]
    with pytest.raises(ValueError):
        flows.read_flow_csv(spark, str(tmp_path), label="nope")


def test_label_map(spark, tmp_path):
    dim = encode.fit_label_encoder(spark.createDataFrame([("Benign",), ("DDoS",)], "l string"), "l")
    flows.write_label_map(dim, str(tmp_path / "map"), class_table(spark))
    again = flows.read_label_map(spark, str(tmp_path / "map"))
    assert {tuple(r) for r in again.collect()} == {("Benign", 0), ("DDoS", 1)}
    lines = [json.loads(x) for p in (tmp_path / "map").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["map"] for x in lines} == {"str_to_int", "int_to_str", "coarse_label_map"} and len(lines) == 2 + 2 + 34


def test_table_sink(spark, tmp_path):
    rows = spark.range(10)
    flows.write_table(rows, str(tmp_path / "t"), files=1)
    assert flows.read_flows(spark, str(tmp_path / "t"), ["id"]).count() == 10
    assert [p.name for p in (tmp_path / "t").glob("*.snappy.parquet")]
    assert flows.row_count(rows).first()["rows"] == 10


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_telemetry_append(spark, tmp_path, fmt):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("A", 1, "0", "n/a")], "condition string, run int, client_id string, train_time_ms string")
    for rnd in (1, 2):
        telemetry.append_telemetry(rows.withColumn("server_round", F.lit(rnd)), path, fmt)
    back = telemetry.read_telemetry(spark, path) if fmt == "csv" else spark.read.parquet(path)
    assert back.columns == list(telemetry.TELEMETRY)
    assert sorted((r["server_round"], r["train_time_ms"], r["eval_client_id"]) for r in back.collect()) == [(1, None, None), (2, None, None)]


def test_report_from_csv(spark, tmp_path):
    head = ",".join(telemetry.TELEMETRY)
    put(tmp_path, "a.csv", head + "\nA_baseline,1,1,aggregate,,,,,,,,,,0.5,0.25,aggregate,0.5,0.25\nA_baseline,1,1,0,4,,,,,,False,False,-1.0,,,,,\n")
    put(tmp_path, "b.csv", head + "\nB_pqc_only,1,1,0,5,,,,,,True,False,-1.0,,,,,\n")
    report = experiment_report(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert report.overhead.first()["overhead_percent"] == 25.0
    assert report.curves.first()["mean"] == 0.25
    assert {r["metric"] for r in report.summary.filter("condition = 'A_baseline'").collect()} == {"train_time_ms", "global_loss", "global_accuracy"}
    combined = telemetry.combine_telemetry(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "all"))
    assert combined.count() == telemetry.read_telemetry(spark, str(tmp_path / "all")).count() == 3
