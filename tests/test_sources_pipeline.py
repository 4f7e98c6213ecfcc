import datetime as dt
import random

import numpy as np
import pytest
from conftest import START, wavy
from pyspark.sql import functions as F

from tidepanel.operators import evaluate
from tidepanel.plans.pipeline import REPORT, Options, analyse, report
from tidepanel.sources import delimited, roles, server_metrics, sinks


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def lines_of(sep, rows=40, bad=()):
    out = [sep.join([" timestamp ", "temp", "site", "is_anomaly", "empty"])]
    for i in range(rows):
        ts = "broken" if i in bad else (START + dt.timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S")
        out.append(sep.join([ts, f"{i / 4}", "x", "1" if i == 7 else "0", ""]))
    return out


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_and_roles(spark, tmp_path, sep):
    path = write(tmp_path / "f.csv", lines_of(sep, bad=(3,)))
    assert delimited.sniff_delimiter(spark, path) == sep
    got = delimited.read_series(spark, path)
    assert (got.time_col, got.label_col) == ("timestamp", "is_anomaly")
    assert got.features == ["temp", "empty"] and got.dropped_cols == ["site"]
    assert got.panel.count() == 2 * 39
    assert got.labels.agg(F.sum("y")).first()[0] == 1
    assert len(got.meta(spark).first()["warnings"]) == 2


def test_row_order_over_files_and_splits(spark, tmp_path):
    for part in range(3):
        rows = ["a,b"] + [f"{part * 1000 + i},{'x' * 40}" for i in range(1000)]
        write(tmp_path / f"part{part}.csv", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = delimited.file_rows(spark, str(tmp_path), ",")
        assert rows.rdd.getNumPartitions() > 3
        wrong = rows.where(F.col("a").cast("bigint") != F.col(delimited.POSITION)).count()
        assert (rows.count(), wrong) == (3000, 0)
        last = delimited.most_recent(rows, 5).select(F.col("a").cast("int")).collect()
        assert sorted(r[0] for r in last) == [2995, 2996, 2997, 2998, 2999]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_time_column_gives_daily_axis(spark, tmp_path):
    path = write(tmp_path / "n.csv", ["a,b"] + [f"{i},{i * 2.5}" for i in range(30)])
    got = delimited.read_series(spark, path, max_rows=10)
    assert got.time_col is None and got.features == ["a", "b"]
    first = got.panel.where("variable = 'a'").orderBy("ts").first()
    assert first["value"] == 20.0
    whole = delimited.read_series(spark, path).panel.where("variable = 'a'").orderBy("ts").first()
    assert whole["ts"] == dt.datetime(2000, 1, 1)


def test_no_numeric_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "t.csv", ["date,name"] + [f"2024-01-0{i},x{i}" for i in range(1, 9)])
    with pytest.raises(ValueError):
        delimited.read_series(spark, path)


def test_time_words():
    assert roles.has_time_word("event_time") and roles.has_time_word("측정일시")
    assert not roles.has_time_word("runtime_s") and roles.has_time_word("runtime_s", True)
    assert not roles.has_time_word("odds") and roles.has_time_word("odds", True)


def test_time_column_choice(spark):
    rows = spark.createDataFrame(
        [(f"2024-02-{i:02d}", f"2024-01-{i:02d}", 1_700_000_000_000_000_000 + i, i % 2) for i in range(1, 25)],
        "note string, obs_date string, unix_time bigint, flag int",
    )
    facts = roles.profile(rows)
    assert roles.detect_time_column(facts) == "obs_date"
    numeric = roles.profile(rows.select("unix_time", "flag"))
    assert roles.detect_time_column(numeric) == "unix_time"
    parsed = rows.select(roles.parse_time("unix_time", numeric).alias("t")).first()["t"]
    assert parsed.year == 2023
    assert roles.detect_label_column(facts, "obs_date") == "flag"


def test_label_rules(spark):
    rows = spark.createDataFrame([(0, 0, "true", 3), (0, 1, "false", 4)], "zeros int, y int, fault string, k int")
    facts = roles.profile(rows)
    assert roles.detect_label_column(facts, None) == "y"
    assert roles.detect_label_column(roles.profile(rows.select("k", "fault")), None) == "fault"
    assert roles.detect_label_column(roles.profile(rows.select("zeros")), None) is None
    named = spark.createDataFrame([(5,), (7,)], "label int")
    assert roles.detect_label_column(roles.profile(named), None) is None


def test_zone_is_dropped(spark):
    rows = spark.createDataFrame([("2024-01-01T10:00:00+09:00",), ("2024/03/01",), ("x",)], "t string")
    got = [r[0] for r in rows.select(roles.parse_text_time("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 3, 1), None]


def test_epochs_keep_their_microseconds(spark):
    base = 1_700_000_000_123_456_000
    kinds = spark.range(2000).select(
        "id", *[(F.col("id") * 1000 + base).cast(kind).alias(kind) for kind in ("bigint", "string")]
    )
    for kind in ("bigint", "string"):
        got = kinds.select("id", F.unix_micros(roles.parse_epoch(F.col(kind)).cast("timestamp")).alias("us"))
        assert got.where(F.col("us") != F.col("id") + base // 1000).isEmpty()
    odd = spark.createDataFrame([(float("nan"),), (None,), (1e300,)], "x double")
    assert odd.where(roles.parse_epoch(F.col("x")).isNotNull()).isEmpty()


def test_positions_of_unequal_tables(spark):
    long, short = (spark.range(n).withColumnRenamed("id", delimited.POSITION) for n in (5, 4))
    with pytest.raises(ValueError, match="5 and 4 rows"):
        server_metrics.join_by_position(long, short)


def test_server_sets(spark, tmp_path):
    values = write(tmp_path / "v.txt", [f"{i / 10},{i}" for i in range(20)])
    labels = write(tmp_path / "l.txt", [str(int(i == 4)) for i in range(20)])
    got = server_metrics.server_machine(spark, values, labels).orderBy("timestamp").collect()
    assert got[4].asDict() == {
        "timestamp": dt.datetime(2019, 1, 1, 0, 4), "server_metric_00": 0.4, "server_metric_01": 4.0, "is_anomaly": 1,
    }
    values = write(tmp_path / "p.csv", ["timestamp_(min),cpu"] + [f"{i * 2},{i}" for i in range(20)])
    labels = write(tmp_path / "pl.csv", ["timestamp_(min),label"] + [f"{i * 2},{int(i == 3)}" for i in range(20)])
    pool = server_metrics.server_pool(spark, values, labels, first_rows=10).orderBy("timestamp").collect()
    assert len(pool) == 10 and pool[3]["timestamp"] == dt.datetime(2020, 1, 1, 0, 6) and pool[3]["is_anomaly"] == 1


def test_whole_analysis(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = wavy(300, 1, period=12), wavy(300, 2, period=12)
    labels = np.zeros(300, dtype=int)
    for at in (230, 251, 280):
        a[at] += 9
        labels[at] = 1
    lines = ["timestamp,a,b,fixed,is_anomaly"]
    for i in range(300):
        ts = (START + dt.timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S")
        left = "" if rng.random() < 0.05 and not labels[i] else f"{a[i]:.5f}"
        if i != 100:
            lines.append(f"{ts},{left},{b[i]:.5f},4,{labels[i]}")
    got = delimited.read_series(spark, write(tmp_path / "all.csv", lines))
    tables = analyse(got.panel, got.labels, Options())
    out = str(tmp_path / "out")
    sinks.write_tables(tables, out, "run1")
    run = sinks.published(spark, out)
    back = run.tables
    assert run.run_id == "run1" and set(back) == set(tables)
    overview = back["overview"].first()
    assert (overview["n_rows"], overview["n_cols"], overview["freq"]) == (299, 3, "min")
    assert set(report(tables)) == set(REPORT)
    assert back["true_rate"].first()["true_rate"] == pytest.approx(100 * 3 / 299)
    assert back["frequency"].first()["freq"] == "min"
    assert {r[0] for r in back["strength"].select("variable").collect()} == {"a", "b"}
    assert back["metrics"].where("variable = 'a' and scorer = 'norm'").first()["auc_roc"] > 0.9
    assert back["forest_metrics"].where("variable = 'a'").first()["auc_roc"] > 0.9
    assert back["explanations"].count() == 5
    assert back["decomposition"].count() == 2 * 299
    assert back["components"].groupBy("variable").count().count() == 2
    sinks.write_panel(got.panel, f"{out}/panel")
    assert spark.read.parquet(f"{out}/panel").count() == got.panel.count()


def test_panels_lie_in_buckets(spark, tmp_path):
    rows = [(f"s{i % 40}", "v", START + dt.timedelta(hours=i), float(i)) for i in range(400)]
    panel = spark.createDataFrame(rows, "series_id string, variable string, ts timestamp_ntz, value double")
    path = str(tmp_path / "panel")
    sinks.write_panel(panel, path, buckets=4)
    assert len(list((tmp_path / "panel").glob("bucket=*"))) <= 4
    mine = sinks.read_series_panel(spark, path, "s7", buckets=4)
    assert sorted(r["value"] for r in mine.collect()) == [float(i) for i in range(7, 400, 40)]
    assert "PartitionFilters: [isnotnull(bucket" in mine._jdf.queryExecution().toString()


def test_a_run_that_broke_off_is_not_read(spark, tmp_path):
    out = str(tmp_path)
    sinks.publish({"a": spark.range(3)}, out, "one", {"by": "test"})
    spark.range(9).write.parquet(f"{out}/two/a")
    got = sinks.published(spark, out)
    assert (got.run_id, got.facts, got.tables["a"].count()) == ("one", {"by": "test"}, 3)
    with pytest.raises(ValueError, match="two"):
        sinks.published(spark, out, "two")


def test_only_one_label_name_is_taken_for_the_truth(spark):
    labels = spark.createDataFrame([("s", START, 1), ("s", START, 0)], "series_id string, ts timestamp_ntz, y int")
    assert evaluate.true_rate(labels).first()["true_rate"] == 50
    assert evaluate.true_rate(labels, "is_anomaly").count() == 1
    assert evaluate.true_rate(labels, "label").count() == 0 == evaluate.true_rate(labels, None).count()


def _quoted_files(folder):
    """Files of records with quotes, separators and line breaks in their cells, and blank lines between."""
    rng, want = random.Random(2), []
    for part in range(3):
        with open(folder / f"p{part}.csv", "w", newline="") as out:
            out.write(" id ,text, q \n")
            for i in range(200):
                cell = "".join(rng.choice(["a", "b", '"', ",", "\n", "\n", "x y", "", " "]) for _ in range(rng.randint(0, 12)))
                last = 'it"s' if rng.random() < 0.2 else "z"
                out.write(f'{part * 1000 + i},"{cell.replace(chr(34), chr(34) * 2)}",{last}\n')
                if rng.random() < 0.1:
                    out.write("\n")
                want.append((str(part * 1000 + i), cell.strip(" ") or None, last))
    return want


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_records_go_on_over_quoted_line_breaks(spark, tmp_path, split):
    want = _quoted_files(tmp_path)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(split))
    spark.conf.set(keys[1], "10")
    try:
        assert delimited.spans_lines(spark, str(tmp_path), ",")
        rows = delimited.file_rows(spark, str(tmp_path), ",").orderBy(delimited.POSITION).collect()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert [(r["id"], r["text"], r["q"]) for r in rows] == want
    assert [r[delimited.POSITION] for r in rows] == list(range(len(want)))


def test_quoted_records_keep_their_roles(spark, tmp_path):
    lines = ['time;remark;x', '2024-01-01;"two', 'lines; and ""more""";1.5', '2024-01-02;plain;2.5', 'never;"a', 'b";3.5']
    lines += [f"2024-01-{day:02d};plain;{day}.5" for day in range(3, 29)]
    path = write(tmp_path / "q.csv", lines)
    assert delimited.sniff_delimiter(spark, path) == ";"
    got = delimited.read_series(spark, path)
    assert (got.features, got.dropped_cols) == (["x"], ["remark"])
    assert sorted(r["value"] for r in got.panel.collect()) == [day + 0.5 for day in range(1, 29)]
    assert len(got.warnings) == 2
    plain = write(tmp_path / "p.csv", ['a,b', 'it is 5" wide,"say ""so"""', "x,y"])
    assert not delimited.spans_lines(spark, plain, ",")
    cells = [(r["a"], r["b"]) for r in delimited.file_rows(spark, plain, ",").orderBy(delimited.POSITION).collect()]
    assert cells == [('it is 5" wide', 'say "so"'), ("x", "y")]


@pytest.mark.parametrize("most, said", [(3, 1), (4, 0)])
def test_cut_rows_are_said(spark, tmp_path, most, said):
    (tmp_path / "a.csv").write_text("time,x\n" + "".join(f"2024-01-0{i},{i}.5\n" for i in range(1, 5)))
    found = delimited.read_series(spark, str(tmp_path), max_rows=most)
    assert found.panel.count() == most
    assert sum("most recent" in text for text in found.warnings) == said


def test_spanning_records_are_parsed_once(spark, tmp_path):
    path = tmp_path / "spanning.csv"
    path.write_text('a,b\n1,"x\n\ny"\n\n2,"z\n"\n3,w\n')
    rows = delimited.file_rows(spark, str(path))
    # the uses of the rows read cells that are written, not the records
    assert "from_csv" not in rows._jdf.queryExecution().toString()
    got = [tuple(r) for r in rows.orderBy(delimited.POSITION).collect()]
    assert got == [("1", "x\n\ny", 0), ("2", "z\n", 1), ("3", "w", 2)]
