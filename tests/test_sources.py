import csv
import math
from concurrent.futures import ThreadPoolExecutor
from random import Random

import pytest

from tabloom.sources import records
from tabloom.sources.catalogue import Catalogue
from tabloom.session import durable, scratch
from tabloom.sources.readers import MISSING, ingest, is_sql_source, jdbc_options, load_dataset, path_exists
from tabloom.sources.records import open_after
from tabloom.sources.tracking import RunLog, experiment_name, scalar_metrics


def test_csv_types_and_missing(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('a,b,c,d\n1,1.5,"x, ""y""",2024-01-31\n2,NaN,,2024-02-01\n3,,z,\n')
    df = load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string", "d": "date"}
    rows = df.orderBy("a").collect()
    assert rows[0]["c"] == 'x, "y"'
    assert [r["b"] for r in rows] == [1.5, None, None]


def test_csv_with_schema(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("a,b\n1,2\n")
    assert load_dataset(spark, str(path), schema="a long, b string").dtypes == [("a", "bigint"), ("b", "string")]


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("n,x,flag,at,text,none\n1,NA,true,2024-01-31 10:00:00,null,N/A\nN/A,2.5,false,NaN,a NA,\n30000000000,1e3,n/a,2024-02-01 00:00:00,7,NULL\n")
    df = load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "at": "timestamp", "text": "string", "none": "string"}
    rows = df.orderBy("n").collect()
    assert [r["x"] for r in rows] == [2.5, None, 1000.0] and [r["text"] for r in rows] == ["a NA", None, "7"]
    typed = load_dataset(spark, str(path), schema="n long, x string, flag boolean, at string, text string, none int").orderBy("n").collect()
    assert [r["x"] for r in typed] == ["2.5", None, "1e3"]


def test_csv_codes_stay_text(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("letter,word,code,clock,hex,pad,half,signed,truth,day,at\nT,yes,10d,12:30,0x1F,007,.5,+1,TRUE,2024-1-3,2024-01-03T10:00:00Z\nF,no,12f,23:59,1F,010,-2.,-3,false,2024-12-31,2024-01-03 10:00:01.5\n")
    kinds = dict(load_dataset(spark, str(path)).dtypes)
    assert {c for c, k in kinds.items() if k == "string"} == {"letter", "word", "code", "clock", "hex"}
    assert (kinds["pad"], kinds["half"], kinds["signed"], kinds["truth"], kinds["day"], kinds["at"]) == ("int", "double", "int", "boolean", "date", "timestamp")


def test_csv_misfits_under_a_schema(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("a,b\n1,x\noops,y\n,z\n")
    with pytest.raises(Exception, match="oops"):
        load_dataset(spark, str(path), schema="a int, b string").collect()
    rows = load_dataset(spark, str(path), schema="a int, b string", misfits="null").orderBy("b").collect()
    assert [r["a"] for r in rows] == [1, None, None]
    assert load_dataset(spark, str(path), schema="a int, b string").select("b").count() == 3
    with pytest.raises(ValueError, match="misfits"):
        load_dataset(spark, str(path), misfits="drop")


def test_csv_line_breaks(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,one\n')
    assert [r["b"] for r in load_dataset(spark, str(path), multiLine=True).orderBy("a").collect()] == ["two\nlines", "one"]


def test_lines_open_and_close_quotes():
    cases = {
        'a,b': (False, True), 'a,"b': (True, False), 'a,"b"': (False, False), '"': (True, False), '""': (False, True),
        'x",y': (False, False), 'x",y,"z': (True, True), '5" disk,b': (False, False), 'a,"say ""hi""': (True, False),
        '"a""': (True, False), '"a"b"c,"d': (True, True), '': (False, True),
    }
    assert {line: tuple(open_after(line, inside, ",", '"') for inside in (False, True)) for line in cases} == cases


def _random_file(random, path, count, end, header=True, tail=""):
    """A written CSV file; values hold quotes, separators and line breaks, some over many lines."""
    pieces = ["a", "word", ",", '"', "\n", "\r\n", '",', ',"', "é", " ", "\n\n", '""']
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end)
        if header:
            writer.writerow(["id", "te xt", "more"])
        for i in range(count):
            long = 300 if random.random() < 0.02 else 8
            writer.writerow([i, *("".join(random.choices(pieces, k=random.randrange(long))) for _ in range(2))])
        f.write(tail)


@pytest.mark.parametrize(("end", "split", "header"), [("\n", 64, True), ("\r\n", 200, True), ("\n", 1000, False), ("\n", 1 << 20, True)])
def test_csv_line_breaks_in_splits_equal_one_task(spark, tmp_path, monkeypatch, end, split, header):
    """Splits of a few bytes: records reach over many of them, and some splits hold no line's beginning."""
    random = Random(split)
    folder = tmp_path / "data.csv"
    folder.mkdir()
    for k in range(2):
        _random_file(random, folder / f"{k}.csv", 120, end, header, tail=end if k else "")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    schema = "id long, `te xt` string, more string"
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        parts = spark.read.text(str(folder)).rdd.getNumPartitions()
        assert parts > 6 or split > 2000
        read = load_dataset(spark, str(folder), multiLine=True, header=header, schema=schema)
        found = sorted(map(tuple, read.collect()), key=str)
        if split == 1000:
            monkeypatch.setattr(records, "SMALL_SPLITS", 0)
            assert sorted(map(tuple, load_dataset(spark, str(folder), multiLine=True, header=header, schema=schema).collect()), key=str) == found
        # The one-task reader writes the breaks of values anew where the lines end with \\r\\n; here they stay.
        if end == "\n":
            one_task = load_dataset(spark, str(folder), multiLine=True, header=header, schema=schema, comment="")
            assert found == sorted(map(tuple, one_task.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = []
    for k in range(2):
        with open(folder / f"{k}.csv", newline="", encoding="utf-8") as f:
            rows = [r for r in csv.reader(f) if r][header:]
        expected += [(int(r[0]), *(None if v in MISSING else v for v in r[1:])) for r in rows]
    assert found == sorted(expected, key=str) and len(found) == 240


def test_csv_line_breaks_edges(spark, tmp_path):
    empty, bare, open_ended = tmp_path / "empty.csv", tmp_path / "bare.csv", tmp_path / "open.csv"
    empty.write_text("a,b\n")
    assert load_dataset(spark, str(empty), multiLine=True).count() == 0
    bare.write_text("\ufeffa,b\n\n1\n2,x,y\n", encoding="utf-8")
    assert [tuple(r) for r in load_dataset(spark, str(bare), multiLine=True).orderBy("a").collect()] == [(1, None), (2, "x")]
    open_ended.write_text('a,b\n1,"never\nclosed')
    assert [tuple(r) for r in load_dataset(spark, str(open_ended), multiLine=True).collect()] == [(1, "never\nclosed")]


def test_folder_and_query_sources(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.createDataFrame([(1, math.nan), (2, 2.0)], "a int, b double").write.parquet(folder)
    assert [r["b"] for r in load_dataset(spark, folder, format="parquet").orderBy("a").collect()] == [None, 2.0]
    spark.read.parquet(folder).createOrReplaceTempView("folder_table")
    assert [r["b"] for r in load_dataset(spark, sql_query="SELECT * FROM folder_table ORDER BY a").collect()] == [None, 2.0]
    with pytest.raises(ValueError, match="sql_query"):
        load_dataset(spark)


def test_scratch_deletes_what_was_written_inside(spark):
    outer = durable(spark.range(3))
    with scratch(spark):
        inner = durable(spark.range(5))
        assert inner.count() == 5
        (path,) = {f.rsplit("/", 1)[0] for f in inner.inputFiles()}
    assert not path_exists(spark, path) and outer.count() == 3


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "data.parquet")
    spark.createDataFrame([(1, math.nan), (2, 2.0)], "a int, b double").write.parquet(path)
    assert [r["b"] for r in load_dataset(spark, path).orderBy("a").collect()] == [None, 2.0]


def test_pq_suffix(spark, tmp_path):
    path = str(tmp_path / "data.pq")
    spark.range(3).write.parquet(path)
    assert load_dataset(spark, path).count() == 3


def test_source_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "absent.csv"))
    other = tmp_path / "data.xlsx"
    other.write_text("x")
    with pytest.raises(ValueError, match="Unsupported format"):
        load_dataset(spark, str(other))
    with pytest.raises(ValueError, match="sql_query"):
        load_dataset(spark, "postgresql://host/db")


def test_sql_connection_strings():
    assert is_sql_source("sqlite:///x.db") and not is_sql_source("s3://bucket/x.csv")
    assert jdbc_options("postgresql+psycopg2://me:p%40ss@db:5433/shop") == {
        "url": "jdbc:postgresql://db:5433/shop",
        "user": "me",
        "password": "p@ss",
    }
    assert jdbc_options("mysql://db/shop?useSSL=false") == {"url": "jdbc:mysql://db/shop?useSSL=false"}
    assert jdbc_options("sqlite:////tmp/x.db") == {"url": "jdbc:sqlite:/tmp/x.db"}


def test_ingest(spark, tmp_path):
    source = tmp_path / "data.csv"
    source.write_text("a,b\n1,2\n3,4\n")
    stored = ingest(spark, str(source), str(tmp_path / "stored.parquet"))
    assert (stored["rows"], stored["columns"], stored["column_names"]) == (2, 2, ["a", "b"])
    assert load_dataset(spark, stored["dataset_path"]).count() == 2


def test_catalogue_round_trip(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path))
    assert catalogue.projects().count() == 0
    first, second = catalogue.create_project("one"), catalogue.create_project("two", "text")
    assert (first["id"], second["id"]) == (1, 2)
    catalogue.attach_dataset(1, "a.parquet")
    catalogue.attach_dataset(1, "b.parquet")
    made = catalogue.create_feature_set(1, "fs", {"features": [{"name": "x", "source": "raw"}]})
    assert made["feature_count"] == 1
    assert catalogue.feature_sets(1).first()["feature_count"] == 1
    listed = catalogue.projects().collect()
    assert [r["id"] for r in listed] == [2, 1]
    assert listed[1]["dataset_path"] == "b.parquet" and listed[1]["run_count"] == 0
    catalogue.add_feature_history(1, {"x": 0.75, "y": 0.25})
    assert catalogue.feature_history("x").first()["importance_score"] == 0.75


def test_writers_at_the_same_time_get_different_ids(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path))
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda i: catalogue.create_project(f"p{i}")["id"], range(6)))
        firsts = list(pool.map(lambda i: catalogue.next_id("feature_history", 3), range(4)))
    assert len(set(ids)) == 6 and catalogue.projects().count() == 6
    taken = [first + i for first in firsts for i in range(3)]
    assert len(set(taken)) == 12


class _Result:
    model_type, task, model_path = "svm", "classification", None
    hyperparams = {"C": 1.0, "layers": (1, 2)}
    training_time_s = 1.5

    def __init__(self, accuracy):
        self.metrics = {"accuracy": accuracy, "confusion_matrix": [[1]], "flag": True, "status": "completed"}


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    experiment = log.get_or_create_experiment(1, "My Churn")
    assert log.get_or_create_experiment(1, "My Churn") == experiment
    assert log.get_experiment(experiment)["name"] == experiment_name(1, "My Churn") == "project_1_my_churn"
    assert log.get_experiment("absent") is None and log.get_best_run(experiment) is None
    ids = [log.log_run(_Result(a), experiment, "v1", 1, i) for i, a in enumerate((0.7, 0.9, 0.8), 1)]
    assert log.get_best_run(experiment)["run_id"] == ids[1]
    assert log.get_best_run(experiment, higher_is_better=False)["run_id"] == ids[0]
    run = log.get_run(ids[0])
    assert run["run_name"] == "svm__v1" and run["tags"]["catalogue_run_id"] == "1"
    assert run["params"] == {"C": "1.0", "layers": "(1, 2)"}
    assert run["metrics"] == {"accuracy": 0.7, "training_time_s": 1.5}
    assert log.get_run("absent") is None
    summary = log.summary(experiment)
    assert summary["total_runs"] == 3 and [r["run_id"] for r in summary["runs"].collect()] == [ids[1], ids[2], ids[0]]


def test_scalar_metrics_only():
    assert scalar_metrics({"r2": 1, "residuals": {"a": 1}, "task": "x", "ok": True}, 2) == {"r2": 1.0, "training_time_s": 2.0}
