import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citeframe.operators import derive, facts
from citeframe.plans import extraction
from citeframe.streaming import attempts, sinks

T0 = datetime.datetime(2030, 1, 1)
KIND = "doc_id bigint, name string, attempt int, error string, json string, at timestamp"


@pytest.fixture(scope="module")
def states(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.ROCKSDB)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


def _row(doc, attempt, error=None, minute=0, name="g", text=None):
    return {"doc_id": doc, "name": name, "attempt": attempt, "error": error, "json": text or f"{doc}.{attempt}", "at": (T0 + datetime.timedelta(minutes=minute)).isoformat() + "Z"}


class _Run:
    """A stream over a folder of files, run again and again with the same checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, Path(folder), 0
        (self.folder / "in").mkdir()

    def __call__(self, *rows):
        (self.folder / "in" / f"{self.n:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        self.n += 1
        stream = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        sinks.into(attempts.first_valid(stream), sinks.replacing(str(self.folder / "out")), str(self.folder / "ck")).awaitTermination(300)
        return self.rows()

    def rows(self):
        out = self.spark.read.schema(KIND + ", status int").parquet(str(self.folder / "out")).collect() if any(self.folder.glob("out/batch=*")) else []
        return sorted((r.doc_id, r.name, r.status, r.attempt, r.json) for r in out)


def test_late_repeated_and_restarted(states, tmp_path):
    run = _Run(states, tmp_path)
    assert run(_row(1, 1), _row(2, 1, "validation"), _row(3, 2), _row(4, 1, "auth"), _row(5, 1, "api"), _row(5, 2, "validation")) == [(1, "g", 200, 1, "1.1"), (4, "g", 500, 1, "4.1"), (5, "g", 502, 2, "5.2")]
    # repeated answers and answers after the decision change nothing; 3 was waiting for its first attempt
    got = run(_row(1, 1), _row(1, 2), _row(4, 2), _row(2, 1, "validation"), _row(3, 1, "api", 2))
    assert got == [(1, "g", 200, 1, "1.1"), (3, "g", 200, 2, "3.2"), (4, "g", 500, 1, "4.1"), (5, "g", 502, 2, "5.2")]
    # time passes: the retry of 2 never came; a row that is later than the watermark is passed over
    got = run(_row(6, 1, minute=100)) + run(_row(2, 2, minute=1), _row(7, 1, minute=1), _row(8, 2, minute=100))
    assert got.count((2, "g", 504, 1, "2.1")) >= 1 and not any(r[0] == 7 for r in got)
    assert run.rows() == sorted(set(run.rows()))  # each group once
    assert (6, "g", 200, 1, "6.1") in run.rows() and not any(r[0] == 8 for r in run.rows())
    assert (8, "g", 200, 2, "8.2") in run(_row(9, 1, minute=300))  # numbers from 2 on: decided when no other is waited for


def test_streamed_as_selected_at_once(states, tmp_path):
    import random

    rnd = random.Random(5)
    rows = [_row(d, n, rnd.choice((None, "validation", "api", "auth", "rate_limit")), name=g, text=f"{d}{g}{n}") for d in range(60) for g in "ab" for n in range(1, rnd.randint(2, 4))]
    order = rows + rnd.sample(rows, 80)
    rnd.shuffle(order)
    run = _Run(states, tmp_path)
    for k in range(0, len(order), 120):
        run(*order[k : k + 120])
    # 45 minutes later all is decided; what is decided after that is of no interest here
    got = run(_row(-1, 1, minute=45)) and run(_row(-2, 1, minute=90))
    batch = extraction.select_attempts(states.createDataFrame([{k: v for k, v in r.items() if k != "at"} for r in rows], "doc_id bigint, name string, attempt int, error string, json string"))
    assert [r for r in got if r[2] == 200 and r[0] >= 0] == sorted((r.doc_id, r.name, 200, r.attempt, r.json) for r in batch.collect())
    assert len(got) == len({r[:2] for r in got}) == 122  # every group is told once, with an answer or an error


def test_decisions():
    e = lambda n, error=None: (n, error, "")
    assert attempts.decided([], True) == (504, None) and attempts.decided([], False) is None
    assert attempts.decided([e(2)], False) is None and attempts.decided([e(2)], True) == (200, e(2))
    assert attempts.decided([e(1, "api"), e(3)], False) is None and attempts.decided([e(1, "api"), e(3)], True) == (200, e(3))
    assert attempts.decided([e(1, "api"), e(2, "timeout")], False) == (504, e(2, "timeout"))
    assert attempts.decided([e(1, "else")], False) == (502, e(1, "else"))


def test_groups_share_rows_of_state(states, tmp_path):
    rows = [_row(d, n, None if (d + n) % 3 == 0 else ("validation", "auth", "api")[(d * n) % 3], minute=d % 10) for d in range(3000) for n in range(1, 1 + d % 4)]
    told = []
    for buckets in (1, 16):
        folder = tmp_path / str(buckets)
        (folder / "in").mkdir(parents=True)
        for part in (rows[::2], rows, [_row(-1, 1, minute=65)], [_row(-2, 1, minute=200)]):
            (folder / "in" / f"{len(list((folder / 'in').iterdir())):03d}.json").write_text("\n".join(map(json.dumps, part)))
            stream = states.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
            query = sinks.into(attempts.first_valid(stream, buckets=buckets), sinks.replacing(str(folder / "out")), str(folder / "ck"))
            query.awaitTermination(300)
            # a row of state for each bucket, not for each group
            assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= buckets
        told.append(sorted((r.doc_id, r.status, r.attempt, r.json) for r in states.read.parquet(str(folder / "out")).collect()))
    plain = []
    for d in range(3000):
        known = sorted((r["attempt"], r["error"], r["json"]) for r in rows if r["doc_id"] == d) if d < 200 else []
        if known:
            status, last = attempts.decided(known, False) or attempts.decided(known, True)
            plain.append((d, status, last[0], last[2]))
    assert told[0] == told[1] and len({r[0] for r in told[0]}) == len(told[0]) == 2250 + 2
    assert [r for r in told[0] if 0 <= r[0] < 200] == plain


def test_a_bucket_keeps_each_groups_own_time():
    import pandas as pd

    def came(*rows):
        return iter([pd.DataFrame(rows, columns=["group", "millis", "attempt", "error", "answer"])])

    groups = {}
    assert attempts.step(groups, came(("a", 5, 1, "validation", "a1"), ("b", 30, 2, None, "b2")), 0, 100, 1000) == []
    assert groups == {"a": (105, [(1, "validation", "a1")]), "b": (130, [(2, None, "b2")])}
    groups = json.loads(json.dumps(groups))
    assert attempts.step(groups, came(("a", 50, 1, "validation", "a1"), ("c", 60, 1, None, "c1")), 110, 100, 1000) == [(200, "c", "c1"), (504, "a", "a1")]
    assert groups == {"a": (1105, None), "b": [130, [[2, None, "b2"]]], "c": (1110, None)}
    assert attempts.step(groups, iter(()), 130, 100, 1000) == [(200, "b", "b2")]
    assert attempts.step(groups, came(("a", 140, 2, None, "a2")), 1105, 100, 1000) == [] and list(groups) == ["b", "c"]


def test_streamed_attempts_inputs_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from citeframe import catalog_flows

    asked = []
    monkeypatch.setattr(catalog_flows, "discard", lambda spark, path: asked.append(path))
    spark.range(0, 4000, 1, 4).selectExpr("id as l_orderkey", "cast(1 + id % 3 as int) as l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog_flows._Q["streamed_attempts"](spark, str(tmp_path))
        assert got.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = Path(next(p for p in asked if p.endswith("/in")).removeprefix("file:"))
    assert len(list(folder.glob("part-*"))) >= 2 * 4


def test_refused_without_its_state_store(spark):
    with pytest.raises(ValueError):
        attempts.first_valid(spark.createDataFrame([], KIND))


def _files(folder):
    return sorted((str(p.relative_to(folder).parent), p.read_bytes()) for p in Path(folder).rglob("part-*"))


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write = sinks.replacing(path)
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"), spark.createDataFrame([(1, "z")], "k int, t string")
    write(a, 0)
    write(b, 1)
    once = sorted(map(tuple, spark.read.parquet(path).collect()))
    write(a, 0)
    write(b, 1)
    write(b.limit(0), 2)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == once == [(1, "x", 0), (1, "z", 1), (2, "y", 0)]


def test_actuals_by_model_and_document(spark, tmp_path):
    path = str(tmp_path / "a")
    write = sinks.actuals(path)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id int, model string, project string, extraction_meta string")
    write(docs((1, "m", "a", "x"), (2, "m", None, "x")), 0)
    first = _files(path)
    write(docs((1, "m", "a", "x"), (2, "m", None, "x")), 0)
    assert _files(path) == first
    write(docs((1, "m", "new", "y"), (1, "n", "a", "y")), 1)  # extracted again, and by another model
    got = {(r.model, r.doc_id): json.loads(r.value) for r in spark.read.text(path).collect()}
    assert got == {("m", 1): {"doc_id": 1, "project": "new"}, ("m", 2): {"doc_id": 2, "project": None}, ("n", 1): {"doc_id": 1, "project": "a"}}


def test_facts_as_they_arrive(spark, tmp_path):
    from citeframe.catalog import _extracted

    docs = derive.assemble(_extracted(spark, "/root/testdata/sf0.001")).repartition(3)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    sinks.into(stream, sinks.facts_csv(out), ck).awaitTermination(300)
    before = _files(out)
    assert {f.split("/")[0] for f, _ in before} == {"batch=0", "batch=1", "batch=2"}
    # the stream has written its last batch but couldn't say so
    for f in (tmp_path / "ck" / "commits").glob("*2*"):
        f.unlink()
    sinks.into(stream, sinks.facts_csv(out), ck).awaitTermination(300)
    assert _files(out) == before
    want = facts.csv_rows(facts.flatten(docs)).select("doc_id", *facts.CSV_COLUMNS)
    assert sorted(map(tuple, sinks.read_facts(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_predictions_in_few_files(spark, tmp_path):
    path = str(tmp_path / "p")
    write = sinks.predictions(path)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id int, model string, project string, extraction_meta string")
    first, second = docs((1, "m", "a", "x"), (2, "m", None, "x"), (None, None, "b", "x")), docs((1, "m", "new", "y"), (1, "n", "a", "y"))
    for batch, rows in ((0, first), (0, first), (1, second), (1, second), (2, second.limit(0))):
        write(rows, batch)
    got = {(r.model, r.doc_id): json.loads(r.value) for r in sinks.read_predictions(spark, path).collect()}
    assert got == {("m", 1): {"doc_id": 1, "project": "new"}, ("m", 2): {"doc_id": 2, "project": None}, ("n", 1): {"doc_id": 1, "project": "a"}, (None, None): {"doc_id": None, "project": "b"}}


def test_dump_makes_no_folder_for_each_document(spark, tmp_path):
    from citeframe import catalog
    from citeframe.shared import shared_folder

    spark.range(1, 301).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    there = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("actuals-*"))
    before = there()
    got = {r.doc_id: (r.model, json.loads(r.value)) for r in catalog.queries()["actuals_dump"](spark, str(tmp_path)).collect()}
    assert got == {k: ("ab"[k % 2], {"doc_id": k, "name": f"s{k}", "again": k % 3 == 0}) for k in range(1, 301)}
    (made,) = there() - before
    assert len(list(made.rglob("part-*"))) < 30


def test_facts_are_written_by_all_cores_in_order(spark):
    import csv

    from citeframe import catalog
    from citeframe.shared import shared_folder

    d = "/root/testdata/sf0.001"
    there = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("facts-*"))
    before = there()
    got = catalog.queries()["facts_csv_stream"](spark, d)
    (made,) = there() - before
    assert {p.name: len(list(p.glob("part-*"))) for p in (made / "out").glob("batch=*")} == {f"batch={b}": spark.sparkContext.defaultParallelism for b in (0, 1)}
    want = {}
    for r in facts.csv_rows(facts.flatten(derive.assemble(catalog._extracted(spark, d)))).orderBy("doc_id", "seq").collect():
        want.setdefault(r.doc_id, []).append([str(r.doc_id), *[r[c] for c in facts.CSV_COLUMNS]])
    assert got.count() == sum(map(len, want.values()))
    for p in (made / "out").rglob("part-*"):
        rows = list(csv.reader(p.open(newline="")))[1:]
        assert rows == [r for k in sorted({int(r[0]) for r in rows}) for r in want[k]]
