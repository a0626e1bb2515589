"""Fingerprints of tables, stages that are used again or not, files of a run on shared storage."""

import itertools

from pyspark.sql import functions as F

from quillspark.plans.pipeline import Run, fingerprint
from quillspark.sources import files, storage


def test_fingerprints_tell_multisets(spark):
    make = lambda rows, schema="a string, b string, m map<string,int>, l array<string>": spark.createDataFrame(rows, schema)
    rows = [("x", None, {"k": 1}, ["a", None]), (None, "x", None, []), ("", "", {}, None), ("x", None, {"k": 1}, ["a", None])]
    same = {fingerprint(make(list(p)).repartition(n)) for p in itertools.permutations(rows) for n in (1, 3)}
    assert len(same) == 1
    other = [rows[:3], rows + rows[:1], [(None, "x", {"k": 1}, ["a", None]), *rows[1:]], [("x", "", {"k": 1}, ["a", None]), *rows[1:]], [("x", None, {"k": 1}, ["a"]), *rows[1:]], [("x", None, {"k": 2}, ["a", None]), *rows[1:]], []]
    prints = [fingerprint(make(o)) for o in other]
    assert len({*prints, *same}) == len(other) + 1
    a, b = make([("p", "q", None, None)]), make([("q", "p", None, None)])
    assert fingerprint(a) != fingerprint(b) and fingerprint(a.select("l", "b", "m", "a")) == fingerprint(a) and fingerprint(a.withColumnRenamed("a", "z")) != fingerprint(a)


def test_changed_inputs_run_again_and_permuted_ones_do_not(spark, tmp_path):
    made = []

    def stage(run, df, table, n=1):
        def make():
            made.append(1)
            return df.join(table, "k", "left")

        return run.stage("joined", make, {"n": n}, fingerprint(df), {"table": fingerprint(table)}, counters=lambda x: {"filled": F.count("v"), "most": F.max("k")})

    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "k long, r string")
    table = spark.createDataFrame([(i, i * i) for i in range(5)], "k long, v long")
    run = Run(spark, str(tmp_path), "r")
    out, sig = stage(run, df, table)
    assert out.where("v is not null").count() == 5
    again, same = stage(Run(spark, str(tmp_path), "other"), df.repartition(7), table.orderBy(F.desc("k")))
    assert sig == same and made == [1] and again.count() == 20
    more, new = stage(run, df, table.unionAll(spark.createDataFrame([(9, 81)], "k long, v long")))
    assert new != sig and made == [1, 1] and more.where("v is not null").count() == 6
    stage(run, df.where("k > 3"), table)
    records = run.records().orderBy("_ord").collect()
    assert [(r.rows, r.counters) for r in records] == [(20, {"filled": 5, "most": 19}), (20, {"filled": 6, "most": 19}), (16, {"filled": 1, "most": 19})]
    assert records[0].digest == fingerprint(out) and records[0].fields == ["k", "r", "v"] and len({r._ord for r in records}) == 3


def test_a_stage_is_written_by_one_job_and_lost_files_are_made_again(spark, tmp_path):
    run, df = Run(spark, str(tmp_path), "r"), spark.range(100).withColumn("x", F.col("id") % 3)
    spark.sparkContext.setJobGroup("one stage", "")
    rows, digest, counted = run.write(df, f"{tmp_path}/t", {"zeros": F.count_if(F.col("x") == 0)})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one stage")
    spark.sparkContext._jsc.clearJobGroup()
    assert (rows, counted) == (100, {"zeros": 34}) and len(jobs) == 1 and digest == fingerprint(spark.read.parquet(f"{tmp_path}/t"))
    assert run.write(df.where("false"), f"{tmp_path}/none", {"zeros": F.count_if(F.col("x") == 0)})[::2] == (0, {"zeros": 0})
    made = []
    go = lambda: run.stage("s", lambda: made.append(1) or df)
    go(), go()
    at, fs = storage._path(spark, run.last("s").path)
    fs.delete(at, True)
    assert go()[0].count() == 100 and made == [1, 1]


def test_files_on_any_scheme(spark, tmp_path):
    for root in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        storage.write_text(spark, f"{root}/x/run.json", '{"x": "é"}')
        storage.write_text(spark, f"{root}/x/run.json", '{"x": "ü"}')
        assert storage.read_json(spark, f"{root}/x/run.json") == {"x": "ü"} and storage.read_json(spark, f"{root}/none") == {}
        storage.write_text(spark, f"{root}/list", "[1]")
        assert storage.read_json(spark, f"{root}/list") == {} and len(storage.sha256(spark, f"{root}/list")) == 64 and storage.sha256(spark, f"{root}/none") == "" and storage.sha256(spark, f"{root}/x") == ""
        rows = spark.createDataFrame([(i, f'"q", {i}\nline', ["x", None, "y"], {"k": 1}) for i in reversed(range(50))], "_ord long, t string, l array<string>, m map<string,int>").repartition(5)
        storage.write_csv(rows, f"{root}/t.csv", ["_ord"], ("_ord",))
        storage.write_csv(rows, f"{root}/t.csv", ["_ord"], ("_ord",))  # over the old one
        text = storage.read_text(spark, f"{root}/t.csv")
        assert text.startswith("t,l,m\n") and [r.t for r in files.read_csv(spark, f"{root}/t.csv").collect()] == [f'"q", {i}\nline' for i in range(50)]
        storage.write_csv(rows.where("false"), f"{root}/none.csv")
        assert storage.read_text(spark, f"{root}/none.csv").strip() == "_ord,t,l,m"
        left = [p.name for p in (tmp_path / root[-1]).iterdir() if not p.name.endswith(".crc")]
        assert sorted(left) == ["list", "none.csv", "t.csv", "x"]


def test_a_killed_stage_goes_on_within_it(spark, tmp_path):
    source = spark.range(0, 100, 1, 1).withColumn("t", F.concat(F.lit("t"), "id"))
    done, stop = [], [3]

    def f(batch):
        if len(done) == stop[0]:
            raise RuntimeError("killed")
        done.append(1)
        return batch.withColumn("double", F.col("id") * 2)

    counters = lambda df: {"even": F.count_if(F.col("id") % 2 == 0)}
    go = lambda run: run.batched("verified", source, f, 10, {"n": 1}, "p", {"a": "b"}, counters)
    run = Run(spark, f"{tmp_path}/a", "r")
    try:
        go(run)
        raise AssertionError("was not killed")
    except Exception as e:
        assert "killed" in str(e)
    assert run.records().where("status = 'partial'").count() == 3 and run.last("verified").status == "partial"
    stop[0] = -1
    out, sig = go(Run(spark, f"{tmp_path}/a", "later"))
    assert len(done) == 10 and out.count() == 100 and out.columns == ["id", "t", "double"]
    whole, _ = Run(spark, f"{tmp_path}/b", "r").stage("verified", lambda: source.withColumn("double", F.col("id") * 2), {"n": 1}, "p", {"a": "b"}, counters)
    one, other = run.last("verified"), Run(spark, f"{tmp_path}/b", "r").last("verified")
    assert (one.rows, one.counters, one.digest, one.fields) == (other.rows, other.counters, other.digest, other.fields) and fingerprint(out) == fingerprint(whole)
    again, same = go(run)
    assert len(done) == 10 and same == sig and fingerprint(again) == fingerprint(whole)
    none, _ = Run(spark, f"{tmp_path}/c", "r").batched("verified", source.where("false"), f, 10, counters=counters)
    assert none.count() == 0 and none.columns == ["id", "t", "double"]


def test_written_tables_are_removed_on_request(spark):
    from quillspark.sources import shared

    shared.clean(spark)
    df = shared.written(spark.range(5), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 5 and storage.exists(spark, path)
    assert shared.clean(spark) == 1 and not storage.exists(spark, path) and shared.clean(spark) == 0
