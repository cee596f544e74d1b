import pytest
from pyspark.sql import functions as F

from strandmill.catalogue import load, workflows as catalogue
from strandmill.operators.tools import ToolError, ToolSpec
from strandmill.plans import buckets, text
from strandmill.plans.annotation import annotate
from strandmill.plans.buckets import done_buckets, resume_buckets
from strandmill.plans.workflow import SUCCESS, Workflow, materialise, path_exists, take
from strandmill.session import CHECKPOINT_KEY, fresh_dir, shared_root

load()


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_root(spark) == spark.conf.get(CHECKPOINT_KEY)
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_stages_are_numbered_and_resumed(spark, tmp_path):
    df = spark.range(10)
    first = Workflow(spark, str(tmp_path), "job", recover=True)
    first.stage("a", lambda: df)
    first.stage("b", lambda: df.filter("id > 4"))
    assert path_exists(spark, f"{next((tmp_path / 'job' / 'stage_2').iterdir())}/{SUCCESS}")
    again = Workflow(spark, str(tmp_path), "job", recover=True)
    assert again.stage("a", lambda: df).count() == 10 and again.stage("b", lambda: df.filter("id > 4")).count() == 5
    assert [(r.stage, r.n_rows, r.recovered) for r in again.report().collect()] == [("stage_1/a", 10, True), ("stage_2/b", 5, True)]


def test_a_stage_of_another_query_or_input_is_computed(spark, tmp_path):
    def run(df, **recipe):
        workflow = Workflow(spark, str(tmp_path), "job", recover=True)
        return workflow.stage("a", lambda: df, **recipe).count(), workflow.timings[-1][-1]

    spark.range(10).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert run(table.filter("id < 3")) == (3, False) and run(table.filter("id < 3")) == (3, True)
    assert run(table.filter("id < 4")) == (4, False)
    assert run(table.filter("id < 3"), recipe="v2") == (3, False)
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/t")
    assert run(spark.read.parquet(f"{tmp_path}/t").filter("id < 3")) == (5, False)
    made = [spark.createDataFrame([(i,)], "id INT") for i in (1, 2, 1)]
    assert [run(df)[1] for df in made] == [False, False, True]


def test_interrupted_stage_is_overwritten(spark, tmp_path):
    first = Workflow(spark, str(tmp_path), "job", recover=True)
    first.stage("a", lambda: spark.range(10))
    first.stage("b", lambda: spark.range(10))
    (next((tmp_path / "job" / "stage_2").iterdir()) / SUCCESS).unlink()
    again = Workflow(spark, str(tmp_path), "job", recover=True)
    again.stage("a", lambda: spark.range(10))
    assert again.stage("b", lambda: spark.range(10)).count() == 10
    assert [recovered for *_, recovered in again.timings] == [True, False]


def test_without_recovery_nothing_is_written(spark, tmp_path):
    workflow = Workflow(spark, str(tmp_path), "job")
    kept = workflow.keep(workflow.stage("a", lambda: spark.range(4)))
    assert materialise(kept) == 4 and kept.is_cached
    workflow.release()
    assert not kept.is_cached and not (tmp_path / "job").exists()


def test_scalar_is_kept(spark, tmp_path):
    one = Workflow(spark, str(tmp_path), "job", recover=True)
    assert one.scalar("size", lambda: spark.range(5).agg(F.sum("id").alias("n"))) == 10
    again = Workflow(spark, str(tmp_path), "job", recover=True)
    assert again.scalar("size", lambda: spark.range(5).agg(F.sum("id").alias("n"))) == 10
    assert again.scalar("size", lambda: spark.range(6).agg(F.sum("id").alias("n"))) == 15
    assert [recovered for *_, recovered in again.timings] == [True, False]


def test_take(spark):
    assert [r.id for r in take(spark.range(9), 2, "id").collect()] == [0, 1]
    assert len(take(spark.range(9), 5).collect()) == 5


def test_buckets_resume_after_a_failure(spark, tmp_path):
    df = spark.range(200).withColumn("hot", F.lit("same"))
    calls = []

    def compute(part):
        calls.append(1)
        if len(calls) == 4:  # the first call only asks for the schema
            raise RuntimeError("lost")
        return part.withColumn("twice", F.col("id") * 2)

    def run(df=df, recipe="v1", **options):
        return resume_buckets(df, compute, str(tmp_path), "me/us", "s", recipe, **({"n_buckets": 8, "at_once": 1} | options))

    with pytest.raises(RuntimeError):
        run()
    folder = next(p for p in tmp_path.glob("me*/s-*") if not p.name.endswith("-input"))
    mark = folder.name.removeprefix("s-")
    # all buckets but the one that failed are done
    first = done_buckets(spark, str(tmp_path), "me/us", "s", mark)
    assert first == {*"01234567"} - {"2"}
    stamps = {b: (folder / f"bucket={b}" / "_SUCCESS").stat().st_mtime_ns for b in first}
    assert sorted(r.twice for r in run().collect()) == list(range(0, 400, 2))
    assert stamps == {b: (folder / f"bucket={b}" / "_SUCCESS").stat().st_mtime_ns for b in first}
    before = len(calls)
    again = run()
    assert len(calls) == before + 1 and again.count() == 200
    assert done_buckets(spark, str(tmp_path), "you", "s", mark) == set()
    assert run(recipe="v2", n_buckets=4, at_once=3).count() == 200
    other = run(spark.range(1000, 1020).withColumn("hot", F.lit("same")))
    assert sorted(r.id for r in other.collect()) == list(range(1000, 1020))


def test_too_many_buckets_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "MAX_BUCKETS", 3)
    odd = spark.createDataFrame([("a/b",), ("%null",), (None,)], "k STRING")
    got = resume_buckets(odd, lambda part: part, str(tmp_path), "me", "s", "v1", partition_column="k")
    assert sorted(map(str, (r.k for r in got.collect()))) == ["%null", "None", "a/b"] and got.columns == ["k"]
    with pytest.raises(ValueError, match="more than 3 values"):
        resume_buckets(spark.range(4), lambda part: part, str(tmp_path), "me", "s", "v1", partition_column="id")


def test_lazy_stages_are_counted_as_they_run(spark, tmp_path):
    workflow = Workflow(spark, str(tmp_path), "job")
    a = workflow.keep(workflow.stage("a", lambda: spark.range(10)))
    b = workflow.stage("b", lambda: a.filter("id > 6"))
    assert [r.n_rows for r in workflow.report().collect()] == [None, None]
    assert b.join(b.withColumnRenamed("id", "k"), F.col("id") == F.col("k")).count() == 3
    for _ in range(2):
        assert [(r.stage, r.n_rows) for r in workflow.report().collect()] == [("stage_1/a", 10), ("stage_2/b", 3)]
    workflow.release()


def test_every_value_of_a_partition_column_is_a_bucket(spark, tmp_path):
    df = spark.range(100).withColumn("bucket", F.when(F.col("id") % 11 != 0, F.col("id") % 10 - 3))
    twice = lambda part: part.withColumn("twice", F.col("id") * 2)
    for column in (None, "bucket"):
        got = resume_buckets(df, twice, f"{tmp_path}/{column}", "me", "s", "v1", n_buckets=4, partition_column=column)
        assert sorted(r.id for r in got.collect()) == list(range(100)) and got.columns == ["id", "bucket", "twice"]
    nothing = resume_buckets(df.filter("id < 0"), twice, f"{tmp_path}/none", "me", "s", "v1")
    assert nothing.count() == 0


def test_text_variants_agree(spark, lines, tmp_path):
    df = lines("lorem ipsum  dolor", "sit amet", " dolor", "", "the end dolor sit", "Dolor").repartition(3)
    workflow = Workflow(spark, str(tmp_path), "job", recover=True)
    for query, expected in (("dolor", 8), ("absent", 0)):
        variants = (
            text.native(df, query),
            text.in_memory(df, query),
            text.through_stages(df, query, workflow),
            text.with_programs(df, query),
            text.with_programs(df, query, workflow),
        )
        assert [v.head().n_words for v in variants] == [expected] * 5


def test_native_variant_stays_in_the_jvm(spark, tmp_path):
    spark.createDataFrame([("a dolor", 1)], "line STRING, other INT").write.parquet(str(tmp_path / "t"))
    df = text.native(spark.read.parquet(str(tmp_path / "t")), "dolor")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "StringContains(line,dolor)" in plan and "ReadSchema: struct<line:string>" in plan


@pytest.mark.parametrize("recover", [False, True])
def test_annotation(spark, tmp_path, recover):
    contigs = spark.createDataFrame(
        [("c1", "ACGTTGCAAC" * 35), ("c2", "G" * 30), ("short", "ACGT")], "header STRING, sequence STRING"
    )
    workflow = Workflow(spark, str(tmp_path), "job", recover=recover)
    tools = (catalogue.GENE_CALLER, catalogue.SEARCHER, catalogue.SCANNER)
    result = annotate(workflow, lambda: contigs, contigs, *tools, n_splits=2, multiplier=0.25)
    genes = {r.header: r.sequence for r in result.genes.collect()}
    assert genes == {
        "c1_gene_1": "ACGTTGCAAC" * 30, "c1_gene_2": ("ACGTTGCAAC" * 5)[::-1], "c2_gene_1": "G" * 30,
        "short_gene_1": "ACGT",
    }
    assert result.database_size == 384
    hits = result.hits.collect()
    assert len(hits) == 8 and {(h.split_id, h.subject_id, h.e_value) for h in hits} == {
        (1, "S1", 1e-11), (2, "S2", 1e-12),
    }
    assert all(h.bit_score == 384.0 for h in hits)
    assert {h.subject_id for h in result.best_hits().collect()} == {"S2"}
    assert sorted((d.protein_accession, d.analysis) for d in result.domains.collect()) == [
        ("c1_gene_1", "Gene3D"), ("c1_gene_2", "Coils"), ("c2_gene_1", "Gene3D"), ("short_gene_1", "Gene3D"),
    ]
    workflow.release()
    if recover:
        again = Workflow(spark, str(tmp_path), "job", recover=True)
        assert annotate(again, lambda: contigs, contigs, *tools, n_splits=2, multiplier=0.25).hits.count() == 8
        assert all(recovered for *_, recovered in again.timings)


def test_a_missing_program_is_found_before_any_work(spark, tmp_path):
    contigs = spark.createDataFrame([("c", "ACGT")], "header STRING, sequence STRING")
    workflow = Workflow(spark, str(tmp_path), "job", recover=True)
    with pytest.raises(ToolError, match="no-such-scanner"):
        annotate(workflow, lambda: contigs, contigs, catalogue.GENE_CALLER, catalogue.SEARCHER, ToolSpec(["no-such-scanner"]))
    assert workflow.timings == []


def test_one_hit_with_another_database_size_is_seen(spark):
    sizes = lambda *values: sorted(r[0] for r in catalogue.database_sizes(spark.createDataFrame([(v,) for v in values], "bit_score double")).collect())
    assert sizes(7.0, 7.0, 7.0) == [7.0] and sizes(7.0, 7.0, 3.0, 9.0, 7.0) == [3.0, 9.0]
