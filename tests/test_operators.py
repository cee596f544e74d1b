import random
from collections import Counter, defaultdict

import pytest

from strandmill import schemas
from strandmill.operators.domains import distinct_analyses, explode_terms, record_count, select_analyses
from strandmill.operators.genes import extract_genes, filter_min_length, total_residues
from strandmill.operators.hits import best_hits, filter_evalue, top_hits, union_hits
from strandmill.operators.pairs import read_fastq_pairs
from strandmill.sources.domains import parse_domains
from strandmill.sources.hits import parse_hits

FASTA = schemas.FASTA


def annotations(spark, *rows):
    def gene(gene_id, start, end, strand):
        return (gene_id, start, end, strand, 0, "11", 1.0, "s", None)

    nested = [(name, 0.5, -1.0, "b", [gene(*g) for g in genes]) for name, genes in rows]
    return spark.createDataFrame(nested, schemas.GENE_CALLS)


def test_gene_extraction_in_any_order(spark):
    contigs = spark.createDataFrame([("c 1", "AACCGGTTRY"), ("c2", "ACGT"), ("unused", "A")], FASTA)
    calls = annotations(spark, ("c2", [("g 1", 0, 4, "-")]), ("c 1", [("g1", 1, 4, "+"), ("g2", 6, 10, "-")]))
    found = {r.header: r.sequence for r in extract_genes(calls, contigs).collect()}
    assert found == {"c2_g_1": "TGCA", "c_1_g1": "ACC", "c_1_g2": "YRTT"}
    calls = annotations(spark, ("c2", [("g1", 1, 3, "+")]), ("c 1", [("g2", 7, 10, "-")]))
    found = {r.header: r.sequence for r in extract_genes(calls, contigs, genomic=True).collect()}
    assert found == {"c2_g1": "ACG", "c_1_g2": "RYAA"}


def test_missing_and_repeated_contigs_fail(spark):
    calls = annotations(spark, ("c1", [("g1", 0, 1, "+")]))
    with pytest.raises(Exception, match="no contig has the header c1"):
        extract_genes(calls, spark.createDataFrame([("c2", "A")], FASTA)).collect()
    with pytest.raises(Exception, match="two contigs have the header c1"):
        extract_genes(calls, spark.createDataFrame([("c1", "A"), ("c1", "C")], FASTA)).collect()


def test_contig_length_and_residues(spark):
    contigs = spark.createDataFrame([("a", "A" * 299), ("b", "A" * 300)], FASTA)
    assert [r.header for r in filter_min_length(contigs).collect()] == ["b"]
    assert total_residues(contigs).head()[0] == 599
    assert total_residues(contigs.filter("false")).head()[0] == 0


def random_hits(spark, n):
    """Hits of which a third belong to one query, with ties and several hits per subject."""
    random.seed(13)
    rows = []
    for _ in range(n):
        name = "hot" if random.random() < 1 / 3 else f"q{random.randint(0, 9)}"
        subject, split = f"s{random.randint(0, 30)}", random.randint(1, 3)
        e_value, score = 10.0 ** -random.randint(1, 8), float(random.randint(1, 5))
        rows.append((name, subject, 90.0, 1, 1, 1, 1, 1, 1, 1, e_value, score, split))
    return rows, spark.createDataFrame(rows, f"{schemas.HITS}, split_id INT")


def expected_top(rows, k, key):
    best = defaultdict(dict)
    for row in rows:
        rank = (row[10], -row[11], row[1])
        group = best[key(row)]
        group[row[1]] = min(rank, group.get(row[1], rank))
    top = {
        group: {subject: n for n, subject in enumerate(sorted(ranks, key=ranks.get)[:k], 1)}
        for group, ranks in best.items()
    }
    return Counter((*row, top[key(row)][row[1]]) for row in rows if row[1] in top[key(row)])


def test_top_hits_against_brute_force(spark):
    rows, hits = random_hits(spark, 3000)
    found = Counter(map(tuple, top_hits(hits).collect()))
    assert found == expected_top(rows, 5, lambda row: (row[0], row[12]))
    found = Counter(map(tuple, best_hits(hits, 2).collect()))
    assert found == expected_top(rows, 2, lambda row: row[0])


def test_ranking_is_limited_before_the_shuffle(spark):
    _, hits = random_hits(spark, 10)
    plan = top_hits(hits)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_union_and_cutoff(spark):
    _, hits = random_hits(spark, 100)
    plain = hits.drop("split_id")
    both = union_hits([plain.limit(0), plain, plain])
    assert sorted((r.split_id, r["count"]) for r in both.groupBy("split_id").count().collect()) == [(2, 100), (3, 100)]
    kept = filter_evalue(hits)
    assert kept.filter("e_value > 1e-5").count() == 0
    assert kept.count() == hits.filter("e_value <= 1e-5").count()


def test_domains(spark):
    df = spark.createDataFrame(
        [("Gene3D", ["a", "b"]), ("ProSiteProfiles", []), ("Phobius", ["c"]), ("GENE3D", [])],
        "analysis STRING, go_annotations ARRAY<STRING>",
    )
    assert sorted(r.analysis for r in distinct_analyses(df).collect()) == ["gene3d", "phobius", "prositeprofiles"]
    assert [r.analysis for r in select_analyses(df).collect()] == ["Gene3D", "ProSiteProfiles", "GENE3D"]
    assert sorted(r.go_term for r in explode_terms(df).collect()) == ["a", "b", "c"]
    assert record_count(df).head()[0] == 4


def fastq(path, reads):
    path.write_text("".join(f"@{name}\n{bases}\n+\n{quality}\n" for name, bases, quality in reads))


@pytest.mark.parametrize("size", ["128m", "50b"])
def test_mate_pairs(spark, tmp_path, split_size, size):
    for side in ("left", "right"):
        (tmp_path / side).mkdir()
    reads = [(f"r{n}", str(n), "@@"[: n % 3] or "I") for n in range(30)]
    fastq(tmp_path / "left" / "1", [(f"{a} 1", b, c) for a, b, c in reads[:20]])
    fastq(tmp_path / "left" / "2", [(f"{a} 1", b, c) for a, b, c in reads[20:]])
    fastq(tmp_path / "right" / "1", [(f"{a} 2", b, c) for a, b, c in reads[:5]])
    fastq(tmp_path / "right" / "2", [(f"{a} 2", b, c) for a, b, c in reads[5:]])
    split_size(size)
    for on in ("position", "id"):
        pairs = read_fastq_pairs(spark, str(tmp_path / "left"), str(tmp_path / "right"), on=on)
        rows = pairs.collect()
        assert sorted(int(r.left_sequence) for r in rows) == list(range(30))
        assert all(r.left_sequence == r.right_sequence and r.right_header.endswith(" 2") for r in rows)
    with pytest.raises(ValueError):
        read_fastq_pairs(spark, "x", "y", on="name")


@pytest.mark.parametrize("size", ["128m", "50b"])
def test_fast_pairs_by_position_are_not_ranked(spark, tmp_path, split_size, size):
    for side in ("left", "right"):
        (tmp_path / side).mkdir()
        for part in range(3):
            fastq(tmp_path / side / str(part), [(f"{side}{part}{n}", f"{part}{n}", "I") for n in range(7)])
    split_size(size)
    pairs = read_fastq_pairs(spark, str(tmp_path / "left"), str(tmp_path / "right"), fast=True)
    rows = pairs.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(21))
    assert [r.left_sequence for r in rows] == [f"{part}{n}" for part in range(3) for n in range(7)]
    assert all(r.left_sequence == r.right_sequence for r in rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "BroadcastHashJoin" in plan


def test_repeated_read_id_fails(spark, tmp_path):
    fastq(tmp_path / "left", [("a 1", "A", "I"), ("a 1", "C", "I")])
    fastq(tmp_path / "right", [("a 2", "A", "I")])
    pairs = read_fastq_pairs(spark, str(tmp_path / "left"), str(tmp_path / "right"), on="id")
    with pytest.raises(Exception, match="read id occurs more than once on a side: a"):
        pairs.collect()


def test_extraction_has_no_cartesian_product(spark):
    contigs = spark.createDataFrame([("c1", "A")], FASTA)
    plan = extract_genes(annotations(spark, ("c1", [])), contigs)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_unequal_sides_fail(spark, tmp_path):
    record = "@r{0} x\nAC\n+\n@I\n"
    for side, n in (("left", 5), ("right", 3)):
        (tmp_path / f"{side}.fq").write_text("".join(record.format(i) for i in range(n)))
    with pytest.raises(Exception, match="no read at position"):
        read_fastq_pairs(spark, str(tmp_path / "left.fq"), str(tmp_path / "right.fq")).collect()


def test_stretches_number_reads_of_long_files(spark, tmp_path, monkeypatch):
    from strandmill.sources import fastq

    monkeypatch.setattr(fastq, "SUB_BLOCK_BITS", 2)
    for side in ("left", "right"):
        (tmp_path / f"{side}.fq").write_text("".join(f"@r{i} {side}\nAC\n+\n{'@' if i % 3 else 'I'}{i}\n" for i in range(200)))
    rows = read_fastq_pairs(spark, str(tmp_path / "left.fq"), str(tmp_path / "right.fq")).collect()
    assert sorted((r.position, r.left_header, r.right_quality_scores) for r in rows) == [
        (i, f"r{i} left", f"{'@' if i % 3 else 'I'}{i}") for i in range(200)
    ]


def test_a_malformed_record_fails_the_count(spark, lines):
    for parse in (parse_hits, parse_domains):
        with pytest.raises(Exception):
            record_count(parse(lines("bad", "worse"))).collect()
