import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators.genes import flatten_genes
from strandmill.sources import fastq
from strandmill.sources.domains import parse_domains, read_domains
from strandmill.sources.fasta import read_fasta, write_fasta
from strandmill.sources.fastq import read_fastq, write_fastq
from strandmill.sources.gene_calls import (
    composition_header,
    name_header,
    read_gene_calls,
    self_header,
)
from strandmill.sources.hits import hit_line, parse_hits, read_hits
from strandmill.sources.json_rows import from_json_rows, to_json_rows
from strandmill.sources.lines import from_records, read_lines, write_lines

SPLITS = ["128m", "40b", "13b"]


def written(path, text):
    path.write_bytes(text.encode())
    return str(path)


def texts(folder):
    return "".join(part.read_text() for part in sorted(folder.glob("part-*")))


def test_line_endings_and_gzip(spark, tmp_path):
    plain = written(tmp_path / "a.txt", "one\ntwo\r\nthree\r\rlast")
    assert [r.line for r in read_lines(spark, plain).collect()] == ["one", "two", "three", "", "last"]
    with gzip.open(tmp_path / "b.txt.gz", "wt") as out:
        out.write("packed\n")
    both = read_lines(spark, str(tmp_path / "*"), multiplier=2)
    assert both.count() == 6 and both.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    write_lines(both, str(tmp_path / "out"), gzip=True)
    assert sorted(r.line for r in read_lines(spark, str(tmp_path / "out")).collect()) == sorted(
        r.line for r in both.collect()
    )


def test_from_records_spreads_rows(spark):
    df = from_records(spark, [("a", "AC"), ("b", "")], "header STRING, sequence STRING")
    assert df.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, df.collect())) == [("a", "AC"), ("b", "")]


@pytest.mark.parametrize("size", SPLITS)
def test_fasta_reads_wrapped_records(spark, tmp_path, split_size, size):
    text = ">one first > still header\nACGT\nAC\n\n>two\n>three\nTT\r\nGG\r\n>\nA"
    path = written(tmp_path / "x.fas", text)
    split_size(size)
    found = sorted(map(tuple, read_fasta(spark, path).collect()))
    assert found == [("", "A"), ("one first > still header", "ACGTAC"), ("three", "TTGG"), ("two", "")]


@pytest.mark.parametrize("size", SPLITS)
def test_fasta_keeps_odd_headers(spark, tmp_path, split_size, size):
    written(tmp_path / "1.fas", "xno marker\nAC\n>>double\nGT\n>>again\nGG\n")
    written(tmp_path / "2.fas", ">>double first\nAC\n>b\nA\n")
    split_size(size)
    found = sorted(map(tuple, read_fasta(spark, str(tmp_path)).collect()))
    assert found == [
        (">again", "GG"), (">double", "GT"), (">double first", "AC"), ("b", "A"), ("no marker", "AC"),
    ]


def test_fasta_round_trip_and_width(spark, tmp_path):
    random.seed(7)
    records = [(f"r{n} x", "".join(random.choices("ACGT", k=n))) for n in (0, 1, 59, 60, 61, 120, 121, 400)]
    df = spark.createDataFrame(records, "header STRING, sequence STRING")
    for width in (60, 75):
        out = tmp_path / f"w{width}"
        write_fasta(df.coalesce(1), str(out), width)
        expected = "".join(
            f">{h}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for h, s in records
        )
        assert texts(out) == expected
        assert sorted(map(tuple, read_fasta(spark, str(out)).collect())) == sorted(records)


def fastq_records():
    random.seed(11)
    records = []
    for n in range(60):
        quality = "".join(random.choices("@@I+#", k=n % 9))
        records.append((f"read{n} 1:N", "A" * len(quality), "+", quality))
    return records


@pytest.mark.parametrize("size", SPLITS)
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_fastq_quality_lines_may_begin_with_at(spark, tmp_path, split_size, size, ending):
    records = fastq_records()
    text = "".join("@" + ending.join(record) + ending for record in records)
    path = written(tmp_path / "r.fastq", text)
    split_size(size)
    assert sorted(map(tuple, read_fastq(spark, path).collect())) == sorted(records)


def test_fastq_fast_path_refuses_what_it_cannot_read(spark, tmp_path):
    path = written(tmp_path / "r.fastq", "@a\nAC\n+\n@I\n@b\nAC\n+\nII\n")
    with pytest.raises(Exception, match="read without fast"):
        read_fastq(spark, path, fast=True).collect()
    path = written(tmp_path / "s.fastq", "@a\nAC\n+\nIJ\nextra\n@b\nAC\n+\nII\n")
    assert sorted(r.quality_scores for r in read_fastq(spark, path, fast=True).collect()) == ["II", "IJ"]


@pytest.mark.parametrize("text", ["@a\nAC\n+", "@a\nAC\n+\n@b\nAC\n+\nII\n", "@a\n@b\nAC\n+\nII\n"])
def test_incomplete_fastq_fails(spark, tmp_path, text):
    path = written(tmp_path / "r.fastq", text)
    with pytest.raises(Exception, match="incomplete FASTQ record"):
        assert len(read_fastq(spark, path).collect()) == -1


def test_fastq_round_trip(spark, tmp_path):
    records = fastq_records()
    df = spark.createDataFrame(records, "header STRING, sequence STRING, opt_header STRING, quality_scores STRING")
    write_fastq(df, str(tmp_path / "out"), gzip=True)
    assert sorted(map(tuple, read_fastq(spark, str(tmp_path / "out")).collect())) == sorted(records)


HIT = "q1\tUniRef_1\t98.5\t100\t1\t0\t1\t100\t5\t104\t1e-30\t200.5"


def test_hits_are_typed(spark, lines, tmp_path):
    row = parse_hits(lines(HIT)).head()
    assert tuple(row) == ("q1", "UniRef_1", 98.5, 100, 1, 0, 1, 100, 5, 104, 1e-30, 200.5)
    assert parse_hits(lines(HIT + "\textra")).head() == row
    path = written(tmp_path / "h.tsv", HIT + "\n" + HIT + "\n")
    assert read_hits(spark, path).count() == 2
    assert parse_hits(parse_hits(lines(HIT)).select(hit_line())).head() == row


@pytest.mark.parametrize("line", [HIT.rsplit("\t", 1)[0], HIT.replace("\t100\t1\t", "\tmany\t1\t"), ""])
def test_broken_hits_fail(lines, line):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|CAST_INVALID_INPUT"):
        parse_hits(lines(line)).collect()


def test_domains(spark, lines, tmp_path):
    head = "prot\tmd5\t628\tPhobius\tSIG\tdesc\t22\t589"
    rows = [
        f"{head}\t-\tT\t02-06-2015",
        f"{head}\t1.3E-79\tF\t02-06-2015\tIPR1\ttext\tGO:1|GO:2\tKEGG",
        f"{head}\t7\tT\t02-06-2015\tIPR1\ttext\t\t",
        f"{head}\t7\tT\t02-06-2015\t\t\t\tKEGG",
    ]
    path = written(tmp_path / "d.tsv", "\n".join(rows))
    found = read_domains(spark, path).collect()
    assert [(r.score, r.status, r.interpro_accession, r.go_annotations, r.pathway_annotations) for r in found] == [
        (None, True, None, [], None),
        (1.3e-79, False, "IPR1", ["GO:1", "GO:2"], "KEGG"),
        (7.0, True, "IPR1", [], None),
        (7.0, True, "", [""], "KEGG"),
    ]
    assert (found[0].sequence_length, found[0].start_location, found[0].date) == (628, 22, "02-06-2015")
    for broken in (f"{head}\t-\tX\tday", f"{head}\t-\tT"):
        with pytest.raises(Exception, match="neither T nor F|INVALID_ARRAY_INDEX"):
            parse_domains(lines(broken)).collect()


def headers(name, gc="0.5", rbs="-1", own="b"):
    return f"# {name}\n# gc = {gc}, rbs = {rbs}\n# self: {own}\n"


def gene(n, site="-\t-\t-"):
    return f"gene_{n}\t1\t270\t+\t0\t01\t37.5\ts\t{site}\n"


def genes_by_contig(df):
    return sorted((row.name, [g.gene_id for g in row.predicted_genes]) for row in df.collect())


def test_gene_call_headers(lines):
    line = F.col("line")
    df = lines("genome denovo_c8", "gc = 0.313883, rbs = -1", "self: -", "what: ever")
    found = df.select(name_header(line), composition_header(line), self_header(line)).collect()
    assert found[0][0] == "genome denovo_c8" and found[1][0] is None
    assert tuple(found[1][1]) == ("0.313883", "-1")
    assert found[2][2] == "-" and tuple(found[3]) == (None, None, None)


def test_gene_calls_are_nested(spark, tmp_path):
    text = headers("c 1", "0.25", "-1", "b") + gene(1) + gene(2, "1349\t1354\t-0.25") + headers("c-2", own="-")
    text += gene(1, "5\t-\t1.0").removesuffix("\n")
    rows = {r.name: r for r in read_gene_calls(spark, written(tmp_path / "g", text)).collect()}
    first = rows["c 1"]
    assert (first.gc, first.rbs, first.self) == (0.25, -1.0, "b")
    assert tuple(first.predicted_genes[0]) == ("gene_1", 1, 270, "+", 0, "01", 37.5, "s", None)
    assert tuple(first.predicted_genes[1].rbs) == (1349, 1354, -0.25)
    assert rows["c-2"].predicted_genes[0].rbs is None and rows["c-2"].self == "-"
    assert flatten_genes(read_gene_calls(spark, str(tmp_path / "g"))).count() == 3


@pytest.mark.parametrize("size, ending", [("128m", "\n"), ("70b", "\n"), ("23b", "\r\n")])
def test_contigs_without_genes(spark, tmp_path, split_size, size, ending):
    files = {
        "a": headers("a1") + gene(1) + gene(2) + headers("a2") + headers("a3") + gene(1) + headers("a4"),
        "b": headers("b1") + gene(1) + "\n" + headers("b2") + gene(1),
        "c": "",
        "d": headers("d1"),
        "e": "\n" + headers("e1") + gene(1),
    }
    for name, text in files.items():
        written(tmp_path / name, text.replace("\n", ending))
    split_size(size)
    expected = [("a1", ["gene_1", "gene_2"]), ("a3", ["gene_1"]), ("a4", []), ("b1", ["gene_1"]), ("d1", [])]
    assert genes_by_contig(read_gene_calls(spark, str(tmp_path))) == expected
    kept = sorted([*expected, ("a2", [])])
    assert genes_by_contig(read_gene_calls(spark, str(tmp_path), keep_empty=True)) == kept


@pytest.mark.parametrize("size", ["128m", "19b"])
@pytest.mark.parametrize(
    "text, problem",
    [
        (headers("c1") + gene(1) + "# c2\n# self: b\n" + gene(1), "without a composition header"),
        (headers("c1") + "# what: ever\n" + gene(1), "unrecognised gene-call header"),
        ("gene_1\t1\n", "unrecognised gene-call header"),
        (headers("c1") + "gene_1\t1\t2\n", "INVALID_ARRAY_INDEX"),
    ],
)
def test_broken_gene_calls_fail(spark, tmp_path, split_size, size, text, problem):
    split_size(size)
    with pytest.raises(Exception, match=problem):
        read_gene_calls(spark, written(tmp_path / "g", text)).collect()


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_gene_call_headers_are_carried_over_stretches(spark, tmp_path, monkeypatch, bits):
    """Headers, their genes, blank lines and ends of files in stretches of one, two or eight pieces, in files that do not split."""
    rng = random.Random(bits)
    for number in range(3):
        parts = []
        for k in range(20):
            genes = [f"g{k}_{i}\t0\t9\t+\t0\t11\t1.5\ts\t-\t-\t-" for i in range(rng.choice([0, 0, 1, 3]))]
            parts += [f"# c{number}_{k}", f"# gc = 0.{k}, rbs = -1", "# self: x", *genes]
            if rng.random() < 0.1 * number:
                parts.append("")  # nothing counts after it
        (tmp_path / f"{number}.gz").write_bytes(gzip.compress("\n".join(parts).encode()))
    calls = lambda keep: sorted((r.name, r.gc, len(r.predicted_genes)) for r in read_gene_calls(spark, str(tmp_path), keep).collect())
    whole = [calls(False), calls(True)]
    monkeypatch.setattr(fastq, "SUB_BLOCK_BITS", bits)
    assert [calls(False), calls(True)] == whole and len(whole[0]) < len(whole[1])


def test_json_round_trip(spark):
    schema = "a INT, b STRING, c ARRAY<STRING>, d STRUCT<e: DOUBLE>"
    rows = [(1, 'q"uote', ["x"], (1.5,)), (None, None, [], None)]
    df = spark.createDataFrame(rows, schema)
    encoded = to_json_rows(df)
    assert '"b"' not in encoded.collect()[1].json
    assert from_json_rows(encoded, df.schema).collect() == df.collect()
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        from_json_rows(spark.createDataFrame([("{",)], "json STRING"), schema).collect()
