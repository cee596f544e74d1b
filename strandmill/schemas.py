"""Schemas of every record type, as DDL strings that Spark parses."""

LINE = "line STRING"

FASTA = "header STRING, sequence STRING"

FASTQ = "header STRING, sequence STRING, opt_header STRING, quality_scores STRING"

HITS = (
    "query_id STRING, subject_id STRING, percent_identity DOUBLE, alignment_length INT, "
    "mismatch_count INT, gap_open_count INT, query_start INT, query_end INT, "
    "subject_start INT, subject_end INT, e_value DOUBLE, bit_score DOUBLE"
)

DOMAINS = (
    "protein_accession STRING, sequence_digest STRING, sequence_length BIGINT, analysis STRING, "
    "signature_accession STRING, signature_description STRING, start_location BIGINT, "
    "stop_location BIGINT, score DOUBLE, status BOOLEAN, date STRING, interpro_accession STRING, "
    "interpro_description STRING, go_annotations ARRAY<STRING>, pathway_annotations STRING"
)

RIBOSOME_SITE = "STRUCT<start: INT, end: INT, score: FLOAT>"

GENE = (
    "STRUCT<gene_id: STRING, start_pos: INT, end_pos: INT, strand: STRING, frame: INT, "
    f"complete_partial: STRING, gene_score: FLOAT, used_model: STRING, rbs: {RIBOSOME_SITE}>"
)

GENE_CALLS = f"name STRING, gc FLOAT, rbs FLOAT, self STRING, predicted_genes ARRAY<{GENE}>"

WARC = (
    "record_type STRING, warc_date STRING, record_id STRING, content_type STRING, "
    "content_length INT, metadata MAP<STRING, STRING>, content BINARY, file_path STRING, "
    "record_number BIGINT"
)
