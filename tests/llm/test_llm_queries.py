"""The registered queries of the pipeline operators, and the pipeline against a plain-Python one."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect
from test_llm_operators import brute_components, brute_contamination, brute_runs, make_text

import __spark_entry__ as driver
import corpus_pipeline
from strandmill.llm import packing
from strandmill.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


def test_one_query_for_each_operator():
    numbered = [int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbered) == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.items() <= driver.queries().items() and ORACLES.items() <= driver.oracle_sql().items()


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) == ""


@needs_tables
def test_languages_of_held_out_documents_are_right(spark):
    found = QUERIES["op1_language_id"](spark, SF_DIR).where("held_out")
    labels = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    pairs = found.join(labels, "doc_id").where("lang IS NOT NULL").collect()
    assert pairs and sum(r["lang_pred"] == r["lang"] for r in pairs) / len(pairs) >= 0.95


@needs_tables
def test_articles_are_found_whole(spark):
    """The generated pages hold their text between the article tags."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for row in QUERIES["op3_main_text"](spark, SF_DIR).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[row["page_id"]], re.S)[1]
        plain = re.sub(r"\s+", " ", re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", inside))).replace("&amp;", "&").replace("&quot;", '"').strip()
        assert row["text"].replace("\n", " ") == plain and row["n_chars"] == len(row["text"])


@needs_tables
def test_messages_without_quotes_keep_their_order(spark):
    rows = QUERIES["op2_quotation_linking"](spark, SF_DIR).collect()
    by_conversation = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r["conv_id"], r["position"])):
        by_conversation[row["conv_id"]].append(row["turn"])
    assert all(turns == sorted(turns) for turns in by_conversation.values())
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/conversations.parquet").count()


def corpus(rng):
    """Documents with copies, near copies, shared passages, benchmark passages, and some that are no text."""
    items = [(i, make_text(rng, 25).replace("\n", " ")) for i in range(4)]
    rows = [(i, make_text(rng, rng.choice([30, 120, 400]))) for i in range(40)]
    passage = make_text(rng, 70).replace("\n", " ")
    for i in range(40, 46):
        rows.append((i, f"{make_text(rng, 60)}\n{passage}\n{make_text(rng, 60)}"))
    for i in range(46, 52):
        base = rows[i - 46][1].split(" ")
        base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(52, rows[7][1]), (53, rows[8][1])]
    rows += [(54, make_text(rng, 40) + " " + items[1][1] + " " + make_text(rng, 30)), (55, items[2][1])]
    return rows + [(56, None), (57, ""), (58, "123 456 !!!")], items


def test_pipeline_equals_plain_python(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows, items = corpus(random.Random(12))
    table = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "")]
    cleaned = brute_runs(kept, 50)
    kept = [(d, cleaned[d][0]) for d, _ in kept if cleaned[d][2] < cleaned[d][1]]
    groups = brute_components(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    hits = {d: n_hit for d, _, n_hit, _ in brute_contamination(kept, items)}
    kept = [(d, t) for d, t in kept if not hits[d]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for d, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k, (at, n) in enumerate(packing.cut(len(ids), 2048)):
            expected[d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.dtypes == docs.dtypes
        docs = after
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()} == {d: (t, len(t)) for d, t in kept}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected
    assert 0 < len(kept) < len(rows)


def test_pipeline_stages_over_no_rows(spark, tmp_path):
    table = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
