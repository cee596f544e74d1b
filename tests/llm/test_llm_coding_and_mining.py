"""BPE coding against the library, source divergence and hard negatives against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import byte_bpe, hard_negatives, source_audit

P = pytest.importorskip("public_tokenizers")


# --- byte-level BPE --------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return byte_bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    parts = ["a", "b", "The", " ", "  ", "\n", "'s", "'ll", "1", "é", "\U0001f600", "\x1c", "\x85", "　", "中", "٣", "!!", "<|endoftext|>"]
    parts += [chr(0x558), chr(0x88F), chr(0x1246F), chr(0x11DE0)]  # characters of late versions of Unicode
    return "".join(rng.choice(parts) * rng.choice([1, 1, 1, 7]) for _ in range(n))


@pytest.mark.parametrize("memo", [0, 3, 1000])
def test_encoding_equals_the_library(ranks, library, memo, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WHOLE_CHARS", 40)
    coder = byte_bpe.ByteBpe(ranks, P.PATTERN, *byte_bpe.spelled_out(P.PATTERN), memo)
    rng = random.Random(1)
    for _ in range(1500):
        text = random_text(rng, rng.randrange(25))
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_very_long_pieces_equal_the_library(ranks, library):
    rng = random.Random(2)
    for text in ["x" * 60_000, "ab" * 20_000, " " * 50_000, "".join(rng.choice("abcdeé") for _ in range(30_000)), "\U0001f600" * 9_000]:
        pieces = re.findall(r"\s+|\S+", text)
        ids = [i for piece in pieces for i in byte_bpe.merge(piece.encode(), ranks)]
        assert ids == byte_bpe.merge(text.encode(), ranks)
        coder = byte_bpe.ByteBpe(ranks, P.PATTERN, *byte_bpe.spelled_out(P.PATTERN))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_leftmost_of_equal_pairs_is_merged_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258}
    assert byte_bpe.merge(b"aaa", ranks) == [256, 97]
    assert byte_bpe.merge(b"aab", ranks) == [258] and byte_bpe.merge(b"caab", ranks) == [99, 258]
    assert byte_bpe.merge(b"zaaaab", ranks) == [122, 256, 258]
    assert byte_bpe.merge(b"q", ranks) == [113] and byte_bpe.merge(b"qq", ranks) == [113, 113]


def test_coding_of_awkward_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same text"), (3, "same text"), (4, "x" * 20_000), (5, "Straße \U0001f600\n\n <|endoftext|>")]
    table = spark.createDataFrame([(d, t, "i", 1) for d, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    path = P.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table, path), path)
    expected = Counter((d, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)
    found = coded.collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), bytes(r["decoded"])) for r in found) == expected
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in found)
    assert byte_bpe.encode(table.limit(0), path).count() == 0
    broken = byte_bpe.decode(spark.createDataFrame([(1, None), (2, bytearray(np.array([224], "<u4").tobytes()))], "doc_id int, ids binary"), path)
    texts = {r["doc_id"]: r["decoded"] for r in broken.collect()}
    assert texts[1] is None and len(texts[2]) == 1
    with pytest.raises(ValueError, match="there already"):
        byte_bpe.decode(coded, path)


# --- source divergence -----------------------------------------------------


def brute_divergence(rows, least=10, top=10):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, out = [(lang or "", source or "", split(text)) for lang, source, text in rows], []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holders = Counter(w for d in mine for w in set(d[2]))
        kept, counts = [w for w in holders if holders[w] >= least], defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if holders[w] >= least)

        def share(c):
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        shares, whole = {s: share(counts[s]) for s in {d[1] for d in mine}}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in shares.items():
            pairs = sorted((-sum(f(p[w], q[w]) for w in kept), o.encode()) for o, q in shares.items() if o != s)
            terms = sorted((-f(p[w], whole[w]), w.encode()) for w in kept if counts[s][w] and p[w] > whole[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows(rng, n):
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", None, "", "fr", "zz", "en"]), rng.choice([None, "a", "b", "c d", "é", "zzz", "hot", "hot", "hot"])
        words = ["The", f"w{chr(97 + int(26 * rng.random() ** 2))}" + "x" * int(rng.random() * 3), "é-É", "\U0001f600,x"]
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
        rows.append((lang, source, text) if lang != "zz" else (lang, rng.choice("xyz"), None if k % 40 else f"rare {k}"))
    return rows + [("one", "only", "a b " * 5_000)] * 12


@pytest.mark.parametrize("block, chunk, flush", [(256, 1 << 18, 200_000), (2, 5, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, chunk, flush):
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", block)
    monkeypatch.setattr(source_audit, "CHUNK_PAIRS", chunk)
    monkeypatch.setattr(source_audit, "FLUSH_TERMS", flush)
    rows = divergence_rows(random.Random(block), 500)
    table = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, value int")
    expected = brute_divergence(rows)
    assert sorted(tuple(r) for r in source_audit.source_divergence(table.repartition(5)).collect()) == expected
    assert {r[2] for r in expected} == {"pair", "term"} and any(r[0] == "zz" and r[4] == 0 for r in expected)


def test_divergence_does_not_depend_on_the_broadcasts_or_the_borders(spark, monkeypatch):
    from strandmill.llm import common

    rows = divergence_rows(random.Random(5), 300)
    table = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(source_audit, "BORDER_DEPTH", 1)
    assert sorted(tuple(r) for r in source_audit.source_divergence(table).collect()) == brute_divergence(rows)
    assert source_audit.source_divergence(table.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    counts = [(2, 3), (4_000_000_000_000_000, 4_000_000_000_000_001), (1, 9_000_000_000_000_000), (7, 7)]
    table = spark.createDataFrame(counts, "c long, n long")
    for row in table.withColumn("p", source_audit._share(F.col("c"), F.col("n"))).collect():
        assert row["p"] == 1 + 1_000_000_000 * row["c"] // row["n"]


# --- hard negatives --------------------------------------------------------


def brute_negatives(rows):
    sound = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in sound:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in sound)
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "b", "k", 0.5) for r in rows], "vec_id long, label int, embedding array<double>, block string, key string, score double").repartition(4)


@pytest.mark.parametrize("dim, size, whole", [(6, 1.0, False), (3, 1e5, False), (2, 0.01, False), (3, 1.0, True)])
def test_negatives_equal_brute_force(spark, dim, size, whole, monkeypatch):
    rng = random.Random(dim)
    number = (lambda x: float(round(x))) if whole else float
    rows = [(k * 10, rng.randrange(3), [number(rng.gauss(0.3, 1) * size) for _ in range(dim)]) for k in range(200)]
    rows += [(k, 1, list(rows[5][2])) for k in range(3_000, 3_040)]  # many copies of one vector
    table, expected = vector_table(spark, rows), brute_negatives(rows)
    assert expected
    for bound in (1 << 25, 0):
        found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, broadcast_bytes=bound)
        assert sorted(tuple(r) for r in found.collect()) == expected
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("HELD_ENTRIES", 30)):
        monkeypatch.setattr(hard_negatives, name, value)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_negatives_of_awkward_rows(spark):
    rng = random.Random(7)
    rows = [(k * 10, rng.randrange(2), [float(rng.randrange(-2, 4)) for _ in range(3)]) for k in range(80)]
    rows += [(7, 1, None), (8, None, [1.0]), (9, 1, [1.0, None]), (11, 1, [1.0, float("nan")]), (12, 0, []), (13, 0, [1.0]), (14, 1, [2.0] * 9)]
    rows += [(200, 0, [3.0] * 3), (200, 0, [3.0] * 3), (300, 1, [float("inf")]), (None, 1, [1.0] * 3), (900, 8, [1.0] * 3)]
    table = vector_table(spark, rows)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, F.lit(False)).count() == 0


def test_scores_beyond_double_precision_are_exact(spark):
    rows = [(0, 1, [2.0**20, 1.0]), (1, 1, [2.0**20, 3.0]), (2, 2, [2.0**19, 1.0 / 256]), (3, 2, [2.0**19, 2.0 / 256]), (4, 2, [2.0**18, 0.0])]
    found = hard_negatives.hard_negatives(vector_table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute_negatives(rows) and len(found) == 2
