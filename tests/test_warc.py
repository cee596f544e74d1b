import gzip
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.catalogue.archives import warc_nested_records
from strandmill.operators.links import (
    html_tags,
    http_body,
    outlink_sets,
    outlinks,
    warc_outlinks,
)
from strandmill.sources import warc


def record(kind, body, *more, number=0, end=b"\r\n"):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Date: 2015", b"WARC-Record-ID: <urn:%d>" % number]
    lines += [*more, b"Content-Type: text/html", b"Content-Length: %d" % len(body), b"", body]
    return end.join(lines)


def bodies(df):
    return [bytes(row.content) for row in df.orderBy("file_path", "record_number").collect()]


@pytest.mark.parametrize("packed", [False, True])
def test_records_and_fields(spark, tmp_path, packed):
    data = b"junk before\nthe first record\n"
    data += record(b"response", b"\r\nstarts with a line end", b"WARC-Target-URI: http://h/a:b") + b"\r\n\r\n"
    data += record(b"request", b"caf\xe9 \xff", b"No colon here", b"X:  1 ", b"X: 2", number=1) + b"\r\n\r\n"
    data += record(b"Response", b"", number=2, end=b"\n") + b"\n\n"
    name = tmp_path / ("a.warc.gz" if packed else "a.warc")
    name.write_bytes(gzip.compress(data[:60]) + gzip.compress(data[60:]) if packed else data)
    df = warc.read_warc(spark, str(name))
    rows = df.orderBy("record_number").collect()
    assert [(r.record_type, r.record_id, r.record_number) for r in rows] == [
        ("response", "<urn:0>", 0), ("request", "<urn:1>", 1), ("Response", "<urn:2>", 2),
    ]
    assert rows[0].metadata == {"WARC-Target-URI": "http://h/a:b"}
    assert rows[1].metadata == {"No colon here": "", "X": "2"}
    assert bytes(rows[0].content) == b"\r\nstarts with a line end" and bytes(rows[1].content) == b"caf\xe9 \xff"
    assert [r.content_length for r in rows] == [24, 6, 0]
    assert all(r.file_path.endswith(name.name) and r.content_type == "text/html" for r in rows)
    assert [r[0] for r in df.orderBy("record_number").select(warc.content_text()).collect()][1] == "caf� �"
    assert warc.warc_responses(df).count() == 2


def test_header_ends_after_the_length(spark, tmp_path):
    data = b"WARC/0.18\nWARC-Type: response\n\nContent-Length: x\n\nContent-Length: 3\n\nabc\n"
    (tmp_path / "a.warc").write_bytes(data)
    row = warc.read_warc(spark, str(tmp_path)).head()
    assert bytes(row.content) == b"abc" and row.record_type == "response" and row.metadata == {}


@pytest.mark.parametrize("packed", [False, True])
def test_payloads_that_look_like_records(spark, tmp_path, packed):
    inner = b"text\n" + record(b"metadata", b"inner") + b"\nWARC/0.9 not a record\nmore"
    payloads = [inner, b"plain", b"ends with a line end\n", inner * 3, b"x"]
    data = b"\r\n\r\n".join(record(b"response", body, number=n) for n, body in enumerate(payloads[:2]))
    # the third follows at once, the fourth after the line end that closes the third's payload
    data += record(b"response", payloads[2], number=2).replace(b"\r\n", b"\n", 1)
    data += b"".join(record(b"response", body, number=n) for n, body in enumerate(payloads[3:], 3))
    name = tmp_path / ("a.gz" if packed else "a.warc")
    name.write_bytes(gzip.compress(data) if packed else data)
    assert bodies(warc.read_warc(spark, str(name), splittable=False)) == payloads
    assert bodies(warc.read_warc(spark, str(name))) == payloads


def test_plain_files_split(spark, tmp_path, split_size):
    random.seed(2)
    payloads = [bytes(random.choices(range(256), k=random.randint(0, 300))) for _ in range(80)]
    payloads = [body.replace(b"\nWARC/", b"") for body in payloads]
    for name in ("a", "b"):
        data = b"".join(record(b"response", body, number=n) + b"\r\n\r\n" for n, body in enumerate(payloads))
        (tmp_path / name).write_bytes(data)
    for size in ("128m", "900b"):
        split_size(size)
        df = warc.read_warc(spark, str(tmp_path))
        assert bodies(df) == payloads * 2
        numbers = [r.record_number for r in df.orderBy("file_path", "record_number").collect()]
        assert numbers == list(range(80)) * 2
        assert warc.read_warc(spark, str(tmp_path), numbered=False).count() == 160


def test_a_record_over_the_end_of_a_split_is_put_together(spark, tmp_path, split_size):
    payload = b"\nWARC/1.0 inside".join([b"x" * 50] * 20)
    (tmp_path / "a.warc").write_bytes(record(b"response", payload) + b"\r\n\r\n")
    split_size("100b")
    settled = warc.read_warc(spark, str(tmp_path))
    split_size("1k")
    assert bodies(settled) == [payload]
    assert bodies(warc.read_warc(spark, str(tmp_path), splittable=False)) == [payload]
    split_size("100b")
    with pytest.raises(Exception, match="splittable=False"):
        warc.read_warc(spark, str(tmp_path), numbered=False).collect()


def test_nested_records_at_any_split_size(spark, tmp_path, split_size):
    """Payloads of whole records, of marks without a record and of records that claim more than there is."""
    rng = random.Random(0)

    def payload(depth):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append(bytes(rng.choices(range(32, 127), k=rng.randrange(120))))
            if depth and rng.random() < 0.7:
                inner = record(b"response", payload(depth - 1), number=99)
                if rng.random() < 0.3:
                    inner = inner.replace(b"Content-Length: ", b"Content-Length: 9")
                parts.append(b"\n" + inner)
            if rng.random() < 0.4:
                parts.append(b"\nWARC/1.0 a line")
        return b"".join(parts)

    expected = []
    for name in ("a",):
        payloads = [payload(2) for _ in range(3)] + [b""] + [payload(2) for _ in range(3)]
        gaps = [rng.choice([b"\r\n\r\n", b"\n", b""]) for _ in payloads[1:]] + [b""]
        (tmp_path / name).write_bytes(b"".join(record(b"response", body, number=n) + gap for n, (body, gap) in enumerate(zip(payloads, gaps))))
        expected += payloads
    cut = record(b"response", b"y" * 300 + b"\nWARC/1.0" + b"z" * 300, number=5)
    (tmp_path / "c").write_bytes(record(b"response", b"whole") + b"\r\n\r\n" + cut[:-100])
    expected.append(b"whole")
    for size in ("130b", "400b"):
        split_size(size)
        df = warc.read_warc(spark, str(tmp_path), with_truncated=True)
        split_size("128m")  # the archive has been read
        assert bodies(df.filter("not truncated")) == expected
        assert [bytes(r.content) for r in df.filter("truncated").collect()] == [b"y" * 300 + b"\nWARC/1.0" + b"z" * 200]
        numbers = [r.record_number for r in df.orderBy("file_path", "record_number").collect()]
        assert numbers == [*range(7), 0, 1]


def members(payloads, level=9):
    return [gzip.compress(record(b"response", body, number=n) + b"\r\n\r\n", level) for n, body in enumerate(payloads)]


def test_large_gzip_archives_split_at_members(spark, tmp_path, split_size):
    rng = random.Random(4)
    payloads = [bytes(rng.choices(range(256), k=rng.randrange(900))) for _ in range(150)]
    payloads[20] = b"\n" + record(b"response", b"inner") + b"\r\n\r\n" + payloads[20]
    payloads[30] = b""
    (tmp_path / "a b%20.warc.gz").write_bytes(b"".join(members(payloads)) + gzip.compress(b""))
    split_size("5k")
    df = warc.read_warc(spark, str(tmp_path), large_gzip=0)
    assert bodies(df) == payloads
    assert [r.record_number for r in df.orderBy("record_number").collect()] == list(range(150))
    assert df.select("file_path").distinct().count() == 1 and df.first().file_path.endswith("a%20b%2520.warc.gz")
    pieces = spark.read.options(**warc.UNPACKED).text(str(tmp_path), lineSep=warc.MEMBER.decode("latin-1"))
    assert pieces.rdd.getNumPartitions() > 5


def test_a_member_mark_by_chance(spark, tmp_path, split_size):
    """Stored blocks keep the bytes of a payload, marks of members among them, over whole splits and their ends."""
    fake = gzip.compress(b"WARC/ not a member of the file\n", 0)
    payloads = [b"a" * 50, (fake + b"x" * 300) * 20, b"b", warc.MEMBER * 40, b"c" * 700]
    (tmp_path / "a.gz").write_bytes(b"".join(members(payloads, 0)))
    for size in ("128m", "700b", "64b"):
        split_size(size)
        df = warc.read_warc(spark, str(tmp_path), large_gzip=0)
        split_size("128m")
        assert bodies(df) == payloads
        assert [r.record_number for r in df.orderBy("record_number").collect()] == list(range(5))


def test_gzip_archives_whose_members_are_not_records(spark, tmp_path, split_size):
    payloads = [b"p%d" % n * 200 for n in range(30)]
    text = b"".join(record(b"response", body, number=n) + b"\r\n\r\n" for n, body in enumerate(payloads))
    whole = b"".join(members(payloads))
    (tmp_path / "a.gz").write_bytes(gzip.compress(text))  # one member
    (tmp_path / "b.gz").write_bytes(b"".join(gzip.compress(text[i : i + 1000]) for i in range(0, len(text), 1000)))  # members cut anywhere
    (tmp_path / "c.gz").write_bytes(whole + b"".join(gzip.compress(part) for part in (record(b"response", b"glued"), record(b"response", b"not at a line end"))))
    (tmp_path / "d.gz").write_bytes(gzip.compress(b"junk\n") + whole)
    (tmp_path / "e!.gz").write_bytes(whole)
    (tmp_path / "f.gz").write_bytes(whole)
    (tmp_path / "g").write_bytes(text)
    alone = bodies(warc.read_warc(spark, str(tmp_path)))
    split_size("1k")
    assert bodies(warc.read_warc(spark, str(tmp_path), large_gzip=0)) == alone
    assert alone[:60] == payloads * 2 and alone.count(payloads[7]) == 7


def test_truncated_tail_is_dropped_or_marked(spark, tmp_path):
    whole, cut = record(b"response", b"whole"), record(b"response", b"cut off", number=1)
    (tmp_path / "a.gz").write_bytes(gzip.compress(whole + b"\r\n\r\n" + cut[:-3]))
    (tmp_path / "b.gz").write_bytes(gzip.compress(whole + b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n"))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b""))
    assert bodies(warc.read_warc(spark, str(tmp_path))) == [b"whole", b"whole"]
    marked = warc.read_warc(spark, str(tmp_path), with_truncated=True)
    assert sorted(bytes(r.content) for r in marked.filter("truncated").collect()) == [b"", b"cut "]


def test_render_metadata_and_round_trip(spark, tmp_path):
    rows = [
        ("response", "2015", "<urn:1>", "text/html", {"WARC-Target-URI": "u", "WARC-TREC-ID": "t"}, b"caf\xe9\x00\xff"),
        ("request", "2015", "<urn:2>", "", {}, b""),
    ]
    schema = "record_type STRING, warc_date STRING, record_id STRING, content_type STRING, "
    df = spark.createDataFrame(rows, schema + "metadata MAP<STRING, STRING>, content BINARY").withColumn(
        "content_length", F.octet_length("content")
    )
    text = df.select(warc.header_text(), warc.total_record_length()).head()
    assert text[0] == (
        "WARC/0.18\nWARC-Type: response\nWARC-Date: 2015\nWARC-Target-URI: u\nWARC-TREC-ID: t\n"
        "WARC-Record-ID: <urn:1>\nContent-Type: text/html\nContent-Length: 6\n"
    )
    assert text[1] == len(text[0]) + 6
    for packed in (False, True):
        out = str(tmp_path / f"out{packed}")
        warc.write_warc(df, out, gzip=packed)
        back = warc.read_warc(spark, out).select(df.columns)
        key = lambda row: row.record_id
        assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    items = df.select(*(warc.metadata_item(k) for k in ("WARC-Type", "Content-Length", "WARC-TREC-ID"))).collect()
    assert [tuple(r) for r in items] == [("response", "6", "t"), ("request", "0", None)]
    put = df.select(
        warc.put_metadata(F.lit("WARC-TREC-ID"), F.lit("new")),
        warc.put_metadata(F.lit("Content-Length"), F.lit("9")),
        warc.clear_metadata(),
    ).head()
    assert put[0] == {"WARC-Target-URI": "u", "WARC-TREC-ID": "new"}
    assert put[1] == {"WARC-Target-URI": "u", "WARC-TREC-ID": "t"} and put[2] == {}
    assert sorted(map(tuple, warc.metadata_entries(df, "record_id").collect())) == [
        ("<urn:1>", "WARC-TREC-ID", "t"), ("<urn:1>", "WARC-Target-URI", "u"),
    ]


HTML = """<a href="/one">x</a><A class=big HREF='two.html?q=1'><a href=/unquoted><link rel="s" href="/style">
<area shape="r" href="../three"><frame src="//other.org/f"><iframe src='https://i.org/?x'><img src="/no">
<a href="mailto:me@h"><a href="http://h.com/dir/page"><a
href="/broken"><a href="/one#frag"><a href="/one"><a href=""><area href=""><area href="" alt=""><a href="http://b ad/">
<b <a href="/nested">"""


def test_outlinks(spark):
    rows = [(1, "http://h.com/dir/page", HTML), (2, "", HTML), (3, "not a url", HTML), (4, "http://h.com/x", "no tags")]
    df = spark.createDataFrame(rows, "id INT, url STRING, html STRING")
    found = {}
    for row in outlinks(df, "id").collect():
        found.setdefault(row.id, []).append(row.link)
    assert list(found) == [1]
    assert sorted(found[1]) == sorted(
        ["http://h.com/one", "http://h.com/dir/two.html", "http://h.com/three",
         "http://other.org/f", "https://i.org/", "http://h.com/one#frag", "http://h.com/dir/", "http://b ad/",
         "http://h.com/nested"]
    )
    sets = {row.id: row.links for row in outlink_sets(df, "id").collect()}
    assert sets == {1: sorted(found[1]), 2: [], 3: [], 4: []}
    assert df.select(F.size(html_tags(F.col("html")))).head()[0] == 18


def test_no_shuffle_between_page_and_links(spark):
    df = spark.createDataFrame([(1, "u", "h")], "id INT, url STRING, html STRING")
    plan = outlinks(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "text, body",
    [
        ("HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\n", "<p>\r\n\r\n"),
        ("A: b\n \t \nbody", "body"),
        ("\nbody", "body"),
        ("A\rB\r\rbody", "body"),
        ("A: b\nno blank line", None),
        ("A: b\n\n", ""),
    ],
)
def test_http_header_is_skipped(spark, text, body):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(http_body(F.col("t"))).head()[0] == body


def test_warc_outlinks(spark, tmp_path):
    uri = b"WARC-Target-URI: http://h.com/p"
    page = b'HTTP/1.1 200 OK\r\nX: <a href="/header">\r\n\r\n<a href="/b\xff"><a href="/c">'
    data = b"\r\n\r\n".join(
        [record(b"Response", page, uri), record(b"request", page, uri, number=1), record(b"response", page, number=2)]
    )
    (tmp_path / "a.warc").write_bytes(data)
    links = warc_outlinks(warc.read_warc(spark, str(tmp_path)), "record_id").collect()
    assert sorted((r.record_id, r.link) for r in links) == [
        ("<urn:0>", "http://h.com/b�"), ("<urn:0>", "http://h.com/c"),
    ]


def test_small_splits_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(0, 60, 1, 2).selectExpr("id AS page_id", "'http://h/' || id AS url", "repeat('html of ' || id || '\n', 3000) AS html")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    found = warc_nested_records(spark, str(tmp_path))
    # 60 records of over 60 kB in splits of 64 kB, which few tasks read in each round
    assert len(found.inputFiles()) <= 40
    texts = {row.record_id: row.text for row in found.collect()}
    assert len(texts) == 60 and texts["<urn:outer:<urn:page:7>>"].count("html of 7\n") == 6000


def test_split_size_does_not_change_records(spark, tmp_path):
    rng = random.Random(6)
    payloads = [bytes(rng.choices(range(32, 127), k=rng.randrange(400))) + b"\n" + record(b"response", b"inner" * rng.randrange(40)) for _ in range(60)]
    (tmp_path / "a").write_bytes(b"".join(record(b"response", body, number=n) + b"\r\n\r\n" for n, body in enumerate(payloads)))
    for size in ("150b", "1k", None):
        df = warc.read_warc(spark, str(tmp_path), split_bytes=size)
        assert bodies(df) == payloads
        assert [r.record_number for r in df.orderBy("record_number").collect()] == list(range(60))


def peak_of(parse, *batches):
    """The bytes that Python takes at most beside the batches, and the number of records."""
    tracemalloc.start()
    try:
        n = sum(sum(kind == "record" for kind in found.column("kind").to_pylist()) for found in parse(iter(batches)))
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


def test_a_long_member_is_inflated_in_parts(spark):
    text = b"".join(record(b"response", b"%d " % n * 2000, number=n) + b"\r\n\r\n" for n in range(6000))
    pieces = gzip.compress(text, 1).split(warc.MEMBER)
    schema = pa.schema([("piece", pa.binary()), ("source", pa.string()), ("block", pa.int64())])
    batch = pa.RecordBatch.from_pylist([{"piece": piece, "source": "a", "block": 0} for piece in pieces], schema=schema)
    peak, n = peak_of(warc._records_of_members, batch)
    assert n == 6000 and len(text) > 50 << 20 and peak < 30 << 20


def test_a_batch_of_pieces_is_taken_row_by_row(spark):
    pieces = [record(b"response", b"%d " % n * 2000, number=n).removeprefix(warc.MARK if n else b"") for n in range(6000)]
    place = {"source": "a", "block": 0, "claimed": 0, "ends_file": True}
    schema = pa.schema([("piece", pa.binary()), ("source", pa.string()), ("block", pa.int64()), ("claimed", pa.int64()), ("ends_file", pa.bool_())])
    batch = pa.RecordBatch.from_pylist([{"piece": piece, **place} for piece in pieces], schema=schema)
    del pieces
    peak, n = peak_of(warc._records_of_partition, batch)
    assert n == 6000 and batch.nbytes > 50 << 20 and peak < 30 << 20


def test_a_member_in_chunks_of_any_size(monkeypatch):
    """Members by chance whole records or not, with separators over the ends of chunks."""
    rng = random.Random(7)
    schema = pa.schema([("piece", pa.binary()), ("source", pa.string()), ("block", pa.int64())])
    payloads = [b"\nWARC/1.0 x" * rng.randrange(4) + bytes(rng.choices(b"ab\n", k=rng.randrange(90))) for _ in range(40)]
    whole = b"".join(record(b"response", body, number=n) + b"\r\n\r\n" for n, body in enumerate(payloads))
    for text, missing in ((whole, None), (b"", None), (whole + b"x", 1), (b"junk\n" + whole, 1), (b"WAR", 1), (whole[:-60] + b"\n", 1)):
        rows = [{"piece": piece, "source": "a", "block": 0} for piece in gzip.compress(text).split(warc.MEMBER)]
        for chunk, packed in ((1, 1), (5, 3), (1 << 20, 64 << 10)):
            monkeypatch.setattr(warc, "CHUNK", chunk)
            monkeypatch.setattr(warc, "PACKED", packed)
            found = [row for batch in warc._records_of_members(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])) for row in batch.to_pylist()]
            assert found[-1]["kind"] == "end" and found[-1]["missing"] == missing
            if missing is None:
                assert [row["content"] for row in found[:-1]] == (payloads if text else [])
