"""Quotation linking against plain Python, on random trees of quotes, long messages and deep threads."""

import random
import re
import time
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandmill.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def normal(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def parse(line):
    marks = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
    return (marks.group(1).count(">"), line[marks.end() :]) if marks else (0, line)


def units(text):
    """Distinct (level, words) of a message: its lines, passages, paragraphs and own text."""
    lines = [parse(line) for line in text.split("\n")]
    after = [level for level, _ in lines[1:]] + [0]
    introduces = [bool(re.search(r"\b(wrote|writes)[ \t]*:[ \t]*$", body)) and after[i] > level for i, (level, body) in enumerate(lines)]
    own = "\n".join(body for (level, body), intro in zip(lines, introduces) if level == 0 and not intro)
    found = [line for line in lines if line[0] > 0]
    found += [(level, " ".join(body for _, body in run)) for level, run in groupby(lines, key=lambda line: line[0]) if level > 0]
    kinds = [-1 if intro or not body.strip() else level for (level, body), intro in zip(lines, introduces)]
    at = 0
    for kind, run in groupby(kinds):
        n = len(list(run))
        if kind >= 0:
            found.append((kind, " ".join(body for _, body in lines[at : at + n])))
        at += n
    found += [(0, own), *((0, line) for line in own.split("\n"))]
    return {(level, normal(body)) for level, body in found if normal(body)}, own


def brute_force(rows):
    """(conv, turn) -> (reply_to, thread, depth, position, own text)."""
    out = {}
    for conv in {row[0] for row in rows}:
        messages = {turn: units(text or "") for c, turn, _, text in rows if c == conv}
        parent = {}
        for turn, (mine, _) in messages.items():
            votes = {}
            for level, body in mine:
                if level == 1:
                    sources = [t for t, (theirs, _) in messages.items() if t < turn and (0, body) in theirs]
                    if sources:
                        votes[max(sources)] = votes.get(max(sources), 0) + len(body.split(" "))
            parent[turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
        order = []
        stack = [(t, t, 0) for t in sorted(messages, reverse=True) if parent[t] is None]
        while stack:
            turn, thread, depth = stack.pop()
            out[conv, turn] = (parent[turn], thread, depth, len(order), messages[turn][1].strip(" "))
            order.append(turn)
            stack += [(t, thread, depth + 1) for t in sorted(messages, reverse=True) if parent[t] == turn]
    return out


def conversation(rng, conv, n):
    words = ["alpha", "Beta", "gamma", "delta", "écho", "wrote:", "x"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            if texts and rng.random() < 0.7:
                source = rng.choice(texts).split("\n")
                lo = rng.randrange(len(source))
                taken = source[lo : lo + rng.randrange(1, 6)]
                if rng.random() < 0.3:
                    words_of = " ".join(taken).split()
                    taken = [" ".join(words_of[i : i + 3]) for i in range(0, len(words_of), 3)]
                if rng.random() < 0.4:
                    parts.append("Ann wrote:")
                parts += [rng.choice(["> ", ">"]) + line for line in taken]
            parts += [" ".join(rng.choices(words, k=rng.randrange(7))) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.3:
                parts.append("")
        texts.append("\n".join(parts))
    return [(conv, turn, "user", text) for turn, text in enumerate(texts)]


def result(spark, rows):
    found = quotations.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    return {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.position, r.text) for r in found}


def test_random_quotes_as_by_brute_force(spark):
    rng = random.Random(11)
    rows = [row for conv in range(60) for row in conversation(rng, conv, rng.randrange(1, 25))]
    expected = brute_force(rows)
    assert sum(reply is not None for reply, *_ in expected.values()) > 150 and max(depth for _, _, depth, *_ in expected.values()) > 3
    assert result(spark, rows) == expected


def test_one_conversation_over_many_ranges(spark):
    """A chain of replies, a message with many replies and a crowd of single messages, in one conversation."""
    rng = random.Random(5)
    rows = [(7, 0, "user", "start 0")]
    rows += [(7, t, "user", f"> start {t - 1}\nstart {t}") for t in range(1, 300)]
    rows += [(7, t, "user", f"> start 5\nlate {t}") for t in range(300, 900)]
    rows += [(7, t, "user", f"single {t}") for t in range(900, 2000)]
    rng.shuffle(rows)
    got = result(spark, rows)
    assert got == brute_force(rows)
    assert max(depth for _, _, depth, *_ in got.values()) == 299


def test_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(None if g == 0 else g, i, rng.randrange(5)) for g, n in enumerate((3000, 1, 0, 40, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, v long")
    expected, sums = [], {}
    for g, i, v in rows:
        expected.append((g, i, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    got = quotations.running_sum(df.repartition(7), ["g"], ["i"], F.col("v"), "sums")
    assert got.columns == ["g", "i", "v", "before"]
    key = lambda row: (row[0] or 0, row[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("quoted", [False, True])
def test_a_message_of_many_lines(spark, quoted):
    n = 200_000
    first = "\n".join(f"line {i} of the first" for i in range(n))
    second = "\n".join(f"> line {i} of the first" if quoted else f"other {i}" for i in range(n)) + "\nend"
    started = time.monotonic()
    got = result(spark, [(1, 0, "user", first), (1, 1, "user", second)])
    assert time.monotonic() - started < 60
    assert got[1, 1][:4] == ((0, 0, 1, 1) if quoted else (None, 1, 0, 1))


def test_a_line_of_many_marks_and_control_characters(spark):
    rows = [(1, 0, "user", "a\x01b c\x02d\nx"), (1, 1, "user", "> a\x01b c\x02d\n> x\n" + ">" * 100_000 + "deep"), (1, 2, "user", None)]
    got = result(spark, rows)
    assert got[1, 1][:4] == (0, 0, 1, 1) and got[1, 1][4] == "" and got[1, 2][:4] == (None, 2, 0, 2)


def test_clashing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "user", "> hi\nho"), (1, 1, "bot", "> hi\nha")], SCHEMA)
    for name in ("conv", "lines", "before", "row", "thread", "__value"):
        df = df.withColumn(name, F.lit("x"))
    rows = quotations.reply_ordered(df).collect()
    assert sorted((r.turn, r.position, r.reply_to, r.role) for r in rows) == [
        (0, 0, None, "user"), (0, 1, None, "user"), (1, 2, 0, "bot"), (1, 3, 0, "user"),
    ]
