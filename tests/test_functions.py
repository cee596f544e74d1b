import random
import subprocess

import pytest
from pyspark.sql import functions as F

from strandmill.functions import fields, sequences, urls
from strandmill.functions.binding import let
from strandmill.functions.patterns import basic_to_java, java_pattern
from strandmill.functions.words import count_words
from strandmill.operators.lines import count_words_in_matching, grep, partition_words, total_words


def values(df):
    return [row[0] for row in df.collect()]


def test_space_rule_counts_tabs_as_part_of_a_word(lines):
    df = lines("a b", "x\tdolor", "  a   b ", "", " ", "a b c")
    assert values(df.select(count_words("line"))) == [2, 1, 2, 0, 0, 2]


def test_whitespace_rule_agrees_with_wc(lines, tmp_path):
    rows = ["a b", "x\tdolor", "  a   b ", "", "a\x0bb\x0cc\rd"]
    counted = values(lines(*rows).select(count_words("line", "whitespace")))
    for row, n in zip(rows, counted, strict=True):
        wc = subprocess.run(["wc", "-w"], input=row.encode(), capture_output=True, check=True)
        assert int(wc.stdout) == n


def test_unknown_word_rule_is_refused():
    with pytest.raises(ValueError):
        count_words("line", "letters")


def test_totals_are_zero_without_lines(lines):
    df = lines("lorem ipsum dolor", "sit amet", "dolor  dolor")
    assert values(count_words_in_matching(df, "dolor")) == [5]
    assert values(count_words_in_matching(df, "Dolor")) == [0]
    assert values(total_words(df.filter("false"))) == [0]
    partials = partition_words(df.repartition(2))
    assert sum(row.n_words for row in partials.collect()) == 7


BASIC_PATTERNS = [
    "dolor", "a.c", "a*b", "*b", r"\(ab\)*c", r"\(a\|b\)c", r"a\{2\}", r"a\{1,\}b", "a+b", r"a\+b", "a?b",
    r"a\?b", "(ab)", "{a}", "a|b", "^ab", "a^b", "ab$", "a$b", "[abc]d", "[^abc]d", "[]a]b", "[^]a]b",
    "[a-c]x", "[[:digit:]]x", "[[:alpha:][:digit:]]-", r"\.", r"a\.b", r"[\.]b", r"\(a\)\1", r"\<ab", r"ab\>",
    r"\w\w\W", r"^\(ab\|cd\)$", "[[]", "[a&&b]", r"\*b", "^*b", r"\(^a\)", r"\(a$\)", "[a-]z",
]


def test_basic_expressions_find_what_grep_finds(lines, tmp_path):
    random.seed(3)
    alphabet = list("abcdx19.*+?(){}|[]^$\\&- z") + ["ab", "cd", "aa", "&&"]
    rows = ["".join(random.choices(alphabet, k=random.randint(0, 7))) for _ in range(600)]
    file = tmp_path / "lines"
    file.write_text("\n".join(rows) + "\n")
    df = lines(*rows).coalesce(1).cache()
    for pattern in BASIC_PATTERNS:
        run = subprocess.run(
            ["grep", "-a", "--", pattern, str(file)], capture_output=True, text=True, env={"LC_ALL": "C"}
        )
        assert run.returncode in (0, 1), pattern
        assert sorted(values(grep(df, pattern))) == sorted(run.stdout.split("\n")[:-1]), pattern


def test_other_pattern_syntaxes(lines):
    df = lines("a.b", "axb", "a+b")
    assert values(grep(df, "a.b", "fixed")) == ["a.b"]
    assert values(grep(df, "a[+x]b", "java")) == ["axb", "a+b"]
    with pytest.raises(ValueError):
        java_pattern("a", "perl")
    with pytest.raises(ValueError):
        basic_to_java("[a")


def test_optional_and_strict_fields(lines):
    df = lines("x\t1.5\t\t\t", "x\t-\tT", "\t\t")
    parts = fields.tab_fields("line")
    rows = df.select(
        F.size(parts).alias("n"),
        fields.optional_double(fields.optional(parts, 1)).alias("score"),
        fields.optional(parts, 2).alias("third"),
    ).collect()
    assert [tuple(row) for row in rows] == [(2, 1.5, None), (3, None, "T"), (1, None, None)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_broken_fields_raise(spark, lines, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        parts = fields.tab_fields("line")
        with pytest.raises(Exception, match="column 2 is missing|INVALID_ARRAY_INDEX"):
            lines("a").select(fields.required(parts, 1, "int")).collect()
        with pytest.raises(Exception, match="column 1 is missing or not int|CAST_INVALID_INPUT"):
            lines("1.5").select(fields.required(parts, 0, "int")).collect()
        with pytest.raises(Exception, match="neither T nor F"):
            lines("x").select(fields.strict_flag(F.col("line"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_lists(spark):
    rows = [(None,), ("",), ("a",), ("a|b",), ("a||b|",), ("||",)]
    df = spark.createDataFrame(rows, "c STRING")
    assert values(df.select(fields.bar_list(F.col("c")))) == [[], [""], ["a"], ["a", "b"], ["a", "", "b"], []]
    tags = spark.createDataFrame([("a,,b,",), (",",)], "c STRING")
    assert values(tags.select(fields.comma_list("c"))) == [["a", "b"], []]


def test_cutting_and_orientation(spark):
    df = spark.createDataFrame([("ACGTRYacgn", 2, 6)], "s STRING, a INT, b INT")
    s, a, b = F.col("s"), F.col("a"), F.col("b")
    row = df.select(
        sequences.cut(s, a, b),
        sequences.cut(s, a, b, genomic=True),
        sequences.orient(s, F.lit("-")),
        sequences.orient(s, F.lit("+")),
        sequences.orient(s, F.lit("-"), complemented=True),
        sequences.translated_id(F.lit("c1"), F.lit("gene_1")),
        sequences.gene_header(F.lit("my contig"), F.lit("gene 1")),
    ).head()
    assert tuple(row) == (
        "GTRY", "CGTRY", "ngcaYRTGCA", "ACGTRYacgn", "ncgtRYACGT", "c1?mga?gene_1", "my_contig_gene_1",
    )
    for bad in ((8, 11), (-1, 3), (5, 3)):
        with pytest.raises(Exception, match="does not fit"):
            df.select(sequences.cut(s, F.lit(bad[0]), F.lit(bad[1]))).collect()


BASES = [
    "http://h.com", "http://h.com/", "http://h.com/a/b/c.html", "https://h.com/a/b/?q=1#top", "mailto:x@y", "",
    "not a url", "/rel/path", "http://h.com/../a/b", "http://é.com/é/x", "http://[::1]/a/b", "http://h.com/a?x=/y/z",
]
PIECES = [
    "a", "b.html", "..", ".", "/", "//", "?", "#", "x y", "%41", "%zz", "é", "http:", "https://h.org", "mailto:", "[",
    "]", "{", "q=1", "\\", "@", "~", "", "'", "|", "&", " ",
]
LINKS = PIECES + [
    "../x", "../../x", "./x", "x/../y", "x/./y/..", "/x/../y", "x?q#f", "a#b#c", "../", "//o.com/p", "HTTP://UP/",
    "javascript:void(0)", "x:y", "1:2", "a/..", "a/../..", "a//b/../c", "http:rel", "data:a b", "./a:b", "/[x]", "..a",
]


def jvm_normalised(jvm, page, link):
    """The same rule through the URI class of the JVM."""
    try:
        base = jvm.java.net.URI(page)
    except Exception:
        return ""
    cut = link[: link.index("?")] if link.find("?") > 0 else link
    try:
        return base.resolve(cut).toString()
    except Exception:
        return cut


def test_links_resolve_like_the_uri_class(spark):
    random.seed(5)
    pairs = {(page, link) for page in BASES for link in LINKS}
    pairs |= {(random.choice(BASES), "".join(random.choices(PIECES, k=3))) for _ in range(200)}
    # an authority that ends in an empty port is printed with the colon by one and not the other
    pairs = sorted(pair for pair in pairs if not pair[1].startswith("//") or ":" not in pair[1])
    resolved = let(urls.page_parts(F.col("page")), lambda page: urls.normalise(page, F.col("link")))
    df = spark.createDataFrame(pairs, "page STRING, link STRING").withColumn("found", resolved)

    def acceptable(link):
        return link if link.lower().startswith(("http://", "https://")) else None

    wrong = [
        (row.page, row.link, row.found, expected)
        for row in df.collect()
        if acceptable(row.found) != acceptable(expected := jvm_normalised(spark._jvm, row.page, row.link))
    ]
    assert wrong == []


PATTERNS = [
    "foo$", "^f.o$", "a*", "a**", r"a*\+a", r"a\+*", r"a\{2\}", r"a\{2,\}b", r"a\{,2\}$", r"\(ab\)*c", r"\(ab\)\{2\}", r"\(a\|b\)c", "*a", r"\(*a\)", "^*a",
    "a^b", "a$b", r"\$", r"a\.b", "[]a]", "[^]a]b", "[[:digit:]]\\+", "[a-c]x", r"\(a\)\1", r"a\?b", "{", "a+b", "a?b", "(a)", "a|b", r"\<a", r"b\>", r"\w\+-", r"a.c", "\r",
]
TEXTS = ["foo", "foo\r", "f\ro", "f.o", "aaa", "a", "", "ab", "abab", "ababc", "abc", "bc", "*a", "^a", "a^b", "a$b", "a.b", "axb", "]a", "xb", "12", "ax", "aa", "b", "{", "a+b", "a?b", "(a)", "a|b", "cab a", "x-y", "a\rc", "a\u2028c", "aab", "aaab"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_basic_expressions_find_what_grep_finds(spark, lines, pattern):
    run = subprocess.run(["grep", "-a", "--", pattern], input="\n".join(TEXTS).encode() + b"\n", capture_output=True, env={"LC_ALL": "C.UTF-8"})
    expected = sorted(run.stdout.decode().split("\n")[:-1])
    assert sorted(r.line for r in grep(lines(*TEXTS), pattern).collect()) == expected
