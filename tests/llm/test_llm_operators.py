"""The pipeline operators on small tables: brute force, edge cases, and rows no operator may trip over."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import hashing, language_id, line_runs, main_text, near_dedup, packing, ppm, quotations, url_markov
from strandmill.llm.components import components
from strandmill.llm.decontaminate import contamination
from strandmill.llm.exact_dedup import directory, exact_duplicates

DOCS = "doc_id long, text string, kept string, row_key string, words string, `__lines` string"


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text) with extra columns whose names the operators use too."""
    return spark.createDataFrame([(d, t, "k", "r", "w", "l") for d, t in rows], schema)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one"),
    (5, "One"),
    (None, "a b c d e f g"),
    (6, "a b c d e f g"),
    (6, "a b c d e f g"),
    (7, "word " * 60_000),
    (8, "x" * 400_000),
    (9, "ünïcödé Straße \U0001f600 a b c"),
    (10, "\n\n\n"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def make_text(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


# --- hashing ---------------------------------------------------------------


def test_word_hashes_split_at_ascii_space_only():
    for _, text in AWKWARD:
        assert len(hashing.word_hashes(text or "")) == len(words(text))
    a = hashing.word_hashes("Foo bar\x0bFOO x")
    assert len(a) == 3 and a[0] != a[2]
    assert hashing.word_hashes("É")[0] != hashing.word_hashes("é")[0]


def test_word_hashes_do_not_depend_on_chunks():
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    hashes = hashing.word_hashes(text)
    assert len(np.unique(hashes)) == 997 and (hashes[:997] == hashes[997:1994]).all()
    raws = [(t or "").encode().lower() for _, t in AWKWARD]
    together, counts = hashing.word_hashes_of_all(raws)
    assert counts.tolist() == [len(words(t)) for _, t in AWKWARD]
    assert (together == np.concatenate([hashing.word_hashes(r) for r in raws])).all()


# --- language ID -----------------------------------------------------------


def test_language_profiles_and_edges(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["ção", "ñe", "que", "lh"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    labelled = spark.createDataFrame([(i, say(lang, 40), lang) for i, lang in enumerate(list(syllables) * 20)], "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(labelled)
    assert set(profiles) == set(syllables)
    test = [(i, say(lang, 8), lang) for i, lang in enumerate(list(syllables) * 10)]
    found = language_id.identify(spark.createDataFrame(test, "doc_id long, text string, score string"), profiles)
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {i: lang for i, _, lang in test}
    odd = {r["doc_id"]: r for r in language_id.identify(docs(spark, [(1, None), (2, "123 !? "), (3, "ka"), (None, "ka")]), profiles).collect()}
    assert (odd[1]["lang_pred"], odd[2]["lang_pred"], odd[3]["lang_pred"], odd[None]["lang_pred"]) == ("und", "und", "aa", "aa")
    assert odd[1]["score"] == 0 and 0 <= odd[3]["score"] <= 1
    assert language_id.identify(docs(spark, []), profiles).count() == 0
    none = labelled.where("false")
    assert language_id.learn_profiles(none) == {}
    assert language_id.identify(docs(spark, [(1, "ka")]), {}).first()["lang_pred"] == "und"


def brute_ngrams(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = "\0" + word + "\0"
        for n in (1, 2, 3):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip("\0") or n > 1)
    del counts["\0"]
    return Counter({g: c for g, c in counts.items() if g.strip("\0")})


def test_ngram_counts_equal_brute_force():
    for text in ("Der Hund, der Hund!", "a", "42 b-c  d", "é è É", "x " * 50):
        _, counts = language_id.ngram_counts(text)
        assert sorted(counts.tolist()) == sorted(brute_ngrams(text).values())
    long = "ab cd-" * 300_000
    short = language_id.ngram_counts("ab cd-" * 3)
    pieces = language_id.ngram_counts(long)
    assert pieces[0].tolist() == short[0].tolist() and (pieces[1] == short[1] * 100_000).all()


# --- quotations ------------------------------------------------------------


def test_quotes_are_linked_and_conversations_ordered(spark):
    rows = [
        (1, 0, "user", "Shall we meet on Monday?\nI am free all day."),
        (1, 1, "assistant", "Tuesday is better."),
        (1, 2, "user", "Ann wrote:\n> Shall we  MEET on Monday?\nYes, fine."),
        (1, 3, "user", "> Ann wrote:\n>> I am free all day.\n> Yes, fine.\nGood."),
        (1, 4, "assistant", "> nobody said this\nHm."),
        (2, 0, "user", "Shall we meet on Monday?"),
        (2, 1, "user", None),
        (None, 0, "user", "x"),
        (None, 1, "user", ">x\ny"),
        (3, None, "user", "no turn"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotations.reply_ordered(table).collect()}
    assert len(got) == len(rows)
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, None, 0, 2, None]
    assert [got[1, t]["position"] for t in range(5)] == [0, 3, 1, 2, 4]
    assert [got[1, t]["thread"] for t in range(5)] == [0, 1, 0, 0, 4]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 0, 1, 2, 0]
    assert got[1, 2]["text"] == "Yes, fine." and got[1, 3]["text"] == "Good." and got[1, 3]["n_quotes"] == 3
    assert got[None, 1]["reply_to"] == 0 and got[None, 1]["text"] == "y"
    assert got[2, 1]["text"] == "" and got[3, None]["position"] == 0
    assert quotations.reply_ordered(table.where("false")).count() == 0


def test_quote_levels_and_normal_form(spark):
    lines = spark.createDataFrame([("> > a",), (">>b",), (" >c",), ("d > e",), ("",)], "line string")
    assert [r[0] for r in lines.select(quotations.quote_level(F.col("line"))).collect()] == [2, 2, 1, 0, 0]
    assert lines.select(quotations.normalised(F.lit("  A\t b\n C "))).first()[0] == "a b c"


def test_common_line_links_to_the_latest_earlier_message(spark):
    rows = [(1, t, "user", "same" if t % 2 == 0 else "> same\nreply") for t in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["reply_to"] for r in quotations.reply_ordered(table).collect()}
    assert all(got[t] == t - 1 for t in range(1, 200, 2)) and all(got[t] is None for t in range(0, 200, 2))


def test_a_part_of_a_message_is_linked_however_it_is_wrapped(spark):
    rows = [
        (1, 0, "user", "First of all, hello.\n\nThe second paragraph goes over\ntwo lines of text.\n\nThe third one is a bit\nlonger than others.\n\nBye."),
        (1, 1, "assistant", "Something else."),
        (1, 2, "user", "Ann wrote:\n> The second paragraph\n> goes over two\n> lines of text.\n>\n> The third one is a bit longer\n> than others.\nMy answer has\ntwo lines.\n> Bye now.\nMore."),
        (1, 3, "assistant", "> My answer has two\n> lines.\nNo."),
        (1, 4, "user", "> > The second paragraph goes\n> > over two lines of text.\n> No.\nHm."),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotations.reply_ordered(table).collect()}
    assert [got[t]["reply_to"] for t in range(5)] == [None, None, 0, 2, 3]
    assert [got[t]["position"] for t in range(5)] == [0, 4, 1, 2, 3] and got[4]["thread"] == 0


def test_a_text_of_marks_has_no_language():
    profiles = language_id.Profiles({"aa": language_id.ngram_codes("abc abd").tolist()[:5]}, 5)
    for text in (None, "", "12 !?", "\u0301\u0302", "\u0483 1"):
        assert profiles.judge(text) == ("und", 0.0)
    assert profiles.judge("\u0301a")[0] == "aa"


# --- main text -------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now, cheap, good, today</div><div class="cookie-notice">We use cookies, and more, always</div>
<article><h1>Head&amp;line</h1><p>First, with   commas,\nand more.<p>Second<br>line &lt;b&gt; <a href="/x">link</a></p>
<ul><li>item</li></ul><form><p>Sign up, now, please</p></form><aside>Other, stories</aside></article>
<div id="comments"><p>Nice, really, nice, post</p></div><div class="sidebar"><p>Side, bar, text</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text_keeps_the_article_and_nothing_else(spark):
    expected = "Head&line\nFirst, with commas, and more.\nSecond line <b> link\nitem"
    assert main_text.main_text(PAGE) == expected
    rows = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", "<p", 0)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in main_text.extract(rows).collect()}
    assert got[1]["text"] == expected and got[1]["n_chars"] == len(expected)
    assert (got[2]["text"], got[2]["n_chars"], got[None]["text"], got[3]["text"]) == ("", 0, "", "")
    assert main_text.extract(rows.where("false")).count() == 0


def test_main_text_without_article_element():
    page = "<body><div class=menu><a href=1>one</a></div><div><div id=x>" + "<p>A sentence, with commas, and so on, long enough.</p>" * 4 + "<p>ok</p></div><div><a href=2>two, three, four</a></div></div></body>"
    assert main_text.main_text(page).split("\n") == ["A sentence, with commas, and so on, long enough."] * 4 + ["ok"]
    assert main_text.main_text("<p>" + "word, " * 200_000 + "</p>").count("word") == 200_000
    assert main_text.main_text("plain &amp; simple") == "plain & simple"
    deep = "<div>" * 20_000 + "<p>A sentence, with commas, in there.</p><nav>menu</nav>" + "</div>" * 20_000 + "</b>" * 20_000
    assert main_text.main_text(deep) == "A sentence, with commas, in there."


def test_main_text_keeps_paragraphs_beside_the_best_container():
    lead = "word, " * 20 + "and more words " * 192
    rest = "<p>" + "a, b, c, d, e, f, " * 10 + "</p>"
    page = f"<body><h1>Title</h1><p>{lead}</p><div>{rest * 20}</div><h3>More</h3><p><a href=1>A link of more than eighty characters, {'x' * 80}.</a></p><p>Last one.</p></body>"
    found = main_text.main_text(page).split("\n")
    assert found[:2] == ["Title", lead.strip()] and found[-1] == "Last one." and len(found) == 23


@pytest.mark.parametrize("levels", range(1, 5))
def test_main_text_keeps_every_section_of_nested_boxes(levels):
    """Sections in boxes in boxes, beside a menu without a name and an advert."""
    text = "A sentence of the section, with commas, and so on, that is long enough to be one. It goes on, too."
    menu = "<div>" + "".join(f'<p><a href="/{k}">link number {k}</a></p>' for k in range(12)) + "</div>"
    after = '<div class="sponsored-content"><p>' + text + "</p></div>"
    for n in range(1, 13):
        sections = "".join(
            "<div class=sec>" + "<div class=inner>" * (levels - 1) + f"<h2>Part {k}</h2><p>{text} {k}</p><p>{text}</p>" + "</div>" * levels
            for k in range(n)
        )
        for page in (sections, f"<div>{sections}</div>", f"<div><h1>Title</h1>{sections}</div>"):
            foot = "" if page is sections else after  # beside the sections it would be one of them
            found = main_text.main_text(f"<html><body>{menu}{page}{foot}</body></html>").split("\n")
            title = ["Title"] if "<h1>" in page else []
            assert found == title + [line for k in range(n) for line in (f"Part {k}", f"{text} {k}", text)], (n, page[:30])


def test_main_text_leaves_out_named_paragraphs_and_content_boxes():
    text = "A sentence of the article, with commas, and so on, that is long enough to be one."
    gone = [
        '<p class="advert">BUY NOW, it is cheap, and good.</p>', '<p class="cookie-notice">We use cookies, as all do.</p>', '<p class="comment">I, for one, agree.</p>',
        '<div class="sponsored-content"><p>Paid, by them.</p></div>', '<div class="ad-text"><p>An ad, here.</p></div>', '<div class="cookie-content"><p>Cookies, again.</p></div>',
        '<div class="alert"><p>An alert, here.</p></div>', '<section id="disclaimer"><p>No advice, at all.</p></section>', '<div class="reader-opinions"><p>I think, so.</p></div>',
        '<h3 class="related">Related, as they say</h3>',
    ]
    kept = ['<h1 class="header">Title</h1>', f'<div class="content no-sidebar"><p>{text}</p></div>', f'<div class="article-header"><p>{text}</p></div>']
    lines = ["Title", text, text]
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        page = open_ + kept[0] + "".join(k + g for k, g in zip(kept[1:], ("".join(gone[:5]), "".join(gone[5:])))) + close
        assert main_text.main_text(f"<body>{page}</body>").split("\n") == lines


def test_main_text_keeps_short_parts_of_a_split_article():
    long = "<section><h2>One</h2>" + "<p>Much, much, more, text, is, here, than, there.</p>" * 10 + "</section>"
    links = "<section><h2>See</h2><p><a href=1>Another story.</a></p></section>"
    page = f"<body><div>{long}<section><h2>Two</h2><p>It ended well.</p></section>{links}</div></body>"
    assert main_text.main_text(page).split("\n")[-2:] == ["Two", "It ended well."]


def test_end_tags_beyond_the_greatest_depth_close_nothing_else():
    deep = "<div>" * 600 + "<p>Deep down.</p><nav>menu</nav>" + "</div>" * 600
    page = f"<body><div id=x><p>Before, and, so, on, here.</p>{deep}<ul><li>one</li></ul></div></body>"
    before, down, one = main_text.parse(page)
    assert [x[1] for x in (before, down, one)] == ["Before, and, so, on, here.", "Deep down.", "one"]
    assert one[0].parent.parent is before[0].parent and before[0].parent.tag == "div"
    assert main_text.parse("<div>" * 100_000 + "</b>" * 100_000 + "x")[0][1] == "x"
    assert main_text.parse("<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000 + "x")[0][1] == "x"


# --- near dedup ------------------------------------------------------------


def brute_components(rows, size=5, num=75, den=100):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * inter >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(7)
    bases = [make_text(rng, n).split(" ") for n in (6, 12, 40, 90, 200, 300)]
    rows = []
    for base in bases:
        for _ in range(14):
            changed = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 20, len(base) // 10])):
                changed[rng.randrange(len(changed))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    passage = make_text(rng, 60)
    rows += [(len(rows) + i, make_text(rng, rng.choice([60, 150])) + " " + passage + " " + make_text(rng, 50)) for i in range(25)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one two", "One  two", "one two three"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), block_classes=block).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert all(by_id[d][0]["component_id"] == d and by_id[d][0]["n_shingles"] == 0 for d in (1, 2, 3, 10))
    assert by_id[None][0]["component_id"] == 6 and not by_id[None][0]["kept"]
    assert [r["kept"] for r in by_id[6]] == [True, True]
    assert by_id[5][0]["component_id"] == 4
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_overlap_bounds_hide_no_link():
    share = near_dedup.needed_overlap(64, (75, 100))
    below = sum(math.comb(64, t) * 0.75**t * 0.25 ** (64 - t) for t in range(share))
    assert below <= near_dedup.MISS < below + math.comb(64, share) * 0.75**share * 0.25 ** (64 - share)
    assert near_dedup.overlap_bounds(64, (75, 100))[4] == 3


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3)]
    got = components(spark.createDataFrame(path, "a long, b long"), "test").collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len(got) == len(roots) == 350
    assert all(roots[i] == (1 if i <= 300 else 1000) for i in roots)
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


# --- exact dedup -----------------------------------------------------------


@pytest.mark.parametrize("bits", [2, 63])
def test_exact_duplicates_with_and_without_chains(spark, bits):
    rng = random.Random(3)
    texts = [f"text {i}" for i in range(40)] + ["", None, "Text 1"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    got = {r["doc_id"]: r for r in exact_duplicates(docs(spark, rows), key_bits=bits, capacity=3).collect()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]))


def test_exact_duplicates_edges(spark):
    got = exact_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    same = [(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in got if r["doc_id"] in (None, 6)]
    assert sorted(same, key=str) == sorted([(None, 6, False, 3), (6, 6, True, 3), (6, 6, True, 3)], key=str)
    assert exact_duplicates(docs(spark, [(None, "a"), (None, "a")])).where("kept").count() == 2
    assert exact_duplicates(docs(spark, [])).count() == 0


def test_directory_doubles_only_where_it_must():
    assert directory({}, 4, 3) == [(0, 0)]
    assert directory({0: 5, 9: 1}, 4, 3) == [(0, 4), (1, 4), (2, 3), (4, 2), (8, 1)]


# --- language model --------------------------------------------------------


def brute_ppm(train, text, order):
    """log10 of a text's probability: escapes by distinct bytes, with exclusion, from raw counts."""
    counts = defaultdict(Counter)
    pad = b"\0" * order
    for raw in train:
        data = pad + raw + b"\0"
        for i in range(order, len(data)):
            for j in range(order + 1):
                counts[data[i - j : i]][data[i]] += 1
    total, data = 0.0, pad + text + b"\0"
    for i in range(order, len(data)):
        gone = set()
        for j in range(order, -1, -1):
            here = counts.get(data[i - j : i])
            if not here:
                continue
            rest = {s: c for s, c in here.items() if s not in gone}
            room = sum(rest.values()) + len(rest)
            if data[i] in rest:
                total += math.log10(rest[data[i]] / room)
                break
            if rest:
                total += math.log10(len(rest) / room)
            gone |= set(here)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_scores_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, make_text(rng, rng.choice([0, 3, 30]), 30)) for i in range(40)] + [(90, None), (91, "ÉTÉ zzz"), (92, "zzz zzz")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    train = [r for r in rows if r[0] % 3]
    got = {r["doc_id"]: r for r in ppm.score_texts(table, table.where("doc_id % 3 <> 0"), max_words=20).collect()}
    tokens = Counter()
    for _, t in train:
        tokens.update(words(t) + [None])
    n, v = sum(tokens.values()), len(tokens)
    raws = [(t or "").encode().lower() for _, t in train]
    for d, t in rows:
        mine = words(t) + [None]
        assert got[d]["n_tokens"] == len(mine) and got[d]["n_known"] == sum(tokens[w] > 0 for w in mine) and got[d]["train_tokens"] == n
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in mine))
        assert got[d]["score"] == pytest.approx(brute_ppm(raws, (t or "").encode().lower(), ppm.ORDER), rel=1e-9)


def test_probabilities_of_a_pruned_trie_sum_to_one(spark):
    rng = random.Random(6)
    table = spark.createDataFrame([(i, make_text(rng, 50, 60)) for i in range(20)], "doc_id long, text string")
    full = ppm.score_texts(table, table).agg(F.sum("score")).first()[0]
    pruned = ppm.score_texts(table, table, max_nodes=150, max_words=5)
    assert pruned.agg(F.sum("score")).first()[0] < full
    counts = Counter()
    for r in table.collect():
        data = b"\0" * ppm.ORDER + r["text"].encode() + b"\0"
        for j in range(ppm.ORDER + 1):
            counts.update((j, data[i - j : i + 1]) for i in range(ppm.ORDER, len(data)))
    total, kinds = Counter(), Counter()
    for (j, gram), n in counts.items():
        total[j, gram[:-1]] += n
        kinds[j, gram[:-1]] += 1
    kept = {k: n for k, n in counts.items() if n >= 20}
    nodes = []
    for j in range(ppm.ORDER + 1):
        level = [(int.from_bytes(g, "big"), n, total[j, g[:-1]], kinds[j, g[:-1]]) for (i, g), n in kept.items() if i == j]
        nodes.append(tuple(np.array(x, np.int64) for x in zip(*level)) if level else (np.zeros(0, np.int64),) * 4)
    trie = ppm.Trie(nodes)
    for context in (b"w1 w2", b"zzzzz", b"\0\0\0\0\0", b"5 w0 "):
        start = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log10(np.array([start | s for s in range(256)], np.uint64))).sum() == pytest.approx(1)


def test_scores_are_those_of_the_whole_model_at_any_size(spark):
    rng = random.Random(16)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(i, say(25_000)) for i in range(12)]
    new = [(20, say(300)), (21, rows[0][1][:200]), (22, ""), (23, "\u00e9\u00e9 zzz")]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(new, "doc_id long, text string")
    raws = [t.encode() for _, t in rows]
    assert sum(len({r[i : i + k] for r in raws for i in range(len(r) - k + 1)}) for k in range(1, 7)) > 500_000
    expected = {d: brute_ppm(raws, t.encode(), ppm.ORDER) for d, t in new}
    got = {r["doc_id"]: r["score"] for r in ppm.score_texts(asked, training).collect()}
    assert got == {d: pytest.approx(x, rel=1e-9) for d, x in expected.items()}
    assert {r["doc_id"]: r["score"] for r in ppm.score_texts(asked, training, cache_nodes=0).collect()} == {d: pytest.approx(x, rel=1e-9) for d, x in expected.items()}


def test_scores_edges(spark):
    table = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    assert ppm.score_texts(table, table).count() == len(AWKWARD)
    untrained = ppm.score_texts(table.where("doc_id = 4"), table.where("false")).first()
    assert untrained["score"] == pytest.approx(-4 * math.log10(256)) and untrained["n_known"] == 0 and untrained["base_score"] == 0
    assert ppm.score_texts(table.where("false"), table).count() == 0


# --- decontamination -------------------------------------------------------


def brute_contamination(rows, items, size=10):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = []
    for d, t in rows:
        w, hit, held = split(t), set(), set()
        for item, text in items:
            iw = split(text)
            width = min(size, len(iw))
            for s in range(len(iw) - width + 1) if iw else ():
                for p in range(len(w) - width + 1):
                    if w[p : p + width] == iw[s : s + width]:
                        hit.update(range(p, p + width))
                        held.add(item)
        found.append((d, len(w), len(hit), tuple(sorted(str(i) for i in held if i is not None))))
    return Counter(found)


@pytest.mark.parametrize("block_rows", [3, 200_000])
def test_contamination_equals_brute_force(spark, block_rows):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["the", "of", "Ä", "é", "x1", "foo", "BAR", "baz-qux", "rare%d" % rng.randrange(30)]) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(12, None), (13, " .. "), (3, "the of"), (None, "foo foo foo"), (14, "É é")]
    rows = []
    for i in range(40):
        parts = [say(rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randrange(len(w))
            parts += [" ".join(w[: cut + 12]).swapcase().replace("É", "é"), say(rng.randrange(5))]
        rows.append((i, ", ".join(parts)))
    rows += AWKWARD[:7] + [(50, "É é"), (51, "é É"), (52, "K of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs(spark, rows), bench, block_rows=block_rows).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_contamination(rows, items)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs(spark, []), bench).count() == 0
    assert contamination(docs(spark, [(1, "a b")]), bench.where("false")).first()["n_hit"] == 0


# --- packing ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


TRICKY = ["", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "I'll don't 12 3.5", "<|endoftext|> x", "é ü x", "tab\tx", "a\x1cb c", "日本語 text", "x" * 5000, "\r\n a\r\nb"]


def test_token_ids_equal_the_library(tokenizer):
    path, library = tokenizer
    for memo in (2, 100_000):
        encode = packing.ByteBpeEncoder(path, memo_words=memo)
        rng = random.Random(2)
        for text in TRICKY + ["".join(rng.choice("ab .,'\n 1é\t") for _ in range(60)) for _ in range(300)]:
            assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_whole_and_tight(spark, tokenizer):
    path, library = tokenizer
    rng = random.Random(4)
    rows = [(i, make_text(rng, rng.choice([5, 50, 200, 400]))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(TRICKY)] + [(None, None), (500, "again")]
    rows.append((900, make_text(rng, 3000)))
    packed = packing.pack(docs(spark, rows), path, block_pieces=64).collect()
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
    expected = Counter()
    for d, texts in ids.items():
        for tokens in texts:
            for k, (at, n) in enumerate(packing.cut(len(tokens), 2048)):
                expected[d, k, at, n, zlib.crc32(np.array(tokens[at : at + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(r["length"] for r in packed)
    assert len(bins) <= math.ceil(total / 2048) + 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_cut_lets_the_first_piece_be_short():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_evolution_keeps_every_piece_and_never_gets_worse():
    rng = random.Random(8)
    lengths = [rng.randrange(1, 90) for _ in range(300)]
    packer = packing.Packer(lengths, 100, seed=1)
    start = [[p] for p in range(300)]
    best = packer.evolve([start], 4, 40)
    assert sorted(p for b in best for p in b) == list(range(300))
    assert all(packer.load(b) <= 100 for b in best)
    assert packer.fitness(best) >= packer.fitness(packer.best_fit([], packer.decreasing(list(range(300)))))


def brute_best_fit(lengths, capacity):
    """The bins of best-fit decreasing, piece by piece, looking at every bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


SHAPES = {
    "uniform": lambda rng: rng.randrange(1, 2048),
    "thirds": lambda rng: rng.randrange(650, 720),
    "over_half": lambda rng: rng.randrange(1030, 1200),
    "one_length": lambda rng: 700 if rng.random() < 0.6 else rng.randrange(1, 60),
    "short": lambda rng: rng.randrange(1, 40),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_best_fit_by_length_equals_piece_by_piece(shape):
    rng = random.Random(shape)
    lengths = sorted((SHAPES[shape](rng) for _ in range(900)), reverse=True)
    runs, n_bins = packing.best_fit_decreasing(Counter(lengths), 2048)
    loads = Counter()
    for (start, first, per_bin), end in zip(runs.tolist(), [*runs[1:, 0].tolist(), len(lengths)]):
        for place in range(start, end):
            loads[first + (place - start) // per_bin] += lengths[place]
    assert sorted(2048 - n for n in loads.values()) == sorted(brute_best_fit(lengths, 2048)) and n_bins == len(loads)
    assert packing.best_fit_decreasing({}, 2048)[1] == 0


@pytest.mark.parametrize("shape", SHAPES)
def test_never_more_sequences_than_best_fit_decreasing_over_all(spark, monkeypatch, shape):
    rng = random.Random(shape)
    lengths = [SHAPES[shape](rng) for _ in range(3000)]
    frame = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "tokenised_pieces", lambda *_: frame)
    packed = packing.pack(docs(spark, []), "", block_pieces=512).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(3000))
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    best_fit = len(brute_best_fit(lengths, 2048))
    print(shape, len(ends), best_fit, math.ceil(sum(lengths) / 2048))
    assert len(ends) <= best_fit
    if shape == "thirds":  # three to a bin at best, where best fit leaves room for generations to find
        assert len(ends) < best_fit


# --- line runs -------------------------------------------------------------


def brute_runs(rows, min_words):
    seqs = {d: (t or "").split("\n") for d, t in rows}
    size = {d: [len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in lines] for d, lines in seqs.items()}
    starts = [(d, i) for d in sorted(seqs, key=lambda d: (d is not None, d or 0)) for i in range(len(seqs[d]))]
    gone = {d: set() for d in seqs}
    for a, (d, i) in enumerate(starts):
        best = 0
        for e, j in starts[:a]:
            n = 0
            while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n] == seqs[e][j + n]:
                n += 1
            best = max(best, n)
        if best and sum(size[d][i : i + best]) >= min_words:
            gone[d].update(range(i, i + best))
    return {d: ("\n".join(x for k, x in enumerate(lines) if k not in gone[d]), len(lines), len(gone[d])) for d, lines in seqs.items()}


def test_results_replace_clashing_columns_and_others_are_passed_on(spark):
    names = ["N_TOKENS", "score", "n_common", "score_cached", "unseen", "row_number_", "passed_0", "__doc", "__h", "__spans", "__whole", "__lines", "__removed"]
    table = docs(spark, [(k, "a b c\nd e f" if k < 3 else "x y") for k in range(5)])
    clashing = table.select("doc_id", "text", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    by_id = lambda frame: {r["doc_id"]: r.asDict() for r in frame.collect()}
    scored, plain = by_id(ppm.score_texts(clashing, table)), by_id(ppm.score_texts(table.select("doc_id", "text"), table))
    cleaned, bare = by_id(line_runs.remove_repeated_runs(clashing, min_words=2)), by_id(line_runs.remove_repeated_runs(table.select("doc_id", "text"), min_words=2))
    for k in range(5):
        passed = {n: f"{n}{k}" for n in names}
        assert scored[k] == {**{n: v for n, v in passed.items() if n not in ("N_TOKENS", "score")}, **plain[k]}
        assert cleaned[k] == {**passed, **bare[k]}


@pytest.mark.parametrize("share", [3, 50])
def test_repeated_runs_with_split_hot_lines(spark, monkeypatch, share):
    monkeypatch.setattr(line_runs, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_runs, "HOT_SHARE", share)
    rng = random.Random(share)
    rows = [(d, "\n".join(rng.choice(["a b", "a b", "a b", "c", "d e f", "g h"]) for _ in range(rng.choice([1, 3, 9])))) for d in range(10)]
    rows += [(10 + d, rows[3][1]) for d in range(6)]
    got = {r["doc_id"]: (r["text"], r["__lines"], r["__removed"]) for r in line_runs.remove_repeated_runs(docs(spark, rows).drop("__lines"), min_words=5).collect()}
    assert got == brute_runs(rows, 5)


@pytest.mark.parametrize("seed,kinds,min_words", [(1, 2, 4), (2, 3, 9), (3, 6, 1)])
def test_repeated_runs_equal_brute_force(spark, seed, kinds, min_words):
    rng = random.Random(seed)
    alphabet = ["a b", "c", "d e f", "", "g  h\ti", "x y z w"][:kinds]
    rows = [(d, "\n".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 9, 17])))) for d in range(12)]
    rows += [(12, rows[3][1]), (13, rows[5][1] + "\n" + rows[6][1]), (None, rows[8][1])]
    got = {r["doc_id"]: (r["text"], r["__lines"], r["__removed"]) for r in line_runs.remove_repeated_runs(docs(spark, rows).drop("__lines"), min_words=min_words).collect()}
    assert got == brute_runs(rows, min_words)


def test_repeated_runs_edges(spark):
    table = docs(spark, AWKWARD).drop("__lines")
    got = line_runs.remove_repeated_runs(table, min_words=3).collect()
    assert len(got) == len(AWKWARD)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["text"], r["__lines"], r["__removed"]))
    assert by_id[1] == [(None, 1, 0)] and by_id[10] == [("\n\n\n", 4, 0)]
    assert by_id[None] == [("a b c d e f g", 1, 0)] and by_id[6] == [("", 1, 1)] * 2
    assert got[0].asDict().keys() == {"doc_id", "text", "kept", "row_key", "words", "__lines", "__removed"}
    assert line_runs.remove_repeated_runs(docs(spark, []).drop("__lines")).count() == 0


# --- URL filter ------------------------------------------------------------

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def brute_url(url):
    after = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in RULES:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    return host, path, best


def brute_ratio(urls, weights, order):
    """A function of a URL: its score by interpolated counts, straight from the definition."""
    counts = {k: defaultdict(Counter) for k in ("allow", "block")}
    for u, label in zip(urls, weights):
        padded = url_markov.PAD * order + u + url_markov.END
        for i in range(order, len(padded)):
            for j in range(order + 1):
                if label:
                    counts[label][padded[i - j : i]][padded[i]] += 1

    def p(label, context, ch):
        low = p(label, context[1:], ch) if context else 1 / url_markov.ALPHABET
        here = counts[label].get(context)
        return (here[ch] + len(here) * low) / (sum(here.values()) + len(here)) if here else low

    def score(u):
        padded = url_markov.PAD * order + u + url_markov.END
        parts = [(padded[i - order : i], padded[i]) for i in range(order, len(padded))]
        return sum(math.log10(p("allow", c, ch) / p("block", c, ch)) for c, ch in parts) / len(parts)

    return score


def test_urls_are_judged_as_by_brute_force(spark):
    rng = random.Random(9)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}{rng.choice(['example', 'adult', 'news'])}.{rng.choice(['com', 'net', 'org', 'COM'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?q=/en/', '#x'])}" for _ in range(150)]
    urls += [None, "", "no scheme", "http://example.com", "http://xcom/en/", "http://a.net/es/1", "//x", "http://", "ftp://Example.Com/en/é"] + [urls[0]] * 30
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_markov.judge_urls(table, RULES).collect()}
    assert len(got) == len(urls)
    parsed = [brute_url(u) for u in urls]
    score = brute_ratio([h + p for h, p, _ in parsed], [b and b[1] for _, _, b in parsed], 4)
    means = {k: np.mean([score(h + p) for h, p, b in parsed if b and b[1] == k]) for k in ("allow", "block")}
    threshold = (means["allow"] + means["block"]) / 2
    for i, (host, path, best) in enumerate(parsed):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        if best:
            assert r["verdict"] == best[1]
        else:
            value = score(host + path)
            assert r["score"] / url_markov.UNIT == pytest.approx(value, abs=1e-5)
            if abs(value - threshold) > 1e-5:
                assert r["verdict"] == ("block" if value < threshold else "allow")


def test_urls_without_examples_are_allowed(spark):
    table = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_markov.judge_urls(table, RULES).collect()] == ["allow", "allow"]
    assert url_markov.judge_urls(table.where("false"), RULES).count() == 0
