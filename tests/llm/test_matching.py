"""Neighbours, URL rules, main text and near-duplicates against plain models."""

import random

import numpy as np
import pytest

import brute
import oracle_check
from flightline.llm import html, near_dedup, neighbours, queries, urls

VECTORS = "vec_id long, embedding array<float>, score string"


def brute_neighbours(ids, vectors, query, k):
    """Nearest candidates of position ``query``; equal rows count once."""
    seen, ranked = set(), []
    for i, v in zip(ids, vectors, strict=True):
        if i != ids[query] and (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            score = float(neighbours.exact_scores(vectors[query][None], v[None])[0])
            ranked.append((-score, i))
    return [(i, -s) for s, i in sorted(ranked)[:k]]


@pytest.mark.parametrize("relaxation, recall", [(1.0, 1.0), (1.05, 0.9)])
def test_neighbours_recall(spark, relaxation, recall):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((40, 8))
    vectors = (centres[draw.integers(0, 40, 3_000)] + 0.3 * draw.standard_normal((3_000, 8))).astype(np.float32)
    vectors[::7] = vectors[0]
    table = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in enumerate(vectors)], VECTORS)
    found = {}
    for r in neighbours.nearest(table, lambda i: i % 50 == 0, k=5, relaxation=relaxation).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits, wide = 0, vectors.astype(float)
    for q in range(0, 3_000, 50):
        want = brute_neighbours(np.arange(3_000), wide, q, 5)
        got = sorted(found[q])
        assert [rank for rank, _, _ in got] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in want} & {i for _, i, _ in got})
        if relaxation == 1.0:
            assert [(i, s) for _, i, s in got] == want
    assert hits >= recall * 5 * 60


def test_neighbours_tied_in_one_direction(spark):
    """Many different vectors of one direction: exact scores, then smaller ids, decide."""
    draw = np.random.default_rng(6)
    scales = np.concatenate([2.0 ** draw.integers(-9, 9, 300), draw.permutation(np.arange(1, 301))])
    vectors = draw.permutation(scales)[:, None] * np.array([[1.0, 2.0, 3.0]])
    vectors[::3, 0] *= -1
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], VECTORS)
    found = {}
    for r in neighbours.nearest(table, lambda i: i % 50 == 0, k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 600, 50):
        assert [(i, s) for _, i, s in sorted(found[q])] == brute_neighbours(np.arange(600), vectors, q, 5)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]),
        (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []),
        (50, [1.0, 0.0, 0.0]), (100, None), (150, [5.0]),
    ]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table, lambda i: i % 50 == 0).collect())
    # The smaller vector of id 0 asks; a repeated row counts once; ties go to the smaller id.
    assert found == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (50, 1, 8, 1.0)]
    assert neighbours.nearest(table.limit(0), lambda i: i % 50 == 0).collect() == []


def test_queries_equal_their_oracles(spark, sf_dir):
    con = oracle_check.connect(sf_dir)
    for name, sql in queries.ORACLES.items():
        text, ok = oracle_check.compare(spark, con, sf_dir, name, queries.QUERIES[name], sql)
        assert ok, text


def test_url_rules_and_odd_rows(spark):
    rows = [
        (1, "http://WWW.Example.ORG/es/x?q"), (2, "https://example.org/en/123#f"), (3, "https://a.org"), (4, None),
        (5, "no scheme /es/"), (5, "no scheme /es/"), (6, "x://notexample.org/es/"), (7, "http://fr.com/fr/"), (None, "http://b.com/de/"),
        (8, "http://com/de/"), (9, "http:///es/"), (10, "a://b://c.org/es/"), (11, ""), (12, "http://ÉX.ORG/\n"),
    ]
    table = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, rule string, host string")
    found = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge_urls(table, queries.URL_RULES).collect()}
    assert urls.judge_urls(table, queries.URL_RULES).count() == len(rows)
    assert found == {
        (1, "www.example.org", "/es/x"): ("example.org/es/", "block"),
        (2, "example.org", "/en/123"): ("example.org/en/1", "block"),
        (3, "a.org", ""): (None, "allow"),
        (4, "", ""): (None, "allow"),
        (5, "", ""): (None, "allow"),
        (6, "notexample.org", "/es/"): ("org/", "allow"),
        (7, "fr.com", "/fr/"): ("com/fr/", "allow"),
        (None, "b.com", "/de/"): ("com/de/", "block"),
        (8, "com", "/de/"): ("com/de/", "block"),
        (9, "", "/es/"): (None, "allow"),
        (10, "b:", "//c.org/es/"): (None, "allow"),
        (11, "", ""): (None, "allow"),
        (12, "Éx.org", "/\n"): ("org/", "allow"),
    }
    assert urls.judge_urls(table.limit(0), queries.URL_RULES).collect() == []


ARTICLE = "One <b>long</b> paragraph of the story &amp; more of it, with   white\nspace and a <a href='/x'>link</a> in it."
PAGES = [
    (None, ""),
    ("", ""),
    ("<<<>>> < a", ""),
    (
        f"<head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><header>Site</header><nav><a href='/'>Home</a></nav>"
        f"<div class='ad'>Buy this now because it is cheap</div><article><h1>Title</h1><p>{ARTICLE}<p>Short.<br>Yes."
        "<script>var t = '</p>';</script><!-- <p>hidden</p> --></article><aside>More stories for you to read on this site</aside>"
        "<div id='comments'><p>I like this story very much, thank you for it</p></div><form><label>Name</label></form><footer>&copy; x</footer>",
        "Title\n\nOne long paragraph of the story & more of it, with white space and a link in it.\n\nShort. Yes.",
    ),
    ("<article><p>unclosed <b>bold<p>next<!-- open", "unclosed bold\n\nnext"),
]


def test_main_text_of_pages(spark):
    rows = [(k, None, page, "clash") for k, (page, _) in enumerate(PAGES)] * 2 + [(None, "u", PAGES[3][0], "c")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract_text(table).collect()
    assert [(r.page_id, r.text) for r in found[: len(PAGES)]] == [(k, want) for k, (_, want) in enumerate(PAGES)]
    assert found[-1].text == PAGES[3][1] and len(found) == len(rows)
    assert html.extract_text(table.limit(0)).collect() == []
    assert html.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000


@pytest.mark.parametrize(
    "before, after",
    [
        ("<html><head><title>x</title><meta charset=a>stray<body>", ""),
        ("<head><title>x</title>", ""),
        *[(f"<div><{tag}>Go on</div>", "") for tag in ("button", "select", "object", "canvas", "svg", "template", "noscript")],
        ("<body><button>Go", "<button>Stop</button>"),
        ("<div><object>a<object><p>b</p></object><p>c</p></object></div>", ""),
    ],
)
def test_main_text_after_tags_left_open(before, after):
    article = f"<article><h1>Title</h1><p>{ARTICLE}</p><p>See <button>this</button> too.</p></article>"
    assert html.main_text(before + article + after) == html.main_text(article) != ""


def test_article_blocks_of_the_page_table(spark, sf_dir):
    """Pages hold one article; every word inside it is main text, nothing outside is."""
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = html.blocks_of(row.html[row.html.index("<article>") : row.html.index("</article>")])
        assert html.main_text(row.html) == "\n\n".join(b.text for b in inside)


def test_near_duplicates_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_components(documents, rows)


def check_components(table, rows):
    want, sizes = brute.components(rows)
    found = near_dedup.near_duplicates(table).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {
        (i, sizes[i], want[i], want[i] == i) for i, _ in rows
    }


def test_chains_borders_and_hot_groups(spark):
    """Chains of near copies, pairs close to the border, a passage most rows share, exact copies."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(draw.choice([12, 40, 90, 300]))]
        for _ in range(15):
            texts.append(" ".join(base))
            for _ in range(draw.choice([1, 1, 2, len(base) // 30 + 1])):
                base[draw.randrange(len(base))] = word()
    texts += [passage + " " + " ".join(word() for _ in range(draw.choice([3, 8, 15, 40]))) for _ in range(60)]
    texts += [texts[3]] * 25 + ["short text", "short text", "Short  TEXT", "other", "", None]
    draw.shuffle(texts)
    rows = list(enumerate(texts, 100))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_lists_compared_in_blocks(spark, monkeypatch):
    """The block comparison alone, with blocks of three rows, finds what the join finds."""
    monkeypatch.setattr(near_dedup, "PAIRS_JOINED", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 1)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (40, 120, 500):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(0, size // 14)):
                copy[draw.randrange(size)] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_link_cut_and_extended_texts(spark, monkeypatch):
    """Pairs of long texts of which one is the other cut down, close to the border, by blocks alone."""
    monkeypatch.setattr(near_dedup, "PAIRS_JOINED", 0)
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 0)
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = []
    for k in range(40):
        whole = [word() for _ in range(draw.choice([360, 600, 1_000]))]
        share = (0.73, 0.755, 0.76, 0.77)[k % 4]
        texts += [" ".join(whole), " ".join(whole[: int(share * len(whole)) + 4])]
    rows = list(enumerate(texts))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_common_values_of_the_union_sketch():
    draw = np.random.default_rng(3)
    for n, m in ((300, 300), (256, 40), (1, 1), (0, 5), (900, 700)):
        left, right = (np.unique(draw.integers(0, 1_200, k))[: near_dedup.WIDE] for k in (n, m))
        union = np.union1d(left, right)[: near_dedup.WIDE]
        assert near_dedup._common_in_union(left, right) == len(set(union) & set(left) & set(right))


def test_near_duplicates_odd_rows(odd, nothing):
    found = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=repr)
    _, sizes = brute.components({(r.doc_id or -1): r.text for r in odd.collect()}.items())
    want = [(i, sizes[i], None if i == -1 else i, True) for i in (1, 2, 3, 4, 5, 6, 6, -1)]
    assert found == sorted(want, key=repr)
    assert near_dedup.near_duplicates(nothing).collect() == []
