"""Lexical search against plain Python; main text of pages against pages written around a known text."""

import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import html_extract as H
from assaykit.llm import lexical_search as L
from assaykit.llm.scratch import Scratch

DOCS, ITEMS = "doc_id bigint, text string, score string", "item_id string, text string, rank int"


def terms(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def ranked(docs, items, k):
    tokens = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tokens), sum(sum(c.values()) for _, c in tokens)
    df = Counter(t for _, c in tokens for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tokens:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "日本", "x" * 300, "The", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 60, 400]))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)]  # ties
    docs += [(None, docs[7][1]), (5, docs[7][1]), (5, docs[7][1]), (-3, docs[7][1]), (2001, None), (2002, ""), (2003, " .,;"), (2004, text(60_000))]
    items = [(f"q{i}", text(rng.choice([1, 5, 30]))) for i in range(40)]
    items += [("copy", docs[7][1]), ("twice", "w3 w3 W3"), ("none", None), ("empty", "?"), ("absent", "zzz"), (None, "w1 w2"), ("copy", docs[7][1])]
    return docs, items


@pytest.mark.parametrize("shard_bytes, block_docs, query_bytes, k", [(4 << 20, 32, 1 << 20, 10), (3000, 4, 1 << 20, 10), (20_000, 1, 1500, 3)])
def test_search_equals_plain_ranking(spark, corpus, shard_bytes, block_docs, query_bytes, k):
    docs, items = corpus
    d = spark.createDataFrame([(a, t, "x") for a, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(a, t, 1) for a, t in items], ITEMS)
    got = L.lexical_search(d, q, k, query_bytes, shard_bytes, block_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(docs, items, k)


def test_search_prunes_blocks(spark, corpus, monkeypatch):
    """Few blocks are scored once the threshold of an item is known."""
    rng = random.Random(1)
    docs = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(30))) for i in range(2000)]
    scratch = Scratch(spark)
    index = L.build_index(spark.createDataFrame(docs, "doc_id int, text string").coalesce(1), scratch, 1 << 20, 10)
    row = index.table.first().asDict()
    text = docs[77][1]
    words = L._terms(pa.array([text.encode()], pa.binary()))
    vocabulary, at = np.unique(words.hash, return_inverse=True)
    q = L.Queries(["a"], np.array([0, len(vocabulary)]), np.arange(len(vocabulary)), np.bincount(at), vocabulary)
    shard = L._Shard(row, vocabulary)
    df = np.zeros(len(vocabulary), np.int64)
    df[shard.number[shard.number >= 0]] = shard.df[shard.number >= 0]
    c = q.weighted(df, index.n_docs)
    ((_, bound),) = shard.bounds(q, c)
    every = np.concatenate([shard.scores(b, q, c, 0) for b in range(shard.n_blocks)])
    assert (bound[0] >= every.reshape(-1, 10).max(axis=1)).all()
    tenth = np.sort(every)[-10]
    assert (bound[0] >= tenth).sum() < shard.n_blocks / 2


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "b", 1)], ITEMS)
    assert L.lexical_search(docs, items).collect() == []
    assert L.lexical_search(spark.createDataFrame([(1, "b", "")], DOCS), items.limit(0)).collect() == []
    with pytest.raises(TypeError):
        L.lexical_search(spark.createDataFrame([("a", "b")], "doc_id string, text string"), items)
    with pytest.raises(ValueError):
        L.lexical_search(docs, items, 0)


PROSE = "The history of the town is long and it was written down by those who came to live there in the years of the great flood, and by the people they met on the way to it."
LONG = " ".join([PROSE, PROSE.replace("town", "valley")])


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title of it</title><style>p{{margin:0}}</style><script>var a='</p><p>the of and';</script>{head}</head><body class='has-sidebar'>{body}</body></html>"


NOISE_BEFORE = (
    "<header class='top'><p>The name of the site and what it is for</p></header><nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(5)) + "</ul></nav>"
    f"<div class='cookie-notice'><p>{PROSE}</p></div><!-- {PROSE} --><div class=ad>{PROSE}</div>"
)
NOISE_AFTER = (
    f"<aside><p>{PROSE}</p></aside><div id='sidebar-left'><p>{PROSE}</p></div><form><p>{PROSE}</p><select><option>one</option></select></form>"
    f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{LONG}</p></article></section><div class='userComments'>{PROSE}</div>"
    f"<div role='dialog'>{PROSE}</div><p hidden>{PROSE}</p><noscript>{PROSE}</noscript><footer>&copy; 2020 <a href='/'>the site</a> {PROSE}</footer>"
)


def test_marked_article():
    article = f"<article class='post-with-sidebar'><header><h1>A  title &amp;\n more</h1></header><p>{PROSE}</p><p>Short.</p><p>So <b>bo</b>ld<br>yes&nbsp;no <span class='ad'>buy</span>now</p><ul><li>one<li>two</ul><p><a href='x'>A link</a></p>"
    article += "<ul><li><a href=1>See this</a></li><li><a href=2>See that</a></li><li><a href=3>And that</a></li></ul><table><tr><td>a<td>b</table><footer>By the author</footer></article>"
    want = f"A title & more {PROSE} Short. So bold yes no now one two A link a b"
    assert H.extract([page(NOISE_BEFORE + article + NOISE_AFTER)]) == [want]
    assert H.extract([page(f"<form id=all>{article}</form>"), page(f"<div class='ad'>{PROSE}{article}")]) == [want, want]
    assert H.extract([page(f"<article class='post comments-open hasAds sharing-disabled'>{PROSE}<p class='comments-link'>3 comments</p></article>")]) == [PROSE]
    assert H.extract([page(f"<div role='main'><p>{PROSE}</p></div><div>{LONG}</div>")]) == [PROSE]


def test_rules_without_a_marked_article():
    body = f"<div class='text'><h2>Of the town</h2><p>{LONG}</p><p>Short one.</p><p>{PROSE}</p><p>{LONG}</p></div>"
    links = "<div>" + " ".join(f"<a href='{i}'>Story number {i}</a>" for i in range(12)) + "</div>"
    low = "<div>Opening 9-17 phone 555 1234 fax 555 1235 street 12 postal code 1000 city 44 room 12 floor 3 door 7 bell 12 lift 4 car park 3 zone 7</div>"
    got = H.extract([page(NOISE_BEFORE + links + body + low + "<p>tiny</p>" + links + NOISE_AFTER)])
    assert got == [f"Of the town {LONG} Short one. {PROSE} {LONG}"]
    assert H.extract([page("<p>Only a few words.</p>"), "plain text &lt;b&gt;", None, "", "<p>", "<div></div>"]) == ["Only a few words.", "plain text <b>", "", "", "", ""]


def test_short_blocks_go_with_their_container():
    """Headings and last lines beside unmarked menus, and pages in a language without known stop words."""
    menu = "<div>" + " ".join(f"<a href='{i}'>Entry {i}</a>" for i in range(9)) + "</div>"
    text = f"<div><h1>Heading</h1><h2>Second</h2><p>{LONG}</p><p>End.</p></div>"
    assert H.extract([page(menu + text + menu)]) == [f"Heading Second {LONG} End."]
    foreign = " ".join(f"sana{i}" for i in range(40))
    assert H.extract([page(f"{menu}<div><p>{foreign}</p><p>loppu</p></div>{menu}"), page(f"<div>{LONG}</div><div>{foreign}</div>")]) == [f"{foreign} loppu", LONG]


def test_second_pass_takes_the_nearest():
    p = H.ExtractParams()
    lengths = np.array([300, 10, 10, 300, 10, 300, 100, 300, 10, 100])
    stops = np.array([0.5, 0, 0, 0.1, 0, 0.5, 0.4, 0.1, 0, 0.4])
    page_no = np.array([0] * 8 + [1, 1])
    n = np.zeros(10, int)
    got = H.judge(page_no, lengths, n, n, n > 0, stops, np.zeros(10, bool), p)
    assert got.tolist() == [True, True, False, False, True, True, True, False, True, True]
    assert H.judge(np.array([0, 0, 0]), np.array([300, 10, 300]), np.zeros(3, int), np.zeros(3, int), np.zeros(3, bool), np.array([0.5, 0, 0]), np.zeros(3, bool), p).tolist() == [True, False, False]


def test_pages_as_rows(spark):
    rows = [(1, "u", page(f"<article>{PROSE}</article>"), "x"), (1, "u", page(f"<article>{PROSE}</article>"), "x"), (None, None, None, None), (2, "é", "<article>日本 &eacute;&#x1F600;</article>", "y"), (3, "", "", "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = H.html_extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, "é", "日本 é😀", 5), (3, "", "", 0)], key=repr)
    assert H.html_extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["<a <a ", "<!-- ", "<script>", "<p title='", '<b x="', "<i>", "</b>", "<div></p></i>", "<i></b>", "<", "&amp", "<div class=ad>", "<ul><li><b>", "</", "<a href=x>t</a>"])
def test_pages_are_read_in_linear_time(piece):
    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        H.extract(["<div><i>" + piece * (n // len(piece))])
        took.append(time.process_time() - began)
    assert took[1] < 15 * max(took[0], 0.02)


def test_random_text_survives():
    rng = random.Random(9)
    for _ in range(200):
        paragraphs = [" ".join("".join(rng.choices("abcé<>&\"'ß", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{html.escape(x)}</p>" for x in paragraphs)
        assert H.extract([page(f"{NOISE_BEFORE}<article>{body}</article>{NOISE_AFTER}")]) == [" ".join(paragraphs)]
