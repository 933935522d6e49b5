"""Template deduction against a plain Python version, on hosts whose elements and class names tell nothing."""

import collections
import random

import pytest

from loomspan.llm import html_extraction as H
from loomspan.llm.common import table

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def site(host, pages, seed, kind):
    """(page_id, url, html) of a host and the text of each page."""
    rng, rows, want = random.Random(seed), [], {}
    for i in range(pages):
        title, story = words(rng, 5), [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        teaser = words(rng, 4)
        paragraphs = "".join(f"<p>{p}</p>" for p in story)
        aside = "<div class='q7'><p>Read all about it</p></div>" if i % 4 else ""
        if kind == "divs":
            body = f"<div class='x2'><h1>{title}</h1><div class='x3'>{paragraphs}</div></div>{aside}<div class='x4'><p>{teaser}</p></div>"
        elif kind == "cards":
            body = f"<div class='x2' id='post-{i}'><h2>{title}</h2>{paragraphs}</div>" + (f"<article class='card'>{teaser}</article>" if i % 2 else "")
        else:
            body = f"<form id='all' action='/'><div class='x2'><h1>{title}</h1>{paragraphs}</div><div class='x4'><span>{teaser}</span></div></form>"
        key = seed * 1000 + i
        html = f"<html><body><div class='x1'><p>First line of all pages</p><p>Second</p></div>{body}<div class='x5'><p>The same words on all pages, and quite a few of them as well</p></div></body></html>"
        rows.append((key, f"https://{host}/{i}", html))
        want[key] = "\n".join([title, *story])
    return rows, want


@pytest.mark.parametrize("kind", ["divs", "cards", "form"])
def test_slots_give_the_text(spark, kind):
    rows, want = site(f"{kind}.example", 12, len(kind), kind)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == want
    # without the template the constant blocks and teasers are taken for text
    assert all(H._extract(html, None) != want[i] for i, _, html in rows if kind != "cards" or not i % 2)


def slow_classes(pages):
    """Valid equivalence classes of one host's pages, as sets of codes."""
    found = [list(H._coded(p)) for p in pages]
    counts = collections.defaultdict(lambda: [0] * len(pages))
    for k, tokens in enumerate(found):
        for code, *_ in tokens:
            counts[code][k] += 1
    groups = collections.defaultdict(set)
    for code, vector in counts.items():
        if sum(map(bool, vector)) >= max(2, 0.5 * len(pages)):
            groups[tuple(vector)].add(code)
    valid = []
    for codes in groups.values():
        orders = {tuple(o) for tokens in found if (o := dict.fromkeys(t[0] for t in tokens if t[0] in codes))}
        if len(orders) == 1:
            valid.append(frozenset(codes))
    return set(valid)


def test_classes_are_brute_force(spark):
    fixture = site("divs.example", 9, 5, "divs")[0] + site("cards.example", 8, 6, "cards")[0]
    both = spark.createDataFrame(fixture, "page_id long, url string, html string").unionByName(table(spark, SF, "pages").select("page_id", "url", "html"))
    rows = both.withColumn("host", H.host_of(both["url"]))
    signs = rows.where("host is not null").selectExpr("page_id page", "host", "html").mapInArrow(H._signatures, f"page long, host string, {H.SIGNS}")
    got = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in H.classes(signs).collect():
        got[r["host"]][r["class"]].add(r["code"])
    pages = collections.defaultdict(list)
    for r in rows.collect():
        pages[r["host"]].append(r["html"])
    large = {h: p for h, p in pages.items() if h and len(p) >= 3}
    assert len(large) > 3 and set(got) <= set(large)
    for host, texts in large.items():
        assert {frozenset(c) for c in got[host].values()} == slow_classes(texts), host


def test_nesting():
    # class 1: a .. b .. c; class 2 (d, e) always behind a; class 3 (f) behind either of two
    order = [(10, 1), (20, 2), (21, 2), (11, 1), (30, 3), (12, 1)]
    assert H.nest(order, {1: {0}, 2: {10}, 3: {10, 11}}) == {10: 10, 20: 20, 21: 10, 11: 11, 30: 30, 12: 12}


def test_broken_tags_and_constant_lines(spark):
    assert H._extract("<article><p title=it's>first</p><p>se<b>co</b>nd</p><p data-x='a>b'>third</p></article>", None) == "first\nsecond\nthird"
    assert H._extract("<body><form class=search><p>find</p></form><p>text</p></body>", None) == "text"
    rng = random.Random(4)
    rows = [(i, f"https://c.example/{i}", f"<article><h1>{words(rng, 4)}</h1><p>Follow us on all channels</p><p>{words(rng, 30)}</p></article>") for i in range(12)]
    copies = [(100 + i, f"https://d.example/{i}", "<article><p>one text</p><p>on all pages</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert all("Follow us" not in got[i] and got[i].count("\n") == 1 for i in range(12))
    assert all(got[100 + i] == "one text\non all pages" for i in range(12))
