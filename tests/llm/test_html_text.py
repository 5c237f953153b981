"""Template deduction against brute force over small hosts, and pages without telling names."""

import os
import random
from collections import Counter, defaultdict

from llm_fixtures import DATA
from pyspark.sql import functions as F

from dealflux.llm import html_text as H

SCHEMA = "page_id long, url string, html string"


def random_page(rng):
    boxes = ["<div class='a'>{}</div>", "<div>{}</div>", "<section id='s1'>{}</section>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>"]
    parts = [rng.choice(boxes).format(rng.choice(["one", "two", "three", f"own {rng.random()}"])) for _ in range(rng.randrange(6))]
    return f"<html><body>{''.join(parts)}</body></html>"


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(h, n, random_page(rng)) for h in range(12) for n in range(1 + h)]
    df = spark.createDataFrame([(h, 100 * h + n, p) for h, n, p in rows], "host long, page long, html string")
    tokens = H.page_tokens(df.unionByName(df.limit(20)))  # repeated rows are one page
    assert tokens.count() == len(rows)
    got = defaultdict(set)
    for r in H.classes(tokens).collect():
        got[r["host"], r["class"]].add(r["token"])
    on, want = defaultdict(set), defaultdict(set)
    for h, n, p in rows:
        found = [t[0] for t in H.Page(p).tokens()]
        assert len(found) == len(set(found))
        for t in found:
            on[h, t].add(n)
    for (h, t), pages in on.items():
        if len(pages) > 1:
            want[h, frozenset(pages)].add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_slots_hold_every_other_block_once(spark):
    rng = random.Random(9)
    pages = [(h, 100 * h + n, random_page(rng)) for h in range(6) for n in range(1 + 2 * h)]
    df = spark.createDataFrame(pages, "host long, page long, html string")
    tokens = H.page_tokens(df)
    fixed = {(r.host, r.token) for r in H.template_texts(tokens, H.classes(tokens)).collect()}
    slots = {r.page: r.slots for r in H.slots(df).collect()}
    for h, n, p in pages:
        blocks = [t for t in H.Page(p).tokens() if t[2]]
        want = [i for i, t in enumerate(blocks) if (h, t[0]) not in fixed]
        assert sorted(b for s in slots.get(n, []) for b in s["blocks"] or []) == want


def test_containers_in_changing_order_make_no_valid_class(spark):
    a, b = "<div class='a'><p>A {0}</p></div>", "<div class='b'><p>B {0}</p></div>"
    rows = [(1, i, (a + b if i % 2 else b + a).format(i)) for i in range(6)] + [(2, 10 + i, (a + b).format(i)) for i in range(6)]
    got = H.slots(spark.createDataFrame(rows, "host long, page long, html string")).collect()
    valid = {r.host: {s["valid"] for s in r.slots if s["valid"] is not None} for r in got}
    assert valid == {1: {False}, 2: {True}}


def test_main_text_without_telling_names(spark):
    large = os.path.join(os.path.dirname(DATA), "sf0.1")
    pages = spark.read.parquet(f"{large if os.path.isdir(large) else DATA}/pages.parquet")
    names = F.regexp_replace("html", r"(?i)<(/?)(article|main|nav|header|footer|aside|section|form)\b", "<$1div")
    bare = pages.withColumn("html", F.regexp_replace(names, r"(?i)<div\b[^>]*>", "<div>"))
    got = {r.page_id: r.text.split() for r in H.main_text(bare).collect()}
    whole = {r.page_id: r.text.split() for r in H.main_text(pages).collect()}
    scores = []
    for r in pages.select("page_id", "html").collect():
        page = H.Page(r.html)
        named = page.named()
        want = [w for box, text, _ in page.blocks if named[box] for w in text.split()]
        assert whole[r.page_id] == want
        both = sum((Counter(want) & Counter(got[r.page_id])).values())
        scores.append(2 * both / max(1, len(want) + len(got[r.page_id])))
    assert sum(scores) / len(scores) >= 0.99


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>down</p>"
    rows = [(1, "http://a/1", deep), (1, "http://a/1", deep), (2, None, None), (None, "", "<div><p>x"), (3, "http://a/2", "<math>1</math> is one"), (3, "http://b/2", "<table><tr><td>c</td></tr></table>")]
    df = spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA + ", page string, slots int")
    got = Counter((r.page_id, r.text) for r in H.main_text(df).collect())
    assert got == Counter({(1, "down"): 2, (2, ""): 1, (None, "x"): 1, (3, "1 is one"): 1, (3, "c"): 1})
    assert H.main_text(df.limit(0)).count() == 0
