"""Token store, language model, sketches, mixing, packing, quality and pages on small and odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealflux.llm import backoff_lm, compression_quality, html_text, mixing, packing, sketches, token_store


def words(text):
    return (text or "").encode().lower().split()


# 1: token store.


def test_pieces_encode_like_the_tokenizer():
    path = token_store.tokenizer_path()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    odd = ["", " ", "  a", "a  b", "a \nb", "a\n b", " a", "a ", "a\t b", "x\0 y", "\0", "don't  we'll", "é 1a b2 ,c", "　x  y", "<|endoftext|> x", None, "Word, word. Word\nnext"]
    coder = token_store.PieceIds(path, 0, limit=5)
    for texts in (odd, odd[::-1], odd):
        got = [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)]
        assert got == [e.ids + [0] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_store_round_trip(spark, odd_docs, no_docs, tmp_path):
    path = token_store.tokenizer_path()
    token_store.write(odd_docs, str(tmp_path / "t"), path, file_chars=2000)
    stored = token_store.read(spark, str(tmp_path / "t"))
    tokenizer = Tokenizer.from_file(path)
    want = sorted((r.doc_id is not None, r.doc_id or 0, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.tokens) for r in stored.collect()) == want
    assert token_store.read(spark, str(tmp_path / "t"), 6, 7).count() == 2
    out = token_store.positions(token_store.checksums(stored)).orderBy("start").collect()
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in out), key=lambda i: (i is not None, i))
    assert Counter(r.ids_crc32 for r in out) == Counter(zlib.crc32(np.array(t, "<u4").tobytes()) for *_, t in want)
    token_store.write(no_docs, str(tmp_path / "none"), path)
    assert token_store.positions(token_store.checksums(token_store.read(spark, str(tmp_path / "none")))).count() == 0


# 2: language model.


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_formula(spark, odd_docs, order, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_CHARS", 9000)
    monkeypatch.setattr(backoff_lm, "BUCKET_CHARS", 5000)
    docs = odd_docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.concat("text", F.lit(" a b unseen"))))
    rows = docs.collect()
    learn = lambda r: r.doc_id is not None and r.doc_id % 3 != 0
    grams, contexts = Counter(), Counter()
    for r in rows:
        if learn(r):
            t = ["^"] * (order - 1) + words(r.text) + ["$"]
            for i in range(order - 1, len(t)):
                for k in range(order):
                    grams[tuple(t[i - k : i + 1])] += 1
                    contexts[tuple(t[i - k : i])] += 1
    single = {g: c for g, c in grams.items() if len(g) == 1}
    total, v = sum(single.values()), len(single)

    def p(context, w):
        if not context:
            return (grams[w,] + 0.1) / (total + 0.1 * (v + 1))
        return (grams[(*context, w)] + 16.0 * p(context[1:], w)) / (contexts[context] + 16.0)

    want = []
    for r in rows:
        t = ["^"] * (order - 1) + words(r.text) + ["$"]
        own = range(order - 1, len(t))
        want.append((r.doc_id or -1, len(own), sum(grams[t[i],] > 0 for i in own), total, round(sum(math.log10(p((), t[i])) for i in own), 6), round(sum(math.log10(p(tuple(t[i - order + 1 : i]), t[i])) for i in own), 6)))
    got = backoff_lm.score(docs, F.col("doc_id") % 3 != 0, order=order).collect()
    mine = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert np.allclose(np.array(mine, float), np.array(sorted(want), float), rtol=0, atol=1e-5)


def test_no_training_rows_and_no_rows(odd_docs, no_docs):
    got = backoff_lm.score(odd_docs, F.lit(None).cast("boolean")).collect()
    assert len(got) == 15 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert backoff_lm.score(no_docs, F.lit(True)).count() == 0


# 4: sketches.


def test_edited_texts_and_neighbours(spark, odd_docs, no_docs):
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()}, key=lambda r: r[:2])
    got = sketches.edited_likeness(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id and r.doc_id > 2}
    for (_, doc, text), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        if 2 < doc < 11:
            k = len(text) // 4
            edited = text[: len(text) - k] + after[:k]
            assert (by_id[doc].n_chars, by_id[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    prints = {r.text or "": None for r in odd_docs.collect()}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[8].fingerprint == by_id[9].fingerprint != "" and by_id[4].fingerprint == "" and prints
    assert by_id[6].near_next > 0.9
    assert sketches.edited_likeness(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (40_000, 4_000))
    whole = np.union1d(a, b)
    sa, sb, sw = sketches.sketch(a), sketches.sketch(b), sketches.sketch(whole)
    assert np.array_equal(sketches.merge(sa, sb), sw)
    assert sketches.containment(sb, sw) == 1 and sketches.containment(sw, sb) == pytest.approx(1 / 11, abs=0.02)
    assert np.array_equal(sketches.from_text(sketches.to_text(sw)), sw)


@pytest.mark.parametrize("n", [3, 12, 40, 200, 1500, 30_000])
def test_likeness_error_by_length(n):
    rng = np.random.default_rng(n)
    for share in (0.1, 0.5, 0.9):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[int(n * (1 - share)) : int(n * (1 - share)) + n])
        both = len(np.intersect1d(a, b))
        got = sketches.jaccard(sketches.sketch(a), sketches.sketch(b))
        assert got == pytest.approx(both / (len(a) + len(b) - both), abs=0.1 if n > 200 else 1e-9)
        assert sketches.containment(sketches.sketch(a), sketches.sketch(b)) == pytest.approx(both / n, abs=0.1 if n > 200 else 1e-9)


# 6: mixing.


def test_mix_hits_targets(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, range_rows=2).collect()
    per = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = per.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
    total = sum(s[1] for s in per.values())
    assert sum(s[2] for s in per.values()) == pytest.approx(total)
    assert all(s[1] == s[3] and s[0] == math.floor(s[2] + 1e-6) and s[2] <= 3 * s[3] + 1e-9 for s in per.values())
    again = mixing.mix(odd_docs.repartition(5), range_rows=3).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(no_docs).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 50, 1), (None, 0, 1), ("d", 400, 1)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 5 2 1 5 and 2 for the null source; a, c and the null one are full, b and d share the rest 2 : 5.
    level = (1460 - 30 - 150 - 0) / 7
    assert got["a"] == 30 and got["c"] == 150 and got[None] == 0
    assert got["b"] == pytest.approx(2 * level) and got["d"] == pytest.approx(5 * level)


# 3: packing.


def plain_best_fit(pieces, capacity, limit):
    bins, out = [], []
    for length, cluster, source in pieces:
        fit = [(capacity - sum(p[0] for p in b), n) for n, b in enumerate(bins)
               if capacity - sum(p[0] for p in b) >= max(length, 1) and all(p[1] != cluster for p in b) and sum(p[2] == source for p in b) < limit]
        n = min(fit)[1] if fit else len(bins)
        if n == len(bins):
            bins.append([])
        bins[n].append((length, cluster, source))
        out.append(n)
    return out


def test_best_fit_equals_the_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = sorted(zip(rng.integers(0, 20, 120).tolist(), rng.integers(0, 15, 120).tolist(), rng.integers(0, 3, 120).tolist()), key=lambda p: (-p[0], p[1:]))
        assert packing.best_fit(pieces, 20, 3) == plain_best_fit(pieces, 20, 3)


def test_pack_keeps_every_unit(odd_docs, no_docs):
    size = F.coalesce(F.size(F.split("text", " ")), F.lit(0))
    got = packing.pack(odd_docs, size, F.md5("text"), capacity=100, source_limit=2, shard_bins=8).toPandas()
    assert got.groupby(["shard", "bin"]).length.sum().max() <= 100
    total = odd_docs.agg(F.sum(F.greatest(size, F.lit(0)))).first()[0]
    assert got.length.sum() == total
    assert (got.groupby(["shard", "bin"]).doc_id.count() <= 20).all()
    assert packing.pack(no_docs, size, F.md5("text")).count() == 0


def test_near_copies_share_no_bin(spark, odd_docs):
    from dealflux.llm import queries

    near = [(i, " ".join(f"w{j}" for j in range(60)) + f" end{i}", f"s{i}") for i in range(12)]
    rows = odd_docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(100 + i, t, s) for i, t, s in near], "doc_id long, text string, source string"))
    docs = queries.near_clusters(rows)
    assert docs.count() == rows.count()
    got = packing.pack(docs, F.col("n_words"), F.col("cluster")).where("doc_id >= 100").collect()
    assert len(got) == len({(r.shard, r.bin) for r in got}) == 12


# 10: quality.


def test_quality_tells_held_out_classes(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["the", "river", "stone", "walked", "slowly", "under", "bridge", "morning", "light", "quiet", "houses", "garden"]
    good = [" ".join(rng.choice(vocabulary, 60)) + "." for _ in range(150)]
    bad = [" | ".join(f"{rng.choice(vocabulary).upper()}!!{rng.integers(9)}" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 3] + [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0), (12345, 0, 0)], "doc_id long, quality int, toxic int")
    model = compression_quality.fit(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", compression_quality.score(F.col("text"), model).alias("s")).collect()}
    held = [i for i in range(300) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]


def test_quality_without_labels_or_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = compression_quality.fit(odd_docs, none)
    assert {r.s for r in odd_docs.select(compression_quality.score(F.col("text"), model).alias("s")).collect()} == {0.5}
    one = compression_quality.fit(odd_docs, spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"))
    assert odd_docs.select(compression_quality.score(F.col("text"), one)).count() == 15 and compression_quality.fit(no_docs, none)


# 9: pages.


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad-%d">Buy</div>
<article id="post-%d"><h1>Title&nbsp;%d &amp; more</h1><p><b>First   line<br>goes on.<p>Second &#233; x<br/></p><div class="newsletter">Join</div>
<aside>Side</aside><form><p>Mail</p></form><div class="comments"><p>I think</p></div><p>a &lt; b</article><section class='related'><p>See</p></section><footer>&copy; x</footer></body>"""


def test_main_text_of_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i)) for i in range(30)] + [(100, None, None), (101, "x", ""), (102, "http://one.example:80/a?b", "<p>Just <i>this</i> text"), (None, "http://h.example/z", "<article>broken <p"), (102, "http://one.example/", "text &am")]
    got = html_text.main_text(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[3, "http://h.example/3"].text == "Title 3 & more\nFirst line goes on.\nSecond é x\na < b"
    assert all(r.n_chars == len(r.text) for r in got)
    assert by[100, None].text == "" == by[101, "x"].text
    assert by[102, "http://one.example:80/a?b"].text == "Just this text" and by[102, "http://one.example/"].text == "text &am"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_of_a_large_host_goes(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='top'><p>Welcome to us</p></div><div class='story'><p>Story {i} begins</p><p>Shared by some</p></div></body>" if i % 2 else f"<body><div class='top'><p>Welcome to us</p></div><div class='story'><p>Tale {i} goes on</p></div></body>") for i in range(40)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 begins\nShared by some" and got[4] == "Tale 4 goes on"


def texts_of(spark, pages, host="h.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_sibling_containers_and_forms_keep_the_article(spark):
    page = "<html><body><div class='intro'><p>{0} today</p></div><div class='title'><h1>Title {0}</h1></div><section id='introduction'><p>Why {0}</p></section><section id='methods'><p>How {0} was done at length</p></section></body></html>"
    index = "<html><body><div class='intro'><p>All of it</p></div></body></html>"
    want = "{0} today\nTitle {0}\nWhy {0}\nHow {0} was done at length"
    got = texts_of(spark, [page.format(f"n{i}") for i in range(24)] + [index])
    assert all(got[i] == want.format(f"n{i}") for i in range(24)) and got[24] == "All of it"
    form = "<html><body><form id='form1' action='/'>{}<div class='search'><p>Find</p></div></form></body></html>"
    got = texts_of(spark, [form.format(f"<div class='post'><p>Text {i}</p></div>") for i in range(5)])
    assert got == {i: f"Text {i}" for i in range(5)}
    assert texts_of(spark, [form.format(f"<article><p>Text {i}</p><form><p>Mail</p></form></article>") for i in range(3)])[2] == "Text 2"
    assert texts_of(spark, [form.format("<p>Only page</p>")])[0] == "Only page"


@pytest.mark.parametrize("n", [3, 19, 20])
def test_template_texts_at_every_host_size(spark, n):
    page = "<body><div class='top'><p>Welcome to us</p><ul><li>Home</li><li>Home</li></ul></div><div class='story'><p>Story {0} begins</p></div></body>"
    bare = "<body><div class='story'><p>Story {0} begins</p></div></body>"
    got = texts_of(spark, [page.format(i) for i in range(n - 1)] + [bare.format(n - 1)])
    assert got == {i: f"Story {i} begins" for i in range(n)}


def test_copies_are_no_template(spark):
    page = "<body><div class='story'><p>Story begins</p><p>and ends</p></div></body>"
    assert texts_of(spark, [page] * 4) == dict.fromkeys(range(4), "Story begins\nand ends")
    assert texts_of(spark, [page]) == {0: "Story begins\nand ends"}
