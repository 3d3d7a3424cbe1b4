import random
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rimlight.llm import hnsw, html_extract, materialise, packing, sentencepiece_codec
from rimlight.llm.common import scratch_path


def test_packing_holds_capacity_and_conflicts(odd_docs, no_docs):
    rows = packing.packed_documents(odd_docs, capacity=64, per_source=2, shard_pieces=100).toPandas()
    bins = rows.groupby("bin")
    assert (bins.n_tokens.sum() + bins.room.first() == 64).all()
    assert all(b.cluster.nunique() == len(b) for _, b in bins)
    assert all(b.source.isna().sum() <= 2 and b.source.value_counts().max() <= 2 for _, b in bins if b.source.notna().any())
    whole = rows.groupby(["doc_id", "cluster", "n_pieces"], dropna=False).n_tokens.sum()
    assert whole.max() == 30_002 and len(rows[rows.doc_id == 10]) == 2
    assert packing.packed_documents(no_docs).count() == 0


def test_equal_rows_are_spread_over_all_shards(spark):
    rows = [(None, "s", 7, 1)] * 2500 + [(k, None, None, 10) for k in range(500)] + [(5, "s", 7, 3)] * 3
    items = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    copies = packing.numbered(items, run=100).collect()
    assert sorted(r.copy for r in copies if r.doc_id is None) == list(range(2500))
    assert sorted(r.copy for r in copies if r.cluster == 7 and r.doc_id == 5) == [0, 1, 2]
    got = packing.best_fit(items, capacity=100, shard_pieces=500).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 7 and max(sizes.values()) < 600
    # equal texts conflict: no two in a bin
    assert max(Counter((r.shard, r.bin) for r in got if r.doc_id is None).values()) == 1
    # the result does not depend on the order of rows
    again = packing.best_fit(items.orderBy(F.rand(3)), capacity=100, shard_pieces=500).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_best_fit_equals_a_naive_search():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(1, 60)
        sizes = sorted((rng.randrange(1, 41) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice("ab") for _ in range(n)], [rng.randrange(12) for _ in range(n)]
        bins, starts, _ = packing.pack_shard(np.array(sizes), sources, clusters, 40, 3)
        held: dict[int, list[int]] = {}
        for k in range(n):
            # brute force over all open bins; ties may go to any
            room = {
                b: 40 - sum(sizes[i] for i in rows) for b, rows in held.items()
                if clusters[k] not in {clusters[i] for i in rows} and sum(sources[i] == sources[k] for i in rows) < 3
            }
            fits = {b: r for b, r in room.items() if r >= sizes[k]}
            assert bins[k] in fits if fits else bins[k] not in held
            assert 40 - starts[k] == (fits[bins[k]] if fits else 40) and fits.get(bins[k], 0) == min(fits.values(), default=0)
            held.setdefault(bins[k], []).append(k)


def test_best_fit_takes_the_tightest_compatible_bin():
    sizes = np.array([6, 5, 4, 4, 3])
    bins, starts, rooms = packing.pack_shard(sizes, list("abcdd"), [1, 2, 1, 4, 5], 10, 1)
    # 4 of cluster 1 may not join the 6; the next 4 may; the 3 fits nowhere beside its own source but bin 2
    assert bins[:4] == [0, 1, 1, 0] and starts[2:4] == [5, 6]
    assert bins[4] == 2 and rooms[0] == 0


def test_nearest_equals_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, (300, 1))
    x[50:120] = x[50]
    rows = [(i, [float(f) for f in v], "c") for i, v in enumerate(x)]
    bad = [(300, None, "c"), (320, [0.0] * 8, "c"), (340, [float("nan")] * 8, "c"), (360, [None] * 8, "c"), (None, [1.0] * 8, "c")]
    table = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in hnsw.nearest(table, min_shards=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.append(np.arange(300), 0)
    every = np.vstack([x, x[:1]])
    hit = 0
    for q in range(0, 300, 20):
        s = every @ x[q]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        hit += len({m[1] for m in mine} & set(ids[best].tolist()))
        for _, i, score in mine:
            assert score == pytest.approx(float(x[i] @ x[q]), abs=1e-12)
    assert set(got) == set(range(0, 300, 20)) and hit >= 0.9 * 300
    assert hnsw.nearest(table.limit(0)).count() == 0


def test_repeated_ids_of_equal_vectors_hide_no_other_id(spark):
    rng = np.random.default_rng(5)
    near = [1.0, 1.0, 1.0, 1.0]
    rows = [(20, near)] * 25 + [(i, near) for i in range(100, 110)]
    rows += [(i, [float(f) for f in 0.1 * rng.normal(size=4)]) for i in range(201, 260)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hnsw.nearest(table, k=10, min_shards=2).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(100, 110))
    other = hnsw.nearest(table, k=10, min_shards=2).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in other] == [20] * 10


def test_shards_are_dealt_one_a_task(spark):
    rows = spark.range(600).selectExpr("id vec_id", "array(id + 1.0D, 2.0D) v", "2 dim")
    graphs = hnsw.indexed(rows, 6, 3)
    plan = graphs._jdf.queryExecution().toString()
    assert plan.count("Exchange") == 1
    parts = graphs.rdd.glom().map(len).collect()
    assert parts == [1] * 6


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 1000, 4096):
        assert sorted(materialise.feistel(np.arange(n), n)) == list(range(n))
    assert (materialise.feistel(np.arange(1000), 1000) != materialise.feistel(np.arange(1000), 1000, key=5)).any()


def test_shards_hold_every_text_once(spark, odd_docs, no_docs, tmp_path):
    stored = str(tmp_path / "docs")
    odd_docs.repartition(3).write.parquet(stored)
    docs = spark.read.parquet(stored)
    out = f"file://{tmp_path}/shards"
    rows = materialise.materialise(docs, out, length=512, per_shard=64).toPandas()
    assert sorted(rows.slot) == list(range(len(rows)))
    back = {r.slot: bytes(r.tokens) for r in materialise.read_slots(spark, out).collect()}
    assert len(back) == len(rows) and {len(t) for t in back.values()} == {512}
    used = sum(n for n in rows.n_tokens)
    assert used == sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    short = next(r for r in rows.itertuples() if 9 in list(r.doc_ids))
    assert b"one two\xff" in back[short.slot]
    part = materialise.read_slots(spark, out, 3, 70).collect()
    assert [bytes(r.tokens) for r in sorted(part)] == [back[k] for k in range(3, 70)]
    assert materialise.materialise(no_docs, f"file://{tmp_path}/none").count() == 0


def test_ids_equal_the_library_and_round_trip(spark, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    more = spark.createDataFrame([(50, "a  b\n c\td   \r\n 日本 ﬁ ==== 0000   "), (51, "    "), (52, "the theory of the thesis")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    rows = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_documents(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == sp.encode(r.text or "")[: len(r.ids) or None] and r.decoded == (r.text or "")
    assert sentencepiece_codec.coded_documents(no_docs).count() == 0


def test_coding_takes_one_python_worker_a_task(spark, odd_docs):
    coded = sentencepiece_codec.coded_documents(odd_docs)
    assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    steps = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_documents(odd_docs)).collect()
    expected = [(r.doc_id, len(r.ids), zlib.crc32(array("i", r.ids).tobytes()), r.decoded == (r.text or "")) for r in steps]
    assert sorted(map(repr, map(tuple, coded.collect()))) == sorted(map(repr, expected))


def test_held_words_are_bounded_in_bytes(monkeypatch):
    import sentencepiece

    for name, bound in [("HELD_WORD_BYTES", 40_000), ("HELD_PAIR_BYTES", 20_000), ("PIECE_BYTES", 300), ("PIECE_IDS", 7)]:
        monkeypatch.setattr(sentencepiece_codec, name, bound)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    vocabulary, table = sentencepiece_codec.load.__wrapped__(Path(sentencepiece_codec.MODEL).read_bytes(), "bpe")
    rng = random.Random(4)

    def word():
        return "".join(rng.choice("abcdefgh日é\n\t ") for _ in range(rng.choice([1, 3, 9, 90])))

    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(300)] + [None, "", "   ", "x" * 2_000]
    texts += texts[:50]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = 0
    for batch in sentencepiece_codec._decoded(sentencepiece_codec._encoded([given], vocabulary), table):
        for row in batch.to_pylist():
            assert row["text"] == texts[row["doc_id"]] and row["decoded"] == (row["text"] or "")
            assert row["ids"] == sp.encode(row["text"] or "")
            got += 1
        held = {**vocabulary.words, **vocabulary.older_words}
        assert sum(len(w) + len(ids) for w, ids in held.items()) < 40_000 + 20_000
        assert 100 * (len(vocabulary.apart) + len(vocabulary.older_apart)) <= 20_000
    assert got == len(texts) and vocabulary.older_words and vocabulary.older_apart


def test_unigram_viterbi_equals_brute_force():
    pieces = {p: (i, s) for i, (p, s) in enumerate([("a", -2.0), ("b", -2.1), ("ab", -3.0), ("ba", -2.5), ("aba", -3.9), ("bab", -3.2)])}
    vocabulary = sentencepiece_codec.Vocabulary(pieces, [], 99, "unigram")

    def best(word):
        if not word:
            return 0.0
        return max(s + best(word[len(p) :]) for p, (_, s) in pieces.items() if word.startswith(p))

    scores = {i: s for i, s in pieces.values()}
    words = sorted({format(k, "b").replace("0", "a").replace("1", "b") for k in range(1, 300)})
    for word, symbols in vocabulary.segment(words):
        assert sum(scores[i] for i in symbols) == pytest.approx(best(word))


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav>"
    '<div class="ad">buy</div>%s<footer>&copy; us</footer></body></html>'
)


def test_text_of_pages(spark):
    pages = [
        (1, "http://h/a", PAGE % "<article><h1>Head &amp;amp one</h1><p>It <b>is</b>n't\n so<br>long<p>two &lt;b&gt;</article>"),
        (2, "http://h/b", PAGE % "<main><p>x</p><form>in</form><section class='comments'>bad</section><p>y</p></main>"),
        (3, "http://h/c", PAGE % "<div><p>plain</p></div><div id='cookie-notice'>we use</div>"),
        (4, None, None), (5, "nourl", ""), (5, "nourl", ""), (6, "http://h/d", "just < text & more"),
        (7, "http://k/1", "<div>" * 3000 + "deep"),
    ]
    df = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, wrapper string")
    got = html_extract.extract_text(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == "Head &amp one It isn't so long two <b>"
    assert text[2] == "x y" and text[3] == "plain" and text[4] == text[5] == ""
    assert text[6] == "just < text & more" and text[7] == "deep"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_wrapper_drops_what_pages_of_a_host_share():
    page = "<html><body><div class='top'>Daily Post</div><div class='x'><p>%s</p><p>%s</p></div><div class='end'>All rights</div></body></html>"
    pages = [page % (f"first {k}", f"second {k * k}") for k in range(5)]
    template = {tuple(t) for t in html_extract.induce(pages)}
    assert {t for _, t in template} == {"Daily Post", "All rights"}
    assert html_extract.main_text(pages[2], template) == "first 2 second 4"
    # copies of one page are no template
    assert html_extract.induce([pages[0]] * 4) == []


@pytest.mark.parametrize("notice", ["<div class='end'>%s</div>", "<p>%s</p>"])
def test_closing_text_of_long_and_deep_pages_is_template(notice):
    end = notice % "All rights"
    page = lambda k, n: "<html><body>" + "".join(f"<p>page {k} part {i}</p>" for i in range(n)) + end + "</body></html>"
    pages = [page(k, n) for k, n in enumerate([30, 200, 7, 150, 90])]
    assert {t for _, t in html_extract.induce(pages)} == {"All rights"}
    assert {t for _, t in html_extract.induce(pages[1::-1] + pages[2:])} == {"All rights"}
    deep = ["<div>" * 900 + f"<p>one {k}</p><p>two {k}</p>{end}" + "</div>" * 900 for k in range(4)]
    assert {t for _, t in html_extract.induce(deep)} == {"All rights"}


def test_alignment_in_linear_space_is_as_good_as_the_table(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 4, n) for n in (90, 90, 130, 130)]

    def total(pairs):
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        return sum(1 + (rows[1][i] == rows[3][j]) for i, j in pairs if rows[0][i] == rows[2][j])

    linear = total(html_extract._aligned(*rows))
    monkeypatch.setattr(html_extract, "SMALL_TABLE", 10**9)
    assert linear == total(html_extract._aligned(*rows))


def test_each_layout_of_a_host_has_its_template(spark):
    one = "<html><body><div class='top'>Daily Post</div><div class='story'><p>news {0} a</p><p>more {0} b</p></div></body></html>"
    two = "<html><body><div class='shop'><h1>item {0} c</h1><p>price {0} d</p><p>Free returns</p></div></body></html>"
    last = "<html><body><center><p>page {0} e</p><p>text {0} f</p><p>Printed edition</p></center></body></html>"
    rows = [("h", one, k) for k in range(60)] + [("h", two, k) for k in range(60)] + [("h", last, k) for k in range(5)]
    rows += [("pair", one, 1), ("pair", one, 2), ("alone", one, 1), ("copies", one, 3), ("copies", one, 3)]
    pages = [(i, f"http://{h}/{i}", page.format(k)) for i, (h, page, k) in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    for i, (host, page, k) in enumerate(rows):
        expect = {one: f"news {k} a more {k} b", two: f"item {k} c price {k} d", last: f"page {k} e text {k} f"}[page]
        # one page, copies of one or what two pages share tell nothing of the template
        assert got[i] == ("Daily Post " if host in ("alone", "copies", "pair") else "") + expect


@pytest.mark.parametrize("fixed", [3, 4, 8, 40])
def test_pages_with_more_fixed_rows_than_paragraphs_have_a_template(fixed):
    # no tag, class or id tells anything
    rows = "".join(f"<div>fixed row {k}</div>" for k in range(fixed))
    page = "<html><body><div>" + rows + "</div><div><div>%s</div><div>%s</div><div>%s</div></div><div>end row</div></body></html>"
    pages = [page % (f"begin {k}", f"middle {k}", f"last {k}") for k in range(10)]
    template = set(html_extract.induce(pages))
    assert len(template) == fixed + 1
    assert [html_extract.main_text(p, template) for p in pages] == [f"begin {k} middle {k} last {k}" for k in range(10)]


def test_pages_without_telling_names_through_spark(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(999)) for _ in range(12))
    pages, expect = [], {}
    for host in ("a.org", "b.org"):
        top = "".join(f"<div>{host} row {k}</div>" for k in range(9))
        for k in range(40):
            parts = [text() for _ in range(rng.randrange(2, 6))]
            body = "".join(f"<div>{p}</div>" for p in parts)
            i = len(pages)
            pages.append((i, f"https://{host}/{k}", f"<html><body><div>{top}</div><div>{body}</div><div>made by {host}</div></body></html>"))
            expect[i] = " ".join(parts)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for piece in (5, 1000):
        assert {r.page_id: r.text for r in html_extract.extract_text(df, piece).collect()} == expect


def test_a_template_cuts_no_marked_article_and_no_sentence_of_two(spark):
    page = "<html><body><div>Daily Post</div><article><p>{0} one</p><p>{1}</p><p>{0} two</p></article></body></html>"
    plain = "<html><body><div>Daily Post</div><div><p>{0} one</p><p>{1}</p><p>{0} two</p></div></body></html>"
    pages = [(k, f"http://h/{k}", page.format(k, "said by all")) for k in range(5)]
    pages += [(k, f"http://h/{k}", plain.format(k, "said by two" if k < 12 else f"said by {k}")) for k in range(10, 14)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{k} one said by all {k} two" for k in range(5))
    assert all(got[k] == f"{k} one said by {'two' if k < 12 else k} {k} two" for k in range(10, 14))


def test_wrappers_joined_by_host_give_the_same(spark, monkeypatch):
    page = "<html><body><div>Daily Post</div><div><p>{0} one</p><p>{0} two</p></div></body></html>"
    rows = [(k, f"http://h/{k}" if k % 2 else None, page.format(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = sorted(html_extract.extract_text(df).collect())
    monkeypatch.setattr(html_extract, "MAX_SENT_KEYS", 0)
    assert sorted(html_extract.extract_text(df).collect()) == sent
    assert [r.text for r in sent][:2] == ["Daily Post 0 one 0 two", "1 one 1 two"]


def test_articles_that_are_comments_or_teasers_are_no_content():
    comments = "<section class=comments>" + "".join(f"<article class=comment><p>reader {k} says so</p></article>" for k in range(9)) + "</section>"
    aside = "<aside class=related><article><h3>other news</h3></article><article>more of it</article></aside>"
    story = "<h1>Head</h1><p>the story is told here</p>"
    text = lambda body: html_extract.main_text(f"<html><body>{body}</body></html>", set())
    expect = "Head the story is told here"
    assert text(f"<article>{story}</article>{comments}{aside}") == expect
    assert text(f"{aside}<main>{story}{comments}</main>") == expect
    assert text(f"<article>{story}{comments}</article><div role=complementary><article>teaser</article></div>") == expect
    # the only or largest article stays whatever it is named and stands in
    assert text(f"<article class='post social'>{story}</article>{aside}") == expect
    assert text(f"<main><div class=sidebar><article>{story}</article></div></main>") == expect
    assert text(f"<form><article>{story}</article></form>") == expect
    # further articles without such a name are content
    assert text(f"<article>{story}</article><article>and more</article>") == expect + " and more"
