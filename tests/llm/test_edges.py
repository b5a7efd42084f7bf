"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from frameloom.llm import decontaminate, exact_dedup, html_text, langid, lm_scoring, mixing, ngram_jaccard, pii, secret_scan, url_filter

LONG = "wort haus " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, block string, digest string, row string"


def rows():
    one = "the quick brown fox jumps over the lazy dog near the river bank today"
    texts = [(1, one, "en", "a"), (2, one, "en", "a"), (2, one, "en", "a"), (3, None, None, None), (None, "", "en", None), (None, one + " x", None, "b"), (4, LONG, "de", "a"), (5, " \t\n", "de", "b"), (6, "12345 !!", "fr", ""), (7, one.replace(" ", "  "), "en", "a")]
    return [(i, t, lang, s, None, "s", "c", "b", "d", "r") for i, t, lang, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, none):
    out = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()}
    assert len(mixing.mix(docs).collect()) == len(rows())
    assert all(0 <= taken <= 2 * size for _, size, taken in out)
    assert mixing.mix(none).collect() == []
    carried = mixing.mix(docs, carry=True)
    assert set(docs.columns) - {"size"} < set(carried.columns) and carried.count() == len(rows())
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == out


def test_exact_dedup(spark, docs, none):
    index = exact_dedup.DigestIndex.fresh(spark, buckets=4)
    counts, groups = index.add(docs)
    got = exact_dedup.decisions(counts, groups).collect()
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len({r.digest for r in got})
    same = [r for r in got if r.doc_id in (1, 2, 7)]
    assert {r.keep_id for r in same} == {7} and {r.group_size for r in same} == {4}  # most code points stay
    empty = [r for r in got if r.doc_id in (3, 5) or (r.doc_id is None and r.group_size == 3)]
    assert {r.keep_id for r in empty} == {5}
    again = exact_dedup.decisions(*index.add(docs)).collect()
    assert not any(r.kept for r in again) and {r.keep_id for r in again} == {r.keep_id for r in got}
    assert exact_dedup.decisions(*index.add(none)).collect() == []
    kept = exact_dedup.keep_first(docs, exact_dedup.DigestIndex.fresh(spark, buckets=4))
    assert kept.columns == docs.columns and kept.count() == len({r.digest for r in got})


def test_index_outlives_its_session_object(spark, docs, tmp_path):
    exact_dedup.DigestIndex(spark, "one_index", str(tmp_path / "i"), 4).add(docs)
    spark.sql("DROP TABLE one_index")
    _, groups = exact_dedup.DigestIndex(spark, "one_index", str(tmp_path / "i"), 4).add(docs)
    assert groups.filter("fresh").count() == 0
    spark.sql("DROP TABLE one_index")


def test_ngram_jaccard(docs, none):
    out = ngram_jaccard.near_classes(docs, n_words=4, percent=85).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.n_shingles))
    assert by[1] == by[2] == by[7] == {(1, 11)} and (1, 12) in by[None]
    assert by[3] == {(3, 0)} and by[5] == {(5, 0)} and by[6] == {(6, 1)} and by[4] == {(4, 2)}
    assert ngram_jaccard.near_classes(none).collect() == []
    kept = ngram_jaccard.keep_one(docs, n_words=4, percent=85)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, None, 4, 5, 6]))
    assert ngram_jaccard.keep_one(none).collect() == []


def test_langid(docs, none):
    model = langid.fit(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == len(rows())
    pred = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert pred[3] == pred[5] == pred[6] == ("und", 0.0) and pred[4][0] == "de" and pred[1][0] == "en"
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.fit(none) is None and langid.identify(none, None).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, max_langs=1)


def test_html(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>Some words\n of   text.<p>And <b>more</b><br>here.</article><footer>&copy; me</footer>"
    bad = ["<", "<!--", "<p", "<script>x", "a<b c", "<p>" * 50_000, "&#xZZ;&nope;", "<p>\x00</p>", "</p></p>", "<div class='ad'>"]
    data = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", "t"), *((10 + i, "u", b, "t") for i, b in enumerate(bad))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(data) and got[1].text == "Head & more\nSome words of text.\nAnd more here."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[None].text == ""
    assert html_text.extract(pages.limit(0)).collect() == []


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Quick  brown fox JUMPS over the lazy dog near the river"), (2, None), (3, ""), (4, "wholly absent text of some length that is nowhere"), (1, "quick brown fox jumps over the lazy dog near the river")], "item_id long, text string")
    out = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in out} == {(i, 1, 0) for i in (1, 2, 7, None)} and len(out) == 2 * 5
    small = decontaminate.matches(docs, items, block_chars=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, out))
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows()) - 5
    assert decontaminate.matches(docs, items.limit(0)).collect() == [] and decontaminate.matches(none, items).collect() == []


def test_lm(docs, none):
    learn = docs.selectExpr("*", "doc_id <> 6 AS train")
    out = lm_scoring.score(learn).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows()) and got[3].n_tokens == got[5].n_tokens == 1 and got[4].n_tokens == 80_001
    assert got[6].n_known == 1 and got[6].train is False and got[None].train is False
    assert all(r.score <= 0 and r.base_score <= 0 for r in out) and len({r.train_tokens for r in out}) == 1
    assert lm_scoring.score(none.selectExpr("*", "true AS train")).collect() == []
    untaught = lm_scoring.score(docs.selectExpr("*", "false AS train")).collect()
    assert {r.n_known for r in untaught} == {0} and {r.train_tokens for r in untaught} == {0}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/1?q", "http://x.com/fr/1", "http://x.com/de/1#a", "http://x.com?/de/", "http://example.org/en/12", "http://notexample.org/en/12", "http://a.net/" + "s/" * 5_000, "x://y.com//de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[4], "h"), (4, urls[4], "h")], "page_id long, url string, host string")
    out = url_filter.judge(pages)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(urls) + 2
    assert (got[0].host, got[0].path, got[0].rule, got[3].host) == ("", "", None, "")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[5].rule, got[6].rule, got[7].path, got[7].host) == ("com/fr/", "com/de/", "", "x.com")
    assert (got[8].rule, got[8].verdict, got[9].rule, got[9].verdict) == ("example.org/en/1", "block", "org/", "allow")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and url_filter.judge(pages.limit(0)).collect() == []


def test_scans(docs, none):
    for scan in (pii.find, secret_scan.scan):
        out = scan(docs).collect()
        assert len(out) == len(rows()) and {r.spans for r in out} == {""} and len({r.base_sha256 for r in out}) == 1
        assert scan(none).collect() == []
