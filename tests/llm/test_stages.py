"""Each stage of the pipeline on nulls, repeated rows, empty tables and columns with the names that operators use."""

import pytest

import corpus_pipeline
from frameloom.llm import langid, ngram_jaccard

EXTRA = ("score", "lang_pred", "size", "taken", "_id", "_hash", "_text", "_keep", "_len", "_digest", "_text_hash", "row", "digest", "text_hash", "copies", "hash", "h", "g", "dotted.name")
COLUMNS = ["doc_id", "text", "lang", "source", *EXTRA]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)
ENGLISH = "the river runs past the old mill and the house where the miller lived with his daughter for many years until the flood"
GERMAN = "der fluss zieht an der alten muehle vorbei und an dem haus in dem der mueller mit seiner tochter lange jahre wohnte"
ITEM = "what is the name of the river that runs past the old mill in the valley"


def rows():
    near = ENGLISH + " " + " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, ENGLISH, "en", "a"), (2, ENGLISH, "en", "a"), (2, ENGLISH, "en", "a"), (3, ENGLISH + " ", "en", "b"), (4, GERMAN, "de", "b"), (5, near, "en", "a"),
        (6, near + " more", "en", "a"), (7, f"he asked {ITEM} yesterday", "en", None), (8, None, "en", "a"), (9, "", "de", "b"), (10, "12 34", None, "b"), (None, None, None, None), (None, GERMAN + " heute", "de", "a"),
    ]
    return [(*t, *(f"{c} {i}" for c in EXTRA)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)




@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_rows_whole(spark, sf_dir, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = stage(spark, docs, sf_dir)
    given = {r[4]: r for r in rows()}
    if name == "mixing":
        assert set(out.columns) == set(COLUMNS) | {"size", "taken", "source_size", "target"}
        assert all(r.taken > 0 for r in out.collect())
        keep = [c for c in COLUMNS if c not in ("size", "taken")]
        assert all(tuple(r[c] for c in keep) == tuple(given[r.score][COLUMNS.index(c)] for c in keep) for r in out.collect())
        return
    got = [tuple(r) for r in out.collect()]
    assert out.columns == COLUMNS and all(g == given[g[4]] for g in got) and len(set(got)) == len(got)
    numbers = {int(g[4].split()[1]) for g in got}
    if name == "exact_dedup":
        assert numbers & {0, 1, 2, 3} == {3} and len(numbers & {8, 9, 11}) == 1 and {4, 5, 6, 7, 10, 12} <= numbers
    elif name == "ngram_jaccard":
        assert len(numbers & {0, 1, 2, 3}) == 1 and not numbers & {6, 12} and {4, 5, 7, 8, 9, 10, 11} <= numbers
    else:
        assert numbers == {"language_id": {0, 1, 2, 3, 4, 5, 6, 7, 12}, "decontaminate": set(range(13)) - {7}}[name]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_empty_tables_and_nulls(spark, sf_dir, name, stage):
    none = spark.createDataFrame([], SCHEMA)
    assert stage(spark, none, sf_dir).collect() == []
    nulls = spark.createDataFrame([(None,) * len(COLUMNS)] * 3, SCHEMA)
    left = {"language_id": 0, "exact_dedup": 1, "ngram_jaccard": 3, "decontaminate": 3, "mixing": 0}
    assert stage(spark, nulls, sf_dir).count() == left[name]


def test_ids_of_any_type_and_scores_at_the_threshold(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(str(i), ENGLISH) for i in range(3)], "doc_id string, text string")
    assert {r.component_id for r in ngram_jaccard.near_classes(docs, n_words=5, percent=80).collect()} == {"0"}
    rows_ = spark.createDataFrame([(i, "some text", "en") for i in range(4)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "identify", lambda d, m: d.selectExpr("*", "CASE row.doc_id WHEN 0 THEN 'und' ELSE 'en' END lang_pred", "array(0.9, 0.3999, 0.4, 0.5)[row.doc_id] score"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, rows_, sf_dir).collect()} == {2, 3}
