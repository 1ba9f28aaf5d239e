import corpus_pipeline
import pytest

CLASHING = "doc_id long, text string, quality string, spans int, removed_lines int, clean_text string, kept boolean, n_words int, fingerprint long, part int, ids string, _gone int, _gone_id long, _gone_h long"
BODY, OTHER = ("\n".join(" ".join(f"{name}{k}x{j}" for j in range(8)) + "." for k in range(12)) for name in ("mill", "road"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, "nothing of the kind is said anywhere in these few texts here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_pass_clashing_columns_and_nulls(spark, folder):
    rows = [(1, BODY), (1, OTHER), (None, OTHER), (None, None), (3, ""), (4, BODY)]
    docs = spark.createDataFrame([(i, t, "q", 1, 2, "c", True, 3, 4, 5, "i", 6, 7, 8) for i, t in rows], CLASHING).repartition(2)
    expect = {
        "quality": [(1, BODY), (1, OTHER), (4, BODY), (None, OTHER)],
        "line_dedup": [(1, BODY), (1, OTHER), (3, ""), (None, None)],
        "near_dedup": [(1, BODY), (1, OTHER), (3, "")],
        "decontaminate": rows,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(got, key=str) == sorted(expect[name], key=str), name
        assert all(tuple(r)[2:] == ("q", 1, 2, "c", True, 3, 4, 5, "i", 6, 7, 8) for r in out.collect())
    assert corpus_pipeline.pack(spark, docs, folder).count() == len(rows)


def test_stages_give_empty_tables_for_empty_ones(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
