"""The subpackage and the rest stand alone: queries are added only if it is there."""

import shutil
import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline


def test_one_query_for_each_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_rest_works_without(tmp_path):
    here = entry.__file__.rsplit("/", 1)[0]
    shutil.copytree(f"{here}/tendril", tmp_path / "tendril", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(x.startswith('op1_') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_an_error_inside_is_not_swallowed(tmp_path):
    here = entry.__file__.rsplit("/", 1)[0]
    shutil.copytree(f"{here}/tendril", tmp_path / "tendril", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    shutil.copy(corpus_pipeline.__file__, tmp_path)
    (tmp_path / "tendril/llm/bpe.py").write_text("import no_such_library\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode != 0


def test_pipeline_stages(spark, odd, nothing, tmp_path):
    """Each stage keeps clean rows and the columns of documents; odd and empty input pass."""
    for docs, empty in ((odd, False), (nothing, True)):
        folder = str(tmp_path / f"t{empty}")
        spark.createDataFrame([(1, "x" * 60)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        names = now.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, folder)
            if k < 4:
                assert now.columns == names
            now.write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
        rows = {r.doc_id: r for r in now.collect()}
        if empty:
            assert not rows
        else:
            assert {6, 11, 13}.issubset(rows) and not {0, 1, 2, 3, 7, 9}.intersection(rows)
        assert corpus_pipeline.run(spark, folder).count() == now.count()
