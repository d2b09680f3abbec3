"""The operators with a ``spark.checkpoint.dir`` without a scheme on a cluster whose machines share it."""

import pytest
from pyspark.sql.conf import RuntimeConfig

import corpus_pipeline
from tests.conftest import rows
from tillbook.llm import queries

OPERATORS = {"pipeline": corpus_pipeline.run, **queries.QUERIES}


@pytest.fixture(scope="module")
def texts_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    words = "the red fox runs over a blue hill and finds one old key under green moss near that quiet stone bridge".split()

    def text(i):
        return " ".join(words[(i * (k + 3) + k * k) % len(words)] for k in range(24 + i % 5)) + f" {i - i % 2}"

    held = {
        "documents": ([(i, text(i), ("en", "de")[i % 3 == 0], "web", len(text(i))) for i in range(24)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, int(i % 4 == 0)) for i in range(24)], "doc_id long, quality int, toxic int"),
        "pages": ([(i, f"http://h{i % 3}.de/{i}", f"<html lang='en'><body>{text(i) * 9}</body></html>") for i in range(12)], "page_id long, url string, html string"),
        "benchmark": ([(1, text(3)), (2, "not in any text, this sentence")], "item_id long, text string"),
    }
    for name, (values, schema) in held.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plain(found):
    return sorted((repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in rows(found)))


@pytest.mark.parametrize("name", [
    "pipeline", "op1_warc", "op3_lm_scoring", "op6_simhash", "op8_packing", "op10_language_id", "op11_jaccard_join",
    "op12_merkle", "op13_resampling",
])
def test_operators_run_with_a_bare_path_on_a_cluster(spark, texts_folder, tmp_path, monkeypatch, name):
    expected, get = plain(OPERATORS[name](spark, texts_folder)), RuntimeConfig.get
    monkeypatch.setattr(
        RuntimeConfig, "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *default)
    )
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert expected and plain(OPERATORS[name](spark, texts_folder)) == expected
    assert any(not path.name.startswith("shared-") for path in tmp_path.iterdir())
