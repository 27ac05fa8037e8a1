"""The five stages one after the other, and the registered queries."""

import importlib.util
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus  # noqa: E402
import corpus_pipeline  # noqa: E402

from tapeworks.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases: junk, boilerplate, copies and benchmark passages."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdehirstlmno") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(15)).capitalize() + "." for _ in range(n))
    items = [(k, prose(2)) for k in range(5)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 5
        text = prose(6)
        rows.append((i, " ".join(x.upper() + "!!" for x in text.split()) if bad else ("Subscribe to our letter 12345.\n" if i % 4 == 0 else "") + text))
        labels.append((i, int(not bad), 0))
    rows += [(300 + k, rows[1][1]) for k in range(3)] + [(310 + k, rows[2][1] + f" extra{k}") for k in range(3)] + [(320 + k, prose(3) + "\n" + items[k][1] + "\n" + prose(3)) for k in range(5)] + [(400, None), (401, "")]
    path = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(1, "http://a.com/de/", "")], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    vectors = [(i, [float((i * k) % 17) for k in range(1, 7)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert docs.columns == cols or name == corpus_pipeline.STAGES[-1][0]
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    good = {i for i in range(240) if i % 6 != 5}
    assert ids["quality_classifier"] & set(range(240)) == good
    assert ids["line_dedup"] == ids["quality_classifier"]
    assert not any("Subscribe" in (r.text or "") for r in seen["line_dedup"]) and all(r.n_chars == len(r.text or "") for r in seen["line_dedup"])
    assert ids["near_dedup"] == ids["line_dedup"] - set(range(300, 320))
    assert ids["benchmark_decontamination"] == ids["near_dedup"] - set(range(320, 325))
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    assert corpus_pipeline.run(spark, folder).count() == len(seen["best_fit_packing"])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
    assert set(ORACLES) <= set(QUERIES)


def test_entry_lists_them():
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).parents[2] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert corpus.words("a b") == ["a", "b"]
