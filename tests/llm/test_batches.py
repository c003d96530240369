"""Rows that pass through Python workers come in batches bounded by bytes, whatever the length of the texts."""

import uuid

import pytest

import corpus_pipeline
from meterloom.llm import bpe, queries
from meterloom.session import BATCH_BYTES, BATCH_CONF

ROWS = 200


@pytest.fixture()
def batch_bytes(monkeypatch, tmp_path):
    """Bytes of each batch that reaches a worker after the operator's own."""
    folder = tmp_path / "seen"
    folder.mkdir()
    plain, at = bpe.map_text, str(folder)

    def watched(df, *args):
        out = plain(df, *args)

        def note(batches):
            for batch in batches:
                with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(batch.nbytes))
                yield batch

        return out.mapInArrow(note, out.schema)

    monkeypatch.setattr(bpe, "map_text", watched)
    return lambda: [int(p.read_text()) for p in folder.iterdir()]


@pytest.fixture()
def documents(spark, tmp_path):
    rows = [(i, "en", "web", " ".join(f"word{(i * 31 + j * j) % 4999}" for j in range(4000))) for i in range(ROWS)]
    rows += [(ROWS, "en", "web", None), (ROWS + 1, None, None, "")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).coalesce(1)


def held(sizes):
    # Two texts or their ids go beside each other in a row; the row that fills a batch is in it.
    return len(sizes) > 20 and max(sizes) < 1.5 * BATCH_BYTES


def test_encoding_of_the_pipeline(spark, documents, batch_bytes):
    before = spark.conf.get(BATCH_CONF)
    out = corpus_pipeline.encoded(spark, documents, "")
    assert out.count() == ROWS + 2
    assert out.where("not exact").count() == 0
    assert held(batch_bytes())
    assert spark.conf.get(BATCH_CONF) == before


def test_digests(spark, tmp_path, documents, batch_bytes):
    assert queries.op3_bpe(spark, str(tmp_path)).count() == ROWS + 2
    assert held(batch_bytes())
