"""What Python workers hold: the memory of one operator at a time, and rows of bounded size."""

import gc
import weakref

import pyarrow as pa
from greenframe.llm import language, near, packing
from greenframe.llm.common import documents, written
from greenframe.llm.units import library_ids, tokenizer_path


class Rows:
    """Stands for a table: runs what mapInArrow() gets on ``batch`` at once, in this process."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return list(function(iter([self.batch])))


def test_a_worker_keeps_the_memory_of_one_operator(spark):
    profiles = language.Profiles(["x"], language.np.ones((1, 64), language.np.float32))
    assert profiles.best("some words")[0] == "x"
    vectors = weakref.ref(language.vectors(64))
    gc.collect()
    assert vectors() is not None and language.vectors(64) is vectors()
    library = weakref.ref(library_ids(tokenizer_path("byte_bpe_50k.json"), False))
    gc.collect()
    assert vectors() is None and library() is not None
    assert list(library().ids("some words")) == list(library_ids(tokenizer_path("byte_bpe_50k.json"), False).ids("some words"))
    signed = near.signed(Rows(pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([b"some words"])})))
    gc.collect()
    assert signed[0].num_rows == 1 and library() is None
    assert profiles.best("some words")[0] == "x"


def test_rows_go_to_workers_in_bounded_batches(spark):
    def held(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    before = {name: spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 5000) AS t").mapInArrow(held, "n long, bytes long")
    got = written(rows, "held", batch=1 << 20).collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 1.2 * (1 << 20)
    assert before == {name: spark.conf.get(name) for name in before}


def test_stages_take_small_batches(spark, folder, monkeypatch):
    sizes = {}
    for module in (near, packing):
        monkeypatch.setattr(module, "written", lambda df, label, **more: sizes.__setitem__(label, more.get("batch")) or written(df, label, **more))
    near.without_near_copies(documents(spark, folder))
    packing.packed_documents(documents(spark, folder))
    assert {sizes[x] for x in ("signed", "bags", "pieces")} == {1 << 22}
