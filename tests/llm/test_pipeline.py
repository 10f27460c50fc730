"""Each stage against brute force on a small fixture, and the whole run."""

import re
import tracemalloc
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leak_score
from tests.llm.test_decontaminate import norm
from tests.llm.test_near_dup import brute as groups
from tests.llm.test_token_store import plain
from tests.llm.test_toxicity import rows as toxic_rows
from tremorframe.llm import decontaminate as dc
from tremorframe.llm import store
from tremorframe.llm import text as tx
from tremorframe.llm import token_store as ts

ITEM = "which of the following passages was part of a benchmark that nobody should train on"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels = toxic_rows(240)
    docs = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in docs]
    docs += [(1000 + k, docs[4 * k + 1][1] + (" tail" if k % 2 else ""), "en", "src0", 0) for k in range(12)]
    docs += [(2000, "before " + ITEM.upper() + " after", "en", "src1", 0), (2001, ITEM[:30], "en", "src1", 0), (2002, None, "en", None, None), (2003, "", "en", "src1", 0), (docs[5][0], docs[5][1], "en", "src2", 1), (None, "no id at all here my friend", "de", "src2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(labels)


def test_stages(spark, folder):
    path, truth = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, path), name)
        seen.append(docs.collect())
        assert docs.columns == columns or name == "token_ids"
    start, calm, single, clean, mixed, ids = seen
    kept = {r.doc_id for r in calm}
    right = [(d in kept) != bool(t) for d, t in truth.items()]
    assert np.mean(right) > 0.97 and {2000, 2001, 2002, 2003, None} <= kept
    component = {d: c for d, _, c, _ in groups([(r.doc_id, r.text) for r in calm if r.doc_id is not None])}
    assert sorted(str(r.doc_id) for r in single) == sorted(str(d) for d in {d for d, c in component.items() if d == c} | {None})
    leaked = {r.doc_id for r in single if leak_score(r.text, ITEM) >= min(dc.LEAST, len(norm(ITEM)))}
    assert leaked == {2000} and {r.doc_id for r in clean} == {r.doc_id for r in single} - leaked
    words = {r.doc_id: len((r.text or "").split()) for r in clean}
    assert all(0 < len(r.text.split()) <= 2 * words[r.doc_id] for r in mixed)
    total = sum(len(r.text.split()) for r in mixed)
    assert abs(total - 1.5 * sum(words.values())) < 0.1 * total
    texts = [r.text for r in sorted(mixed, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]
    want = [np.array([*x, 2], "<u4") for x in plain(ts.byte_bpe_path(), texts)]
    assert [r.ids_crc32 for r in sorted(ids, key=lambda r: r.start)] == [zlib.crc32(x.tobytes()) for x in want]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert len(rows) > 100 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_python_gets_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    """A batch is held by the JVM outside its heap and by the worker once more, so it has no more than TEXT_ROWS texts, whatever the part's size."""
    spark.range(0, 3 * store.TEXT_ROWS, 1, 1).write.parquet(f"{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda s, docs, _: docs.mapInArrow(sizes, "n long"))])
    rows = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(rows) == 3 * store.TEXT_ROWS and max(rows) <= store.TEXT_ROWS and spark.conf.get(key) == before


def test_freed_memory_of_a_worker_goes_back():
    """A worker serves many tasks: what one stage has freed must not stay with it beside what the next one takes."""
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    empty, before = held(), pa.RecordBatch.from_pydict({"text": ["a"]})
    last = [bytes(1000) for _ in range(200_000)][-1]  # stands above what is freed, so that glibc keeps it
    full = held()
    assert [b.num_rows for b in tx.returned(iter([before]))] == [1]
    assert len(last) == 1000 and full - empty > 150 and held() - empty < 50


def test_leaks_are_sought_in_little_memory():
    """Normal forms and q-grams of a text take some 40 times its bytes, so few texts are worked through at a time."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(1500)]
    texts[700] += " " + ITEM
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1500), pa.int64()), "text": pa.array(texts)})
    index = SimpleNamespace(value=dc.Index([1], [ITEM]))
    tracemalloc.start()
    kept = [i for b in dc.clean_rows(iter([batch]), index, 1) for i in b["doc_id"].to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == [i for i in range(1500) if i != 700] and peak < 70e6
