"""The pipeline against plain Python and SQL, stage by stage, on the smallest tables."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np

import corpus_pipeline
from beatloom.llm import queries, toxicity
from beatloom.llm.common import Words, utf8_buffers
from tests.llm.test_llm import plain_components, plain_hits

DIR = "/root/testdata/sf0.001"


def plain_pipeline(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT * FROM '{DIR}/documents.parquet' ORDER BY doc_id").df()
    bench = con.execute(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet'").fetchall()
    read = lambda t: spark.read.parquet(f"{DIR}/{t}.parquet")
    model = toxicity.train(read("documents"), read("labels"))
    words, table = Words(toxicity.SEPARATORS), model.table()

    def score(text):
        import pyarrow as pa

        return model.scores(*utf8_buffers(pa.array([text])), words, table)[0]

    stages = [docs[[score(t) < 0.5 for t in docs["text"]]].reset_index(drop=True)]
    firsts = [i == c for i, (_, c) in enumerate(plain_components(list(stages[-1]["text"]), 5, 80))]
    stages.append(stages[-1][firsts].reset_index(drop=True))
    judged = [plain_hits(t, bench) for t in stages[-1]["text"]]
    stages.append(stages[-1][[not (hit and 20 * hit >= n) for n, hit, _ in judged]].reset_index(drop=True))
    con.register("documents", stages[-1])
    taken = con.execute(queries.OP7_SQL).df().set_index("doc_id")
    turns = [int(taken.loc[i, "taken"] // max(1, taken.loc[i, "size"])) for i in stages[-1]["doc_id"]]
    stages.append(stages[-1].loc[np.repeat(stages[-1].index, turns)].reset_index(drop=True))
    return stages


def test_stages_and_rows(spark):
    from tokenizers import Tokenizer

    want = plain_pipeline(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for (_, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.stored(stage(spark, docs, DIR), "test-stage")
        assert docs.columns == columns
        assert sorted(r.doc_id for r in docs.collect()) == sorted(rows["doc_id"])
    full = Tokenizer.from_file(queries.vocabulary())
    start, expected = 0, []
    for row in want[-1].sort_values("doc_id").itertuples():
        ids = np.array([*full.encode(row.text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        expected.append((row.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == expected


def test_stages_on_defined_cases(spark):
    """Nulls, no words, repeated rows, ties and further columns whose names clash."""
    rows = [(1, None, None, 5), (2, "", "s", 5), (3, "one two three", "s", 5), (3, "one two three", "s", 5), (None, "null id here", "t", None), (9, "w " * 50_000, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").selectExpr("*", "1 AS _score", "2 AS size", "3 AS turns", "'x' AS _row", "4 AS draw")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, DIR), "test-stage")
        if k < 4:
            assert out.columns == docs.columns
        docs = out
    ids = [r.doc_id for r in docs.collect()]
    assert set(ids) <= {None, 3, 9} and 3 in ids
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], "doc_id long, text string, source string")
        assert stage(spark, empty, DIR).count() == 0


