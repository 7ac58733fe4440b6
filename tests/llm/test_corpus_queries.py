"""Registered queries against their SQL twins, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import collections
import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_corpus_small import brute_components, brute_lines, words

import corpus_pipeline
from trailwarden.llm import mixing, packing, toxicity
from trailwarden.llm.common import table
from trailwarden.llm.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in all_queries()) == list(range(1, 14))
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(all_oracles()[name])
    columns = [c[0] for c in want.description]
    got = all_queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(want.fetchall())


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dup", "mixing", "packing"]

    kept = stages["toxicity"](spark, docs, SF).cache()
    scored = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, table(spark, SF, "labels")).collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scored.items() if not p)

    lines = stages["line_dedup"](spark, kept, SF).cache()
    assert lines.columns == docs.columns
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in lines.collect()) == sorted((i, t, len(t)) for i, _, _, t in want)

    single = stages["near_dup"](spark, lines, SF).cache()
    assert single.columns == docs.columns
    want = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5)
    assert sorted(r.doc_id for r in single.collect()) == [i for i, _, _, stays in want if stays]

    mixed = stages["mixing"](spark, single, SF).cache()
    assert mixed.columns == docs.columns
    sizes = collections.Counter()
    for r in single.collect():
        sizes[r.source] += len(words(r.text))
    targets = {r.source: r.target for r in mixing.source_targets(single.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    times = collections.Counter(r.doc_id for r in mixed.collect())
    for r in single.collect():
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= times[r.doc_id] <= math.ceil(rate)

    packed = stages["packing"](spark, mixed, SF).collect()
    encode = packing.WordEncoder(packing.vocabulary_path()).tokenizer.encode
    want = collections.Counter()
    for r in mixed.collect():
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048])
            want[r.doc_id, at // 2048, at, len(part) // 4, zlib.crc32(part)] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.length))
    for placed in ends.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))]
        assert sum(n for _, n in placed) <= 2048
    assert len(ends) <= math.ceil(sum(r.length for r in packed) / 2048) + 1

    assert collections.Counter(map(tuple, packed)) == collections.Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
