"""WARC archives, neighbours, the quality classifier, the registered queries and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sluicegate.llm import neighbours, quality, warc
from sluicegate.llm.oracles import ORACLES
from sluicegate.llm.queries import QUERIES
from sluicegate.session import settle
from workload.check import compare, oracle_connection

SMALL = "/root/testdata/sf0.001"
GZIP = "\x1f\x8b\x08"


@pytest.fixture(scope="module")
def pages(llm):
    rows = [
        (1, "http://a/1", "<p>" + "x" * 2000),
        (2, "http://a/2", "<p>" + "x" * 2000),
        (7, None, "<p>" + "x" * 2000),
        (3, "http://a/3", "short"),
        (4, "http://a/4\r\nWARC-Type: fake", "short"),
        (5, "", None),
        (6, "u", ""),
        (None, "n", "<p>" + "x" * 2000),
        (8, "é", "é" * 499 + "ab"),
        (9, "é", "é" * 499 + "ab"),
        (10, "m", (GZIP + "WARC/1.1\r\n\r\n") * 300),
        (11, "m", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3),
        (12, "big", "".join(map(str, range(200_000)))),
        (13, "r", "y" * 1500),
        (13, "r", "y" * 1500),
    ]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.withColumns({"digest": F.lit("d"), "same": F.lit(1), "payload": F.lit("p")}).repartition(3)


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 777])
def test_archives_give_back_every_page(llm, pages, split):
    manifest = warc.write_archives(warc.with_revisits(pages), warc.archive_folder(llm), max_bytes=300)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == pages.count()
    found = Counter(tuple(r) for r in warc.read_archives(llm, manifest, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    last = {}
    for key, body in rows:
        last[body] = max((k for k in (last.get(body), key) if k is not None), default=None)
    wanted = Counter()
    for key, body in rows:
        other = last[body] if len(body) >= 1000 and last[body] != key else None
        wanted[(key, len(body), hashlib.sha1(body).hexdigest(), "response" if other is None else "revisit", other)] += 1
    assert found == wanted


def test_archives_are_plain_gzip_members(llm, pages):
    manifest = warc.write_archives(warc.with_revisits(pages), warc.archive_folder(llm)).collect()
    text = b""
    for r in manifest:
        rest = open(r["path"].removeprefix("file://"), "rb").read()
        while rest:
            member = zlib.decompressobj(31)
            text += member.decompress(rest)
            rest = member.unused_data
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count() + 3 and b"\nWARC-Type: fake" not in text


def test_a_damaged_payload_is_an_error():
    data = warc.record(1, "u", b"payload", "0" * 40, None)
    with pytest.raises(ValueError):
        warc.parse(data)


def test_no_pages(llm, pages):
    manifest = warc.write_archives(warc.with_revisits(pages.where("false")), warc.archive_folder(llm))
    assert warc.read_archives(llm, manifest).count() == 0


def brute_neighbours(vectors, queries, k):
    out = {}
    for q, x in queries.items():
        scored = sorted(((-float(np.dot(x, v)), i) for i, v in vectors.items() if i != q and len(v) == len(x)))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_of_few_vectors_are_exact(llm):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=5).round(3).tolist() for i in range(60)}
    vectors |= {i: vectors[3] for i in range(100, 160)} | {200: [1.0, 2.0], 201: [2.0, 1.0]}
    bad = [(300, None), (301, [0.0] * 5), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (None, [1.0] * 5)]
    rows = [*vectors.items(), *bad]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"home": F.lit(1), "id": F.lit(2), "score": F.lit(3)})
    asked = {i: v for i, v in vectors.items() if i % 20 == 0}
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wanted = brute_neighbours(vectors, asked, 20)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in wanted.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in wanted for a, b in zip(got[q], wanted[q], strict=True))
    assert [r["rank"] for r in found if r["query_id"] == 0] and max(r["rank"] for r in found) == 20


def test_recall_over_many_leaves():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.3, size=(4000, 32))
    queries = vectors[::50]
    which, best = neighbours.search(vectors, queries, 20, float((vectors**2).sum(axis=1).max()))
    products = queries @ vectors.T
    exact = np.argsort(-products, axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(which.tolist(), exact.tolist(), strict=True)])
    assert recall >= 0.95
    assert np.allclose(best, np.take_along_axis(products, which, axis=1))


def test_chi_square():
    assert neighbours.chi_square_cut(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_cut(0.99, 2) == pytest.approx(9.210, abs=1e-3)


def test_no_vectors(llm):
    df = llm.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(df, df).count() == 0


def test_quality_on_held_out_labels(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scores(docs, labels)
    judged = found.join(labels, "doc_id").where("held_out").toPandas()
    assert found.count() == docs.count() and found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert (judged["predicted"] == judged["quality"]).mean() >= 0.97
    assert judged[judged["quality"] == 1]["predicted"].mean() >= 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.where("predicted = 1").count()


def test_labels_of_zero_and_of_held_out_rows_change_nothing(llm):
    docs, labels = (llm.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = F.when(quality.held_out(F.col("doc_id")) | (F.col("quality") == 0), F.lit(None)).otherwise(F.col("quality"))
    a = quality.scores(docs, labels).orderBy("doc_id").toPandas()
    b = quality.scores(docs.repartition(5), labels.withColumn("quality", turned)).orderBy("doc_id").toPandas()
    assert a.equals(b)
    assert [r[0] for r in docs.select(quality.held_out(F.col("doc_id"))).limit(50).collect()] == [
        zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in docs.select("doc_id").limit(50).collect()
    ]


def test_the_prior_is_estimated():
    rng = np.random.default_rng(4)
    positive, rest = rng.normal(2, 1, 3000), rng.normal(-2, 1, 900)
    assert quality.estimate_prior(positive, np.concatenate([rng.normal(2, 1, 2100), rest])) == pytest.approx(0.7, abs=0.05)


def test_quality_without_anything_to_learn_from(llm, documents):
    labels = llm.createDataFrame([], "doc_id bigint, quality int")
    found = quality.scores(documents, labels).collect()
    assert len(found) == documents.count() and {r["score"] for r in found} == {0.5}
    model = llm.createDataFrame([(i, 1) for i in range(12)], "doc_id bigint, quality int")
    assert quality.scores(documents, model).where("score IS NULL").count() == 0
    assert quality.scores(documents.where("false"), labels).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


@pytest.fixture(scope="module")
def stages(llm):
    df, out = llm.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        df = settle(stage(llm, df, SMALL))
        out.append(df)
    return out


def test_pipeline_stages(llm, stages):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    good, single, apart, masked, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] >= ids[1] >= ids[2] == ids[3] == ids[4]
    folded = {}
    for r in good.collect():
        key = r["text"].translate({c: c + 32 for c in range(65, 91)})
        folded[key] = max(folded.get(key, -1), r["doc_id"])
    assert ids[1] == set(folded.values())
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in (apart, masked))
    assert all(before[i] == t or "[secret]" in t for i, t in after.items())
    assert masked.where("n_chars <> length(text)").count() == 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_takes_odd_documents(llm, documents):
    odd = documents.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    for df in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = settle(stage(llm, df, SMALL))
        assert "sequence_id" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_oracles(llm, name):
    assert compare(llm, oracle_connection(SMALL), SMALL, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_give_all_rows(llm, name):
    found = QUERIES[name](llm, SMALL)
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").count()
    if name == "op8_neighbours":
        assert found.count() == 25 * 20
    elif name == "op12_whitening":
        assert found.count() == 8 * llm.read.parquet(f"{SMALL}/embeddings.parquet").count()
    else:
        assert found.select("doc_id").distinct().count() == docs
