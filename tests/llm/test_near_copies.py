"""Near copies by five-word Jaccard similarity, compared with all pairs."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluicegate.llm import near_copies, quality, simhash
from sluicegate.session import settle

SMALL = "/root/testdata/sf0.001"


def five_words(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_all_pairs(rows):
    """The smallest doc_id of every component of texts with a Jaccard similarity of 0.8 or more."""
    sets, root = {i: five_words(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        shared = len(sets[i] & sets[j])
        if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def edited_texts():
    """Texts with few and with many edits, a dense group, copies, and texts too short for a shingle."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    texts = []
    for edits in (1, 2, 3, 4, 6, 8, 12, 20):  # of 200 words: similarity from 0.95 to far below 0.8
        base = words(200)
        other = list(base)
        for at in rng.choice(200, edits, replace=False):
            other[at] = "changed"
        texts += [base, other]
    base = words(150)
    for _ in range(60):
        other = list(base)
        other[rng.integers(150)] = f"x{rng.integers(10**6)}"
        texts.append(other)
    texts += [words(3), [], words(80), words(5)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, " ".join(texts[0]).upper()), (901, ""), (902, None), (903, " ".join(texts[-2]))]


@pytest.mark.parametrize("most", [near_copies.MOST, 5])
def test_near_copies_are_those_of_all_pairs(llm, monkeypatch, most):
    rows = edited_texts()
    monkeypatch.setattr(near_copies.links, "__defaults__", (most,))
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = corpus_pipeline.drop_near_copies(llm, df, SMALL)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == kept_by_all_pairs(rows)


def varied(n, length, edits, seed=1):
    """Texts of one base, each with some random edits."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, length)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.choice(length, edits, replace=False):
            own[at] = f"x{rng.integers(10**9)}"
        out.append((i, " ".join(own)))
    return out


def linked(llm, rows):
    body = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("at", F.md5("text"))
    nodes = settle(near_copies.described(body).select(F.col("doc_id").alias("id"), "fp", "size", "sketch"))
    return near_copies.links(nodes).count()


def test_only_texts_that_can_have_a_near_copy_are_dealt_to_shards(llm, monkeypatch):
    rng = np.random.default_rng(9)
    alone = [(100 + i, " ".join(f"v{j}" for j in rng.integers(0, 10**9, 60))) for i in range(50)]
    rows, dealt, real = varied(6, 120, 1) + alone, [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda nodes: dealt.append(nodes.count()) or real(nodes))
    kept = {r["doc_id"] for r in near_copies.keep_one(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert dealt == [6] and kept == kept_by_all_pairs(rows) == {0, *range(100, 150)}


def test_a_node_is_sent_to_a_bounded_number_of_parts_of_its_cell(llm):
    nodes = llm.createDataFrame([(i, i % 3, 100, bytes(near_copies.BINS)) for i in range(1000)], "id bigint, fp bigint, size bigint, sketch binary")
    parts = near_copies.cell_parts(nodes, 0, most=10)
    assert set(parts.values()) == {near_copies.PARTS}
    assert near_copies.routed(nodes, 0, parts).count() <= 1000 * near_copies.PARTS
    assert set(near_copies.cell_parts(nodes, 0, most=500).values()) == {2}


@pytest.mark.parametrize("edits", [1, 6, 9])
def test_links_grow_with_the_nodes_of_a_group(llm, edits):
    """Dense groups give trees, and so do unlike neighbours that estimates do not tell apart, however many they are."""
    found = [linked(llm, varied(n, 120, edits)) for n in (150, 600)]
    assert found[1] <= 2 * 600 and (edits > 1 or found[1] >= 599)


def test_recall_against_all_pairs(llm):
    """Pairs at 0.8 or more of texts with few edits: nearly all are judged alike, and hardly one well below."""
    right = wrong = pairs = far = 0
    rng = np.random.default_rng(2)
    for seed in range(400):
        length = int(rng.integers(12, 400))
        (_, a), (_, b) = varied(2, length, int(rng.integers(0, max(2, length // 40) + 1)), seed)
        x, y = five_words(a), five_words(b)
        j = len(x & y) / len(x | y)
        one, two = near_copies.shingles(a), near_copies.shingles(b)
        near = (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= near_copies.RADIUS
        alike = near and near_copies.estimates(near_copies.sketch(one), near_copies.sketch(two)) >= near_copies.ESTIMATE
        pairs, right = pairs + (j >= 0.8), right + (j >= 0.8 and alike)
        far, wrong = far + (j < 0.7), wrong + (j < 0.7 and alike)
    assert pairs > 100 and far > 50 and right >= 0.97 * pairs and wrong <= 0.02 * far


def links_left_out():
    """Pairs at 0.8 or more that fingerprints or estimates reject, and groups at 0.8 in which the likest member may fail."""
    texts = []
    for seed in range(400):  # edits seven words or more apart, as many as 0.8 allows
        words = [f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, 49 + 45 * (seed % 4))]
        other = list(words)
        other[10::45] = [f"x{seed}y{i}" for i in range(len(words[10::45]))]
        # Repeated lines weigh in fingerprints, not in sets.
        pair = [words, other] if seed % 50 else [words + 30 * words[:9], words + 30 * words[20:29]]
        a, b = map(" ".join, pair)
        one, two = near_copies.shingles(a), near_copies.shingles(b)
        far = (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > near_copies.RADIUS
        low = near_copies.estimates(near_copies.sketch(one), near_copies.sketch(two)) < near_copies.ESTIMATE
        if near_copies.similar(one, two) and (far or low):
            texts += [a, b]
    rejected = len(texts) // 2
    for seed in range(4):
        texts += [t for _, t in varied(60, 100 + 10 * seed, 2, 5000 + seed)]
    return rejected, list(enumerate(texts))


@pytest.mark.parametrize("load", [None, 400])
def test_no_link_at_the_threshold_is_left_out(llm, monkeypatch, load):
    rejected, rows = links_left_out()
    if load:
        monkeypatch.setattr(near_copies.missed, "__defaults__", (load,))
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    assert rejected >= 5 and kept == kept_by_all_pairs(rows)


def test_sets_share_so_many_hashes_in_their_heads():
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 400]:
        extra = n // 9
        for m in {n - extra, n}:
            drawn = rng.choice(1 << 62, 3 * n, replace=False).astype("u8")
            # Of n hashes and m others, the fewest in common that reach 0.8; also with all common ones last.
            both = next(c for c in range(m + 1) if 5 * c >= 4 * (n + m - c))
            for order in (drawn, np.sort(drawn)[::-1]):
                common, rest = order[:both], order[both:]
                a = np.sort(np.concatenate([common, rest[: n - both]]))
                b = np.sort(np.concatenate([common, rest[n - both : n + m - 2 * both]]))
                shared = len(np.intersect1d(near_copies.head(a), near_copies.head(b)))
                assert near_copies.similar(a, b) and shared >= -(-4 * n // 5) // near_copies.SPARE + 1


def test_rows_that_share_a_doc_id_are_judged_by_their_text(llm):
    (_, a), (_, b) = varied(2, 100, 1, 3)
    (_, c), (_, d) = varied(2, 100, 1, 4)
    df = llm.createDataFrame([(3, a), (5, b), (5, c), (9, d)], "doc_id bigint, text string")
    df = df.withColumns({"at": F.lit("x"), "component_id": F.lit(1), "id": F.lit(2), "class": F.lit(3)})
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(3, a), (5, c)}


def test_near_copies_take_odd_documents(llm, documents):
    assert near_copies.keep_one(documents.where("false")).count() == 0
    kept = near_copies.keep_one(documents)
    assert kept.columns == documents.columns and kept.where("doc_id IS NULL").count() == 2
    assert {r[0] for r in kept.select("doc_id").collect()} == {None, 1, 3, 6, 8, 9, 10, 11}


def test_the_near_copy_stage_keeps_what_all_pairs_keep(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_exact_copies):
        docs = settle(stage(llm, docs, SMALL))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(llm, docs, SMALL).select("doc_id").collect()}
    assert kept == kept_by_all_pairs([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_the_quality_stage_keeps_what_a_directly_fitted_model_accepts(llm):
    docs, labels = (llm.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "labels"))
    learnt = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    x = {r["doc_id"]: quality.features(r["text"]) for r in docs}
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    p, u = (np.array([x[i] for i in x if learnt(i) and (every or i in good)]) for every in (False, True))
    model = quality.fit(p[np.lexsort(p.T)], u[np.lexsort(u.T)])
    wanted = {i for i, v in x.items() if model.score(v[None])[0] >= 0.5}
    kept = corpus_pipeline.keep_quality(llm, llm.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert 0 < len(wanted) < len(x) and {r["doc_id"] for r in kept.collect()} == wanted
