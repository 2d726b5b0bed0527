"""Token files, whitening and fill-in-the-middle against the library, exact arithmetic and brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicegate.llm import fill_middle, rans, token_files, whitening
from sluicegate.llm.queries import QUERIES
from sluicegate.session import shared_dir

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def place_of(ids):
    symbols, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return rans.Table.of_counts(symbols, counts), places


@pytest.mark.parametrize("n", [0, 1, 63, 64, 129, 5000, 200_000])
def test_blocks_decode_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype("<u4")
    table, places = place_of(ids)
    assert not n or int(table.frequencies.sum()) == 1 << table.bits and table.frequencies.min() > 0
    words, marks, before = rans.encode(places, table)
    decoder = rans.Decoder(rans.Table.from_bytes(table.to_bytes()))
    for first, last in {(0, n), (0, n // 2), (n // 3, n // 2), (n * 3 // 4, n), (max(0, n - 1), n)}:
        assert (decoder.decode(words, marks, before, n, first, last) == ids[first:last]).all()
    if n == 200_000:
        p = np.bincount(places) / n
        assert words.nbytes * 8 < 1.02 * n * float(-(p * np.log2(p)).sum()) + 64 * marks.shape[1]
        with pytest.raises(ValueError):
            decoder.decode(words[:-2], marks, before, n)


def test_one_symbol_and_large_ids():
    ids = np.full(10_000, 4_000_000_000, dtype="<u4")
    table, places = place_of(ids)
    words, marks, before = rans.encode(places, table)
    assert len(words) == 0 and (rans.Decoder(table).decode(words, marks, before, len(ids)) == ids).all()


def test_documents_over_block_borders_and_damage():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 5, 0, *[300] * 30, 5000, 1, 1, 1, 0, 0])
    keys = [None, *range(1, len(lengths))]
    ids = (rng.zipf(1.3, int(lengths.sum())) % 900).astype("<u4")
    parts = list(token_files.file_parts(keys, lengths, ids, 700))
    ends = np.cumsum([len(p[0]) for p in parts])
    data = b"".join(p[0] for p in parts)
    starts = np.cumsum(lengths) - lengths
    wanted = [(k, s, ids[s : s + n].tolist()) for k, s, n in zip(keys, starts.tolist(), lengths.tolist(), strict=True)]
    file = token_files._File(pa.BufferReader(data))
    for step in (1, 3, 100):
        found = []
        for i in range(0, len(parts) - 1, step):
            found += [(k, p, x.tolist()) for k, p, x in file.documents(int(ends[i]), min(step, len(parts) - 1 - i))]
        assert found == wanted
    damaged = bytearray(data)
    damaged[int(ends[0]) + token_files.HEAD.size + 30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files._File(pa.BufferReader(bytes(damaged))).documents(int(ends[0]), 1))
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files._File(pa.BufferReader(bytes(damaged)))


def wanted_tokens(rows, end=2):
    library = Tokenizer.from_file(VOCABULARY)
    coded = [(k, library.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in rows]
    return coded


def test_token_files_hold_what_the_library_gives(llm, documents, rows):
    folder = token_files.token_folder(shared_dir(llm))
    manifest = token_files.write_tokens(documents.repartition(3), VOCABULARY, folder, part_bytes=60_000, block_tokens=500, file_tokens=20_000)
    assert manifest.select("path").distinct().count() > 2 and manifest.count() > 20
    found = [tuple(r) for r in token_files.read_tokens(llm, manifest, 2).select("doc_id", "start", "n_tokens", "ids").collect()]
    told = Counter((k, np.array(ids, "<u4").tobytes()) for k, ids in wanted_tokens(rows))
    assert Counter((k, ids) for k, _, _, ids in found) == told
    found.sort(key=lambda r: r[1])
    assert [r[0] or -1 for r in found] == sorted(r[0] or -1 for r in found)
    at = 0
    for _, start, n, ids in found:
        assert start == at and n == len(ids) // 4
        at += n


def test_token_files_of_the_given_table_and_of_none(llm, documents):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    wanted, at = set(), 0
    for key, ids in wanted_tokens(sorted(rows)):
        wanted.add((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in QUERIES["op11_token_files"](llm, SMALL).collect()} == wanted
    none = token_files.write_tokens(documents.limit(0), VOCABULARY, token_files.token_folder(shared_dir(llm)))
    assert token_files.read_tokens(llm, none).count() == 0


def test_copies_of_one_row_fill_several_files(llm):
    df = llm.range(3000).select(F.lit(7).alias("doc_id"), F.lit("the same words again and again").alias("text"))
    manifest = token_files.write_tokens(df, VOCABULARY, token_files.token_folder(shared_dir(llm)), part_bytes=40_000)
    assert manifest.select("part").distinct().count() >= 6
    found = token_files.read_tokens(llm, manifest)
    n = found.first()["n_tokens"]
    assert sorted(r[0] for r in found.select("start").collect()) == [i * n for i in range(3000)]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(d)]
    return sums, [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(d)] for i in range(d)]


def vectors(llm):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(400, None, "x"), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (402, [math.nan] + [0.0] * 5, "x"), (403, [math.inf] + [0.0] * 5, "x")]
    rows += [(404, [], "x"), (None, base[0].tolist(), "x"), (3, base[3].tolist(), "x"), (3, base[3].tolist(), "x"), (405, [0.0] * 6, "x")]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>, extra string")
    return df.withColumns({"n": F.lit("n"), "component": F.lit(1), "x": F.lit("x"), "whitened": F.lit(0), "i": F.lit(1)}).repartition(4)


def kept(df):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(k, [math.floor(1024 * c) + 100_000 for c in v]) for k, v in good]


def test_whitening_equals_exact_arithmetic(llm):
    df = vectors(llm)
    points = kept(df)
    x = [p for _, p in points]
    n = len(x)
    sums, scatter = exact_covariance(x)
    found = whitening.moments(whitening.fixed_point(df, "vec_id", "embedding"))
    assert (found.n, found.sums) == (n, sums)
    assert [[v * n for v in row] for row in found.scatter] == scatter
    rows = whitening.whiten(df, components=8).collect()
    assert len(rows) == n * 6
    told = Counter((k, sum((n * a - s) ** 2 for a, s in zip(p, sums, strict=True))) for k, p in points)
    assert Counter((r["vec_id"], int(r["deviation"])) for r in rows if r["component"] == 1) == told
    values, basis = np.linalg.eigh(np.array([[float(v) for v in row] for row in scatter]) / n**3)
    order = np.argsort(-values)
    centred = np.array(x, dtype=np.float64) - np.array(sums) / n
    for place, at in enumerate(order, 1):
        own = sorted(r["whitened"] for r in rows if r["component"] == place)
        one = centred @ basis[:, at] / math.sqrt(values[at])
        assert min(np.abs(np.sort(one) - own).max(), np.abs(np.sort(-one) - own).max()) < 1e-7
        assert {round(r["explained"] / (values[at] / values.sum()) - 1, 9) for r in rows if r["component"] == place} == {0}
    assert rows[0]["identity_error"] < 1e-9


def test_whitening_of_large_values_and_without_variance(llm):
    big = [(i, [1e9 * i, -3e12 * (i % 3), 5.0]) for i in range(20)]
    df = llm.createDataFrame(big, "vec_id bigint, embedding array<double>")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in big]
    found = whitening.moments(whitening.fixed_point(df, "vec_id", "embedding"))
    assert [[v * found.n for v in row] for row in found.scatter] == exact_covariance(x)[1]
    flat = {r["component"]: r for r in whitening.whiten(df).collect()}
    assert flat[3]["whitened"] is None and flat[3]["explained"] == 0 and flat[1]["whitened"] is not None
    one = whitening.whiten(df.limit(1)).collect()
    assert len(one) == 3 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {(None, None, None, 0)}
    assert whitening.whiten(df.limit(0)).count() == 0
    mixed = df.union(llm.createDataFrame([(1, [1.0])], df.schema))
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(mixed)


def test_whitening_of_the_given_table(llm):
    rows = QUERIES["op12_whitening"](llm, SMALL).collect()
    x = np.array([p for _, p in kept(llm.read.parquet(f"{SMALL}/embeddings.parquet"))])
    assert len(rows) == len(x) * 8 and rows[0]["identity_error"] < 1e-9
    n, sums = len(x), x.sum(axis=0)
    told = Counter(int(v) for v in ((n * x - sums) ** 2).sum(axis=1))
    assert Counter(r["deviation"] for r in rows if r["component"] == 1) == told
    assert all(r["deviation_exact"] == r["deviation"] for r in rows)


def brute_middle(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    told = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return key, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return key, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_middles_equal_brute_force(llm, documents):
    rng = np.random.default_rng(9)
    alphabet = list("abzAZ@[`{ \n\0<PSM>$\\é漢😀ﬁ́\u007f\u0080")
    odd = [(int(i), "".join(rng.choice(alphabet, size=int(rng.integers(0, 60))))) for i in range(1000, 1800)]
    odd += [(1, "<P>a"), (2, "x <S>"), (3, "<M"), (4, "P><M>"), (None, "null key"), (5, "a" * 4096), (6, "é" * 4096)]
    df = documents.select("doc_id", "text").union(llm.createDataFrame(odd, "doc_id bigint, text string"))
    df = df.withColumns({"n": F.lit("n"), "form": F.lit("f"), "output": F.lit("o")})
    found = fill_middle.fill_in_middle(df)
    again = found.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert Counter(tuple(r)[:-1] for r in again) == Counter(brute_middle(*r) for r in rows)
    assert Counter((r["doc_id"], r["again"]) for r in again) == Counter((k, t or "") for k, t in rows)
    assert {r["form"] for r in again} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_groups_of_texts_do_not_change_middles(llm, documents, monkeypatch):
    whole = fill_middle._cut([1, 2, 3, 4], [b"ab", b"", b"cd e", "é".encode()]).to_pylist()
    each = [fill_middle._cut([k], [t]).to_pylist()[0] for k, t in ((1, b"ab"), (2, b""), (3, b"cd e"), (4, "é".encode()))]
    assert whole == each and [r["n"] for r in whole] == [1, 0, 3, 1]
