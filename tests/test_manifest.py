"""Digest trees over files, and digests of files of any size."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from sluicegate.operators import fingerprint as fp
from sluicegate.operators import manifest
from sluicegate.session import settle


def test_files_add_up_to_the_table_and_only_new_ones_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a table")
    rows = spark.range(200).select("id", (F.col("id") * 0.5).alias("x"), (F.col("id") % 4).cast("int").alias("k"))
    rows.repartition(2).write.partitionBy("k").parquet(path)
    whole = fp.fingerprint(rows).first()
    first = settle(manifest.file_manifest(spark, path, rows.schema))
    assert first.count() == 8 and {r["folder"] for r in first.collect()} == {f"k={i}" for i in range(4)}
    total = manifest.added_up(first).first()
    assert (total["n_rows"], total["fingerprint"], total["n_files"]) == (200, whole["fingerprint"], 8)
    read = []
    real = manifest._file_lanes
    monkeypatch.setattr(manifest, "_file_lanes", lambda s, p, schema, files, *rest: read.append(files) or real(s, p, schema, files, *rest))
    same = settle(manifest.file_manifest(spark, path, rows.schema, first))
    assert read == [] and {r["status"] for r in manifest.compare_manifests(first, same, "file").collect()} == {"same"}
    extra = spark.createDataFrame([(900, 1.0)], "id bigint, x double")
    extra.coalesce(1).write.mode("append").parquet(f"{path}/k=2")
    extra.where("false").coalesce(1).write.parquet(f"{path}/k=9")
    after = settle(manifest.file_manifest(spark, path, rows.schema, same))
    assert len(read) == 1 and {f.split("/")[-2] for f in read[0]} <= {"k=2", "k=9"}
    told = {r["folder"]: r["status"] for r in manifest.compare_manifests(same, after).collect()}
    assert told["k=2"] == "changed" and {told[f"k={i}"] for i in (0, 1, 3)} == {"same"}
    grown = rows.union(spark.createDataFrame([(900, 1.0, 2)], rows.schema))
    assert manifest.added_up(after).first()["fingerprint"] == fp.fingerprint(grown).first()["fingerprint"]


def test_digests_of_files_beyond_two_gigabytes(spark, tmp_path):
    large, small = tmp_path / "large file.bin", tmp_path / "small.bin"
    small.write_bytes(b"abc" * 1000)
    (tmp_path / "empty.bin").write_bytes(b"")
    size = (1 << 31) + 5
    with open(large, "wb") as out:  # sparse: takes no room
        out.truncate(size - 3)
        out.seek(size - 3)
        out.write(b"end")
    wanted = hashlib.sha256()
    zeros = bytes(1 << 24)
    for at in range(0, size - 3, 1 << 24):
        wanted.update(zeros[: min(1 << 24, size - 3 - at)])
    wanted.update(b"end")
    found = {os.path.basename(r["path"]): (r["n_bytes"], r["fingerprint"]) for r in manifest.file_digests(spark, str(tmp_path), chunk=1 << 20).collect()}
    assert found == {
        "large file.bin": (size, wanted.hexdigest()),
        "small.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest()),
    }
