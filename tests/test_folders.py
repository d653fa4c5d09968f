"""Listings and clearing of real folders."""

import os

import pytest
from pyspark.sql import functions as F

from trackloom.sources import folders as D


@pytest.fixture
def root(tmp_path):
    for folder, names in {"run-1": ["chunk-00001.csv", "chunk-2.csv", "deep/er/chunk-00007.csv"], "run 2": ["a.bin", "chunk-x.csv", "chunk-3.csv.tmp"], "run-3": ["é.txt"]}.items():
        for k, name in enumerate(names):
            path = tmp_path / "root" / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x" * (10 * k + len(folder)))
    (tmp_path / "root" / "loose.txt").write_bytes(b"1234")
    (tmp_path / "root" / "run-1" / "_hidden").write_bytes(b"not seen")
    return str(tmp_path / "root")


def walked(root):
    out = {}
    for at, _, names in os.walk(root):
        if "/." in at[len(root) :]:
            continue
        for name in names:
            if name[0] not in "._":
                inside = os.path.relpath(os.path.join(at, name), root)
                out[inside] = os.path.getsize(os.path.join(root, inside))
    return out


def test_listing_equals_a_walk(spark, root):
    want = walked(root)
    files = D.listing(spark, root)
    assert sorted((r.folder, r.name, r.length) for r in files.where("folder is not null").collect()) == sorted((k.split("/")[0], os.path.basename(k), n) for k, n in want.items() if "/" in k)
    assert [(r.name, r.length) for r in files.where("folder is null").collect()] == [("loose.txt", 4)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    sizes = {r.folder: (r.files, r.bytes) for r in D.folder_sizes(files).collect()}
    assert sizes["run 2"] == (3, sum(n for k, n in want.items() if k.startswith("run 2/")))
    assert sorted(r.chunk for r in D.chunk_files(files).collect()) == [1, 2, 7]
    with pytest.raises(FileNotFoundError):
        D.listing(spark, root + "-none")


def test_folders_created_since(spark, root):
    D.listing(spark, root).write.parquet(root + "-before")
    os.makedirs(f"{root}/run-4/in")
    with open(f"{root}/run-4/in/f", "w") as f:
        f.write("x")
    os.makedirs(f"{root}/run-9")
    open(f"{root}/run-9/empty", "wb").close()  # no byte: not listed
    assert [r.folder for r in D.created(spark.read.parquet(root + "-before"), D.listing(spark, root)).collect()] == ["run-4"]


def test_clearing_looks_twice(spark, root):
    """In use at first: untouched. In use the second time: back again. A new folder of the name: it stays, the old one goes."""
    for name in ("run-4", "run-5"):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/old", "w") as f:
            f.write(name)
    before, calls = walked(root), []

    def in_use():
        calls.append(1)
        if len(calls) == 2:
            os.makedirs(f"{root}/run-5")
            with open(f"{root}/run-5/new", "w") as f:
                f.write("new")
        return spark.createDataFrame([(n,) for n in (["run-1"] if len(calls) == 1 else ["run-1", "run-3"])] + [(None,)], "folder string")

    got = {r.folder: (r.files, r.bytes, r.state) for r in D.clear(spark, root, in_use).collect()}
    size = lambda name: sum(n for k, n in before.items() if k.startswith(name + "/"))
    assert got == {"run 2": (3, size("run 2"), "deleted"), "run-3": (1, size("run-3"), "kept"), "run-4": (1, 5, "deleted"), "run-5": (1, 5, "replaced")}
    left = {k: n for k, n in before.items() if k.split("/")[0] in ("run-1", "run-3", "loose.txt")} | {"run-5/new": 3}
    assert walked(root) == left and len(calls) == 2
    assert os.listdir(f"{root}/{D.LEAVING}") == [] and os.path.exists(f"{root}/run-1/_hidden")


def test_what_a_broken_clearing_left_is_swept(spark, root):
    def fails():
        if os.path.exists(f"{root}/{D.LEAVING}"):
            raise RuntimeError("broken off")
        return spark.createDataFrame([("run-1",)], "folder string")

    with pytest.raises(RuntimeError):
        D.clear(spark, root, fails)
    assert {r.folder for r in D.listing(spark, root).collect()} == {"run-1", None}
    assert D.sweep(spark, root) and not os.path.exists(f"{root}/{D.LEAVING}")
    everything = spark.createDataFrame([("run-1",)], "folder string")
    assert D.clear(spark, root, lambda: everything).collect() == []
    assert D.listing(spark, root).where(F.col("folder") == "run-1").count() == 3
