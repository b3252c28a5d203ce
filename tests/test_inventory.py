"""Scans by rounds: every file once, whatever the tree's shape, and the driver sees counts only."""

import os

import pytest

from photoflow.sources import inventory as V
from photoflow.sources.inventory import scan_inventory


def make(root, names):
    for n in names:
        p = os.path.join(root, n)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        os.mknod(p)


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


@pytest.mark.parametrize("shape", ["flat", "chain", "bushy", "comb"])
@pytest.mark.parametrize(("entries", "names"), [(V.ENTRIES, V.NAMES), (7, 3), (1, 1), (40, 1000)])
def test_shapes(spark, tmp_path, shape, entries, names):
    root = str(tmp_path)
    if shape == "flat":
        make(root, [f"f{k}.jpg" for k in range(60)])
    elif shape == "chain":
        make(root, ["/".join(["d"] * k + [f"{k}.jpg"]) for k in range(1, 25, 3)])
    elif shape == "bushy":
        make(root, [f"a{i}/b{j}/{k}.jpg" for i in range(3) for j in range(3) for k in range(3)])
    else:
        make(root, [f"a{i}/" + "x/" * i + f"{k}.jpg" for i in range(5) for k in range(4)])
    found, rounds = V.walked(spark, root, True, entries, names, parts=4)
    rows = found.collect()
    assert sorted(os.path.relpath(r.path, root) for r in rows) == listed(root) and not any(r.failure for r in rows)
    assert rounds == 1 if entries == V.ENTRIES else rounds <= 60
    flat = V.walked(spark, root, False, entries, names)[0]
    assert sorted(r.path for r in flat.collect()) == sorted(e.path for e in os.scandir(root) if e.is_file())


def test_a_chain_500_deep_is_a_round(spark, tmp_path):
    here = os.open(tmp_path, os.O_RDONLY)
    for k in range(500):
        os.mkdir("d", dir_fd=here)
        here, old = os.open("d", os.O_RDONLY, dir_fd=here), here
        os.close(old)
        os.mknod(f"{k}.jpg", dir_fd=here)
    os.close(here)
    found, rounds = V.walked(spark, str(tmp_path), True)
    assert found.count() == 500 and rounds == 1


def test_a_flat_folder_is_listed_once(spark, tmp_path):
    root = str(tmp_path / "many")
    os.mkdir(root)
    for k in range(100_000):
        os.mknod(f"{root}/_{k}.jpg")
    found, rounds = V.walked(spark, root, True)
    assert rounds == 2 and found.select("path").distinct().count() == 100_000
    files, errors = scan_inventory(spark, root)
    assert files.where("file_size = 0 and file_extension = 'jpg'").count() == 100_000 and errors.count() == 0


def test_odd_entries(spark, tmp_path):
    make(str(tmp_path), ["a.jpg", "sub/b.jpg", ".hid/c.jpg", "sub/.hid/c.jpg", "sub/é\n.jpg"])
    os.mkdir(tmp_path / "empty")
    os.symlink(tmp_path / "sub", tmp_path / "loop")  # a link to a folder isn't followed
    os.symlink(tmp_path / "a.jpg", tmp_path / "link.jpg")
    os.symlink(tmp_path / "gone", tmp_path / "broken.jpg")
    os.mkfifo(tmp_path / "pipe.jpg")
    os.mknod(os.fsencode(tmp_path) + b"/\xff.jpg")
    files, errors = scan_inventory(spark, str(tmp_path), recursive=True)
    assert sorted(r.relative_path for r in files.collect()) == ["a.jpg", "link.jpg", "sub/b.jpg", "sub/é\n.jpg"]
    assert [(r.error.code, r.error.stage) for r in errors.collect()] == [("E_FILE_READ", "scan")]
    assert scan_inventory(spark, str(tmp_path / "empty"), recursive=True)[0].collect() == []
    one = scan_inventory(spark, str(tmp_path / "sub/b.jpg"))[0].collect()
    assert [r.relative_path for r in one] == ["b.jpg"]
    gone = V.walked(spark, str(tmp_path / "nowhere"), True)[0].collect()  # a folder that went meanwhile
    assert len(gone) == 1 and "nowhere" in gone[0].failure
