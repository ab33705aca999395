"""Source trees in archives: round trips, splits, and what is passed over."""

import io
import os
import tarfile
import zipfile

import pytest

from faultlens.sources import archives

FILES = [("r1", "src/a.py", "x = 1\n"), ("r1", "b.java", "class B { String s = \"é漢\"; }\r\n"), ("r2", "deep/er/c.go", ""),
         ("r2", "node_modules/d.js", "no"), ("r2", "readme.md", "no"), ("r2", "x.py.txt", "no"), ("r1", "Makefile", "no"),
         ("r3", "src/" + "long/" * 40 + "e.rb", "puts 1\n" * 5000), ("r3", ".git/f.py", "no"), ("r3", "g.swift", None)]
KEPT = sorted((r, p, (c or "").replace("\r\n", "\n")) for r, p, c in FILES if c != "no")


def files_of(spark, rows=FILES):
    return spark.createDataFrame(rows, "repo_url string, path string, content string")


def rows_of(frame):
    return sorted((r.repo_url, r.path, r.content) for r in frame.collect())


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "zip"])
@pytest.mark.parametrize("split", [archives.SPLIT, 700])
def test_round_trip(spark, tmp_path, kind, split):
    folder = str(tmp_path / "packed")
    archives.write_archives(files_of(spark).repartition(3), folder, kind)
    assert all(n.endswith("." + kind) for n in os.listdir(folder) if not n.startswith("_"))
    assert rows_of(archives.read_archives(spark, folder, split)) == KEPT
    listed = archives.list_archives(spark, folder, split).collect()
    assert sorted((r.repo_url, r.path, r.language) for r in listed if r.path == "g.swift") == [("r3", "g.swift", "swift")]
    assert sorted((r.path, r.size_bytes) for r in listed if r.language == "ruby")[0][1] == 35_000


def test_splits_part_large_archives(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"r{i % 5}", f"f{i:04d}.py", "x" * (i % 700)) for i in range(600)]
    archives.write_archives(files_of(spark, rows).coalesce(1), folder)
    read = archives.read_archives(spark, folder, 50_000)
    assert read.rdd.getNumPartitions() > 5
    assert rows_of(read) == sorted(rows)


def test_ranges_begin_with_a_member(tmp_path):
    """Reading all ranges passes each header once or twice, however many ranges there are;
    names that don't fit a header and headers for all members are kept."""
    path = str(tmp_path / "a.tar")
    names = [f"r/{'long/' * (30 * (i % 2))}f{i}.py" for i in range(300)]
    with tarfile.open(path, "w", pax_headers={"comment": "all"}) as out:
        for i, name in enumerate(names):
            member = tarfile.TarInfo(name)
            member.size = i
            out.addfile(member, io.BytesIO(b"x" * i))
    with open(path, "rb") as file:
        ranges = list(archives._tar_ranges(file, 4096))
    assert len(ranges) > 30 and all(h == low for (_, h, _), (low, _, _) in zip(ranges, ranges[1:]))
    assert all("all" in headers for _, _, headers in ranges[1:])
    passed, found, step = [], [], tarfile.TarFile.next
    class Counted(tarfile.TarFile):
        def next(self):
            passed.append(1)
            return step(self)
    for low, high, headers in ranges:
        with open(path, "rb") as file, pytest.MonkeyPatch.context() as patch:
            patch.setattr(tarfile.TarFile, "next", Counted.next)
            found += [(name, body()) for name, _, body in archives._tar_members(file, low, high, False, headers)]
    assert found == [(name, b"x" * i) for i, name in enumerate(names)]
    assert len(passed) <= len(names) + 3 * len(ranges)


def test_archives_made_elsewhere(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as out:
        for name, body in (("./repo/x.py", b"a = 1\n"), ("top.py", b"b\n"), ("repo/bad.py", b"\xff\xfe")):
            member = tarfile.TarInfo(name)
            member.size = len(body)
            out.addfile(member, io.BytesIO(body))
        link = tarfile.TarInfo("repo/link.py")
        link.type, link.linkname = tarfile.SYMTYPE, "x.py"
        out.addfile(link)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as out:
        out.writestr("repo2/", "")
        out.writestr("repo2/y.kt", "val a = 1")
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    tarfile.open(tmp_path / "_lost.tar", "w").close()
    (tmp_path / "notes.txt").write_text("no archive")
    rows = {(r.repo_url, r.path): (r.content, r.decode_ok) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert rows == {("repo", "x.py"): ("a = 1\n", True), (None, "top.py"): ("b\n", True),
                    ("repo", "bad.py"): (None, False), ("repo2", "y.kt"): ("val a = 1", True)}


def test_an_empty_folder(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).collect() == []


def test_unknown_kinds_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no such kind"):
        archives.write_archives(files_of(spark), str(tmp_path), "rar")
