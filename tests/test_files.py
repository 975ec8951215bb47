import io
import os
import zipfile

import pytest

from weftline.sources import files as F


@pytest.mark.parametrize("path,parts", [("/a/b", ("", "/", "a/b")), ("/", ("", "/", "")), ("s3://bucket/a/b", ("s3", "s3://bucket", "a/b")), ("/s3:/bucket/a", ("s3", "s3://bucket", "a")), ("file:///a/b", ("", "/", "a/b")), (r"C:\x\y", ("", "C:/", "x/y")), ("/C:/x", ("", "C:/", "x")), ("mem://a", ("mem", "mem://a", ""))])
def test_roots(path, parts):
    assert F.split_root(path) == parts


def test_paths_without_roots():
    for bad in ("", "a/b", "s3://"):
        with pytest.raises(ValueError):
            F.split_root(bad)
    with pytest.raises(NotImplementedError):
        F.split_root(r"\\host\share")


def test_joining_and_absolute_paths(tmp_path):
    assert F.join("s3://b/", "x", "y") == "s3://b/x/y" and F.join("/a", "b") == "/a/b"
    assert F.abs_path("file:///a/b") == "/a/b" and F.abs_path("s3://b/x") == "s3://b/x"
    before = os.getcwd()
    with pytest.raises(KeyError), F.chdir(str(tmp_path)):
        assert F.abs_path("x") == str(tmp_path / "x")
        raise KeyError
    assert os.getcwd() == before


def test_files(spark, tmp_path):
    fs, top = F.Files(spark), str(tmp_path / "top")
    assert not fs.exists(top) and fs.makedirs(top) == top and fs.isdir(top) and not fs.isfile(top)
    with pytest.raises(FileExistsError):
        fs.makedirs(top)
    fs.makedirs(top, exist_ok=True)
    fs.write_text(f"{top}/a/b.txt", "é")
    assert fs.read_text(f"{top}/a/b.txt") == "é" and fs.isfile(f"{top}/a/b.txt") and fs.read_bytes(f"file://{top}/a/b.txt") == "é".encode()
    fs.write_bytes(f"{top}/c.bin", bytes(range(256)))
    assert fs.read_bytes(f"{top}/c.bin") == bytes(range(256))
    fs.touch(f"{top}/c.bin")
    assert fs.read_bytes(f"{top}/c.bin") == b""
    with pytest.raises(FileNotFoundError):
        fs.touch(f"{top}/no/x")
    fs.touch(f"{top}/no/x", auto_mkdir=True)
    assert fs.glob(f"{top}/*.bin") == [f"{top}/c.bin"] and fs.glob(f"{top}/**/*.txt") == [f"{top}/a/b.txt"]
    with pytest.raises(OSError):
        fs.rm(f"{top}/a")
    fs.rm(f"{top}/a", recursive=True)
    assert not fs.exists(f"{top}/a")
    for missing in (lambda: fs.rm(f"{top}/z"), lambda: fs.read_bytes(f"{top}/z")):
        with pytest.raises(FileNotFoundError):
            missing()


def test_views_below_a_folder(spark, tmp_path):
    top = F.Files(spark).folder(str(tmp_path / "sub"))
    top.write_text("a/b.txt", "x")
    assert (tmp_path / "sub/a/b.txt").read_text() == "x" and top.isfile("/a/b.txt") and top.isdir("/")
    inner = top.folder("a")
    assert inner.read_text("b.txt") == "x"
    assert not top.folder("a", recreate=True).exists("b.txt")


def test_archives(spark, tmp_path):
    fs, target = F.Files(spark), str(tmp_path / "x.zip")
    with fs.zip_temp(target) as folder:
        os.makedirs(f"{folder}/d")
        with open(f"{folder}/d/a.txt", "w") as f:
            f.write("hi")
    with fs.unzip_temp(target) as folder:
        assert open(f"{folder}/d/a.txt").read() == "hi"
    assert not os.path.exists(folder)
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../out.txt", "x")
    evil.seek(0)
    with pytest.raises(ValueError), fs.unzip_temp(evil):
        pass


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    fs = F.Files(spark)
    assert [r[0] for r in fs.texts(str(tmp_path / "a.txt")).collect()] == ["x\ny"]
    assert bytes(fs.binaries(str(tmp_path / "a.txt")).select("content").first()[0]) == b"x\ny"


def test_folders_above_a_file_and_permissions(spark, tmp_path):
    fs = F.Files(spark)
    with pytest.raises(FileNotFoundError):
        fs.write_bytes(f"{tmp_path}/no/such/x", b"1", create_dir=False)
    assert not fs.exists(f"{tmp_path}/no")
    fs.write_text(f"{tmp_path}/a/x", "1")
    fs.write_text(f"{tmp_path}/a/y", "2", create_dir=False)
    assert fs.read_text(f"{tmp_path}/a/y") == "2"
    below = fs.folder(f"{tmp_path}/own", permissions=0o750)
    assert (tmp_path / "own").stat().st_mode & 0o777 == 0o750 and below.exists("")
    fs.folder(f"{tmp_path}/own", permissions=0o700)
    assert (tmp_path / "own").stat().st_mode & 0o777 == 0o750
