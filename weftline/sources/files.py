"""Files through Hadoop's file systems, so that a path means the same here as in spark.read. Tables are read and written by
Spark itself; these are for paths, small texts and archives on the driver."""

from __future__ import annotations

import contextlib
import os
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")
_DRIVE = re.compile(r"[A-Za-z]:[\\/]")


@contextlib.contextmanager
def chdir(path: str) -> Iterator[None]:
    before = os.getcwd()
    os.chdir(abs_path(path))
    try:
        yield
    finally:
        os.chdir(before)


def has_scheme(path: str) -> bool:
    return _SCHEME.match(path) is not None


def abs_path(path: str) -> str:
    """Local paths absolute, without file://; others as they are."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return path if has_scheme(path) else os.path.abspath(path)


def join(base: str, *paths: str) -> str:
    return posixpath.join(base.rstrip("/") if has_scheme(base) else base, *paths) if has_scheme(base) else os.path.join(base, *paths)


def split_root(path: str) -> tuple[str, str, str]:
    """(scheme, root, relative path) of an absolute path; scheme is empty for local ones. Repairs what file APIs make of
    URLs: `/s3:/a`, `file://`, backslashes after a drive. A path without a root is a ValueError."""
    if not path:
        raise ValueError("no path")
    if path.startswith("\\\\"):
        raise NotImplementedError("network shares of Windows")
    if _DRIVE.match(path.lstrip("/")):
        path = path.lstrip("/").replace("\\", "/")
        return "", path[:3], posixpath.normpath(path[3:] or ".").strip("/").removeprefix(".")
    path = re.sub(r"^/+([A-Za-z][A-Za-z0-9+.-]+):/+", r"\1://", path)
    path = re.sub(r"^file:/*", "/", path)
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]+):/+([^/]*)(.*)", path):
        if not m[2]:
            raise ValueError(f"{path} has no host")
        return m[1], f"{m[1]}://{m[2]}", m[3].strip("/")
    if not path.startswith("/"):
        raise ValueError(f"{path} is relative")
    return "", "/", posixpath.normpath(path).strip("/")


class Files:
    """One view of all file systems that the session reaches. Absolute paths only, but for local ones, which may be relative.

    With a root, paths are below it.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self._jvm = spark._jvm

    def _at(self, path: str) -> tuple[Any, Any]:
        path = path if self.root is None else join(self.root, path.strip("/")) if path.strip("/") else self.root
        path = path if has_scheme(path) else "file://" + os.path.abspath(path)
        return self.file_system(path), self._jvm.org.apache.hadoop.fs.Path(path)

    def file_system(self, url: str) -> Any:
        """Hadoop's file system of a URL; a subclass may give another."""
        return self._jvm.org.apache.hadoop.fs.Path(url).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, path: str, recreate: bool = False, permissions: int | None = None) -> Files:
        """A view below a folder, which is made if it is not there, or made anew; it gets the permissions, such as 0o750, where it is made."""
        if recreate and self.exists(path):
            self.rm(path, recursive=True)
        made = not self.exists(path)
        self.makedirs(path, exist_ok=True)
        if permissions is not None and made:
            fs, p = self._at(path)
            fs.setPermission(p, self._jvm.org.apache.hadoop.fs.permission.FsPermission(oct(permissions)[2:]))
        return type(self)(self.spark, path if self.root is None else join(self.root, path.strip("/")))

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def isdir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def isfile(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def touch(self, path: str, auto_mkdir: bool = False) -> None:
        fs, p = self._at(path)
        if not auto_mkdir and p.getParent() is not None and not fs.exists(p.getParent()):
            raise FileNotFoundError(str(p.getParent()))
        fs.create(p, True).close()

    def rm(self, path: str, recursive: bool = False) -> None:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        if not recursive and fs.getFileStatus(p).isDirectory() and len(fs.listStatus(p)):
            raise OSError(f"{path} is not empty")
        fs.delete(p, recursive)

    def makedirs(self, path: str, exist_ok: bool = False) -> str:
        fs, p = self._at(path)
        if not exist_ok and fs.exists(p):
            raise FileExistsError(path)
        fs.mkdirs(p)
        return abs_path(path)

    def glob(self, pattern: str) -> list[str]:
        """Paths that match, with ** for any depth."""
        if "**" in pattern:
            top, _, rest = pattern.partition("**")
            fs, p = self._at(top.rstrip("/") or "/")
            files, found = fs.listFiles(p, True), []
            rest = re.compile("(.*/)?" + re.escape(rest.strip("/")).replace(r"\*", "[^/]*") + r"\Z")
            while files.hasNext():
                path = files.next().getPath().toString()
                if rest.match(path.split(p.toUri().getPath(), 1)[-1].strip("/")):
                    found.append(path)
        else:
            fs, p = self._at(pattern)
            found = [s.getPath().toString() for s in fs.globStatus(p) or []]
        return sorted(abs_path(f) if f.startswith("file:") else f for f in found)

    def write_bytes(self, path: str, data: bytes, create_dir: bool = True) -> None:
        """Makes the folders above as well, or without create_dir raises FileNotFoundError if they are missing."""
        fs, p = self._at(path)
        if not create_dir and not fs.exists(p.getParent()):
            raise FileNotFoundError(str(p.getParent()))
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_text(self, path: str, text: str, create_dir: bool = True) -> None:
        self.write_bytes(path, text.encode(), create_dir)

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode()

    @contextlib.contextmanager
    def zip_temp(self, target: Any) -> Iterator[str]:
        """A temporary folder of the driver that is zipped to a path or file object at the end."""
        with tempfile.TemporaryDirectory() as folder:
            yield folder
            with tempfile.TemporaryFile() as archive:
                with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                    for top, _, names in os.walk(folder):
                        for n in names:
                            z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), folder))
                archive.seek(0)
                if isinstance(target, str):
                    self.write_bytes(target, archive.read())
                else:
                    target.write(archive.read())

    @contextlib.contextmanager
    def unzip_temp(self, source: Any) -> Iterator[str]:
        """A temporary folder of the driver with an archive's files; members that would leave it are refused."""
        with tempfile.TemporaryDirectory() as folder, tempfile.TemporaryFile() as archive:
            archive.write(self.read_bytes(source) if isinstance(source, str) else source.read())
            archive.seek(0)
            with zipfile.ZipFile(archive) as z:
                for n in z.namelist():
                    if not os.path.realpath(os.path.join(folder, n)).startswith(os.path.realpath(folder) + os.sep):
                        raise ValueError(f"{n} leaves the archive")
                z.extractall(folder)
            yield folder

    def texts(self, path: str) -> DataFrame:
        """Whole files as rows, read by the executors."""
        return self.spark.read.text(path, wholetext=True)

    def binaries(self, path: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(path)
