"""Stores: a folder of tables and arrays with a manifest, flat or as a tree."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.expr import Expr, compile_text, quoted
from granary.operators.ndarray import Array
from granary.operators.table import Table
from granary.sources import tabular


class _Files:
    """Small text files in whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.conf), path

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file by renaming a complete one over it."""
        fs, path = self._at(name)
        _, fresh = self._at(f"{name}.new")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.delete(path, False)
        fs.rename(fresh, path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class Store:
    """Paths to tables, arrays and saved expressions; ``/`` makes a tree."""

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, root: str, mode: str = "a", prefix: str = ""):
        if mode not in ("r", "a", "w"):
            raise ValueError("mode is r, a or w")
        self.spark, self.root, self.mode, self.prefix = spark, root.rstrip("/"), mode, prefix.strip("/")
        self.files = _Files(spark, self.root)
        if mode == "w":
            self.files.delete("")
        self._entries = json.loads(self.files.read(self.MANIFEST) or '{"entries": {}, "meta": {}}')

    # Keys

    def _key(self, name: str) -> str:
        name = name.strip("/")
        return "/".join(p for p in (self.prefix, name) if p)

    def _below(self) -> dict[str, dict]:
        start = f"{self.prefix}/" if self.prefix else ""
        return {k[len(start) :]: v for k, v in self._entries["entries"].items() if k.startswith(start)}

    def keys(self) -> list[str]:
        return sorted(self._below())

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self._below())

    def __contains__(self, name: str) -> bool:
        return self._key(name) in self._entries["entries"]

    def values(self) -> list:
        return [self[k] for k in self.keys()]

    def items(self) -> list[tuple[str, Any]]:
        return [(k, self[k]) for k in self.keys()]

    # Entries

    def __setitem__(self, name: str, value: Any) -> None:
        self._writable()
        key = self._key(name)
        if not key or self.MANIFEST in key:
            raise ValueError(f"not a key: {name!r}")
        clash = [k for k in self._entries["entries"] if k.startswith(key + "/") or key.startswith(k + "/")]
        if clash:
            raise ValueError(f"{name!r} is below or above {clash[0]!r}")
        path = f"data/{key}"
        self.files.delete(path)
        entry: dict[str, Any] = {"path": path}
        if isinstance(value, Array):
            entry |= {"kind": "array", "shape": list(value.shape)}
            value.write(f"{self.root}/{path}")
        elif isinstance(value, Table):
            entry |= {"kind": "table", "computed": {k: e.text for k, e in value.computed.items()}}
            entry["generated"] = {k: e.text for k, e in value.generated.items()}
            stored = [c for c in value.columns if c not in value.computed]
            df = value.df.orderBy(*value.order).select(*[F.col(quoted(c)) for c in stored])
            df.write.parquet(f"{self.root}/{path}")
        elif isinstance(value, Expr):
            entry |= {"kind": "expression", "text": value.text}
        else:
            raise TypeError(f"a store keeps tables, arrays and expressions, not {type(value).__name__}")
        self._entries["entries"][key] = entry
        self._save()

    def __getitem__(self, name: str) -> Any:
        key = self._key(name)
        if key not in self._entries["entries"]:
            if any(k.startswith(key + "/") for k in self._entries["entries"]):
                return self.get_subtree(name)
            raise KeyError(name)
        entry = self._entries["entries"][key]
        path = f"{self.root}/{entry['path']}"
        if entry["kind"] == "expression":
            return compile_text(entry["text"])
        if entry["kind"] == "array":
            return Array.read(self.spark, path)
        table = tabular.read_parquet(self.spark, path, separate_nested_cols=False)
        for kind in ("generated", "computed"):
            for column, text in entry[kind].items():
                expression = compile_text(text)
                getattr(table, kind)[column] = expression
                if kind == "computed":
                    table.df = table.df.withColumn(column, expression.bind(table.schema).col)
        return table

    def get(self, name: str, default: Any = None) -> Any:
        try:
            return self[name]
        except KeyError:
            return default

    def __delitem__(self, name: str) -> None:
        self._writable()
        key = self._key(name)
        doomed = [k for k in self._entries["entries"] if k == key or k.startswith(key + "/")]
        if not doomed:
            raise KeyError(name)
        for k in doomed:
            self.files.delete(self._entries["entries"].pop(k)["path"])
        self._save()

    def _writable(self) -> None:
        if self.mode == "r":
            raise ValueError("the store is open for reading")

    def _save(self) -> None:
        self.files.write(self.MANIFEST, json.dumps(self._entries))

    # Copies

    def copy_to(self, root: str, overwrite: bool = False) -> Store:
        """The whole store as another folder, copied file by file."""
        fs, source = self.files._at("")
        target = self.files.jvm.org.apache.hadoop.fs.Path(root)
        to = target.getFileSystem(self.files.conf)
        if to.exists(target):
            if not overwrite:
                raise FileExistsError(root)
            to.delete(target, True)
        self.files.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, target, False, self.files.conf)
        return Store(self.spark, root, "a")

    def pack(self, path: str, overwrite: bool = False) -> str:
        """The whole store as one zip file, streamed through the driver a buffer at a time."""
        jvm, (fs, source) = self.files.jvm, self.files._at("")
        target = jvm.org.apache.hadoop.fs.Path(path)
        to = target.getFileSystem(self.files.conf)
        if to.exists(target) and not overwrite:
            raise FileExistsError(path)
        out = jvm.java.util.zip.ZipOutputStream(to.create(target, True))
        prefix = fs.makeQualified(source).toString().rstrip("/") + "/"
        found = fs.listFiles(source, True)
        while found.hasNext():
            file = found.next().getPath()
            out.putNextEntry(jvm.java.util.zip.ZipEntry(file.toString().removeprefix(prefix)))
            stream = fs.open(file)
            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
            stream.close()
            out.closeEntry()
        out.close()
        return path

    @classmethod
    def unpack(cls, spark: SparkSession, path: str, root: str, overwrite: bool = False) -> Store:
        """A store from a zip file that ``pack`` wrote, in a folder of its own."""
        files = _Files(spark, root)
        fs, target = files._at("")
        if fs.exists(target):
            if not overwrite:
                raise FileExistsError(root)
            fs.delete(target, True)
        source = files.jvm.org.apache.hadoop.fs.Path(path)
        stream = files.jvm.java.util.zip.ZipInputStream(source.getFileSystem(files.conf).open(source))
        while (entry := stream.getNextEntry()) is not None:
            name = entry.getName()
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"a file outside the store: {name!r}")
            _, place = files._at(name)
            out = fs.create(place, True)
            files.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
            out.close()
        stream.close()
        return cls(spark, root)

    # Tree

    def get_children(self, path: str = "/") -> list[str]:
        start = path.strip("/")
        start = f"{start}/" if start else ""
        return sorted({start + k[len(start) :].split("/")[0] for k in self._below() if k.startswith(start)})

    def get_descendants(self, path: str = "/") -> list[str]:
        start = path.strip("/")
        start = f"{start}/" if start else ""
        found = set()
        for k in self._below():
            if k.startswith(start):
                parts = k[len(start) :].split("/")
                found |= {start + "/".join(parts[: i + 1]) for i in range(len(parts))}
        return sorted(found)

    def walk(self, path: str = "/", topdown: bool = True) -> Iterator[tuple[str, list[str], list[str]]]:
        """(path, inner nodes, leaves) for every inner node."""
        children = self.get_children(path)
        leaves = [c for c in children if c in self]
        inner = [c for c in children if c not in leaves]
        here = (path, [c.rsplit("/", 1)[-1] for c in inner], [c.rsplit("/", 1)[-1] for c in leaves])
        if topdown:
            yield here
        for c in inner:
            yield from self.walk(c, topdown)
        if not topdown:
            yield here

    def get_subtree(self, path: str) -> Store:
        out = Store(self.spark, self.root, "r" if self.mode == "r" else "a", self._key(path))
        out._entries = self._entries
        return out

    @property
    def meta(self) -> dict:
        """Metadata of this node; change it with set_meta."""
        return dict(self._entries["meta"].get(self.prefix, {}))

    def set_meta(self, **values: Any) -> None:
        self._writable()
        self._entries["meta"].setdefault(self.prefix, {}).update(values)
        self._save()


def save_table(table: Table, path: str, mode: str = "error") -> None:
    """One table as a folder of Parquet; specifications travel in its schema."""
    tabular.write_parquet(table, path, mode=mode)


def open_table(spark: SparkSession, path: str) -> Table:
    table = tabular.read_parquet(spark, path, separate_nested_cols=False)
    table.is_view = False
    return table


def load_table(spark: SparkSession, path: str) -> Table:
    """An opened table whose rows Spark keeps in memory."""
    table = open_table(spark, path)
    table.df = table.df.persist()
    return table


__all__ = ["Store", "load_table", "open_table", "save_table"]
