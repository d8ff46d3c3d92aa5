"""Tables as folders of Parquet under one root, changed all together by manifests.

A manifest names the folders of every table. A change writes new folders, then a manifest aside, and renames it to the next number, which
no other may have taken: a reader sees all of a change or none, a crash at any step leaves what was there, and of two writers that began
from one manifest the second gets an error. A manifest that cannot be read is passed over.

A change rewrites only folders with rows that it replaces. For folders of up to PRINTS rows the manifest keeps 32-bit fingerprints of their
keys, so that folders which cannot hold a changed key are not read; of larger ones the key columns are. Many small folders are one
after `compact`; `vacuum` removes what no kept manifest names.

A table may have a summary, counts by some of its columns, which is written beside each folder. Folders never change, so the sum of
the summaries of a manifest's folders is what counting all rows would give, after any changes, and reads no rows.
"""

from __future__ import annotations

import base64
import json
import re
import time
import uuid
import warnings
import zlib

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a folder whose keys the manifest tells, and changed keys that are tested on the driver (four bytes each).
PRINTS, TESTED = 1 << 14, 1 << 18


def _packed(prints: np.ndarray) -> str:
    return base64.b64encode(zlib.compress(np.diff(prints.astype(np.int64), prepend=0).astype("<u4").tobytes())).decode()


def _unpacked(text: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(base64.b64decode(text)), "<u4").astype(np.int64))


class Store:
    #: Schema and key of each table.
    tables: dict[str, str] = {}
    keys: dict[str, tuple[str, ...]] = {}
    #: Columns (name -> SQL) that a table's rows are counted by.
    summaries: dict[str, dict[str, str]] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, int]:
        """name -> time of its last change, in ms."""
        path, fs = self._path(folder)
        return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(path)} if fs.exists(path) else {}

    # -- manifests ---------------------------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(x[:10]) for x in self._names("manifests") if re.fullmatch(r"\d{10}\.json", x))

    def _manifest(self, n: int | None = None) -> dict:
        """The newest manifest that can be read, or number n. "next" is the number that a change after it takes."""
        there = self.versions()
        for k in reversed(there) if n is None else [n]:
            try:
                found = json.loads(self.spark.read.text(f"{self.root}/manifests/{k:010d}.json", wholetext=True).first()[0])
                return {"n": k, "tables": found["tables"], "prints": found.get("prints", {}), "next": there[-1] + 1}
            except (ValueError, KeyError, TypeError) as e:
                if n is not None:
                    raise ValueError(f"manifest {k} cannot be read") from e
                warnings.warn(f"manifest {k} cannot be read and is passed over", stacklevel=2)
        return {"n": 0, "tables": {}, "prints": {}, "next": there[-1] + 1 if there else 1}

    def table(self, name: str, manifest: dict | None = None, spark: SparkSession | None = None) -> DataFrame:
        """A table as it is, or as a manifest has it."""
        at, spark = (manifest or self._manifest())["tables"].get(name), spark or self.spark
        return spark.read.schema(self.tables[name]).parquet(*at) if at else spark.createDataFrame([], self.tables[name])

    def _publish(self, base: dict, **changed: list[str]) -> None:
        """The manifest after base; raises RuntimeError if another writer has taken its number."""
        tables = base["tables"] | changed
        there = {x for at in tables.values() for x in at}
        prints = {k: v for k, v in base.get("prints", {}).items() if k in there}
        aside, fs = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps({"n": base["next"], "tables": tables, "prints": prints}).encode())
        out.close()
        jvm = self.spark._jvm
        final = self._path(f"manifests/{base['next']:010d}.json")[0]
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise RuntimeError("another writer has changed the tables; begin again") from None
            raise

    # -- folders -----------------------------------------------------------------------------------------------------
    def _prints_of(self, rows: DataFrame, name: str, most: int) -> np.ndarray | None:
        """Sorted fingerprints of the keys of rows; None if there are more than `most`."""
        found = rows.select((F.xxhash64(*self.keys[name]).bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).limit(most + 1).toArrow()["h"].to_numpy()
        return np.unique(found) if len(found) <= most else None

    def _may_hold(self, base: dict, name: str, gone: DataFrame) -> list[str]:
        """Folders of a table that may hold a key of gone."""
        at, told = base["tables"].get(name, []), base["prints"]
        asked = self._prints_of(gone, name, TESTED) if any(x in told for x in at) else None
        if asked is None:
            return list(at)
        return [x for x in at if x not in told or np.isin(_unpacked(told[x]), asked).any()]

    def _add(self, base: dict, name: str, rows: DataFrame) -> str | None:
        """The path of a new folder with rows, None if there are none."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.tables[name]).columns).write.parquet(path)
        read = self.spark.read.schema(self.tables[name]).parquet(path)
        if name in self.summaries:
            self._counted(read, name).write.parquet(self._beside(path))
        prints = self._prints_of(read, name, PRINTS)
        if prints is not None:
            base["prints"][path] = _packed(prints)
        return path if prints is None or len(prints) else None

    def _new(self, base: dict, name: str, rows: DataFrame) -> tuple[list[str], DataFrame]:
        """Folders with rows, for a manifest to name, and what they hold: rows that a change looks at need not be written apart."""
        at = [x for x in (self._add(base, name, rows),) if x]
        return at, self.table(name, {"tables": {name: at}})

    @staticmethod
    def _beside(path: str) -> str:
        table, _, folder = path.rpartition("/")
        return f"{table}-summary/{folder}"

    def _counted(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*[F.expr(sql).alias(c) for c, sql in self.summaries[name].items()]).agg(F.count("*").alias("n"))

    def summary(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The summary's columns and n, several rows for one value where it stands in several folders."""
        at = (manifest or self._manifest())["tables"].get(name)
        empty = self._counted(self.spark.createDataFrame([], self.tables[name]), name)
        return self.spark.read.schema(empty.schema).parquet(*map(self._beside, at)) if at else empty

    def _put(self, base: dict, name: str, gone: DataFrame | None, new: DataFrame | None) -> list[str]:
        """Folders of the table without the rows whose key is in gone, and with new. Folders that hold none of them stay."""
        at, key = list(base["tables"].get(name, [])), list(self.keys[name])
        parts = []
        if at and gone is not None:
            gone = written(gone.select(*key).distinct())
            if maybe := self._may_hold(base, name, gone):
                folder = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
                read = lambda paths: self.spark.read.schema(self.tables[name]).parquet(*paths)
                hit = {r[0] for r in read(maybe).select(*key, folder.alias("__at")).join(gone, key, "left_semi").select("__at").distinct().collect()}
                touched = [x for x in maybe if x.rsplit("/", 1)[1] in hit]
                at = [x for x in at if x not in touched]
                if touched:
                    parts.append(read(touched).join(gone, key, "left_anti"))
        if new is not None:
            parts.append(new)
        return at + [x for rows in parts if (x := self._add(base, name, rows))]

    # -- upkeep ------------------------------------------------------------------------------------------------------
    def compact(self, least: int = 16) -> list[str]:
        """Tables of which `least` or more small folders have become one; what they hold stays the same."""
        base, changed = self._manifest(), {}
        for name, at in base["tables"].items():
            small = [x for x in at if x in base["prints"]]
            if len(small) >= least:
                rows = self.spark.read.schema(self.tables[name]).parquet(*small)
                one = self._add(base, name, rows.coalesce(max(1, len(small) * PRINTS // 1_000_000)))
                changed[name] = [x for x in at if x not in small] + [x for x in (one,) if x]
        if changed:
            self._publish(base, **changed)
        return sorted(changed)

    def vacuum(self, keep: int = 1, older_s: float = 86_400) -> int:
        """Deletes all but the last `keep` manifests that can be read, and folders older than older_s that none of these names; the number of both.

        Folders of a change that is under way are young; older_s must exceed the time that a change and a reader of an old manifest take.
        """
        named, held = set(), []
        for k in reversed(self.versions()):
            try:
                m = self._manifest(k)
            except ValueError:
                continue
            held.append(k)
            named |= {x for at in m["tables"].values() for x in at}
            if len(held) == max(1, keep):
                break
        until, gone = (time.time() - older_s) * 1000, 0
        for folder in ("manifests", *self.tables, *(f"{x}-summary" for x in self.summaries)):
            for x, changed in self._names(folder).items():
                if folder == "manifests":
                    dead = changed <= until and (not re.fullmatch(r"\d{10}\.json", x) or bool(held) and int(x[:10]) < held[-1])
                else:
                    dead = changed <= until and f"{self.root}/{folder.removesuffix('-summary')}/{x}" not in named
                if dead:
                    path, fs = self._path(f"{folder}/{x}")
                    gone += bool(fs.delete(path, True))
        return gone

    def reset(self) -> None:
        for name in (*self.tables, *(f"{x}-summary" for x in self.summaries), "manifests"):
            path, fs = self._path(name)
            fs.delete(path, True)
