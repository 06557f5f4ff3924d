"""Tables that are replaced bucket by bucket, with a manifest per version."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import file_system

BUCKETS = 64
KEPT_VERSIONS = 2
_BUCKET = "tm_bucket"

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class BucketTable:
    """Rows dealt into buckets by a hash of `keys`, as versions below `path`.

    A version is a manifest: which version wrote each bucket last. `fold` rewrites only
    the buckets that a batch touches and then writes the manifest in one step, so readers
    see a version whole or not at all, and a version folded again starts from the one
    before it and replaces itself. The number of buckets is fixed by the first version.
    Files that the newest `KEPT_VERSIONS` manifests do not name are removed; a reader that
    takes longer than so many versions has to read again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def versions(self) -> list[int]:
        """Complete versions, newest first."""
        fs, root = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def manifest(self, before: int | None = None) -> dict | None:
        """Of the newest version (before `before`): buckets, schema, and the version that wrote each bucket."""
        for version in self.versions():
            if before is None or version < before:
                fs, at = file_system(self.spark, f"{self.path}/manifests/{version}")
                stream = fs.open(at)
                try:
                    return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return None

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of the newest version (before `before`), of some buckets; None before the first version."""
        known = self.manifest(before)
        if known is None:
            return None
        schema = T.StructType.fromJson(known["schema"])
        wanted = {b: v for b, v in known["written"].items() if only is None or int(b) in set(only)}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(v, b) for b, v in sorted(wanted.items())])

    def fold(self, version: int, batch: DataFrame, merge: Merge) -> None:
        """Version `version`: in each touched bucket, what `merge` makes of its rows and the batch's.

        `merge(known, batch)` gets None for `known` before the first version, keeps the keys and
        returns all rows of the touched buckets. The batch is read twice: hand over stored rows.
        """
        known = self.manifest(version)
        buckets = known["buckets"] if known else self.buckets
        at = self._bucket(buckets)
        touched = sorted(r[0] for r in batch.select(at.alias(_BUCKET)).distinct().collect())  # at most `buckets` numbers
        rows = merge(self.read(version, touched), batch)
        out = rows.withColumn(_BUCKET, at).repartition(max(1, len(touched)), _BUCKET)
        out.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/data/{version}")
        written = {b: v for b, v in (known["written"] if known else {}).items() if int(b) not in set(touched)}
        written |= {str(b): version for b in self._written(version)}
        self._commit(version, {"buckets": buckets, "schema": rows.schema.jsonValue(), "written": written})
        self._retire(version)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _folder(self, version: int, bucket: int | str) -> str:
        return f"{self.path}/data/{version}/{_BUCKET}={bucket}"

    def _written(self, version: int) -> list[int]:
        fs, root = file_system(self.spark, f"{self.path}/data/{version}")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")]

    def _commit(self, version: int, manifest: dict) -> None:
        """Write the manifest beside its place, then move it there."""
        fs, final = file_system(self.spark, f"{self.path}/manifests/{version}")
        _, draft = file_system(self.spark, f"{self.path}/manifests/{version}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.delete(final, False)
        if not fs.rename(draft, final):
            raise OSError(f"cannot write the manifest of version {version} of {self.path}")

    def _retire(self, newest: int) -> None:
        """Remove the manifests and bucket folders that no kept version needs."""
        versions = [v for v in self.versions() if v <= newest]
        kept = versions[:KEPT_VERSIONS]
        named = {(str(v), b) for k in kept for b, v in self.manifest(k + 1)["written"].items()}
        fs, data = file_system(self.spark, f"{self.path}/data")
        for version in [s.getPath().getName() for s in fs.listStatus(data)]:
            if int(version) > newest:
                continue
            own = self._written(int(version))
            dead = [b for b in own if (version, str(b)) not in named]
            for folder in [f"{data}/{version}"] if len(dead) == len(own) else [self._folder(int(version), b) for b in dead]:
                fs.delete(file_system(self.spark, folder)[1], True)
        for version in versions[KEPT_VERSIONS:]:
            fs.delete(file_system(self.spark, f"{self.path}/manifests/{version}")[1], False)
