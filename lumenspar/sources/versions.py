"""State in groups of rows below a folder, replaced group by group under a ledger of batches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedGroups:
    """Rows are spread over `groups` by a hash of their key; a batch writes only the groups it touches anew, below its own
    name. The manifest names the folder of each group and the batches that are done. It is replaced by a rename, so a batch
    counts wholly or not at all, and a batch that is done is never worked nor written again, however old it is."""

    MANIFEST = "MANIFEST"

    def __init__(self, spark: SparkSession, folder: str, groups: int = 64) -> None:
        self.spark, self.folder, self.groups = spark, folder.rstrip("/"), groups
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def manifest(self) -> dict:
        """{"groups": {group: folder}, "done": [batch]}."""
        if not self._fs.exists(self._path(f"{self.folder}/{self.MANIFEST}")):
            return {"groups": {}, "done": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/{self.MANIFEST}").first()[0])

    def group(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.groups)).cast("int")

    def touched(self, df: DataFrame, *key: str) -> set[int]:
        """The groups of a batch's rows: at most `groups` numbers."""
        return {r[0] for r in df.select(self.group(*key)).distinct().collect()}

    def read(self, manifest: dict, touched: set[int], schema: str) -> DataFrame | None:
        paths = sorted(f"{self.folder}/{manifest['groups'][str(g)]}/g={g}" for g in touched if str(g) in manifest["groups"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def replace(self, manifest: dict, touched: set[int], state: DataFrame, key: tuple[str, ...], batch: str) -> None:
        """Writes the touched groups' new rows and makes them current, with the batch in the ledger."""
        state.withColumn("g", self.group(*key)).repartition("g").write.mode("overwrite").partitionBy("g").parquet(f"{self.folder}/{batch}")
        held = {r[0] for r in state.select(self.group(*key)).distinct().collect()} if touched else set()  # a group may be empty now
        groups = {g: b for g, b in manifest["groups"].items() if int(g) not in touched} | {str(g): batch for g in held}
        text = json.dumps({"groups": groups, "done": [*manifest["done"], batch]})
        tmp = self._path(f"{self.folder}/{self.MANIFEST}.{batch}")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri()).rename(tmp, self._path(f"{self.folder}/{self.MANIFEST}"), overwrite)
