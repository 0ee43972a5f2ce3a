"""A graph's commits in one folder: numbered manifests, branch heads, tables as layers of Parquet.

manifest/NNNNNNNNNN.json appears by a rename that fails if the number is taken, which makes
every publish a compare-and-swap.  A manifest has all branch heads and at most one new
commit; a commit has its parents, the schema, and for each type a list of layers.  A layer
is a folder of new rows and a folder of ids that it removes from the layers below, so a
write costs its own size, not the table's; compaction folds layers together.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: a column that no table has: names begin with a letter
LAYER = "_layer"


class Conflict(RuntimeError):
    """Another writer moved the branch."""


@dataclass
class Commit:
    id: str
    version: int
    branch: str
    parents: list[str]
    schema: str
    tables: dict[str, list[dict]]
    time: str
    note: dict = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: dict[int, dict] = {}

    # -- files -------------------------------------------------------------
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a whole file under a name that nobody has taken; False if somebody has."""
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        temp = self._path(f"tmp/{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temp, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            fs.delete(temp, False)
            if "AlreadyExists" in str(e):
                return False
            raise

    # -- manifests ---------------------------------------------------------
    def manifests(self) -> dict[int, dict]:
        for name in self._names("manifest"):
            if name.endswith(".json") and (k := int(name[:-5])) not in self._seen:
                self._seen[k] = json.loads(self._read(f"manifest/{name}"))
        return dict(sorted(self._seen.items()))

    def latest(self) -> tuple[int, dict[str, str]]:
        all_ = self.manifests()
        return (max(all_), dict(all_[max(all_)]["branches"])) if all_ else (0, {})

    def commits(self) -> dict[str, Commit]:
        """All commits, oldest first."""
        return {m["commit"]["id"]: Commit(**m["commit"]) for m in self.manifests().values() if m.get("commit")}

    def publish(self, change, retries: int = 32) -> dict:
        """change(version, branches) gives (branches, commit or None) or raises; tried again if the number was taken meanwhile."""
        for _ in range(retries):
            version, branches = self.latest()
            branches, commit = change(version + 1, branches)
            body = {"branches": branches, "commit": asdict(commit) if commit else None}
            if self._create(f"manifest/{version + 1:010d}.json", json.dumps(body)):
                return body
        raise Conflict("too many writers")

    def commit(self, branch: str, parents: list[str], schema: str, tables: dict, expected: str | None, note: dict | None = None) -> Commit:
        def change(version: int, branches: dict) -> tuple[dict, Commit]:
            if branches.get(branch) != expected:
                raise Conflict(f"branch {branch} has moved")
            c = Commit(uuid.uuid4().hex, version, branch, parents, schema, tables, dt.datetime.now(dt.UTC).isoformat(), note or {})
            return branches | {branch: c.id}, c

        return Commit(**self.publish(change)["commit"])

    # -- tables ------------------------------------------------------------
    def write(self, df: DataFrame, type_name: str) -> str:
        name = f"data/{type_name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def rows(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def table(self, layers: list[dict], schema: T.StructType) -> DataFrame:
        """The rows that the layers leave; columns a layer lacks are null.

        A layer takes ids away from those below it.  However many layers there are, that is one aggregation of
        the ids and one join: a row stays if no layer above its own takes its id.
        """
        loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        ids = T.StructType([T.StructField("id", T.StringType())])
        data = [(k, x["data"]) for k, x in enumerate(layers) if x.get("data")]
        gone = [(k, x["gone"]) for k, x in enumerate(layers) if x.get("gone") and data and k > data[0][0]]
        if not data:
            return self.spark.createDataFrame([], loose)
        if not gone:
            return reduce(DataFrame.unionByName, [self.rows(name, loose) for _, name in data])
        fresh = [name for k, name in data if k >= gone[-1][0]]  # nothing is above these
        older = [self.rows(name, loose).withColumn(LAYER, F.lit(k)) for k, name in data if k < gone[-1][0]]
        taken = reduce(DataFrame.union, [self.rows(name, ids).select(F.col("id").alias(f"{LAYER}id"), F.lit(k).alias(f"{LAYER}k")) for k, name in gone])
        if len(gone) > 1:
            taken = taken.groupBy(f"{LAYER}id").agg(F.max(f"{LAYER}k").alias(f"{LAYER}k"))
        kept = reduce(DataFrame.unionByName, older)
        # an outer join: an anti join would be pushed into the union, one for each layer
        kept = kept.join(taken, F.col("id") == F.col(f"{LAYER}id"), "left").where(F.col(f"{LAYER}k").isNull() | (F.col(LAYER) >= F.col(f"{LAYER}k"))).drop(LAYER, f"{LAYER}id", f"{LAYER}k")
        return reduce(DataFrame.unionByName, [self.rows(name, loose) for name in fresh], kept)

    def touched(self, layers: list[dict]) -> DataFrame | None:
        """id: what the layers put or take away, None for nothing."""
        ids = T.StructType([T.StructField("id", T.StringType())])
        found = [self.rows(x[part], ids) for x in layers for part in ("data", "gone") if x.get(part)]
        return reduce(DataFrame.union, found).distinct() if found else None

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def folders(self) -> list[str]:
        return [f"data/{t}/{f}" for t in self._names("data") for f in self._names(f"data/{t}")]
