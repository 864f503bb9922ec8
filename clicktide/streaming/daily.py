"""Tables of a stream kept by day: a log of changes, folded day by day.

A batch writes one folder with a subfolder per day.  A manifest lists for every
day the folders that hold it; the newest complete manifest is the table, so a
batch or a fold becomes visible at once or not at all.  When a day has more than
``fold_after`` folders, that day alone is rewritten as one: work and files follow
the days a batch touches, not the age of the table.  Readers name their days and
open only those.

Rows of one key have to lie in one day.  A target belongs to one checkpoint.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY, _SEQ = "_day", "_seq"
KEPT_MANIFESTS = 3


def latest(columns: list[str]) -> list[Column]:
    """The newest batch's row of a key wins."""
    return [F.max_by(c, _SEQ).alias(c) for c in columns]


@dataclass
class Manifest:
    """One version of a table."""

    version: int = 0
    batch_id: int = -1  # the newest batch in it
    schema: str | None = None
    days: dict[str, list[str]] = field(default_factory=dict)  # day -> folders, oldest first
    notes: dict = field(default_factory=dict)  # small facts of the writer, kept with the batch


class DailyTable:
    """A table below ``target``, with the day of each row taken from ``day``.

    With ``keys`` rows of a key are merged by ``merge`` (the newest wins, unless
    told otherwise) on reading and on folding; without, all rows are kept.
    """

    def __init__(
        self, spark: SparkSession, target: str, day: Column, keys: list[str] | None = None,
        merge: Callable[[list[str]], list[Column]] = latest, fold_after: int = 8,
    ):
        self.spark, self.target, self.day = spark, target.rstrip("/"), day
        self.keys, self.merge, self.fold_after = keys, merge, fold_after
        root = self._path("")
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests ---------------------------------------------------------

    def _path(self, name):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}" if name else self.target)

    def _versions(self) -> list[int]:
        found = self.fs.globStatus(self._path("manifest/v*.json")) or []
        return sorted(int(f.getPath().getName()[1:-5]) for f in found)

    def manifest(self) -> Manifest:
        versions = self._versions()
        if not versions:
            return Manifest()
        stream = self.fs.open(self._path(f"manifest/v{versions[-1]:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, new: Manifest) -> None:
        """Write the next version under another name and rename it: readers never see a part of it."""
        place = self._path(f"manifest/v{new.version:012d}.json")
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(draft, place):
            raise RuntimeError(f"{self.target} has another writer: version {new.version} is there already")
        for old in self._versions()[:-KEPT_MANIFESTS]:
            self.fs.delete(self._path(f"manifest/v{old:012d}.json"), False)

    # -- writing -----------------------------------------------------------

    def _write(self, rows: DataFrame, name: str) -> dict[str, str]:
        """Write rows by day; returns day -> folder."""
        folder = f"parts/{name}-{uuid.uuid4().hex[:12]}"
        # few files a day, however many tasks; a large day is split again
        rows.hint("rebalance", _DAY).write.partitionBy(_DAY).parquet(f"{self.target}/{folder}")
        found = self.fs.globStatus(self._path(f"{folder}/{_DAY}=*")) or []
        return {f.getPath().getName().split("=", 1)[1]: f"{folder}/{f.getPath().getName()}" for f in found}

    def write(self, batch: DataFrame, batch_id: int, notes: dict | None = None) -> bool:
        """Add a batch; one that is in the table already (a replay) changes nothing and gives False."""
        now = self.manifest()
        if batch_id <= now.batch_id:
            return False
        made = self._write(batch.withColumn(_DAY, F.coalesce(self.day.cast("date").cast("string"), F.lit("none"))), f"b{batch_id}")
        days = {d: [*now.days.get(d, []), *([made[d]] if d in made else [])] for d in {**now.days, **made}}
        self._publish(
            Manifest(now.version + 1, batch_id, now.schema or batch.schema.json(), days, {**now.notes, **(notes or {})})
        )
        return True

    def fold(self, least: int | None = None) -> dict[str, int]:
        """Rewrite the days with more folders than ``least`` (``fold_after``); returns the bytes read, by day.

        Other days are not opened.  Folders that no kept manifest names are deleted.
        """
        now, least = self.manifest(), self.fold_after if least is None else least
        touched = sorted(d for d, folders in now.days.items() if len(folders) > least)
        if not touched:
            return {}
        read = {d: sum(self.fs.getContentSummary(self._path(f)).getLength() for f in now.days[d]) for d in touched}
        merged = None
        for day in touched:
            rows = self._merged(now, [day]).withColumn(_DAY, F.lit(day))
            merged = rows if merged is None else merged.unionByName(rows)
        made = self._write(merged, f"f{now.batch_id}")
        days = {**now.days, **{d: [made[d]] if d in made else [] for d in touched}}
        self._publish(Manifest(now.version + 1, now.batch_id, now.schema, {d: f for d, f in days.items() if f}, now.notes))
        self.vacuum()
        return read

    def vacuum(self) -> None:
        """Delete the parts that none of the kept manifests names, and parts of batches that were never published."""
        named = set()
        for version in self._versions():
            stream = self.fs.open(self._path(f"manifest/v{version:012d}.json"))
            try:
                told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            named |= {f.split("/")[1] for folders in told["days"].values() for f in folders}
        for part in self.fs.listStatus(self._path("parts")):
            if part.getPath().getName() not in named:
                self.fs.delete(part.getPath(), True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A writer of micro-batches.  Guard it alone: folding is :meth:`fold`, and a failed fold fails no batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id)

        return write

    # -- reading -----------------------------------------------------------

    def _merged(self, now: Manifest, days: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now.schema))
        layers = max((len(now.days[d]) for d in days), default=0)
        parts = []
        for layer in range(layers):  # at most a day's folders, however many days are read
            paths = [f"{self.target}/{now.days[d][layer]}" for d in days if layer < len(now.days[d])]
            rows = self.spark.read.schema(schema).parquet(*paths)
            parts.append(rows.withColumn(_SEQ, F.lit(layer)))
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        if not self.keys:
            return rows.drop(_SEQ)
        values = [c for c in schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*self.merge(values)).select(*schema.names)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The rows of the days ``first`` to ``last`` (``YYYY-MM-DD``, both included; open ends: all).

        Rows without a day are read only with both ends open.
        """
        now = self.manifest()
        if now.schema is None:
            raise FileNotFoundError(f"no batch in {self.target}")
        days = sorted(
            d for d in now.days
            if (first is None or (d != "none" and d >= first)) and (last is None or (d != "none" and d <= last))
        )
        return self._merged(now, days)

    def files(self, first: str | None = None, last: str | None = None) -> list[str]:
        """The data files a reader of these days opens."""
        return self.read(first, last).inputFiles()
