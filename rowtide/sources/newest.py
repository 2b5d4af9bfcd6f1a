"""The newest entries of every batch of a log, per table: what the activity feed reads instead of the log.

    <newest>/table=<id>/index/<n>.json                       batches whose entries are kept, and the build that made them
    <newest>/table=<id>/data/build=<x>/batch=<token>/*.parquet   the entries: ``length`` per batch at most

A batch never changes, nor do its entries. They are made when first asked for, so a table nobody watches has none;
those of batches that retention removed are not read any more.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowtide.operators.pairs import ENTRY, newest_entries
from rowtide.sources import files

_INDEX = "batch string, build string"


class NewestEntries:
    def __init__(self, spark: SparkSession, path: str, table_id: int, length: int):
        self.spark, self.path, self.length = spark, f"{path}/length={length}/table={table_id}", length

    def _index(self) -> dict[str, str]:
        files.make_dir(f"{self.path}/index")
        numbers = files.manifest_numbers(f"{self.path}/index")
        return {r["batch"]: r["build"] for n in numbers for r in files.read_json(files.manifest_path(f"{self.path}/index", n))}

    def of(self, batches: list[str], events) -> DataFrame:
        """Entries of some batches, as ``newest_entries`` gives them; ``events`` gives those of a list of batches, with a
        column ``batch``, and is asked about batches only that nobody asked about before."""
        known = self._index()
        missing = [b for b in batches if b not in known]
        if missing:
            build = uuid.uuid4().hex
            made = newest_entries(events(missing), self.length, "batch")
            made.repartition(1).write.partitionBy("batch").parquet(f"{self.path}/data/build={build}")  # `length` rows a batch
            self._add([{"batch": b, "build": build} for b in missing])
            known |= {b: build for b in missing}
        paths = [f"{self.path}/data/build={known[b]}/batch={b}" for b in batches]
        return self.spark.read.schema(ENTRY).parquet(*paths)

    def _add(self, rows: list[dict]) -> None:
        """Entries made twice at once are the same; the index names either."""
        while True:
            numbers = files.manifest_numbers(f"{self.path}/index")
            try:
                return files.write_json(files.manifest_path(f"{self.path}/index", (numbers[-1] if numbers else 0) + 1), rows, True)
            except files.AlreadyThere:
                continue
