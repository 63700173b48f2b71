"""Observations from a store that answers searches by pages, as a Spark data source.

The store is asked for the rows of some patients and one concept, and gives a page of so many rows at most; it has no
second page, and a full page cannot be told from a cut one. So a full page is never reported: its patients are asked for
in two halves. A single patient who fills a page is an error, as there is nothing left to divide. Spark plans a task
for each batch of patients and each concept; filters on pid and concept leave out patients and concepts before anything
is asked (with the option push, where spark.sql.python.filterPushdown.enabled is set), and are applied by Spark in any case.

A store over plain Parquet files looks through all of them for each request: that is for small cohorts. `stored` deals
rows and cohort to buckets of patients beforehand, in a shared folder: a task has the patients of one bucket, reads that
bucket's rows of one concept once and answers all of its requests from them. So the work is in proportion to the rows and
the patients, and no list of patients goes through the driver.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module

#: Patients of a request, and rows of a page, where the options do not say otherwise.
PATIENTS, PAGE = 100, 30_000
#: Rows and patients of a bucket of a store, on average.
BUCKET_ROWS, BUCKET_PATIENTS = 200_000, 20_000
SCHEMA = "pid string, concept string, seq long, value double"


class TruncatedRead(RuntimeError):
    """A single patient fills a page: what lies beyond is not known."""


@dataclass
class Request(InputPartition):
    """The patients and the concept of one task; with a bucket its patients, of whom `patients` are wanted if any are named."""

    patients: tuple[str, ...] | None
    concept: str
    bucket: int | None = None


def parquet_store(path: str) -> Callable[[tuple[str, ...], str, int], list[tuple]]:
    """A store over Parquet files with event_id, user_id, event_type and value."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    files = ds.dataset(path.removeprefix("file:"), format="parquet")

    def search(patients: tuple[str, ...], concept: str, limit: int) -> list[tuple]:
        wanted = pc.field("user_id").isin([int(p) for p in patients]) & (pc.field("event_type") == concept)
        rows = files.scanner(columns=["user_id", "event_type", "event_id", "value"], filter=wanted).head(limit).to_pylist()
        return [(str(r["user_id"]), r["event_type"], r["event_id"], r["value"]) for r in rows]

    return search


def _bucket(path: str, bucket: int, columns: list[str], where=None):
    """The rows of a bucket as a table; None if it has no files."""
    import pyarrow.dataset as ds

    try:
        files = ds.dataset(f"{path.removeprefix('file:')}/bucket={bucket}", format="parquet") if path.startswith("file:") else ds.dataset(f"{path}/bucket={bucket}", format="parquet")
    except FileNotFoundError:
        return None
    return files.to_table(columns=columns, filter=where)


def bucket_store(path: str, bucket: int, concept: str) -> Callable[[tuple[str, ...], str, int], list[tuple]]:
    """A store over one bucket's rows of a concept, by patient."""
    import pyarrow.compute as pc

    table = _bucket(f"{path}/rows", bucket, ["pid", "seq", "value"], pc.field("concept") == concept)
    held: dict[str, list[tuple]] = {}
    for pid, seq, value in zip(*(c.to_pylist() for c in table.columns)) if table else ():
        held.setdefault(pid, []).append((pid, concept, seq, value))

    def search(patients: tuple[str, ...], _: str, limit: int) -> list[tuple]:
        rows: list[tuple] = []
        for p in patients:
            rows += held.get(p, ())[: limit - len(rows)]
        return rows

    return search


def stored(rows: DataFrame, cohort: DataFrame, folder: str) -> dict[str, str]:
    """Writes a store of rows (as SCHEMA) and a cohort (pid) to a shared folder, by buckets of patients; the options to read it."""
    count = max(1, math.ceil(rows.count() / BUCKET_ROWS), math.ceil(cohort.count() / BUCKET_PATIENTS))
    bucket = F.pmod(F.xxhash64("pid"), F.lit(count)).cast("int")
    for name, frame in (("rows", rows.select("pid", "concept", F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))), ("patients", cohort.select("pid").distinct())):
        frame.where(F.col("pid").isNotNull()).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")
    return {"path": folder, "buckets": str(count)}


def read_whole(search: Callable[[tuple[str, ...], str, int], list[tuple]], patients: tuple[str, ...], concept: str, page: int) -> Iterator[tuple]:
    """All rows of the patients, by as many searches as it takes; the least ones first, each answer whole."""
    todo = [patients]
    while todo:
        some = todo.pop()
        rows = search(some, concept, page)
        if len(rows) < page:
            yield from rows
        elif len(some) > 1:
            todo += [some[len(some) // 2 :], some[: len(some) // 2]]
        else:
            raise TruncatedRead(f"patient {some[0]} has {page} rows of {concept} or more, a full page")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.page, self.size = options["path"], int(options.get("page", PAGE)), int(options.get("batch", PATIENTS))
        self.buckets = int(options["buckets"]) if "buckets" in options else None
        self.patients: list[str] | None = list(dict.fromkeys(json.loads(options["patients"]))) if "patients" in options else None
        self.concepts: list[str] = list(dict.fromkeys(json.loads(options["concepts"])))

    def partitions(self) -> list[Request]:
        if self.buckets:
            wanted = None if self.patients is None else tuple(self.patients)
            return [Request(wanted, concept, bucket) for bucket in range(self.buckets) for concept in self.concepts] or [Request((), "")]
        batches = [tuple(self.patients[i : i + self.size]) for i in range(0, len(self.patients), self.size)]
        return [Request(batch, concept) for batch in batches for concept in self.concepts] or [Request((), "")]

    def read(self, partition: Request) -> Iterator[tuple]:
        if partition.bucket is not None:
            table = _bucket(f"{self.path}/patients", partition.bucket, ["pid"])
            patients = table.column("pid").to_pylist() if table else []
            if partition.patients is not None:
                patients = list(set(patients).intersection(partition.patients))
            search = bucket_store(self.path, partition.bucket, partition.concept) if patients else None
            for i in range(0, len(patients), self.size):
                yield from read_whole(search, tuple(patients[i : i + self.size]), partition.concept, self.page)
        elif partition.patients:
            yield from read_whole(parquet_store(self.path), partition.patients, partition.concept, self.page)


class PushingReader(PagedReader):
    """One that gets filters before anything is asked; Spark allows it where filters may be pushed down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("pid",), ("concept",)):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                if f.attribute == ("pid",):
                    self.patients = [p for p in (sorted(wanted) if self.patients is None else self.patients) if p in wanted]
                else:
                    self.concepts = [c for c in self.concepts if c in wanted]
            yield f  # Spark filters as well


class PagedObservations(DataSource):
    """spark.read.format("paged_observations") with the options path, patients and concepts (JSON lists), page, batch and
    push; or, over a store by buckets, those that `stored` gives in place of path and patients.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_observations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return (PushingReader if self.options.get("push") == "true" else PagedReader)(self.options)
