"""Long observations: one row for each observation of a patient, from driver tables, FHIR bundles or several sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Coding systems whose codes are concepts of the platform; other systems are only used when none of these codes a row.
CONCEPT_SYSTEM = "^urn:[a-z0-9]+:concept$|/api/v1/concepts$"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: seq, pid, concept, value, ts, d, source, sex, org."""
    events, customer, nation = (read(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("cdr"), F.col("n_regionkey")).alias("source"), F.col("c_mktsegment").alias("sex"), F.concat(F.lit("org-"), F.col("c_nationkey")).alias("org")
    )
    return events.join(people, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("concept"), "value", "ts", F.to_date("ts").alias("d"), "source", "sex", "org"
    )


def cohort_read(rows: DataFrame, members: DataFrame, concepts: Iterable[str], key: str = "pid") -> DataFrame:
    """The rows of a cohort's members, of some concepts; both reach the scan as a semi join and a filter."""
    return rows.where(F.col("concept").isin(list(concepts))).join(members.select(key).distinct(), key, "left_semi")


def union_tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of several sources, tagged; columns that a source lacks are null."""
    out = None
    for name, frame in parts.items():
        frame = frame.withColumn(tag, F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source was named")
    return out


def read_sources(spark: SparkSession, paths: dict[str, str], tag: str = "source", only: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """The union of the sources that can be read, and a status row for each in the order of the registry `paths`; an
    error when none can. `only` asks some of them; one that is not registered is an error."""
    if unknown := [name for name in only or [] if name not in paths]:
        raise ValueError("not registered: " + ", ".join(unknown))
    parts, status = {}, []
    for name, path in paths.items():
        if only is not None and name not in only:
            continue
        try:
            parts[name] = spark.read.parquet(path)
            status.append({"source": name, "ok": True, "error": None})
        except Exception as error:  # a missing store degrades the answer, and is named
            status.append({"source": name, "ok": False, "error": str(error).splitlines()[0][:200]})
    if not parts:
        raise RuntimeError("no source answered: " + "; ".join(s["error"] or "" for s in status))
    return union_tagged(parts, tag), status


def verdict(status: list[dict]) -> str:
    """complete when all sources answered, degraded when most did, else error."""
    ok = sum(s["ok"] for s in status)
    return "error" if 2 * ok <= len(status) else "complete" if ok == len(status) else "degraded"


def page_of_each(rows: DataFrame, by: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+limit of each source."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_n", number).where(F.col("_n").between(offset + 1, offset + limit)).drop("_n")


#: The most rows of a page.
MOST_ROWS = 500


def person_page(tables: dict[str, DataFrame], table: str, pid: str, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of one person's rows in each source of a table; only tables that are offered can be asked for, a person must
    be named, and a page has MOST_ROWS at most (a larger limit is lowered, one below 1 is an error)."""
    if table not in tables:
        raise LookupError(f"no table {table}")
    if not pid:
        raise ValueError("a person must be named")
    if limit < 1 or offset < 0:
        raise ValueError("a page has one row or more")
    return page_of_each(tables[table].where(F.col("pid") == pid), "source", order, min(limit, MOST_ROWS), offset)


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not known yet, one for each key: appending them twice adds nothing."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def imported(lines: DataFrame, schema: str, key: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new rows of JSON lines (column value), and one row with the numbers added, skipped and malformed.

    Blank lines are no lines. A line is malformed when it is no JSON object of the schema or has no key; it is skipped
    when its key is known or stands on another line that is taken. Appending the new rows and importing again adds
    nothing. Of lines with one key that of the least text is taken.
    """
    fields = f"{schema}, _corrupt string"
    parsed = lines.where(F.length(F.trim("value")) > 0).select("value", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    whole = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col(f"r.`{key}`").isNotNull()
    valid = parsed.where(whole).groupBy(F.col(f"r.`{key}`").alias("_key")).agg(F.count("*").alias("_lines"), F.min_by("r", "value").alias("r"))
    if known is not None:
        valid = valid.join(known.select(F.col(key).alias("_key"), F.lit(True).alias("_known")).distinct(), "_key", "left")
    else:
        valid = valid.withColumn("_known", F.lit(None).cast("boolean"))
    new = F.col("_known").isNull()
    told = valid.agg(F.count_if(new).alias("added"), F.coalesce(F.sum(F.col("_lines") - new.cast("long")), F.lit(0)).alias("skipped"))
    wrong = parsed.agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("malformed"))
    names = [f for f in lines.sparkSession.createDataFrame([], schema).columns]
    return valid.where(new).select(*(F.col(f"r.`{c}`").alias(c) for c in names)), told.join(F.broadcast(wrong))  # one row on either side


def tail(reference: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(reference, "/"), -1)


def flatten_fhir(bundles: DataFrame, entry: str = "entry", keep: tuple[str, ...] = ()) -> DataFrame:
    """FHIR bundles to pid, concept, value, unit, effective_at, org, after the columns of the bundle that are kept."""
    kept = [f"_kept{i}" for i in range(len(keep))]
    r = bundles.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), F.explode(entry).alias("e")).select(*kept, "e.resource.*")
    coded = F.filter("code.coding", lambda c: c["code"].isNotNull())
    ours = F.filter(coded, lambda c: c["system"].rlike(CONCEPT_SYSTEM))
    first = lambda found, field: F.get(found, F.lit(0))[field]
    value = F.coalesce(F.col("valueQuantity.value").cast("string"), F.col("valueInteger").cast("string"), F.col("valueString"), F.col("valueBoolean").cast("string"))
    return r.select(
        *(F.col(k).alias(c) for c, k in zip(keep, kept)),
        F.coalesce(F.nullif(tail(F.col("subject.reference")), F.lit("")), F.col("subject.identifier.value")).alias("pid"),
        F.coalesce(first(ours, "code"), first(coded, "code")).alias("concept"),
        value.alias("value"),
        F.when(F.col("valueQuantity.value").isNotNull(), F.coalesce("valueQuantity.unit", "valueQuantity.code")).alias("unit"),
        F.coalesce("effectiveDateTime", "effectivePeriod.start", "issued").alias("effective_at"),
        F.get(F.transform("performer", lambda p: F.coalesce(p["identifier"]["value"], tail(p["reference"]))), F.lit(0)).alias("org"),
    )


FHIR_BUNDLE = (
    "entry ARRAY<STRUCT<resource: STRUCT<subject: STRUCT<reference: STRING, identifier: STRUCT<value: STRING>>,"
    " code: STRUCT<coding: ARRAY<STRUCT<system: STRING, code: STRING>>>, effectiveDateTime: STRING, effectivePeriod: STRUCT<start: STRING>, issued: STRING,"
    " valueQuantity: STRUCT<value: DOUBLE, unit: STRING, code: STRING>, valueInteger: BIGINT, valueString: STRING, valueBoolean: BOOLEAN,"
    " performer: ARRAY<STRUCT<identifier: STRUCT<value: STRING>, reference: STRING>>>>>"
)
