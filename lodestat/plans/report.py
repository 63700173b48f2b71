"""What goes out: results as CSV after a scan for identifiers, where they come from, sentences, and named specs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.columns import direction, strength
from lodestat.operators.disclosure import IDENTIFIERS, checked

from .engine import SourcePolicy, provenance
from .spec import AnalysisSpec

RECIPES = "recipe string, spec_hash string, spec string"


def write_csv(result: DataFrame, path: str, shapes: dict[str, str] = IDENTIFIERS) -> None:
    """The tidy rows of a result; an error, and no file, where a text looks like an identifier."""
    checked(result, shapes).write.mode("overwrite").csv(path, header=True)


def flattened(rows: DataFrame, ids: list[str], nested: str) -> DataFrame:
    """(ids, path, value) of every leaf of a column of JSON texts, with paths such as a.b[0].c; empty objects and arrays
    have none. The column is read as a variant and opened level by level, as many as the texts have."""
    level = rows.select(*ids, F.lit("").alias("path"), F.parse_json(nested).alias("v"))
    marks = F.regexp_replace(F.regexp_replace(nested, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")  # brackets outside of texts
    deeper = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    deep = F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper, lambda s: s["most"])
    depth = rows.agg(F.max(deep)).first()[0] or 0
    container = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    out = None
    for step in range(depth + 1):
        leaves = level.where(~container).select(*ids, "path", F.col("v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if step < depth:
            inner = level.where(container).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "_v"))
            longer = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
            level = inner.select(*ids, longer.alias("path"), F.col("_v").alias("v"))
    return out


#: Columns of an export of rows, in order.
EXPORT = ("subject", "org", "concept", "source_code", "effective_at", "value", "unit", "run")


def export_rows(rows: DataFrame) -> DataFrame:
    """The rows of a cohort's export: exactly the columns of EXPORT; those that the rows lack are null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXPORT))


def receipt(exported: DataFrame, cohort: str, actor: str) -> DataFrame:
    """One row for the audit: whose export of which cohort, with the true numbers of rows and subjects."""
    counts = exported.agg(F.count("*").alias("rows"), F.count_distinct("subject").alias("subjects"))
    return counts.select(F.lit(cohort).alias("cohort"), F.lit(actor).alias("actor"), "rows", "subjects")


def write_export(rows: DataFrame, path: str, audit: str, cohort: str, actor: str) -> None:
    """Writes the rows as CSV, and appends a receipt that is counted from what was written."""
    export_rows(rows).write.mode("overwrite").csv(path, header=True, escape='"')
    written = rows.sparkSession.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in EXPORT))
    receipt(written, cohort, actor).write.mode("append").parquet(audit)


def as_parameters(figures: DataFrame, names: list[str]) -> Column:
    """Figures of a row as a FHIR Parameters resource in JSON; null figures are left out."""
    given = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("valueDecimal")) for n in names))
    return F.to_json(F.struct(F.lit("Parameters").alias("resourceType"), F.filter(given, lambda p: p["valueDecimal"].isNotNull()).alias("parameter")))


def profile_parameters(hours: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by and resource: the hours of a profile as one FHIR Parameters resource in JSON for each of `by`, an hour a
    parameter with its figures as parts; figures that are null are left out."""
    parts = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("valueDecimal")) for n in names)), lambda p: p["valueDecimal"].isNotNull())
    each = hours.select(*by, F.col("hour").cast("int").alias("hour"), F.struct(F.concat(F.lit("hour-"), F.lpad(F.col("hour").cast("string"), 2, "0")).alias("name"), parts.alias("part")).alias("p"))
    held = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "p"))), lambda x: x["p"]).alias("parameter"))  # 24 hours
    return held.select(*by, F.to_json(F.struct(F.lit("Parameters").alias("resourceType"), "parameter")).alias("resource"))


def provenance_rows(spark: SparkSession, spec: AnalysisSpec, policies: list[SourcePolicy]) -> DataFrame:
    """A row for each thing that a report says about its figures: about, value."""
    said = provenance(spec, policies)
    rows = [(k, str(v)) for k, v in said.items() if k != "sources"]
    rows += [(f"{s['source']}: {k}", str(v)) for s in said["sources"] for k, v in s.items() if k != "source"]
    return spark.createDataFrame(rows, "about string, value string")


#: Sentences by language: figures, counts, hidden figures, differences, associations, and words for strength and direction.
#: None of them speaks of causes.
WORDS = {
    "en": {
        "told": "In %s, %s of %s is %s (n = %d).", "counted": "In %s, %s of %s: %d.", "hidden": "In %s, %s of %s is not shown, as it rests on too few patients.",
        "differ": "In %s, %s of %s is %s: the difference of two groups, not a reason for it.", "together": "In %s, %s go together: %s, %s direction (r = %s, n = %d). That two values go together does not say why.",
        "weak": "weakly", "moderate": "moderately", "strong": "strongly", "same": "in the same", "opposite": "in the opposite", "none": "in no",
        "exact": "Figures are exact, also over several sources.", "approximate": "Quartiles over several sources are approximate.", "few": "Groups of fewer than %d patients are hidden; at times another group is hidden too, so that sums do not give them away.", "twice": "A patient whom several sources hold is counted by each of them.",
    },
    "sv": {
        "told": "I %s är %s för %s %s (n = %d).", "counted": "I %s är %s för %s: %d.", "hidden": "I %s visas inte %s för %s, eftersom underlaget är för litet.",
        "differ": "I %s är %s för %s %s: skillnaden mellan två grupper, inte skälet till den.", "together": "I %s följs %s åt: %s, %s riktning (r = %s, n = %d). Att två värden följs åt säger inte varför.",
        "weak": "svagt", "moderate": "måttligt", "strong": "starkt", "same": "i samma", "opposite": "i motsatt", "none": "i ingen",
        "exact": "Siffrorna är exakta, även över flera källor.", "approximate": "Kvartiler över flera källor är ungefärliga.", "few": "Grupper med färre än %d patienter döljs; ibland döljs ännu en grupp, så att summor inte röjer dem.", "twice": "En patient som finns i flera källor räknas i var och en.",
    },
}


def sentence(result: DataFrame, language: str = "en") -> Column:
    """A plain sentence for each row of a result; it states figures and never causes."""
    say = WORDS[language]
    figure = F.round("value", 2).cast("string")
    word = lambda found: F.coalesce(*(F.when(found == w, say[w]) for w in ("weak", "moderate", "strong", "same", "opposite", "none")))
    told = F.format_string(say["told"], "source", "key", "var", figure, "n")
    together = F.format_string(say["together"], "source", "var", word(strength(F.col("value"))), word(direction(F.col("value"))), figure, "n")
    differ = F.format_string(say["differ"], "source", "key", "var", figure)
    counted = F.format_string(say["counted"], "source", "key", "var", "n")
    hidden = F.format_string(say["hidden"], "source", "key", "var")
    shown = F.when(F.col("key").isin("r", "rho"), together).when((F.col("kind") == "compare_groups") & F.col("key").endswith(" diff"), differ).otherwise(told)
    return F.when(F.col("suppressed"), hidden).when(F.col("value").isNotNull(), shown).otherwise(counted)


def caveats(spec: AnalysisSpec, k: int, language: str = "en") -> list[str]:
    """What a report says once: exactness, hidden groups, and patients whom several sources hold."""
    say = WORDS[language]
    out = [say["approximate" if any(a["kind"] == "describe" for a in spec.analyses) else "exact"], say["few"] % k]
    return out + ([say["twice"]] if spec.linkage == "none" and len(spec.sources) > 1 else [])


def keep_recipe(spark: SparkSession, path: str, recipe: str, spec: AnalysisSpec) -> None:
    """Appends a named spec; it is shared by its name and comes back with the same hash."""
    spark.createDataFrame([(recipe, spec.digest(), json.dumps(spec.stated()))], RECIPES).write.mode("append").parquet(path)


def recipe(spark: SparkSession, path: str, name: str) -> AnalysisSpec:
    rows = spark.read.schema(RECIPES).parquet(path).where(F.col("recipe") == name).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows)} recipes are named {name}")
    spec = AnalysisSpec.parse(rows[0]["spec"])
    if spec.digest() != rows[0]["spec_hash"]:
        raise ValueError(f"recipe {name} has changed since it was kept")
    return spec
