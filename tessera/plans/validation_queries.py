"""Checks of tables and batches, the training store, and the import of archives, over order lines and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import table_validation, training_store
from tessera.plans import table_queries
from tessera.plans.domain import TABLES, with_tables
from tessera.plans.registry import query
from tessera.session import shared_folder, ship_package, table
from tessera.streaming import imports

#: Observations of a table for each order; two lines share a source row.
CHECKED = """select k as TextTableID, case when k % 50 = 0 then ' ' else concat('doc-', cast(k as string)) end as DocumentGUID, case when p % 11 = 0 then null else concat('name ', cast(p % 3 as string)) end as ParameterName,
 case s % 5 when 0 then 'Comparison' when 1 then ' ' else concat('arm ', cast(s % 5 as string)) end as TreatmentArm, cast(floor(n / 2) as int) as SourceRowSeq, case when q > 10 then cast(q as int) end as ArmN, case when q < 40 then q end as PrimaryValue,
 case when f = 'A' then 'Percentage' when f = 'N' then 'Count' end as PrimaryValueType, case when st = 'O' then 'AdverseEvent' else 'PK' end as TableCategory, case when q > 20 then 30.0 end as LowerBound, q as UpperBound, q / 50.0 as ParseConfidence,
 case when p % 2 = 0 then q end as Time, case when p % 7 = 0 then 'Single Dose' end as Timepoint, case when q > 25 then 'FLAG' end as ValidationFlags, concat('rule ', f) as ParseRule from {Line}"""


def _checked(spark, sf_dir):
    rows = spark.sql(CHECKED, Line=spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem")))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("PrimaryValue", "LowerBound", "UpperBound", "ParseConfidence", "Time")})


_C = with_tables("Line") + f", o AS ({CHECKED.replace('{Line}', 'Line')})"


@query("table_validation_issues", _C + """, du AS (SELECT TextTableID, 'DUPLICATE_OBSERVATION' i, '(' || coalesce(ParameterName, '') || ', ' || TreatmentArm || ', Row=' || SourceRowSeq || ') x ' || count(*) d FROM o GROUP BY TextTableID, ParameterName, TreatmentArm, SourceRowSeq HAVING count(*) > 1),
gp AS (SELECT TextTableID, 'ARM_COVERAGE_GAP' i, TreatmentArm d FROM o WHERE trim(TreatmentArm) <> '' AND TreatmentArm <> 'Comparison' GROUP BY TextTableID, TreatmentArm HAVING count(ArmN) > 0 AND count(PrimaryValue) = 0),
ct AS (SELECT TextTableID, count(DISTINCT CASE WHEN trim(TreatmentArm) <> '' THEN TreatmentArm END) a, count(DISTINCT ParameterName) p, count(*) n FROM o WHERE TreatmentArm <> 'Comparison' GROUP BY 1),
de AS (SELECT TextTableID, 'COUNT_DEVIATION' i, 'expected ' || a * p || ' (' || a || ' arms, ' || p || ' parameters), got ' || n d FROM ct WHERE a * p > 0 AND abs(n - a * p) > 0.20::DOUBLE * a * p),
tm AS (SELECT TextTableID, 'TIME_EXTRACTION_INCONSISTENCY' i, count(*) - count(Time) || ' of ' || count(*) || ' without time' d FROM o WHERE lower(coalesce(Timepoint, '')) <> 'single dose' GROUP BY 1 HAVING count(Time) > 0 AND count(Time) < count(*)),
sg AS (SELECT TextTableID, unnest(['ORPHAN_ROW', 'MISSING_PARAMETER', 'MISSING_VALUE_TYPE', 'MISSING_ARM_N', 'BOUND_INVERSION', 'LOW_CONFIDENCE']) i, unnest([count(*) FILTER (trim(DocumentGUID) = ''), count(*) FILTER (ParameterName IS NULL), count(*) FILTER (PrimaryValueType IS NULL), count(*) FILTER (TableCategory = 'AdverseEvent' AND ArmN IS NULL),
 count(*) FILTER (LowerBound > UpperBound), count(*) FILTER (ParseConfidence < 0.5)]) n FROM o GROUP BY 1)
SELECT TextTableID "TextTableID", i "Issue", d "Detail" FROM du UNION ALL SELECT * FROM gp UNION ALL SELECT * FROM de UNION ALL SELECT * FROM tm UNION ALL SELECT TextTableID, i, n || '' FROM sg WHERE n > 0""")  # fmt: skip
def table_validation_issues(spark, sf_dir):
    """Every finding of every table's rows, arms and counts, from one scan."""
    return table_validation.issues(_checked(spark, sf_dir))


@query("batch_report", _C + """ SELECT count(*) "rows", count(PrimaryValue) "values", count(ValidationFlags) flagged, count(*) FILTER (TableCategory = 'AdverseEvent') "AdverseEvent", count(*) FILTER (TableCategory = 'PK') "PK", 0::BIGINT "DrugInteraction", 0::BIGINT "Efficacy",
 count(*) FILTER (ParseConfidence >= 0.9) sure, count(*) FILTER (ParseConfidence < 0.9 AND ParseConfidence >= 0.7) likely, count(*) FILTER (ParseConfidence < 0.7 AND ParseConfidence >= 0.5) doubtful, count(*) FILTER (ParseConfidence < 0.5) unsure FROM o""")  # fmt: skip
def batch_report(spark, sf_dir):
    """A batch's figures, observed while its tables are checked."""
    rows, watch = table_validation.observed(_checked(spark, sf_dir), f"batch-{uuid.uuid4().hex}")
    table_validation.issues(rows).write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"`{k}` bigint" for k in got))


@query("batch_rules", _C + """ SELECT TableCategory "TableCategory", ParseRule "ParseRule", count(*) n, min(ParseConfidence)::DOUBLE least FROM o GROUP BY 1, 2""")
def batch_rules(spark, sf_dir):
    return table_validation.by_rule(_checked(spark, sf_dir))


#: Increments of training rows by the hour of events: a user's newest row stays, purchases are trusted.
_ROWS = "select user_id as id, concat('event ', cast(event_id as string)) as text, event_type as label, event_type = 'purchase' as trusted, hour(ts) % 4 as batch from {events}"
KEPT = 40


@query("training_store_rows", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY trusted DESC, batch DESC, label, text) k FROM ({_ROWS.replace('{events}', 'events')})), p AS (SELECT *, row_number() OVER (ORDER BY trusted DESC, batch DESC, id) nth FROM e WHERE k = 1)
SELECT id, text, label, trusted, batch::BIGINT batch FROM p WHERE nth <= {KEPT}""")  # fmt: skip
def training_store_rows(spark, sf_dir):
    """What a store of forty rows holds after four increments; the bound is the feature."""
    rows = spark.sql(_ROWS, events=table(spark, sf_dir, "events"))
    store = spark.createDataFrame([], "id bigint, text string, label string, trusted boolean, batch bigint")
    for batch in range(4):
        store = training_store.add(store, rows.filter(F.col("batch") == batch).drop("batch"), batch, KEPT)
    return store


def per_batch(archives: int, batches: int = 8, least: int = 4) -> int:
    """Archives a batch, so that a larger inbox makes larger batches, which all cores work on, and not more of them."""
    return max(least, -(-archives // batches))


@query("bulk_import", with_tables("Line") + """ SELECT DISTINCT 'doc-' || k "DocumentGUID", k || '.xml' "name", true "imported" FROM Line""")
def bulk_import(spark, sf_dir):
    """The labels of all orders, packed into archives, imported as a stream of several batches."""
    ship_package(spark)
    folder = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    labels = table_queries.labels(spark, sf_dir).select(F.concat(F.col("k").cast("string"), F.lit(".xml")).alias("name"), "xml")
    archives = imports.write_archives(labels, f"{folder}/inbox").count()
    imports.run(spark, f"{folder}/inbox", f"{folder}/out", per_batch=per_batch(archives))
    found = imports.labels(spark, f"{folder}/out")
    known = imports.manifest(spark, f"{folder}/out").select(F.col("path").alias("source"))
    return found.join(known, "source").select("DocumentGUID", "name", F.lit(True).alias("imported"))
