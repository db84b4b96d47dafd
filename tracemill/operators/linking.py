"""Scenario linking (survey 3.2: J3-J9, W1-W3, A16, T15): study selection, admissions, documents. One DAG of joins.

Per-admission facts are aggregated before they are joined. First-of-group steps are aggregates (min_by), not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import chest_report, frontal, view_priority
from .joins import interval_join, lookup
from .metrics import nested_first
from .sampling import first_per


def study_date(c: Column) -> Column:
    """yyyyMMdd or yyyy-MM-dd; anything else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def best_view(studies: DataFrame) -> DataFrame:
    """One frontal image per (subject, study), PA before AP, then by id; other views and null keys left out."""
    x = studies.where(frontal(F.col("viewposition")) & F.col("subject_id").isNotNull() & F.col("study_id").isNotNull())
    return first_per(x, ["subject_id", "study_id"], [view_priority(F.col("viewposition")), F.col("dicom_id"), F.col("studydate")])


def earliest(df: DataFrame, by: list[str], date: str, tie: str) -> DataFrame:
    """The earliest per key; null dates last."""
    return first_per(df, by, [F.col(date).isNull(), F.col(date), F.col(tie)])


def first_report(notes: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """The first chest report per key in order."""
    return first_per(notes.where(chest_report(F.col(text))), by, [F.col(order), F.col(text)])


def label_names(labels: dict[str, Column]) -> Column:
    """CheXpert values 1, 0, -1 to Positive, Negative, Uncertain; null values are absent from the map."""
    word = lambda c: F.when(c == 1.0, "Positive").when(c == 0.0, "Negative").when(c == -1.0, "Uncertain")
    m = F.create_map(*(x for k, c in labels.items() for x in (F.lit(k), word(c))))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def lab_display(value: Column, unit: Column, low: Column, high: Column) -> Column:
    """'value unit (low|high)' with the mark only where a reference range says so; null without a value."""
    v = value.try_cast("double")
    mark = F.when(v < low, " (low)").when(v > high, " (high)").otherwise("")
    return F.when(value.isNotNull(), F.concat(F.concat_ws(" ", value, unit), mark))


def link(studies: DataFrame, admissions: DataFrame, notes: DataFrame, labels: DataFrame, patients: DataFrame, diagnoses: DataFrame, titles: DataFrame, labs: DataFrame, items: DataFrame) -> DataFrame:
    """The whole chain: best view per study, admission by date, earliest study per admission, notes (fan-out kept),
    labels, demographics and first diagnosis with its title (or code), labs per admission as a nested map."""
    x = best_view(studies).withColumn("date", study_date(F.col("studydate"))).where("date is not null")
    x = interval_join(x, admissions, ["subject_id"], "date", "admittime", "dischtime")
    x = earliest(x, ["subject_id", "hadm_id"], "date", "study_id")
    x = x.join(notes, ["subject_id", "hadm_id"]).join(labels, ["subject_id", "study_id"], "left").join(patients, "subject_id", "left")
    d = lookup(diagnoses.where("seq_num = 1"), titles, ["icd_code", "icd_version"], {"long_title": F.col("icd_code")})
    x = x.join(d.select("subject_id", "hadm_id", F.col("long_title").alias("diagnosis")), ["subject_id", "hadm_id"], "left")
    need = labs.join(x.select("hadm_id").distinct(), "hadm_id", "left_semi")
    need = lookup(need, items, ["itemid"], {"category": F.lit("Other"), "label": F.concat(F.lit("Item_"), F.col("itemid").cast("string"))})
    need = need.withColumn("shown", lab_display(F.col("value"), F.col("valueuom"), F.col("ref_range_lower"), F.col("ref_range_upper")))
    per = nested_first(need, ["hadm_id"], "category", "label", "shown", ["itemid", "shown"])
    return x.join(per, "hadm_id", "left")


def document(x: DataFrame) -> Column:
    """The nested scenario of a linked row, fields in fixed order."""
    return F.struct(
        F.lit("Find the diagnosis from the visit.").alias("Objective_for_Doctor"),
        F.struct(F.col("demographics").alias("Demographics"), F.col("history").alias("History")).alias("Patient_Actor"),
        F.col("results").alias("Test_Results"),
        F.col("diagnosis").alias("Correct_Diagnosis"),
        F.col("labels").alias("CheXpert_Labels"),
    )
