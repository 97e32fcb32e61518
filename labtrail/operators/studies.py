"""Profiles, studies and reports: dashboards, ownership, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.functions.basic import blank_to_null, placed



def study_summary(studies: DataFrame, reports: DataFrame) -> DataFrame:
    """Report count and date range of every study."""
    per = reports.groupBy("study_id").agg(
        n_rows().alias("report_count"), F.min("report_date").alias("range_start"), F.max("report_date").alias("range_end")
    )
    return studies.join(per, "study_id", "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))


def study_items(studies: DataFrame, reports: DataFrame) -> DataFrame:
    """Dashboard line per study: counts, range, its one laboratory, alerts."""
    lab = blank_to_null(F.col("lab_name"))
    per = reports.groupBy("study_id").agg(
        n_rows().alias("report_count"), F.min("report_date").alias("range_start"), F.max("report_date").alias("range_end"),
        F.min(lab).alias("_l"), F.max(lab).alias("_h"), F.sum("alerts").alias("alerts_count"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return studies.join(per, "study_id", "left").select(
        "profile_id", "study_id", zero("report_count"), "range_start", "range_end",
        F.when(F.col("_l") == F.col("_h"), F.col("_l")).alias("consistent_lab_name"),
        zero("alerts_count"), (F.coalesce("alerts_count", F.lit(0)) > 0).alias("has_alerts"),
    )


def account_dashboard(profiles: DataFrame, studies: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals per account: reports and studies are summed to profiles before
    they meet the account, so a large account is already small."""
    per_profile = study_items(studies, reports).groupBy("profile_id").agg(
        F.sum("report_count").alias("r"), F.sum("alerts_count").alias("a"), n_rows().alias("s")
    )
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return profiles.join(per_profile, "profile_id", "left").groupBy("owner_id").agg(
        n_rows().alias("profiles_tracked"), zero("s").alias("studies"), zero("r").alias("total_reports"), zero("a").alias("total_alerts")
    )


def profile_report_totals(studies: DataFrame, reports: DataFrame) -> DataFrame:
    return study_summary(studies, reports).groupBy("profile_id").agg(F.sum("report_count").alias("total_reports"))


def accessible_studies(profiles: DataFrame, studies: DataFrame, access: DataFrame) -> DataFrame:
    """Studies whose profile belongs to an owner in the access list."""
    mine = profiles.join(access, "owner_id", "left_semi")
    return studies.join(mine, "profile_id", "left_semi")


def profiles_self_first(profiles: DataFrame) -> DataFrame:
    return placed(profiles, "owner_id", F.when(F.lower("relationship") == "self", 0).otherwise(1), "full_name", "profile_id")


def reports_of_study(reports: DataFrame) -> DataFrame:
    """Dated reports first, oldest first."""
    return placed(reports, "study_id", F.col("report_date").asc_nulls_last(), "uploaded_at", "report_id")


def profiles_of_owner(profiles: DataFrame) -> DataFrame:
    return placed(profiles, "owner_id", "created_at", "profile_id")


def studies_of_profile(studies: DataFrame) -> DataFrame:
    """Most recently changed first."""
    return placed(studies, "profile_id", F.desc("updated_at"), F.desc("created_at"), "study_id")


def analyses_of_user(history: DataFrame) -> DataFrame:
    """Newest first."""
    return placed(history, "user_id", F.desc("created_at"), "id")


def history_rows(history: DataFrame) -> DataFrame:
    """History listing: file names split again, dates in ISO form."""
    return history.select(
        "id", "patient_name", "total_records",
        F.filter(F.split("source_filenames", ","), lambda x: x != "").alias("source_filenames"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )
