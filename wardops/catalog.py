"""The tables and standing views under their names, for ``spark.sql``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from wardops.plans import beds, billing, people, scheduling
from wardops.tables import Tables


def standing_views(t: Tables, as_of: datetime) -> dict[str, DataFrame]:
    return {
        "view_receptionist_appointments": scheduling.receptionist_appointments(t),
        "view_doctor_work_schedule": scheduling.doctor_work_schedule(t, as_of),
        "view_hospital_bed_status": beds.bed_status(t),
        "view_detailed_patient_bill": billing.patient_bill(t),
        "view_hr_staff_directory": people.staff_directory(t),
    }


def register(spark: SparkSession, t: Tables, as_of: datetime) -> list[str]:
    """Create temporary views of all tables and standing views; returns the names.

    Afterwards ``spark.sql(text, args={...})`` runs SQL with bound parameters.
    """
    frames = {**{name: t[name] for name in t}, **standing_views(t, as_of)}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)
