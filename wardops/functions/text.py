"""Labels and text patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display texts of the appointment states.
STATUS_ICONS = {
    "Scheduled": "🟡", "CheckedIn": "🔵", "In-Progress": "🟠",
    "Completed": "🟢", "Cancelled": "🔴",
}
STATUS_LABELS = {
    "Scheduled": "Scheduled", "CheckedIn": "Checked In", "In-Progress": "In Progress",
    "Completed": "Completed", "Cancelled": "Cancelled",
}
SCHEDULE_LABELS = {
    "Completed": "Examined", "Scheduled": "Confirmed", "CheckedIn": "Checked In",
    "In-Progress": "In Progress", "Cancelled": "Cancelled",
}
UNKNOWN_ICON = "⚪"
BED_COLOURS = {"Available": "green", "Occupied": "red"}
OTHER_BED_COLOUR = "orange"


def relabel(value: Column, labels: dict[str, str], otherwise: Column) -> Column:
    """Replace known texts; unknown ones and NULL give ``otherwise``."""
    expression = None
    for known, label in labels.items():
        expression = (
            F.when(value == known, label)
            if expression is None
            else expression.when(value == known, label)
        )
    return expression.otherwise(otherwise)


def status_label(status: Column) -> Column:
    return relabel(status, STATUS_LABELS, status)


def status_badge(status: Column) -> Column:
    icon = relabel(status, STATUS_ICONS, F.lit(UNKNOWN_ICON))
    return F.concat(icon, F.lit(" "), status_label(status))


def schedule_label(status: Column) -> Column:
    return relabel(status, SCHEDULE_LABELS, F.lit("Pending"))


def bed_colour(status: Column) -> Column:
    return relabel(status, BED_COLOURS, F.lit(OTHER_BED_COLOUR))


def contains_text(value: Column, keyword: str) -> Column:
    """Case-blind match anywhere; ``%`` and ``_`` in the keyword are wildcards."""
    return value.ilike(f"%{keyword}%")


def padded_policy_id(year: int, patient_id: Column) -> Column:
    """``INS-<year>-<0000>``; longer ids are kept whole, never cut."""
    return F.format_string(f"INS-{int(year)}-%04d", patient_id)


def username_slug(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.replace(name, F.lit(" "), F.lit("_"))))


def filled(value: Column) -> Column:
    """True where a required text field has content."""
    return F.coalesce(F.length(value) > 0, F.lit(False))
