"""The nineteen care-facility tables: columns, keys, domains and defaults.

Every reader uses these explicit schemas; nothing is inferred.  ``KEYS``,
``UNIQUE``, ``FOREIGN_KEYS``, ``DOMAINS`` and ``DEFAULTS`` drive the integrity
audit and the change rules.
"""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, STR = T.IntegerType(), T.LongType(), T.StringType()
DATE, STAMP = T.DateType(), T.TimestampNTZType()
MONEY, RATE = T.DecimalType(10, 2), T.DecimalType(3, 2)

_COLUMNS: dict[str, list[tuple]] = {
    "roles": [("role_id", INT), ("role_name", STR, 50)],
    "departments": [("dept_id", INT), ("dept_name", STR, 100)],
    "medicine_categories": [("category_id", INT), ("category_name", STR, 100)],
    "patients": [
        ("patient_id", LONG), ("full_name", STR, 100), ("dob", DATE),
        ("gender", STR, 10), ("phone", STR, 15), ("email", STR, 100),
    ],
    "users": [
        ("user_id", LONG), ("username", STR, 50),
        ("password_hash", STR, 255), ("role_id", INT),
    ],
    "medicines": [
        ("med_id", LONG), ("med_name", STR, 100), ("stock", INT),
        ("price", MONEY), ("category_id", INT),
    ],
    "rooms": [("room_id", LONG), ("room_name", STR, 50), ("dept_id", INT)],
    "staff": [
        ("staff_id", LONG), ("full_name", STR, 100), ("dob", DATE),
        ("gender", STR, 10), ("phone_number", STR, 15), ("email", STR, 100),
        ("user_id", LONG), ("dept_id", INT),
    ],
    "beds": [
        ("bed_id", LONG), ("bed_code", STR, 20), ("room_id", LONG), ("status", STR),
    ],
    "insurance": [
        ("insurance_id", STR, 20), ("patient_id", LONG), ("coverage_rate", RATE),
        ("expiry_date", DATE), ("provider", STR, 100),
    ],
    "patient_health_profile": [
        ("profile_id", LONG), ("patient_id", LONG), ("allergies", STR),
        ("chronic_diseases", STR), ("blood_type", STR, 3),
    ],
    "doctors": [("doctor_id", LONG), ("staff_id", LONG), ("specialty", STR, 100)],
    "appointments": [
        ("appt_id", LONG), ("patient_id", LONG), ("doctor_id", LONG),
        ("appt_date", STAMP), ("completed_at", STAMP), ("status", STR),
    ],
    "admissions": [
        ("admission_id", LONG), ("patient_id", LONG), ("doctor_id", LONG),
        ("bed_id", LONG), ("admission_date", STAMP), ("discharge_date", STAMP),
        ("discharge_status", STR, 255),
    ],
    "medical_records": [
        ("record_id", LONG), ("appt_id", LONG), ("admission_id", LONG),
        ("symptoms", STR), ("diagnosis", STR, 255), ("doctor_notes", STR),
    ],
    "prescriptions": [("presc_id", LONG), ("record_id", LONG), ("doctor_id", LONG)],
    "presc_details": [
        ("detail_id", LONG), ("presc_id", LONG), ("med_id", LONG),
        ("quantity", INT), ("dosage", STR, 255),
    ],
    "invoices": [
        ("invoice_id", LONG), ("appt_id", LONG), ("admission_id", LONG),
        ("invoice_date", STAMP), ("total_amount", MONEY), ("payment_status", STR),
        ("net_amount", MONEY),
    ],
    "audit_logs": [
        ("log_id", LONG), ("user_id", LONG), ("action", STR, 255), ("timestamp", STAMP),
    ],
}

SCHEMAS: dict[str, T.StructType] = {
    table: T.StructType([T.StructField(c[0], c[1], True) for c in columns])
    for table, columns in _COLUMNS.items()
}

MAX_LENGTHS: dict[str, dict[str, int]] = {
    table: {c[0]: c[2] for c in columns if len(c) > 2}
    for table, columns in _COLUMNS.items()
}

KEYS: dict[str, str] = {table: columns[0][0] for table, columns in _COLUMNS.items()}
KEYS["command_marks"] = "command"  # kept by states that commands reach out of order

UNIQUE: list[tuple[str, str]] = [
    ("patients", "email"), ("users", "username"), ("staff", "email"),
]

# (child table, child column, parent table); the parent column is its key.
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("users", "role_id", "roles"),
    ("medicines", "category_id", "medicine_categories"),
    ("rooms", "dept_id", "departments"),
    ("staff", "user_id", "users"),
    ("staff", "dept_id", "departments"),
    ("beds", "room_id", "rooms"),
    ("insurance", "patient_id", "patients"),
    ("patient_health_profile", "patient_id", "patients"),
    ("doctors", "staff_id", "staff"),
    ("appointments", "patient_id", "patients"),
    ("appointments", "doctor_id", "doctors"),
    ("admissions", "patient_id", "patients"),
    ("admissions", "doctor_id", "doctors"),
    ("admissions", "bed_id", "beds"),
    ("medical_records", "appt_id", "appointments"),
    ("medical_records", "admission_id", "admissions"),
    ("prescriptions", "record_id", "medical_records"),
    ("prescriptions", "doctor_id", "doctors"),
    ("presc_details", "presc_id", "prescriptions"),
    ("presc_details", "med_id", "medicines"),
    ("invoices", "appt_id", "appointments"),
    ("invoices", "admission_id", "admissions"),
    ("audit_logs", "user_id", "users"),
]

# Allowed texts and defaults, which results must agree with.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("beds", "status"): ["Available", "Occupied", "Cleaning", "Maintenance"],
    ("appointments", "status"): [
        "Scheduled", "CheckedIn", "In-Progress", "Completed", "Cancelled",
    ],
    ("invoices", "payment_status"): ["Unpaid", "Paid", "Cancelled", "Refunded"],
    ("patient_health_profile", "blood_type"): [
        "O+", "O-", "A+", "A-", "B+", "B-", "AB+", "AB-",
    ],
}
DEFAULTS: dict[str, dict[str, str]] = {
    "beds": {"status": "Available"},
    "insurance": {"coverage_rate": "0.00"},
    "appointments": {"status": "Scheduled"},
    "invoices": {"payment_status": "Unpaid"},
}
ADMIN, DOCTOR, RECEPTIONIST = "Admin", "Doctor", "Receptionist"
ACCOUNTANT, HR = "Accountant", "Human Resource (HR)"
LOGIN_ACTION = "User Logged In"
