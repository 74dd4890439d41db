"""A small clinic as literal rows; every table exists, most start empty."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from wardops.schemas import SCHEMAS
from wardops.tables import Tables

ROLES = [(1, "Admin"), (2, "Doctor"), (3, "Receptionist"), (4, "Accountant"), (5, "Human Resource (HR)")]


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def on(text: str) -> date:
    return date.fromisoformat(text)


def frame(spark, name: str, rows: list[tuple]):
    schema = SCHEMAS[name]
    padded = [tuple(r) + (None,) * (len(schema.fields) - len(r)) for r in rows]
    return spark.createDataFrame(padded, schema)


def tables(spark, **rows: list[tuple]) -> Tables:
    return Tables({name: frame(spark, name, rows.get(name, [])) for name in SCHEMAS})


def clinic(spark, **more: list[tuple]) -> Tables:
    """Twenty patients, twenty doctors on staff ids 3 to 22, one user per role besides."""
    users = [(1, "front", None, 3), (2, "books", None, 4)]
    users += [(n, f"dr_{n}", None, 2) for n in range(3, 23)]
    users += [(23, "chief", None, 1), (25, "people", None, 5)]
    specialties = [("Internal", 3), ("Children", 4), ("Birth", 4), ("Ear", 3), ("Surgery", 3), ("Skin", 3)]
    doctors, departments, next_id = [], [], 1
    for number, (name, size) in enumerate(specialties, start=1):
        departments.append((number, name))
        for _ in range(size):
            doctors.append((next_id, next_id + 2, name))
            next_id += 1
    by_doctor = {staff: next(d for d, n in departments if n == name) for _, staff, name in doctors}
    staff = [
        (u[0], f"Person {u[0]}", None, None, f"09{u[0]:08d}", f"p{u[0]}@example.org", u[0], by_doctor.get(u[0], 7))
        for u in users
    ]
    base = {
        "roles": ROLES,
        "departments": [*departments, (7, "Office")],
        "users": users,
        "staff": staff,
        "doctors": doctors,
        "patients": [
            (n, f"Patient {n}", on("1980-01-01"), "Female", f"03{n:08d}", f"q{n}@example.com")
            for n in range(1, 21)
        ],
        "medicine_categories": [(n, f"Category {n}") for n in range(1, 6)],
        "medicines": [
            (1001, "Tablet A", 200, money("10.50"), 1), (1002, "Tablet B", 500, money("2.00"), 2),
            (1003, "Tablet C", 300, money("5.75"), 2), (1004, "Drops D", 150, money("15.00"), 4),
            (1005, "Syrup E", 100, money("8.20"), 5),
        ],
        "rooms": [
            (101, "Room 101", 1), (102, "Room 102", 1), (103, "Room 103", 2), (201, "Room 201", 3),
            (202, "Room 202", 3), (203, "Room 203", 4), (301, "Room 301", 5), (302, "Room 302", 5),
            (303, "Room 303", 6), (304, "Room 304", 6),
        ],
        "beds": [
            (1, "B101-1", 101, "Available"), (2, "B101-2", 101, "Available"), (3, "B102-1", 102, "Available"),
            (4, "B103-1", 103, "Available"), (5, "B201-1", 201, "Available"), (6, "B202-1", 202, "Occupied"),
            (7, "B203-1", 203, "Occupied"), (8, "B301-1", 301, "Occupied"), (9, "B302-1", 302, "Occupied"),
            (10, "B303-1", 303, "Maintenance"),
        ],
        "admissions": [
            (1, 6, 1, 1, at("2023-10-01 08:30:00"), at("2023-10-10 14:00:00"), "Discharged"),
            (2, 7, 2, 2, at("2023-10-05 10:15:00"), at("2023-10-12 09:30:00"), "Discharged"),
            (3, 8, 15, 3, at("2023-10-15 22:00:00"), at("2023-10-20 16:45:00"), "Discharged"),
            (4, 4, 4, 5, at("2023-11-02 07:00:00"), at("2023-11-05 11:00:00"), "Discharged"),
            (5, 5, 5, 4, at("2023-11-10 13:20:00"), at("2023-11-15 08:00:00"), "Discharged"),
            (6, 11, 3, 6, at("2023-12-01 09:00:00"), None, "Admitted"),
            (7, 12, 8, 7, at("2023-12-03 14:30:00"), None, "Admitted"),
            (8, 13, 9, 8, at("2023-12-04 16:00:00"), None, "Admitted"),
            (9, 10, 10, 9, at("2023-12-05 23:45:00"), None, "Admitted"),
        ],
        "insurance": [
            ("P-01", 1, money("0.80"), on("2027-12-31"), "A"), ("P-02", 3, money("0.70"), on("2026-06-30"), "B"),
            ("P-03", 5, money("0.90"), on("2025-12-31"), "C"), ("P-04", 8, money("0.75"), on("2027-03-15"), "D"),
            ("P-05", 10, money("0.60"), on("2026-09-01"), "E"), ("P-06", 11, money("0.85"), on("2028-01-01"), "A"),
            ("P-07", 13, money("0.50"), on("2026-12-31"), "B"), ("P-08", 15, money("0.65"), on("2027-06-30"), "F"),
            ("P-09", 17, money("0.80"), on("2026-04-01"), "G"), ("P-10", 19, money("0.70"), on("2025-08-15"), "D"),
        ],
    }
    return tables(spark, **{**base, **more})


def rows(frame, *columns: str) -> list:
    """Rows as sorted tuples (single values where one column is asked for)."""
    selected = frame.select(*columns) if columns else frame
    found = [tuple(r) for r in selected.collect()]
    found = [r[0] for r in found] if len(columns) == 1 else found
    return sorted(found, key=repr)


def cut(t: Tables) -> Tables:
    """The same small tables without the work that led to them."""
    def literal(name: str):
        table = t[name]
        return table.sparkSession.createDataFrame(table.collect(), table.schema)

    return Tables({name: literal(name) for name in t})
