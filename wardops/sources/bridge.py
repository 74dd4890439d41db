"""The nineteen domain tables, derived from the star-schema test tables.

Every order becomes either an appointment or an admission, with one invoice
each; customers become patients, suppliers staff, parts medicines and beds,
events the audit trail.  Nothing is sampled: the modulo expressions choose a
*role* for a row (outpatient or inpatient, insured or not), they do not thin
the data.  Keys are shifted by one so that no key is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardops.tables import Tables

FIRST_DOCTOR = 1_000_000
FIRST_RECORD = 5_000_001
SOURCES = "region nation customer supplier part orders lineitem events".split()

# How codes of the source tables read as domain texts.
ROLE_NAMES = {0: "Admin", 1: "Doctor", 2: "Receptionist", 3: "Accountant"}
BED_STATES = {0: "Available", 1: "Occupied", 2: "Cleaning"}
APPOINTMENT_STATES = {
    "1-URGENT": "In-Progress", "2-HIGH": "CheckedIn", "3-MEDIUM": "Scheduled",
    "4-NOT SPECIFIED": "Cancelled",
}
PAYMENT_STATES = {4: "Unpaid", 5: "Cancelled", 6: "Refunded"}
BLOOD_TYPES = {0: "O+", 1: "O-", 2: "A+", 3: "A-", 4: "B+", 5: "B-", 6: "AB+"}
ACTIONS = {
    "view": "User Logged In",
    "signup": "Registered new patient: x",
    "purchase": "Processed payment for invoice #1",
    "click": "New appointment created for patient_id: 1",
}


def _choose(value: Column, texts: dict, otherwise: str) -> Column:
    (first, text), *rest = texts.items()
    choice = F.when(value == first, text)
    for known, text in rest:
        choice = choice.when(value == known, text)
    return choice.otherwise(otherwise)


def _address(name: Column, domain: str) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit(domain))


def _digits(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 8, "0"))


def _inpatient(key: Column) -> Column:
    return key % 5 == 4


class Bridge:
    def __init__(self, spark: SparkSession, folder: str):
        def reader(name: str):
            return lambda: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

        # Opened on first use: a query pays only for the files it reads.
        self._src = Tables({name: reader(name) for name in SOURCES})

    def over(self, **frames: DataFrame) -> "Bridge":
        """The same derivations with some source tables replaced."""
        self._src = self._src.replace(**frames)
        return self

    def _count(self, name: str) -> Column:
        return self._src[name].agg(F.count("*")).scalar()

    def _slotted(self) -> DataFrame:
        """Orders with their 15-minute slot."""
        minutes = ((F.col("o_orderkey") % 96) * 15).cast("int")
        return self._src["orders"].withColumn(
            "slot", F.timestamp_add("MINUTE", minutes, F.col("o_orderdate"))
        )

    def _doctor(self) -> Column:
        """The doctor who sees an order."""
        pick = (F.col("o_orderkey") * 7) % self._count("supplier")
        return FIRST_DOCTOR + pick - F.when(pick % 4 == 3, 1).otherwise(0)

    def departments(self) -> DataFrame:
        return self._src["nation"].select(
            (F.col("n_nationkey") + 1).alias("dept_id"), F.col("n_name").alias("dept_name")
        )

    def roles(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self._src["region"].select(
            (key + 1).alias("role_id"),
            _choose(key, ROLE_NAMES, "Human Resource (HR)").alias("role_name"),
        )

    def users(self) -> DataFrame:
        user = F.col("user_id")
        name = F.concat(F.lit("user_"), user.cast("string"))
        return (
            self._src["events"]
            .select((user + 1).alias("user_id"))
            .distinct()
            .select(
                "user_id",
                name.alias("username"),
                F.sha2(F.concat(F.lit("secret_"), user.cast("string")), 256).alias("password_hash"),
                ((user - 1) % 4 + 1).cast("int").alias("role_id"),
            )
        )

    def staff(self) -> DataFrame:
        key, name = F.col("s_suppkey"), F.col("s_name")
        return self._src["supplier"].select(
            (key + 1).alias("staff_id"),
            name.alias("full_name"),
            F.lit(None).cast("date").alias("dob"),
            F.lit(None).cast("string").alias("gender"),
            _digits("09", key).alias("phone_number"),
            _address(name, "@example.org").alias("email"),
            (key + 1).alias("user_id"),
            (F.col("s_nationkey") + 1).alias("dept_id"),
        )

    def doctors(self) -> DataFrame:
        key = F.col("s_suppkey")
        nation = self._src["nation"].select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return (
            self._src["supplier"]
            .filter(key % 4 != 3)
            .join(nation, "s_nationkey")
            .select(
                (key + FIRST_DOCTOR).alias("doctor_id"),
                (key + 1).alias("staff_id"),
                F.concat(F.lit("Spec_"), "n_name").alias("specialty"),
            )
        )

    def patients(self) -> DataFrame:
        key, name = F.col("c_custkey"), F.col("c_name")
        return self._src["customer"].select(
            (key + 1).alias("patient_id"),
            name.alias("full_name"),
            F.date_add(F.lit("1940-01-01").cast("date"), ((key * 37) % 25000).cast("int")).alias("dob"),
            F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
            _digits("03", key).alias("phone"),
            _address(name, "@example.com").alias("email"),
        )

    def patient_health_profile(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._src["customer"].filter(key % 4 != 0).select(
            (key + 1).alias("profile_id"),
            (key + 1).alias("patient_id"),
            F.when(key % 3 == 0, "None").otherwise("Penicillin").alias("allergies"),
            F.col("c_mktsegment").alias("chronic_diseases"),
            _choose(key % 8, BLOOD_TYPES, "AB-").alias("blood_type"),
        )

    def insurance(self) -> DataFrame:
        """Patients hold no policy, one, or two."""
        key, nth = F.col("c_custkey"), F.col("nth")
        policies = (
            F.when(key % 3 == 0, F.expr("CAST(array() AS array<int>)"))
            .when(key % 10 == 1, F.array(F.lit(0), F.lit(1)))
            .otherwise(F.array(F.lit(0)))
        )
        percent = (key + nth * 17) % 101
        return (
            self._src["customer"]
            .select(key, "c_nationkey", F.explode(policies).alias("nth"))
            .select(
                F.concat(
                    F.lit("INS-2024-"), F.lpad((key + 1).cast("string"), 8, "0"),
                    F.lit("-"), nth.cast("string"),
                ).alias("insurance_id"),
                (key + 1).alias("patient_id"),
                (percent.cast("decimal(5,2)") / 100).cast("decimal(3,2)").alias("coverage_rate"),
                F.date_add(
                    F.lit("1996-01-01").cast("date"), ((key * 13 + nth * 700) % 3000).cast("int")
                ).alias("expiry_date"),
                F.concat(
                    F.lit("Provider "), (F.col("c_nationkey") % 6).cast("string")
                ).alias("provider"),
            )
        )

    def medicine_categories(self) -> DataFrame:
        # One row per distinct category text: a catalogue, not a data table.
        by_name = Window.orderBy("category_name")
        return (
            self._src["part"]
            .select(F.col("p_type").alias("category_name"))
            .distinct()
            .select(F.row_number().over(by_name).alias("category_id"), "category_name")
        )

    def medicines(self) -> DataFrame:
        return self._src["part"].select(
            (F.col("p_partkey") + 1).alias("med_id"),
            F.col("p_name").alias("med_name"),
            (F.col("p_size") * 10).alias("stock"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.col("p_type").alias("category_name"),
        )

    def rooms(self) -> DataFrame:
        number = F.col("s_suppkey") + 1
        return self._src["supplier"].select(
            number.alias("room_id"),
            F.concat(F.lit("Room "), number.cast("string")).alias("room_name"),
            (F.col("s_nationkey") + 1).alias("dept_id"),
        )

    def beds(self) -> DataFrame:
        key = F.col("p_partkey")
        return self._src["part"].select(
            (key + 1).alias("bed_id"),
            F.concat(F.lit("B"), (key + 1).cast("string")).alias("bed_code"),
            (key % self._count("supplier") + 1).alias("room_id"),
            _choose(F.col("p_size") % 4, BED_STATES, "Maintenance").alias("status"),
        )

    def appointments(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
        done = F.col("slot") + F.expr("INTERVAL '25' MINUTE")
        return self._slotted().filter(~_inpatient(key)).select(
            (key + 1).alias("appt_id"),
            (F.col("o_custkey") + 1).alias("patient_id"),
            self._doctor().alias("doctor_id"),
            F.col("slot").alias("appt_date"),
            F.when(priority == "5-LOW", done).alias("completed_at"),
            _choose(priority, APPOINTMENT_STATES, "Completed").alias("status"),
        )

    def admissions(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        closed = F.col("o_orderstatus") != "P"
        return self._slotted().filter(_inpatient(key)).select(
            (key + 1).alias("admission_id"),
            (customer + 1).alias("patient_id"),
            self._doctor().alias("doctor_id"),
            ((key * 3 + customer) % self._count("part") + 1).alias("bed_id"),
            F.col("slot").alias("admission_date"),
            F.when(closed, F.col("slot") + F.expr("INTERVAL '4' DAY")).alias("discharge_date"),
            F.when(closed, "Discharged").otherwise("Admitted").alias("discharge_status"),
        )

    def medical_records(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self._src["orders"].select(
            (key + FIRST_RECORD).alias("record_id"),
            F.when(~_inpatient(key), key + 1).alias("appt_id"),
            F.when(_inpatient(key), key + 1).alias("admission_id"),
            F.concat(F.lit("symptom "), (customer % 17).cast("string")).alias("symptoms"),
            F.concat(F.lit("diagnosis "), (customer % 23).cast("string")).alias("diagnosis"),
            F.concat(F.lit("note "), "o_orderstatus").alias("doctor_notes"),
        )

    def prescriptions(self) -> DataFrame:
        seen = self._src["orders"].select(
            F.col("o_orderkey").alias("l_orderkey"), self._doctor().alias("doctor_id")
        )
        # One row per order and line parity: collapse the lines before the join.
        return (
            self._src["lineitem"]
            .select("l_orderkey", (F.col("l_linenumber") % 2).alias("parity"))
            .distinct()
            .join(seen, "l_orderkey")
            .select(
                (F.col("l_orderkey") * 2 + F.col("parity")).alias("presc_id"),
                (F.col("l_orderkey") + FIRST_RECORD).alias("record_id"),
                "doctor_id",
            )
        )

    def presc_details(self) -> DataFrame:
        return self._src["lineitem"].select(
            (F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("presc_id"),
            (F.col("l_partkey") + 1).alias("med_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.concat("l_returnflag", F.lit("/"), "l_linestatus", F.lit(" daily")).alias("dosage"),
        )

    def invoices(self) -> DataFrame:
        key = F.col("o_orderkey")
        gross = F.col("o_totalprice").cast("decimal(10,2)")
        stored = (gross * F.lit("0.80").cast("decimal(3,2)")).cast("decimal(10,2)")
        net = F.when((key % 7 == 4) | (key % 3 == 0), F.lit(None)).otherwise(
            F.when(key % 11 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(stored)
        )
        return self._slotted().select(
            (key + 1).alias("invoice_id"),
            F.when(~_inpatient(key), key + 1).alias("appt_id"),
            F.when(_inpatient(key), key + 1).alias("admission_id"),
            (F.col("slot") + F.expr("INTERVAL '2' HOUR")).alias("invoice_date"),
            gross.alias("total_amount"),
            _choose(key % 7, PAYMENT_STATES, "Paid").alias("payment_status"),
            net.alias("net_amount"),
        )

    def audit_logs(self) -> DataFrame:
        return self._src["events"].select(
            (F.col("event_id") + 1).alias("log_id"),
            F.when(F.col("event_id") % 50 != 0, F.col("user_id") + 1).alias("user_id"),
            _choose(F.col("event_type"), ACTIONS, "Deleted appointment for patient: x").alias("action"),
            F.col("ts").alias("timestamp"),
        )


TABLE_NAMES = [
    "roles", "departments", "medicine_categories", "patients", "users", "medicines", "rooms",
    "staff", "beds", "insurance", "patient_health_profile", "doctors", "appointments",
    "admissions", "medical_records", "prescriptions", "presc_details", "invoices", "audit_logs",
]


def bridge_tables(spark: SparkSession, folder: str) -> Tables:
    source = Bridge(spark, folder)
    return Tables({name: getattr(source, name) for name in TABLE_NAMES})
