"""Helper CTEs: the views of the data that the read queries share."""

AS_OF = "TIMESTAMP '1999-06-15 09:55:00'"
TODAY = "DATE '1999-06-15'"
AUDIT_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"
FIRST, LAST = "DATE '1999-01-01'", "DATE '1999-06-30'"
NO_RATE = "CAST(0 AS DECIMAL(3,2))"


def net(gross: str, rate: str) -> str:
    return f"CAST({gross} * (CAST(1 AS DECIMAL(3,2)) - coalesce({rate}, {NO_RATE})) AS DECIMAL(15,2))"


def dollars(amount: str) -> str:
    return f"format('${{:,.2f}}', CAST({amount} AS DOUBLE))"


def percent(rate: str) -> str:
    return f"concat(CAST(CAST({rate} * 100 AS INTEGER) AS VARCHAR), '%')"


def clock(stamp: str) -> str:
    return f"strftime({stamp}, '%H:%M')"


SHAPES = {
    # Texts of the appointment states: on badges and on schedules.
    "_states": """
        SELECT * FROM (VALUES
          ('Scheduled', '🟡', 'Scheduled', 'Confirmed'), ('CheckedIn', '🔵', 'Checked In', 'Checked In'),
          ('In-Progress', '🟠', 'In Progress', 'In Progress'), ('Completed', '🟢', 'Completed', 'Examined'),
          ('Cancelled', '🔴', 'Cancelled', 'Cancelled')) v(state, icon, label, shown)""",
    "_visits": """
        SELECT 'out' AS kind, appt_id AS visit_id, patient_id, appt_date AS visited_at FROM appointments
        UNION ALL SELECT 'in', admission_id, patient_id, admission_date FROM admissions""",
    "_bills": """
        SELECT invoices.*, kind, patient_id, full_name AS patient_name
        FROM invoices
        LEFT JOIN _visits ON visit_id = ifnull(appt_id, admission_id) AND kind = if(appt_id IS NULL, 'in', 'out')
        LEFT JOIN patients USING (patient_id)""",
    "_cards": """
        SELECT doctor_id, staff_id, full_name AS doctor_name, specialty, dept_name, phone_number, email
        FROM doctors JOIN staff USING (staff_id) JOIN departments USING (dept_id)""",
    "_diary": """
        SELECT appointments.*, CAST(appt_date AS DATE) AS day, full_name AS patient_name, phone,
          doctor_name, specialty, concat(icon, ' ', label) AS badge, label, shown
        FROM appointments JOIN patients USING (patient_id) JOIN _cards USING (doctor_id)
        JOIN _states ON state = status""",
    "_today": f"SELECT * FROM _diary WHERE day = {TODAY}",
    "_ahead": f"SELECT * FROM _diary WHERE day >= {TODAY} - 7",
    "_questions": """
        SELECT DISTINCT doctor_id, appt_date + unnest([INTERVAL '-10' MINUTE, INTERVAL '10' MINUTE]) AS as_of FROM appointments""",
    "_lines": """
        SELECT presc_id, med_name, dosage, quantity, price, CAST(price * quantity AS DECIMAL(15,2)) AS subtotal
        FROM presc_details JOIN medicines USING (med_id)""",
    "_treatments": """
        SELECT if(appt_id IS NULL, 'in', 'out') AS kind, ifnull(appt_id, admission_id) AS visit_id,
          diagnosis, med_name, dosage
        FROM medical_records LEFT JOIN prescriptions USING (record_id) LEFT JOIN _lines USING (presc_id)""",
    "_rates": f"""
        SELECT patient_id, arg_max(coverage_rate, (expiry_date, insurance_id)) AS rate
        FROM insurance WHERE expiry_date >= {TODAY} GROUP BY patient_id""",
    "_due": f"""
        SELECT _bills.*, coalesce(rate, {NO_RATE}) AS coverage_rate, {net("total_amount", "rate")} AS due
        FROM _bills LEFT JOIN _rates USING (patient_id)""",
    "_settled": f"""
        SELECT * FROM _bills
        WHERE payment_status <> 'Unpaid' AND invoice_date >= {FIRST} AND invoice_date < {LAST} + 1""",
    "_takings": """
        SELECT invoice_id, invoice_date, ifnull(net_amount, total_amount) AS taken,
          date_trunc('month', invoice_date) AS month
        FROM invoices WHERE payment_status = 'Paid'""",
    "_month": """
        SELECT CAST(sum(taken) AS DECIMAL(20,2)) AS total_revenue, count(*) AS total_invoices
        FROM _takings WHERE month = DATE '1999-06-01'""",
    "_bed_list": """
        SELECT bed_code, room_name, dept_name, status AS bed_status, ifnull(inside.full_name, 'Empty') AS current_patient
        FROM beds JOIN rooms USING (room_id) JOIN departments USING (dept_id)
        LEFT JOIN (SELECT bed_id, full_name FROM admissions JOIN patients USING (patient_id)
                   WHERE discharge_date IS NULL) inside USING (bed_id)""",
    "_people": """
        SELECT user_id, username, role_name, staff_id, full_name
        FROM users JOIN roles USING (role_id) LEFT JOIN staff USING (user_id)""",
    "_logins": """
        SELECT log_id, timestamp AS login_time, username, role_name, staff_id, full_name
        FROM audit_logs JOIN _people USING (user_id) WHERE action = 'User Logged In'""",
    "_waiting": """
        SELECT appointments.*, full_name AS patient_name, label, blood_type, allergies, chronic_diseases
        FROM appointments JOIN patients USING (patient_id) JOIN _states ON state = status
        LEFT JOIN patient_health_profile USING (patient_id)
        WHERE completed_at IS NULL AND status <> 'Cancelled' AND status <> 'Completed'""",
}
