"""SQL twins of the read queries, over the tables and the shared shapes."""

from oracles.shapes import AS_OF, AUDIT_AS_OF, NO_RATE, TODAY, clock, dollars, net, percent


def available(slot: str) -> str:
    """Doctors free at a slot, with the whole minutes since or until their last completion."""
    return f"""
        SELECT doctor_id, doctor_name, specialty, dept_name, last_free_at,
          CAST(coalesce(abs(epoch_us(last_free_at) - epoch_us({slot})) // 60000000, 0) AS BIGINT) AS minutes_from_slot
        FROM _cards
        LEFT JOIN (SELECT doctor_id, max(completed_at) AS last_free_at FROM appointments
                   WHERE status = 'Completed' GROUP BY doctor_id) done USING (doctor_id)
        ANTI JOIN (SELECT doctor_id FROM appointments
                   WHERE status IN ('Scheduled', 'CheckedIn', 'In-Progress')
                     AND abs(epoch_us(appt_date) - epoch_us({slot})) < 1800000000) busy USING (doctor_id)"""


READ_SQL = {
    "prescription_total": """
        SELECT presc_id, CAST(ifnull(sum(subtotal), 0) AS DECIMAL(15,2)) AS total_amount
        FROM prescriptions LEFT JOIN _lines USING (presc_id) GROUP BY presc_id""",
    "net_pay": "SELECT invoice_id, total_amount AS gross_amount, coverage_rate, due AS net_pay FROM _due",
    "receptionist_appointments": """
        SELECT appt_id, patient_name, phone AS patient_phone, doctor_name, appt_date, status AS appt_status FROM _diary""",
    "today_appointments": f"""
        SELECT appt_id, patient_name, phone, doctor_name, appt_date, status, {clock("appt_date")} AS clock, badge
        FROM _today""",
    "today_appointment_count": "SELECT count(*) AS appointments FROM _today WHERE status = 'Scheduled'",
    "doctor_work_schedule": """
        SELECT appt_id, doctor_name, specialty, day AS schedule_date, strftime(appt_date, '%H:%M:%S') AS schedule_time,
          patient_name, shown AS display_status,
          format('{:02d}:{:02d}:{:02d}', (minutes + 30) // 60, (minutes + 30) % 60, second(appt_date)) AS end_time
        FROM (SELECT *, hour(appt_date) * 60 + minute(appt_date) AS minutes FROM _ahead) x""",
    # The badge looks the schedule's own text up again; texts it does not know get a white dot.
    "doctor_day_sheet": """
        SELECT doctor_name, appt_id, patient_name, day AS appt_day, strftime(appt_date, '%H:%M:%S') AS appt_time,
          concat(ifnull(s.icon, '⚪'), ' ', ifnull(s.label, _ahead.shown)) AS badge
        FROM _ahead LEFT JOIN _states s ON s.state = _ahead.shown""",
    "bed_status": "SELECT * FROM _bed_list",
    "bed_board": """
        SELECT *, if(bed_status = 'Available', 'green', if(bed_status = 'Occupied', 'red', 'orange')) AS colour
        FROM _bed_list""",
    "bed_availability_counts": """
        SELECT dept_name, count(*) AS beds_shown, count(*) FILTER (bed_status = 'Available') AS beds_available
        FROM _bed_list GROUP BY dept_name""",
    "patient_bill": f"""
        SELECT invoice_id, invoice_date, patient_name, diagnosis AS doctor_diagnosis, med_name AS medicine_name,
          dosage, total_amount AS gross_amount, ifnull(coverage_rate, {NO_RATE}) AS insurance_rate,
          CAST(ifnull(net_amount, {net("total_amount", "coverage_rate")}) AS DECIMAL(15,2)) AS net_pay
        FROM _bills
        LEFT JOIN insurance USING (patient_id)
        LEFT JOIN _treatments ON _treatments.kind = _bills.kind AND visit_id = ifnull(appt_id, admission_id)
        WHERE payment_status = 'Paid'""",
    "staff_directory": """
        SELECT staff_id, _people.full_name, role_name, dept_name, phone_number, email
        FROM _people JOIN staff USING (staff_id) JOIN departments USING (dept_id)""",
    "patient_search": """
        SELECT * FROM patients WHERE contains(full_name, '00012') OR contains(phone, '00012')""",
    "patient_profile": """
        SELECT 'Profile' AS data_type, * EXCLUDE (profile_id) FROM patient_health_profile""",
    "patient_history": """
        SELECT patient_id, record_id, diagnosis, symptoms, doctor_notes, visited_at AS event_date,
          if(kind = 'out', 'Outpatient', 'Inpatient') AS visit_type
        FROM medical_records JOIN _visits ON visit_id = if(kind = 'out', appt_id, admission_id)""",
    "doctors_free_on_date": f"""
        SELECT staff_id, doctor_name AS full_name, dept_name, specialty FROM _cards
        ANTI JOIN (SELECT doctor_id FROM appointments WHERE CAST(appt_date AS DATE) = {TODAY}) t USING (doctor_id)""",
    "doctor_schedule_flow": f"""
        SELECT doctor_id, flow_type, patient_name AS full_name, appt_date, {clock("appt_date")} AS clock FROM (
          SELECT *, 'Active' AS flow_type FROM _diary
          WHERE status IN ('CheckedIn', 'In-Progress')
            AND appt_date BETWEEN {AS_OF} - INTERVAL 30 MINUTE AND {AS_OF}
          UNION ALL
          SELECT DISTINCT ON (doctor_id) *, 'Next' FROM (
            SELECT * FROM _diary WHERE status IN ('Scheduled', 'CheckedIn') AND appt_date > {AS_OF}
            ORDER BY doctor_id, appt_date, appt_id) upcoming) flow""",
    "monthly_revenue": "SELECT * FROM _month",
    "monthly_revenue_empty_month": """
        SELECT CAST(sum(taken) AS DECIMAL(20,2)) AS total_revenue, count(*) AS total_invoices
        FROM _takings WHERE month = DATE '2010-01-01'""",
    "monthly_revenue_reports": """
        SELECT DISTINCT user_id AS executor_id, 1999 AS year, 6 AS month, reader AS allowed,
          if(reader, NULL, 'Permission Denied') AS reason, if(reader, total_revenue, NULL) AS total_revenue,
          if(reader, total_invoices, NULL) AS total_invoices
        FROM (SELECT user_id, role_name IN ('Accountant', 'Admin') AS reader FROM _people) p, _month""",
    # Half up in whole cents, because DuckDB divides decimals as doubles.
    "monthly_average": """
        SELECT revenue, n AS invoices_collected,
          CAST(CAST((2 * CAST(revenue * 100 AS HUGEINT) + n) // (2 * n) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,2)) AS average_per_invoice
        FROM (SELECT CAST(ifnull(total_revenue, 0) AS DECIMAL(20,2)) AS revenue, greatest(total_invoices, 1) AS n FROM _month) m""",
    "daily_revenue": """
        SELECT CAST(d AS INTEGER) AS day, CAST(ifnull(sum(taken), 0) AS DECIMAL(20,2)) AS daily_revenue
        FROM range(1, 31) days(d)
        LEFT JOIN _takings ON CAST(invoice_date AS DATE) = make_date(1999, 6, CAST(d AS INTEGER))
        GROUP BY d""",
    "revenue_trend_12m": f"""
        SELECT CAST(year(month) AS INTEGER) AS yr, CAST(month(month) AS INTEGER) AS mo,
          CAST(sum(taken) AS DECIMAL(20,2)) AS revenue, concat(month(month), '/', year(month)) AS month_label
        FROM _takings WHERE invoice_date >= {AS_OF} - INTERVAL 12 MONTH GROUP BY month""",
    "payment_history": """
        SELECT invoice_id, invoice_date, payment_status, patient_name, total_amount, net_amount FROM _settled""",
    "period_net_revenue": f"""
        SELECT total_net_revenue, {dollars("total_net_revenue")} AS total_display FROM (
          SELECT CAST(sum(if(net_amount > 0, net_amount, total_amount)) AS DECIMAL(20,2)) AS total_net_revenue
          FROM _settled WHERE payment_status = 'Paid') x""",
    "refundable_invoices": """
        SELECT invoice_id, concat('#', invoice_id, ' — ', patient_name) AS label
        FROM _settled WHERE payment_status = 'Paid'""",
    "pending_invoices": """
        SELECT invoice_id, invoice_date, patient_name, patient_id, coverage_rate, total_amount AS gross_amount,
          due AS estimated_net, if(kind = 'out', 'Outpatient', 'Inpatient') AS visit_type
        FROM _due WHERE payment_status = 'Unpaid'""",
    "pending_invoice_cards": f"""
        SELECT invoice_id,
          concat('Invoice #', invoice_id, ' — ', patient_name, ' — ', if(kind = 'out', 'Outpatient', 'Inpatient')) AS title,
          {dollars("total_amount")} AS gross_display, {percent("coverage_rate")} AS coverage_display,
          {dollars("due")} AS net_display
        FROM _due WHERE payment_status = 'Unpaid'""",
    "invoice_line_items": """
        SELECT invoice_id, med_name, dosage, quantity, price, subtotal
        FROM _lines JOIN prescriptions USING (presc_id) JOIN medical_records USING (record_id)
        JOIN invoices USING (appt_id) WHERE payment_status = 'Unpaid'""",
    "active_coverage": f"""
        SELECT patient_id, coalesce(rate, {NO_RATE}) AS coverage_rate FROM patients LEFT JOIN _rates USING (patient_id)""",
    "insurance_status": f"""
        SELECT insurance_id, full_name AS patient_name, patient_id, provider, coverage_rate, expiry_date,
          if(expiry_date >= {TODAY}, 'Active', 'Expired') AS policy_state,
          {percent("coverage_rate")} AS coverage_display, CAST(expiry_date AS VARCHAR) AS expiry_display
        FROM insurance JOIN patients USING (patient_id)""",
    "staff_by_department": """
        SELECT staff_id, full_name, phone_number, dept_name FROM staff JOIN departments USING (dept_id)""",
    "staff_activity": """
        SELECT username, total_actions, last_activity
        FROM users JOIN (SELECT user_id, count(*) AS total_actions, max(timestamp) AS last_activity
                         FROM audit_logs GROUP BY user_id) acted USING (user_id)""",
    "doctor_appointment_counts": """
        SELECT doctor_id, doctor_name AS full_name, specialty, dept_name, phone_number, email,
          ifnull(n, 0) AS total_appointments
        FROM _cards LEFT JOIN (SELECT doctor_id, count(*) AS n FROM appointments GROUP BY doctor_id) b USING (doctor_id)""",
    "staff_accounts": "SELECT full_name, user_id, username FROM _people WHERE staff_id IS NOT NULL",
    "users_by_role": """
        SELECT role_name, ifnull(n, 0) AS user_count
        FROM roles LEFT JOIN (SELECT role_id, count(*) AS n FROM users GROUP BY role_id) held USING (role_id)""",
    "actions_last_24h": f"""
        SELECT count(*) AS action_count FROM audit_logs WHERE {AUDIT_AS_OF} - timestamp < INTERVAL 24 HOUR""",
    "login_history": """
        SELECT row_number() OVER (PARTITION BY username ORDER BY login_time, log_id) AS login_no,
          username, full_name, role_name, login_time FROM _logins""",
    "login_frequency": "SELECT username, count(*) AS total_logins FROM _logins GROUP BY username",
    "audit_latest": """
        SELECT log_id, username, action, timestamp FROM audit_logs JOIN users USING (user_id)
        ORDER BY timestamp DESC, log_id DESC LIMIT 100""",
    "home_kpis": """
        SELECT (SELECT count(*) FROM patients) AS patients, (SELECT count(*) FROM _today) AS appointments_today,
          (SELECT count(*) FROM beds WHERE status = 'Available') AS available_beds,
          (SELECT count(*) FROM invoices WHERE payment_status = 'Unpaid') AS unpaid_invoices""",
    "slot_available_doctors": available(AS_OF),
    "referral_candidates": f"""
        SELECT * FROM ({available(f"({AS_OF} + INTERVAL 5 MINUTE)")}) free
        WHERE doctor_id <> 1000001 ORDER BY minutes_from_slot, doctor_id LIMIT 10""",
    "doctor_patients_today": """
        SELECT doctor_id, appt_id, patient_id, patient_name FROM _today
        WHERE status IN ('CheckedIn', 'In-Progress', 'Completed')""",
    "patient_today_appointments": f"""
        SELECT patient_id, appt_id, doctor_name, specialty, appt_date, status, {clock("appt_date")} AS clock, badge
        FROM _today""",
    "exam_queue": f"""
        SELECT doctor_id, appt_id, patient_id, patient_name, appt_date, status, blood_type, allergies, chronic_diseases,
          concat(patient_name, ' — ', {clock("appt_date")}, ' (', label, ')') AS queue_label
        FROM _waiting""",
    "exam_profile_cards": """
        SELECT appt_id, ifnull(blood_type, '—') AS blood_type, ifnull(allergies, '—') AS allergies,
          ifnull(chronic_diseases, '—') AS chronic_diseases
        FROM _waiting""",
    "doctor_profile": "SELECT doctor_id, staff_id, doctor_name AS full_name, specialty, dept_name FROM _cards",
    "medicine_catalogue": f"""
        SELECT med_id, med_name, price, stock,
          concat(med_name, ' (stock: ', stock, ', price: ', {dollars("price")}, ')') AS label
        FROM medicines""",
    "prescription_items": "SELECT presc_id, med_name, dosage, quantity FROM _lines",
    "reference_lists": """
        SELECT 'patients' AS list_name, patient_id AS entry_id, full_name AS entry_name, phone FROM patients
        UNION ALL SELECT 'departments', CAST(dept_id AS BIGINT), dept_name, NULL FROM departments
        UNION ALL SELECT 'roles', CAST(role_id AS BIGINT), role_name, NULL FROM roles""",
    "resolve_logins": """
        SELECT event_id + 1 AS attempt_id, username, granted, if(granted, p.user_id, NULL) AS user_id,
          if(granted, role_name, NULL) AS role_name, if(granted, ifnull(full_name, username), NULL) AS full_name,
          if(granted, staff_id, NULL) AS staff_id, if(granted AND role_name = 'Doctor', doctor_id, NULL) AS doctor_id
        FROM (SELECT event_id, events.user_id + 1 AS user_id, event_type <> 'error' AS granted FROM events) e
        JOIN _people p ON p.user_id = e.user_id LEFT JOIN doctors USING (staff_id)""",
    "executor_roles": """
        SELECT executor_id, role_name, ifnull(role_name = 'Accountant', FALSE) AS may_take_payment,
          ifnull(role_name IN ('Accountant', 'Admin'), FALSE) AS may_read_revenue,
          ifnull(role_name IN ('Admin', 'Human Resource (HR)'), FALSE) AS may_manage_staff,
          ifnull(role_name IN ('Admin', 'Receptionist'), FALSE) AS may_delete_appointment
        FROM (SELECT DISTINCT user_id AS executor_id FROM audit_logs) x
        LEFT JOIN (SELECT DISTINCT user_id, role_name FROM _people) p ON p.user_id = executor_id""",
}
# Plain or hashed, the same attempts are right.
READ_SQL["resolve_plain_logins"] = READ_SQL["resolve_logins"]

#: One value of an optional filter, and tables read back from where they were stored.
READ_SQL |= {
    "staff_directory_of_role": f"SELECT * FROM ({READ_SQL['staff_directory']}) d WHERE dept_name = 'NATION_6' AND role_name = 'Doctor'",
    "directory_by_sql": f"SELECT staff_id, full_name, dept_name FROM ({READ_SQL['staff_directory']}) d WHERE role_name = 'Doctor' AND staff_id > 10",
    "staff_by_department_of_one": f"{READ_SQL['staff_by_department']} WHERE dept_id = 7",
    "today_appointments_in_state": f"{READ_SQL['today_appointments']} WHERE status = 'CheckedIn'",
    "patient_history_of_one": f"SELECT * FROM ({READ_SQL['patient_history']}) h WHERE patient_id = 17",
    "doctor_schedule_flow_of_one": f"SELECT * FROM ({READ_SQL['doctor_schedule_flow']}) f WHERE doctor_id = 1000001",
    "bed_status_free": f"SELECT * FROM ({READ_SQL['bed_status']}) b WHERE bed_status = 'Available'",
    "username_slugs": "SELECT staff_id, concat('st_', lower(replace(full_name, ' ', '_'))) AS username FROM staff",
    "snapshot_invoices": "SELECT * FROM invoices",
    "snapshot_versions": f"""
        SELECT '19980101_000000' AS snapshot, invoice_id,
          CAST(CAST(total_amount AS DECIMAL(9,1)) AS DECIMAL(10,2)) AS total_amount, CAST(NULL AS DECIMAL(10,2)) AS net_amount FROM invoices
        UNION ALL SELECT strftime({AS_OF}, '%Y%m%d_%H%M%S'), invoice_id, total_amount, net_amount FROM invoices""",
    "snapshot_sql_read_back": """
        SELECT patient_id, concat(full_name, ' ''O''''Neil'',', chr(10), 'NULL);', chr(10), phone) AS full_name, dob,
          if(patient_id % 2 = 0, gender, NULL) AS gender, phone, email FROM patients""",
}

#: Many questions in one plan, and the bill over tables stored by visit.
READ_SQL |= {
    "patient_bill_clustered": READ_SQL["patient_bill"],
    "actions_trailing_24h": """
        SELECT DISTINCT timestamp, count(*) OVER (ORDER BY timestamp RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING
          AND CURRENT ROW) AS action_count FROM audit_logs""",
    "patient_search_many": """
        SELECT keyword, p.* FROM (
          SELECT DISTINCT unnest([phone_number[7:10], concat(phone_number[7:8], '_', phone_number[10:10]),
            concat('R#%', phone_number[9:10])]) AS keyword FROM staff) k
        JOIN patients p ON full_name ILIKE concat('%', keyword, '%') OR phone ILIKE concat('%', keyword, '%')""",
    "doctor_schedule_flow_at": f"""
        SELECT as_of, doctor_id, flow_type, patient_name AS full_name, appt_date, {clock("appt_date")} AS clock FROM (
          SELECT q.as_of, d.*, 'Active' AS flow_type FROM _diary d JOIN _questions q ON q.doctor_id = d.doctor_id
            AND appt_date >= as_of - INTERVAL 30 MINUTE AND appt_date <= as_of
          WHERE status IN ('CheckedIn', 'In-Progress')
          UNION ALL
          SELECT q.as_of, d.*, 'Next' FROM _questions q ASOF JOIN (
            SELECT DISTINCT ON (doctor_id, appt_date) * FROM _diary WHERE status IN ('Scheduled', 'CheckedIn')
            ORDER BY doctor_id, appt_date, appt_id) d ON d.doctor_id = q.doctor_id AND q.as_of < d.appt_date) flow""",
}
