"""SQL twins of the change rules: command batches and resulting rows."""

from oracles.shapes import AS_OF, TODAY

#: Roles where user 16 works in HR.
ROLE_OF_HR = """LEFT JOIN (
          SELECT user_id, CASE WHEN user_id = 16 THEN 'Human Resource (HR)' ELSE role_name END AS role_name
          FROM users JOIN roles USING (role_id)) r ON r.user_id = c.executor_id"""
ROLE_OF = "LEFT JOIN (SELECT user_id, role_name FROM users JOIN roles USING (role_id)) r ON r.user_id = c.executor_id"


def seq_number(order: str = "seq") -> str:
    return f"row_number() OVER (ORDER BY {order})"


COMMANDS = {
    "cmd_payments": """
        SELECT invoice_id AS seq, invoice_id, invoice_id % 16 + 1 AS executor_id
        FROM invoices WHERE payment_status = 'Unpaid'""",
    "done_payments": f"""
        SELECT invoice_id, appt_id, admission_id, 'Paid' AS payment_status, CAST(due AS DECIMAL(10,2)) AS net_amount
        FROM cmd_payments c {ROLE_OF} JOIN _due USING (invoice_id)
        WHERE r.role_name = 'Accountant'""",
    "cmd_bookings": """
        SELECT patient_id AS seq, patient_id % 16 + 1 AS executor_id, patient_id,
          CASE WHEN patient_id % 50 = 0 THEN 1
            ELSE 1000000 + patient_id % 8 - CASE WHEN patient_id % 8 % 4 = 3 THEN 1 ELSE 0 END END AS doctor_id,
          TIMESTAMP '1999-06-15 08:00:00' + INTERVAL '1' MINUTE * CAST((patient_id % 30) * 1440 + (patient_id % 96) * 15 AS INT) AS appt_date
        FROM patients""",
    "clashes": """
        SELECT DISTINCT c.seq FROM cmd_bookings c JOIN appointments a ON a.doctor_id = c.doctor_id
        WHERE a.status IN ('Scheduled','CheckedIn','In-Progress')
          AND a.appt_date > c.appt_date - INTERVAL 30 MINUTE AND a.appt_date < c.appt_date + INTERVAL 30 MINUTE""",
    "done_bookings": f"""
        SELECT *, {seq_number()} AS n FROM cmd_bookings
        WHERE doctor_id IN (SELECT doctor_id FROM doctors) AND executor_id IN (SELECT user_id FROM users)""",
    # Requests one by one in order of seq, each against those granted to its doctor so far.
    "asked_slots": """
        SELECT *, row_number() OVER (PARTITION BY doctor_id ORDER BY seq) AS k
        FROM done_bookings WHERE seq NOT IN (SELECT seq FROM clashes)""",
    "walked_slots": """
        SELECT DISTINCT doctor_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq,
          CAST([] AS TIMESTAMP[]) AS times, FALSE AS granted FROM asked_slots
        UNION ALL
        SELECT doctor_id, k, seq, CASE WHEN free THEN list_append(times, appt_date) ELSE times END, free
        FROM (
          SELECT a.doctor_id, a.k, a.seq, a.appt_date, w.times,
            len(list_filter(w.times, lambda x: abs(epoch_us(x) - epoch_us(a.appt_date)) < 1800000000)) = 0 AS free
          FROM walked_slots w JOIN asked_slots a ON a.doctor_id = w.doctor_id AND a.k = w.k + 1) s""",
    "granted_slots": "SELECT seq FROM walked_slots WHERE granted",
    "cmd_visit_states": """
        SELECT appt_id * 2 + step AS seq, appt_id,
          CASE WHEN step = 0 THEN 'CheckedIn' WHEN appt_id % 3 = 0 THEN 'In-Progress'
            WHEN appt_id % 3 = 1 THEN 'Completed' ELSE 'Done' END AS status
        FROM appointments, (SELECT 0 AS step UNION ALL SELECT 1) s
        WHERE status IN ('Scheduled','CheckedIn')""",
    "cmd_records": """
        SELECT appt_id AS seq, appt_id % 16 + 1 AS executor_id,
          CASE WHEN appt_id % 10 = 4 THEN -appt_id ELSE appt_id END AS appt_id,
          CASE WHEN appt_id % 10 = 6 THEN -appt_id END AS admission_id,
          'fever' AS symptoms, CASE WHEN appt_id % 10 = 0 THEN '' ELSE 'influenza' END AS diagnosis,
          'rest' AS doctor_notes
        FROM appointments WHERE status = 'In-Progress'""",
    "done_records": """
        SELECT * FROM cmd_records WHERE diagnosis <> '' AND executor_id IN (SELECT user_id FROM users)
          AND appt_id IN (SELECT appt_id FROM appointments)
          AND (admission_id IS NULL OR admission_id IN (SELECT admission_id FROM admissions))""",
    "cmd_lines": """
        SELECT record_id * 2 + step AS seq, record_id,
          CASE WHEN record_id % 8 <> 5 THEN record_id % 8 + 1000000 END AS doctor_id,
          (record_id * 3 + step) % (SELECT count(*) FROM medicines) + 1 AS med_id,
          CAST(record_id % 5 AS INTEGER) AS quantity, '1 daily' AS dosage
        FROM medical_records, (SELECT 0 AS step UNION ALL SELECT 1) s""",
    "done_lines": """
        SELECT * FROM cmd_lines
        WHERE quantity >= 1 AND (doctor_id IS NULL OR doctor_id IN (SELECT doctor_id FROM doctors))""",
    "new_prescriptions": """
        SELECT (SELECT max(presc_id) FROM prescriptions) + row_number() OVER (ORDER BY min(seq)) AS presc_id,
          record_id, min(doctor_id) AS doctor_id
        FROM done_lines GROUP BY record_id""",
    "new_lines": """
        SELECT n.presc_id, c.med_id, c.quantity, c.dosage, c.seq
        FROM done_lines c JOIN new_prescriptions n USING (record_id)""",
    "cmd_registrations": f"""
        SELECT patient_id AS seq, patient_id % 16 + 1 AS executor_id, concat(full_name, ' Jr') AS full_name, dob, gender,
          CASE WHEN patient_id % 20 = 1 THEN '' ELSE phone END AS phone,
          CASE WHEN patient_id % 20 = 0 THEN email WHEN patient_id % 20 = 2 THEN 'shared@example.com'
            ELSE concat('jr.', email) END AS email,
          CASE WHEN patient_id % 3 = 0 THEN 'Provider X' ELSE '' END AS provider,
          CAST(patient_id % 104 AS INTEGER) AS rate_percent,
          {TODAY} + CAST(patient_id % 100 - 5 AS INT) AS expiry_date
        FROM patients""",
    "valid_registrations": f"""
        SELECT * FROM cmd_registrations
        WHERE full_name <> '' AND phone <> '' AND email <> ''
          AND dob BETWEEN DATE '1900-01-01' AND {TODAY} AND rate_percent BETWEEN 0 AND 100
          AND (provider = '' OR expiry_date >= {TODAY}) AND executor_id IN (SELECT user_id FROM users)""",
    "done_registrations": """
        SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS nth FROM valid_registrations) v
        WHERE nth = 1 AND email NOT IN (SELECT email FROM patients)""",
    "cmd_policies": """
        SELECT insurance_id, CAST((patient_id * 7) % 120 AS INTEGER) AS rate_percent,
          expiry_date + 365 AS expiry_date
        FROM insurance""",
    "booked_appointments": """
        SELECT * FROM appointments
        UNION ALL SELECT (SELECT max(appt_id) FROM appointments) + n, patient_id, doctor_id, appt_date, NULL, 'Scheduled' FROM done_bookings""",
    "booked_invoices": f"""
        SELECT * FROM invoices
        UNION ALL SELECT (SELECT max(invoice_id) FROM invoices) + n, (SELECT max(appt_id) FROM appointments) + n, NULL, {AS_OF},
          CAST(0 AS DECIMAL(10,2)), 'Unpaid', NULL FROM done_bookings""",
    "cmd_removals": "SELECT appt_id AS seq, appt_id, appt_id % 16 + 1 AS executor_id FROM booked_appointments",
    "done_removals": f"""
        SELECT c.* FROM cmd_removals c {ROLE_OF}
        WHERE r.role_name IN ('Admin','Receptionist')
          AND c.appt_id NOT IN (SELECT appt_id FROM medical_records WHERE appt_id IS NOT NULL)""",
    "cmd_staff": """
        SELECT staff_id AS seq, staff_id % 16 + 1 AS executor_id, concat(full_name, ' II') AS full_name,
          phone_number AS phone, concat('ii.', email) AS email, dept_id,
          CASE staff_id % 5 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Doctor' WHEN 2 THEN 'Receptionist'
            WHEN 3 THEN 'Accountant' ELSE 'Janitor' END AS new_role,
          concat('new_', CAST(staff_id AS VARCHAR)) AS username
        FROM staff""",
    "done_staff": f"""
        SELECT c.*, n.role_id, {seq_number("c.seq")} AS n FROM cmd_staff c {ROLE_OF_HR}
        JOIN roles n ON n.role_name = c.new_role
        WHERE r.role_name IN ('Admin','Human Resource (HR)')""",
    "hired_staff": """
        SELECT * FROM staff
        UNION ALL SELECT (SELECT max(staff_id) FROM staff) + n, full_name, DATE '1980-01-01', 'Female', phone, email,
          (SELECT max(user_id) FROM users) + n, dept_id FROM done_staff""",
    "hired_doctors": """
        SELECT * FROM doctors
        UNION ALL SELECT (SELECT max(doctor_id) FROM doctors) + row_number() OVER (ORDER BY seq),
          (SELECT max(staff_id) FROM staff) + n, 'Pediatrics' FROM done_staff WHERE new_role = 'Doctor'""",
    "cmd_staff_removals": "SELECT staff_id AS seq, staff_id, staff_id % 16 + 1 AS executor_id FROM hired_staff",
    "busy_staff": """
        SELECT staff_id FROM doctors WHERE doctor_id IN (SELECT doctor_id FROM appointments)
          OR doctor_id IN (SELECT doctor_id FROM admissions) OR doctor_id IN (SELECT doctor_id FROM prescriptions)""",
    "done_staff_removals": f"""
        SELECT c.* FROM cmd_staff_removals c {ROLE_OF_HR}
        WHERE r.role_name IN ('Admin','Human Resource (HR)') AND c.staff_id NOT IN (SELECT staff_id FROM busy_staff)""",
    # Prices of all present prescriptions, the highest id counting as the last changed.
    "links": """
        SELECT i.invoice_id, mr.record_id FROM invoices i JOIN medical_records mr ON i.appt_id = mr.appt_id
        UNION SELECT i.invoice_id, mr.record_id FROM invoices i JOIN medical_records mr ON i.admission_id = mr.admission_id""",
    "repriced": """
        SELECT l.invoice_id, max(p.presc_id) AS presc_id
        FROM links l JOIN prescriptions p USING (record_id)
        WHERE p.presc_id IN (SELECT presc_id FROM presc_details) GROUP BY l.invoice_id""",
    "paid_stays": """
        SELECT DISTINCT admission_id FROM repriced JOIN invoices USING (invoice_id)
        WHERE payment_status = 'Paid' AND admission_id IS NOT NULL""",
}

CHANGE_SQL = {
    "w01_new_patients": """
        SELECT (SELECT max(patient_id) FROM patients) + n AS patient_id, full_name, dob, gender, phone, email
        FROM done_registrations""",
    "w01_new_profiles": """
        SELECT (SELECT max(profile_id) FROM patient_health_profile) + n AS profile_id,
          (SELECT max(patient_id) FROM patients) + n AS patient_id, 'None' AS allergies,
          'None' AS chronic_diseases, 'O+' AS blood_type
        FROM done_registrations""",
    "w01_new_policies": """
        SELECT format('INS-1999-{:04d}', (SELECT max(patient_id) FROM patients) + n) AS insurance_id,
          (SELECT max(patient_id) FROM patients) + n AS patient_id,
          CAST(rate_percent * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(3,2)) AS coverage_rate, expiry_date, provider
        FROM done_registrations WHERE provider <> ''""",
    "w01_rejected": f"""
        SELECT seq, CASE WHEN full_name = '' OR phone = '' OR email = '' THEN 'Please fill in all required fields'
            WHEN dob NOT BETWEEN DATE '1900-01-01' AND {TODAY} THEN 'Birth date out of range'
            WHEN rate_percent NOT BETWEEN 0 AND 100 THEN 'Coverage must be between 0 and 100 percent'
            WHEN provider <> '' AND expiry_date < {TODAY} THEN 'Policy has expired'
            WHEN executor_id NOT IN (SELECT user_id FROM users) THEN 'Unknown user'
            ELSE 'Email address is already registered' END AS reason
        FROM cmd_registrations WHERE seq NOT IN (SELECT seq FROM done_registrations)""",
    "w02_new_prescriptions": "SELECT * FROM new_prescriptions",
    "w02_new_lines": "SELECT presc_id, med_id, quantity, dosage FROM new_lines",
    "w02_rejected": """
        SELECT seq, CASE WHEN quantity < 1 THEN 'Quantity must be at least 1' ELSE 'Unknown doctor' END AS reason
        FROM cmd_lines WHERE seq NOT IN (SELECT seq FROM done_lines)""",
    "w05_rejected": """
        SELECT seq, CASE WHEN diagnosis = '' THEN 'Please fill in symptoms and diagnosis'
          WHEN executor_id NOT IN (SELECT user_id FROM users) THEN 'Unknown user'
          WHEN appt_id NOT IN (SELECT appt_id FROM appointments) THEN 'Unknown appointment'
          ELSE 'Unknown admission' END AS reason
        FROM cmd_records WHERE seq NOT IN (SELECT seq FROM done_records)""",
    "w03_new_appointments": """
        SELECT (SELECT max(appt_id) FROM appointments) + n AS appt_id, patient_id, doctor_id, appt_date,
          CAST(NULL AS TIMESTAMP) AS completed_at, 'Scheduled' AS status FROM done_bookings""",
    "w03_new_invoices": f"""
        SELECT (SELECT max(invoice_id) FROM invoices) + n AS invoice_id,
          (SELECT max(appt_id) FROM appointments) + n AS appt_id, CAST(NULL AS BIGINT) AS admission_id,
          {AS_OF} AS invoice_date, CAST(0 AS DECIMAL(10,2)) AS total_amount, 'Unpaid' AS payment_status,
          CAST(NULL AS DECIMAL(10,2)) AS net_amount
        FROM done_bookings""",
    "w03_audit": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + n AS log_id, executor_id AS user_id,
          concat('New appointment created for patient_id: ', CAST(patient_id AS VARCHAR)) AS action,
          {AS_OF} AS timestamp
        FROM done_bookings""",
    "w03_slot_conflicts": """
        SELECT seq, CASE WHEN doctor_id NOT IN (SELECT doctor_id FROM doctors) THEN 'Unknown doctor'
            WHEN executor_id NOT IN (SELECT user_id FROM users) THEN 'Unknown user'
            ELSE 'Doctor is not available at that time' END AS reason
        FROM cmd_bookings WHERE seq NOT IN (SELECT seq FROM granted_slots)""",
    "w03_checked_appointments": """
        SELECT (SELECT max(appt_id) FROM appointments) + row_number() OVER (ORDER BY seq) AS appt_id, patient_id,
          doctor_id, appt_date, CAST(NULL AS TIMESTAMP) AS completed_at, 'Scheduled' AS status
        FROM done_bookings WHERE seq IN (SELECT seq FROM granted_slots)""",
    "w04_appointments": f"""
        SELECT a.appt_id, a.patient_id, a.doctor_id, a.appt_date,
          CASE WHEN x.ended THEN {AS_OF} ELSE a.completed_at END AS completed_at,
          coalesce(x.status, a.status) AS status
        FROM appointments a LEFT JOIN (
          SELECT appt_id, arg_max(status, seq) AS status, bool_or(status = 'Completed') AS ended
          FROM cmd_visit_states WHERE status <> 'Done' GROUP BY appt_id) x ON x.appt_id = a.appt_id""",
    "w05_new_records": """
        SELECT (SELECT max(record_id) FROM medical_records) + row_number() OVER (ORDER BY seq) AS record_id,
          appt_id, admission_id, symptoms, diagnosis, doctor_notes
        FROM done_records""",
    "w05_appointments": f"""
        SELECT a.appt_id, a.patient_id, a.doctor_id, a.appt_date,
          CASE WHEN c.appt_id IS NOT NULL THEN {AS_OF} ELSE a.completed_at END AS completed_at,
          CASE WHEN c.appt_id IS NOT NULL THEN 'Completed' ELSE a.status END AS status
        FROM appointments a LEFT JOIN done_records c ON c.appt_id = a.appt_id""",
    "w05_audit": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY seq) AS log_id,
          executor_id AS user_id, concat('Created medical record for appt/adm: ', CAST(appt_id AS VARCHAR)) AS action,
          {AS_OF} AS timestamp
        FROM done_records""",
    "w06_repriced_invoices": """
        SELECT r.invoice_id, CAST(sum(m.price * l.quantity) AS DECIMAL(15,2)) AS total_amount
        FROM repriced r JOIN presc_details l USING (presc_id) JOIN medicines m USING (med_id) GROUP BY r.invoice_id""",
    "w06_after_new_lines": """
        SELECT x.invoice_id, CAST(sum(m.price * n.quantity) AS DECIMAL(15,2)) AS total_amount
        FROM links x JOIN new_prescriptions p USING (record_id) JOIN new_lines n USING (presc_id)
        JOIN medicines m ON m.med_id = n.med_id GROUP BY x.invoice_id""",
    "w07_paid_invoices": "SELECT invoice_id, payment_status, net_amount FROM done_payments",
    "w07_invoices": """
        SELECT i.invoice_id, i.appt_id, i.admission_id, i.invoice_date, i.total_amount,
          coalesce(p.payment_status, i.payment_status) AS payment_status,
          CASE WHEN p.invoice_id IS NOT NULL THEN p.net_amount ELSE i.net_amount END AS net_amount
        FROM invoices i LEFT JOIN done_payments p ON p.invoice_id = i.invoice_id""",
    "w07_rejected": f"""
        SELECT c.seq, 'Permission Denied: Only Accountants can process payments' AS reason
        FROM cmd_payments c {ROLE_OF} WHERE coalesce(r.role_name, '') <> 'Accountant'""",
    "w07_audit": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY c.seq) AS log_id,
          c.executor_id AS user_id,
          concat('Processed payment for invoice #', CAST(c.invoice_id AS VARCHAR)) AS action, {AS_OF} AS timestamp
        FROM cmd_payments c {ROLE_OF} WHERE r.role_name = 'Accountant'""",
    "w08_beds": """
        SELECT b.bed_id, b.bed_code, b.room_id,
          CASE WHEN b.bed_id IN (SELECT bed_id FROM admissions JOIN paid_stays USING (admission_id))
            THEN 'Available' ELSE b.status END AS status
        FROM beds b""",
    "w08_admissions": f"""
        SELECT a.admission_id, a.patient_id, a.doctor_id, a.bed_id, a.admission_date,
          CASE WHEN p.admission_id IS NOT NULL THEN {AS_OF} ELSE a.discharge_date END AS discharge_date,
          CASE WHEN p.admission_id IS NOT NULL THEN 'Discharged' ELSE a.discharge_status END AS discharge_status
        FROM admissions a LEFT JOIN paid_stays p ON p.admission_id = a.admission_id""",
    "w09_invoice_states": """
        SELECT invoice_id, CASE payment_status WHEN 'Unpaid' THEN 'Cancelled' WHEN 'Paid' THEN 'Refunded'
          ELSE payment_status END AS payment_status FROM invoices""",
    "w10_policies": """
        SELECT i.insurance_id, i.patient_id,
          CASE WHEN c.rate_percent <= 100 THEN CAST(c.rate_percent * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(3,2))
            ELSE i.coverage_rate END AS coverage_rate,
          CASE WHEN c.rate_percent <= 100 THEN c.expiry_date ELSE i.expiry_date END AS expiry_date, i.provider
        FROM insurance i JOIN cmd_policies c USING (insurance_id)""",
    "w11_admissions": f"""
        SELECT admission_id, patient_id, doctor_id, bed_id, admission_date,
          coalesce(discharge_date, {AS_OF}) AS discharge_date,
          CASE WHEN discharge_date IS NULL THEN 'Transferred' ELSE discharge_status END AS discharge_status
        FROM admissions""",
    "w12_new_users": """
        SELECT (SELECT max(user_id) FROM users) + n AS user_id, username, sha256('first password') AS password_hash, role_id
        FROM done_staff""",
    "w12_new_staff": """
        SELECT (SELECT max(staff_id) FROM staff) + n AS staff_id, full_name, DATE '1980-01-01' AS dob,
          'Female' AS gender, phone AS phone_number, email, (SELECT max(user_id) FROM users) + n AS user_id, dept_id
        FROM done_staff""",
    "w12_new_doctors": """
        SELECT (SELECT max(doctor_id) FROM doctors) + row_number() OVER (ORDER BY seq) AS doctor_id,
          (SELECT max(staff_id) FROM staff) + n AS staff_id, 'Pediatrics' AS specialty
        FROM done_staff WHERE new_role = 'Doctor'""",
    "w12_rejected": f"""
        SELECT c.seq, CASE WHEN coalesce(r.role_name, '') NOT IN ('Admin','Human Resource (HR)')
          THEN 'Permission Denied: Only Admin or HR can add new staff' ELSE 'Unknown role' END AS reason
        FROM cmd_staff c {ROLE_OF_HR} WHERE c.seq NOT IN (SELECT seq FROM done_staff)""",
    "w13_staff": """
        SELECT s.staff_id, s.full_name, s.dob, s.gender, s.phone_number, s.email, s.user_id,
          coalesce(d.dept_id, s.dept_id) AS dept_id
        FROM staff s LEFT JOIN departments d ON d.dept_id = s.dept_id + 1""",
    "w13_audit": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY s.staff_id) AS log_id,
          s.staff_id % 16 + 1 AS user_id, concat('Transferred staff ', s.full_name, ' to ', d.dept_name) AS action,
          {AS_OF} AS timestamp
        FROM staff s JOIN departments d ON d.dept_id = s.dept_id + 1""",
    "w14_staff": "SELECT * FROM hired_staff WHERE staff_id NOT IN (SELECT staff_id FROM done_staff_removals)",
    "w14_doctors": "SELECT * FROM hired_doctors WHERE staff_id NOT IN (SELECT staff_id FROM done_staff_removals)",
    "w14_rejected": f"""
        SELECT c.seq, CASE WHEN coalesce(r.role_name, '') NOT IN ('Admin','Human Resource (HR)')
          THEN 'Permission Denied: Only Admin or HR can delete staff'
          ELSE 'Doctor still has appointments, admissions or prescriptions' END AS reason
        FROM cmd_staff_removals c {ROLE_OF_HR} WHERE c.seq NOT IN (SELECT seq FROM done_staff_removals)""",
    "w15_appointments": "SELECT * FROM booked_appointments WHERE appt_id NOT IN (SELECT appt_id FROM done_removals)",
    "w15_invoices": """
        SELECT * FROM booked_invoices WHERE appt_id IS NULL OR appt_id NOT IN (SELECT appt_id FROM done_removals)""",
    "w15_rejected": f"""
        SELECT c.seq, CASE WHEN coalesce(r.role_name, '') NOT IN ('Admin','Receptionist')
          THEN 'Permission Denied: Only Admin or Receptionist can delete appointments'
          ELSE 'Appointment has medical records' END AS reason
        FROM cmd_removals c {ROLE_OF} WHERE c.seq NOT IN (SELECT seq FROM done_removals)""",
    "w15_audit": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + (SELECT count(*) FROM done_bookings) + row_number() OVER (ORDER BY c.seq) AS log_id,
          c.executor_id AS user_id, concat('Deleted appointment for patient: ', p.full_name) AS action,
          {AS_OF} AS timestamp
        FROM done_removals c JOIN booked_appointments a ON a.appt_id = c.appt_id JOIN patients p ON p.patient_id = a.patient_id""",
    "w16_login_log": f"""
        SELECT log_id, user_id, action, timestamp FROM audit_logs
        UNION ALL
        SELECT (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY user_id), user_id,
          'User Logged In', {AS_OF} FROM users""",
    "w17_gated_payments": f"""
        SELECT c.seq, c.executor_id, r.role_name, coalesce(r.role_name = 'Accountant', FALSE) AS allowed
        FROM cmd_payments c {ROLE_OF}""",
    "w18_allocated_ids": """
        SELECT log_id, (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY log_id) AS new_id
        FROM audit_logs""",
    "w20_defaulted_beds": "SELECT bed_id, bed_code, room_id, 'Available' AS status FROM beds",
    "integrity_violations": f"""
        SELECT 'patients' AS table_name, 'unique' AS rule, 'email' AS column_name, email AS value,
          count(*) AS rows_affected FROM (
            SELECT email FROM patients UNION ALL SELECT email FROM cmd_registrations) x
        GROUP BY email HAVING count(*) > 1
        UNION ALL
        SELECT 'patients', 'required', 'phone', '', count(*) FROM cmd_registrations WHERE phone = ''
        UNION ALL
        SELECT 'patients', 'range', 'dob', CAST(dob AS VARCHAR), count(*) FROM (
          SELECT dob FROM patients UNION ALL SELECT dob FROM cmd_registrations) z
        WHERE dob NOT BETWEEN DATE '1900-01-01' AND {TODAY} GROUP BY dob
        UNION ALL
        SELECT 'patients', 'key', 'patient_id', CAST(patient_id AS VARCHAR), 2 FROM patients
        UNION ALL
        SELECT 'appointments', 'reference', 'doctor_id', CAST(doctor_id AS VARCHAR), count(*)
        FROM cmd_bookings WHERE doctor_id NOT IN (SELECT doctor_id FROM doctors) GROUP BY doctor_id
        UNION ALL
        SELECT 'appointments', 'domain', 'status', status, count(*) FROM cmd_visit_states
        WHERE status = 'Done' GROUP BY status
        UNION ALL
        SELECT 'appointments', 'key', 'appt_id', CAST(appt_id AS VARCHAR), count(*) FROM (
          SELECT appt_id FROM appointments UNION ALL SELECT appt_id FROM cmd_visit_states
          UNION ALL SELECT patient_id FROM cmd_bookings) y GROUP BY appt_id HAVING count(*) > 1""",
    "snapshot_sql_text": """
        SELECT concat('INSERT INTO `invoices` VALUES (', CAST(invoice_id AS VARCHAR), ', ',
          coalesce(CAST(appt_id AS VARCHAR), 'NULL'), ', ', coalesce(CAST(admission_id AS VARCHAR), 'NULL'), ', ',
          '''' || strftime(invoice_date, '%Y-%m-%d %H:%M:%S') || '''', ', ', '''' || CAST(total_amount AS VARCHAR) || '''', ', ',
          '''' || payment_status || '''', ', ', coalesce('''' || CAST(net_amount AS VARCHAR) || '''', 'NULL'), ');') AS statement
        FROM invoices""",
    "bookings_stream": f"""
        SELECT (SELECT max(invoice_id) FROM invoices) + n AS invoice_id,
          (SELECT max(appt_id) FROM appointments) + n AS appt_id, CAST(NULL AS BIGINT) AS admission_id,
          {AS_OF} AS invoice_date, CAST(0 AS DECIMAL(10,2)) AS total_amount, 'Unpaid' AS payment_status,
          CAST(NULL AS DECIMAL(10,2)) AS net_amount
        FROM done_bookings""",
    "records_stream": f"""
        SELECT a.appt_id, a.patient_id, a.doctor_id, a.appt_date, {AS_OF} AS completed_at, 'Completed' AS status
        FROM appointments a JOIN done_records c ON c.appt_id = a.appt_id""",
    "payments_stream": """
        SELECT bed_id, bed_code, room_id, 'Available' AS status FROM beds
        WHERE bed_id IN (SELECT bed_id FROM done_payments JOIN admissions USING (admission_id))""",
    # A window is open until the watermark (newest event less one hour) has passed its end.
    "actions_24h_stream": """
        SELECT w.window_end - INTERVAL 24 HOUR AS window_start, w.window_end,
          CAST(sum(h.n) AS BIGINT) AS action_count,
          w.window_end > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS is_open
        FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)) + INTERVAL 1 HOUR,
                date_trunc('hour', max(ts)) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM events) w
        JOIN (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) h
          ON h.hour >= w.window_end - INTERVAL 24 HOUR AND h.hour < w.window_end
        GROUP BY w.window_end""",
    "w03_booking_slips": """
        SELECT (SELECT max(appt_id) FROM appointments) + b.n AS appt_id,
          concat('Appointment booked for ', p.full_name, ' (', p.phone, ') with ', s.full_name, ' at ',
            strftime(b.appt_date, '%d/%m/%Y %H:%M'), ' (Appointment ID: ',
            CAST((SELECT max(appt_id) FROM appointments) + b.n AS VARCHAR), ')') AS slip
        FROM done_bookings b JOIN patients p ON p.patient_id = b.patient_id
        JOIN doctors d ON d.doctor_id = b.doctor_id JOIN staff s ON s.staff_id = d.staff_id""",
    "logins_stream": f"""
        SELECT (SELECT max(log_id) FROM audit_logs) + row_number() OVER (ORDER BY user_id) AS log_id, user_id,
          'User Logged In' AS action, {AS_OF} AS timestamp FROM users""",
}
CHANGE_SQL["w18_ids_after_removal"] = CHANGE_SQL["w03_new_appointments"]
CHANGE_SQL["lines_stream"] = CHANGE_SQL["w06_after_new_lines"].replace("DECIMAL(15,2)", "DECIMAL(10,2)")
CHANGE_SQL["w04_late_commands"] = CHANGE_SQL["w04_appointments"]
CHANGE_SQL["w06_late_changes"] = f"""
    SELECT i.invoice_id, coalesce(CAST(r.total_amount AS DECIMAL(10,2)), i.total_amount) AS total_amount
    FROM invoices i LEFT JOIN ({CHANGE_SQL["w06_repriced_invoices"]}) r USING (invoice_id)"""
CHANGE_SQL["actions_trailing_stream"] = """
    SELECT DISTINCT timestamp, count(*) OVER (ORDER BY timestamp RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING
      AND CURRENT ROW) AS action_count FROM audit_logs"""
