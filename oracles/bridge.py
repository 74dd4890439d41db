"""The nineteen domain tables as SQL over the test tables.

Each entry becomes a CTE of the same name.  ``_visit_slots`` is a helper.
"""

BRIDGE = {
    "departments": "SELECT n_nationkey+1 AS dept_id, n_name AS dept_name FROM nation",
    "roles": """
        SELECT r_regionkey+1 AS role_id, CASE r_regionkey WHEN 0 THEN 'Admin' WHEN 1 THEN 'Doctor'
          WHEN 2 THEN 'Receptionist' WHEN 3 THEN 'Accountant' ELSE 'Human Resource (HR)' END AS role_name
        FROM region""",
    "users": """
        SELECT DISTINCT user_id+1 AS user_id, concat('user_', CAST(user_id+1 AS VARCHAR)) AS username,
          sha256(concat('secret_', CAST(user_id+1 AS VARCHAR))) AS password_hash,
          CAST(user_id % 4 + 1 AS INTEGER) AS role_id
        FROM events""",
    "staff": """
        SELECT s_suppkey+1 AS staff_id, s_name AS full_name, CAST(NULL AS DATE) AS dob,
          CAST(NULL AS VARCHAR) AS gender,
          concat('09', lpad(CAST(s_suppkey AS VARCHAR),8,'0')) AS phone_number,
          concat(lower(replace(s_name,'#','.')),'@example.org') AS email,
          s_suppkey+1 AS user_id, s_nationkey+1 AS dept_id
        FROM supplier""",
    "doctors": """
        SELECT 1000000+s_suppkey AS doctor_id, s_suppkey+1 AS staff_id, concat('Spec_', n_name) AS specialty
        FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE s_suppkey % 4 <> 3""",
    "patients": """
        SELECT c_custkey+1 AS patient_id, c_name AS full_name,
          DATE '1940-01-01' + CAST((c_custkey*37)%25000 AS INT) AS dob,
          CASE WHEN c_custkey%2=0 THEN 'Female' ELSE 'Male' END AS gender,
          concat('03', lpad(CAST(c_custkey AS VARCHAR),8,'0')) AS phone,
          concat(lower(replace(c_name,'#','.')),'@example.com') AS email
        FROM customer""",
    "patient_health_profile": """
        SELECT c_custkey+1 AS profile_id, c_custkey+1 AS patient_id,
          CASE WHEN c_custkey%3=0 THEN 'None' ELSE 'Penicillin' END AS allergies,
          c_mktsegment AS chronic_diseases,
          CASE c_custkey%8 WHEN 0 THEN 'O+' WHEN 1 THEN 'O-' WHEN 2 THEN 'A+' WHEN 3 THEN 'A-'
            WHEN 4 THEN 'B+' WHEN 5 THEN 'B-' WHEN 6 THEN 'AB+' ELSE 'AB-' END AS blood_type
        FROM customer WHERE c_custkey%4<>0""",
    "insurance": """
        SELECT concat('INS-2024-', lpad(CAST(c_custkey+1 AS VARCHAR),8,'0'), '-', CAST(k AS VARCHAR)) AS insurance_id,
          c_custkey+1 AS patient_id,
          CAST(((c_custkey+k*17)%101)/CAST(100 AS DECIMAL(5,2)) AS DECIMAL(3,2)) AS coverage_rate,
          DATE '1996-01-01' + CAST((c_custkey*13+k*700)%3000 AS INT) AS expiry_date,
          concat('Provider ', CAST(c_nationkey%6 AS VARCHAR)) AS provider
        FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x
        WHERE c_custkey%3<>0 AND (k=0 OR c_custkey%10=1)""",
    "medicine_categories": """
        SELECT CAST(row_number() OVER (ORDER BY p_type) AS INT) AS category_id, p_type AS category_name
        FROM (SELECT DISTINCT p_type FROM part) t""",
    "medicines": """
        SELECT p_partkey+1 AS med_id, p_name AS med_name, p_size*10 AS stock,
          CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_type AS category_name
        FROM part""",
    "rooms": """
        SELECT s_suppkey+1 AS room_id, concat('Room ', CAST(s_suppkey+1 AS VARCHAR)) AS room_name,
          s_nationkey+1 AS dept_id
        FROM supplier""",
    "beds": """
        SELECT p_partkey+1 AS bed_id, concat('B', CAST(p_partkey+1 AS VARCHAR)) AS bed_code,
          p_partkey % (SELECT count(*) FROM supplier) + 1 AS room_id,
          CASE p_size%4 WHEN 0 THEN 'Available' WHEN 1 THEN 'Occupied' WHEN 2 THEN 'Cleaning'
            ELSE 'Maintenance' END AS status
        FROM part""",
    "_visit_slots": """
        SELECT o.*, (o_orderkey*7) % (SELECT count(*) FROM supplier) AS k,
          o_orderdate + INTERVAL '1' MINUTE * CAST((o_orderkey%96)*15 AS INT) AS slot
        FROM orders o""",
    "appointments": """
        SELECT o_orderkey+1 AS appt_id, o_custkey+1 AS patient_id,
          1000000 + k - CASE WHEN k%4=3 THEN 1 ELSE 0 END AS doctor_id, slot AS appt_date,
          CASE WHEN o_orderpriority='5-LOW' THEN slot + INTERVAL '25' MINUTE END AS completed_at,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'In-Progress' WHEN '2-HIGH' THEN 'CheckedIn'
            WHEN '3-MEDIUM' THEN 'Scheduled' WHEN '4-NOT SPECIFIED' THEN 'Cancelled'
            ELSE 'Completed' END AS status
        FROM _visit_slots WHERE o_orderkey%5<>4""",
    "admissions": """
        SELECT o_orderkey+1 AS admission_id, o_custkey+1 AS patient_id,
          1000000 + k - CASE WHEN k%4=3 THEN 1 ELSE 0 END AS doctor_id,
          (o_orderkey*3 + o_custkey) % (SELECT count(*) FROM part) + 1 AS bed_id, slot AS admission_date,
          CASE WHEN o_orderstatus<>'P' THEN slot + INTERVAL '4' DAY END AS discharge_date,
          CASE WHEN o_orderstatus<>'P' THEN 'Discharged' ELSE 'Admitted' END AS discharge_status
        FROM _visit_slots WHERE o_orderkey%5=4""",
    "medical_records": """
        SELECT o_orderkey+5000001 AS record_id, CASE WHEN o_orderkey%5<>4 THEN o_orderkey+1 END AS appt_id,
          CASE WHEN o_orderkey%5=4 THEN o_orderkey+1 END AS admission_id,
          concat('symptom ', CAST(o_custkey%17 AS VARCHAR)) AS symptoms,
          concat('diagnosis ', CAST(o_custkey%23 AS VARCHAR)) AS diagnosis,
          concat('note ', o_orderstatus) AS doctor_notes
        FROM orders""",
    "prescriptions": """
        SELECT DISTINCT l_orderkey*2 + l_linenumber%2 AS presc_id, l_orderkey+5000001 AS record_id,
          1000000 + k - CASE WHEN k%4=3 THEN 1 ELSE 0 END AS doctor_id
        FROM lineitem JOIN _visit_slots o ON l_orderkey=o_orderkey""",
    "presc_details": """
        SELECT l_orderkey*2 + l_linenumber%2 AS presc_id, l_partkey+1 AS med_id,
          CAST(l_quantity AS INT) AS quantity, concat(l_returnflag, '/', l_linestatus, ' daily') AS dosage
        FROM lineitem""",
    "invoices": """
        SELECT o_orderkey+1 AS invoice_id, CASE WHEN o_orderkey%5<>4 THEN o_orderkey+1 END AS appt_id,
          CASE WHEN o_orderkey%5=4 THEN o_orderkey+1 END AS admission_id,
          slot + INTERVAL '2' HOUR AS invoice_date, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
          CASE o_orderkey%7 WHEN 4 THEN 'Unpaid' WHEN 5 THEN 'Cancelled' WHEN 6 THEN 'Refunded'
            ELSE 'Paid' END AS payment_status,
          CASE WHEN o_orderkey%7=4 OR o_orderkey%3=0 THEN NULL
            WHEN o_orderkey%11=0 THEN CAST(0 AS DECIMAL(10,2))
            ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2))*CAST(0.80 AS DECIMAL(3,2)) AS DECIMAL(10,2))
          END AS net_amount
        FROM _visit_slots""",
    "audit_logs": """
        SELECT event_id+1 AS log_id, CASE WHEN event_id%50<>0 THEN user_id+1 END AS user_id,
          CASE event_type WHEN 'view' THEN 'User Logged In' WHEN 'signup' THEN 'Registered new patient: x'
            WHEN 'purchase' THEN 'Processed payment for invoice #1'
            WHEN 'click' THEN 'New appointment created for patient_id: 1'
            ELSE 'Deleted appointment for patient: x' END AS action,
          ts AS timestamp
        FROM events""",
}
