"""Registered code-numbering and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import codes as C
from wayline.operators import quality as Q
from wayline.operators import reports as R
from wayline.plans import params as P
from wayline.plans.registry import register

# Oracle: every intake request with its reject reason (NULL = accepted).
REQ_REASON = f"""
req AS (
  SELECT r.*, CASE
    WHEN r.customer_name IS NULL OR r.customer_name = '' OR r.mobile IS NULL OR r.mobile = ''
      THEN '{Q.MSG_REQUIRED}'
    WHEN r.travel_date IS NOT NULL AND r.travel_date <> ''
         AND try_strptime(r.travel_date, '%Y-%m-%d') IS NULL THEN '{Q.MSG_TRAVEL_DATE}'
    WHEN u.id IS NULL THEN '{Q.MSG_ASSIGNEE}' || CAST(r.eff AS VARCHAR)
  END AS reject_reason
  FROM (SELECT *, CASE WHEN assigned_to IS NULL OR assigned_to = 0 THEN actor_id
                       ELSE assigned_to END AS eff FROM crm_lead_requests) r
  LEFT JOIN crm_users u ON u.id = r.eff)"""


def _in(col: str, values: list[str], default: str) -> str:
    vals = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {col} IN ({vals}) THEN {col} ELSE '{default}' END"


_COERCED = ",\n  ".join(
    f"{_in(name, allowed, default)} AS {name}" if name in ("hotel_category", "status")
    else f"'{default}' AS {name}"
    for name, (allowed, default) in Q.ENUMS.items())


@register("lead_enum_coerce", family="quality", oracle=f"""
SELECT request_id,
  {_COERCED}
FROM crm_lead_requests""")
def lead_enum_coerce(t):
    return Q.coerce_enums(Q.conform_requests(t.lead_requests)).select(
        "request_id", *Q.ENUMS.keys())


@register("lead_intake_rejects", family="quality", oracle=f"""
WITH {REQ_REASON}
SELECT request_id, reject_reason FROM req WHERE reject_reason IS NOT NULL""")
def lead_intake_rejects(t):
    return Q.lead_intake_rejects(t.lead_requests, t.users)


GOOD_SQL = f"""
SELECT request_id, actor_id, customer_name, mobile, CAST(NULL AS VARCHAR) AS alt_mobile,
       CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS city,
       CAST(NULL AS VARCHAR) AS tour_name,
       CAST(try_strptime(NULLIF(travel_date, ''), '%Y-%m-%d') AS DATE) AS travel_date,
       pickup_location, drop_location, 1 AS adults, 0 AS children,
       {_COERCED},
       eff AS assigned_to, DATE '{P.AS_OF_DAY}' AS enquiry_date, CAST(NULL AS VARCHAR) AS notes, created_at
FROM req WHERE reject_reason IS NULL"""


@register("lead_intake_good", family="quality", oracle=f"WITH {REQ_REASON}\n{GOOD_SQL}")
def lead_intake_good(t):
    return Q.lead_intake_good(t.lead_requests, t.users, P.AS_OF_DAY)


_LEAD_BASE = """
base AS (SELECT CAST(split_part(lead_id, '-', 2) AS INTEGER) AS year,
                arg_max(lead_id, id) AS last_code
         FROM crm_leads WHERE lead_id LIKE 'LEAD-%' GROUP BY 1)"""


@register("lead_code_last", family="quality", oracle=f"""
WITH {_LEAD_BASE}
SELECT year, last_code, TRY_CAST(split_part(last_code, '-', 3) AS BIGINT) AS last_seq FROM base""")
def lead_code_last(t):
    return C.lead_code_last(t.leads)


@register("assign_lead_codes", family="quality", oracle=f"""
WITH {REQ_REASON}, {_LEAD_BASE},
good AS ({GOOD_SQL}),
g AS (SELECT request_id, CAST(year(created_at) AS INTEGER) AS y,
             row_number() OVER (PARTITION BY year(created_at) ORDER BY request_id) AS rn FROM good)
SELECT g.request_id,
       printf('LEAD-%d-%05d', g.y, COALESCE(TRY_CAST(split_part(b.last_code, '-', 3) AS BIGINT), 0) + g.rn)
         AS lead_code,
       CAST(COALESCE(TRY_CAST(split_part(b.last_code, '-', 3) AS BIGINT), 0) + g.rn AS BIGINT)
         AS lead_code_seq
FROM g LEFT JOIN base b ON b.year = g.y""")
def assign_lead_codes(t):
    good = Q.lead_intake_good(t.lead_requests, t.users, P.AS_OF_DAY)
    coded = C.assign_codes(good, C.lead_code_last(t.leads), "LEAD", F.year("created_at"),
                           "request_id", "lead_code")
    return coded.select("request_id", "lead_code", "lead_code_seq")


@register("booking_code_max", family="quality", oracle="""
SELECT CAST(split_part(booking_id, '-', 2) AS INTEGER) AS year,
       MAX(CAST(split_part(booking_id, '-', 3) AS BIGINT)) AS max_seq
FROM crm_bookings WHERE regexp_matches(booking_id, '^BOOKING-[0-9]{4}-[0-9]{5}$')
GROUP BY 1""")
def booking_code_max(t):
    return C.booking_code_max(t.bookings)


@register("booked_status_mismatch", family="quality", oracle="""
SELECT COALESCE(l.id, b.lead_id) AS lead_pk, l.status, COALESCE(b.n, 0) AS n_bookings,
  CASE WHEN l.id IS NULL THEN 'booking_without_lead'
       WHEN b.lead_id IS NULL AND l.status = 'Booked' THEN 'booked_without_booking'
       WHEN b.lead_id IS NOT NULL AND l.status <> 'Booked' THEN 'booking_not_booked' END AS issue
FROM crm_leads l
FULL JOIN (SELECT lead_id, COUNT(*) AS n FROM crm_bookings GROUP BY lead_id) b ON b.lead_id = l.id
WHERE l.id IS NULL OR (b.lead_id IS NULL AND l.status = 'Booked')
   OR (b.lead_id IS NOT NULL AND l.status <> 'Booked')""")
def booked_status_mismatch(t):
    return Q.booked_status_mismatch(t.leads, t.bookings)


@register("booking_amount_mismatch", family="quality", oracle="""
SELECT b.id, b.final_amount, CAST(b.final_amount - COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS balance,
  CASE WHEN b.final_amount <> b.total_amount - b.discount THEN 'final_mismatch'
       WHEN b.final_amount - COALESCE(p.paid, 0) < 0 THEN 'overpaid' END AS issue
FROM crm_bookings b
LEFT JOIN (SELECT booking_id, SUM(amount) AS paid FROM crm_payments GROUP BY booking_id) p
  ON p.booking_id = b.id
WHERE b.final_amount <> b.total_amount - b.discount OR b.final_amount - COALESCE(p.paid, 0) < 0""")
def booking_amount_mismatch(t):
    return Q.booking_amount_mismatch(t.bookings, R.booking_balances(t.bookings, t.payments))
