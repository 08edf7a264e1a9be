"""Registered list / search / lookup queries."""

from __future__ import annotations

from wayline.operators import lists as L
from wayline.plans import params as P
from wayline.plans.registry import register

_NEWEST = "ORDER BY created_at DESC NULLS LAST, id DESC"


def _like5(text: str, alias: str = "l") -> str:
    """Case- and accent-folded infix ILIKE (DuckDB), wildcards live."""
    pat = f"%{text}%"
    cols = ["customer_name", "mobile", "alt_mobile", "tour_name", "lead_id"]
    return "(" + " OR ".join(f"strip_accents({alias}.{c}) ILIKE strip_accents('{pat}')"
                             for c in cols) + ")"


def _contains(cols: list[str], text: str) -> str:
    """Case- and accent-folded literal substring test (DuckDB)."""
    return "(" + " OR ".join(f"coalesce(contains(strip_accents(lower({c})), "
                             f"strip_accents(lower('{text}'))), false)" for c in cols) + ")"


@register("user_directory", family="lists", oracle="""
SELECT id, username, full_name, role, is_active FROM crm_users""")
def user_directory(t):
    return L.user_directory(t.users)


@register("active_staff", family="lists", oracle="""
SELECT id, full_name FROM crm_users WHERE role = 'staff' AND is_active = 1""")
def active_staff(t):
    return L.active_staff(t.users)


_LEAD_PAGE = """
SELECT l.*, u.full_name AS assigned_name
FROM crm_leads l LEFT JOIN crm_users u ON l.assigned_to = u.id
WHERE {where}
ORDER BY l.created_at DESC NULLS LAST, l.id DESC"""


@register("lead_list_page", family="lists", oracle=_LEAD_PAGE.format(where="l.is_deleted = 0")
          + f" LIMIT {P.PAGE_SIZE} OFFSET {(P.LIST_PAGE - 1) * P.PAGE_SIZE}")
def lead_list_page(t):
    return L.lead_list(t.leads, t.users, page_no=P.LIST_PAGE, per_page=P.PAGE_SIZE)


@register("lead_list_filtered", family="lists", oracle=_LEAD_PAGE.format(
    where=f"l.is_deleted = 0 AND l.assigned_to = {P.FILTER_ASSIGNEE} "
          f"AND strip_accents(lower(l.status)) = strip_accents(lower('{P.FILTER_STATUS}'))"))
def lead_list_filtered(t):
    return L.lead_list(t.leads, t.users, page_no=None, role="admin",
                       assigned=P.FILTER_ASSIGNEE, status=P.FILTER_STATUS)


@register("lead_list_staff_scope", family="lists", oracle=_LEAD_PAGE.format(
    where=f"l.is_deleted = 0 AND l.assigned_to = {P.STAFF_USER}"))
def lead_list_staff_scope(t):
    # A staff caller's assignee filter is ignored: scope wins.
    return L.lead_list(t.leads, t.users, page_no=None, role="staff", user_id=P.STAFF_USER,
                       assigned=P.FILTER_ASSIGNEE)


@register("lead_list_search_page", family="lists", oracle=_LEAD_PAGE.format(
    where=f"l.is_deleted = 0 AND {_like5(P.SEARCH_TEXT)}") + f" LIMIT {P.PAGE_SIZE}")
def lead_list_search_page(t):
    return L.lead_list(t.leads, t.users, page_no=1, per_page=P.PAGE_SIZE, search=P.SEARCH_TEXT)


@register("lead_page_total", family="lists", oracle=f"""
SELECT COUNT(*) AS total, CAST(ceil(COUNT(*) / {P.PAGE_SIZE}) AS BIGINT) AS pages
FROM crm_leads WHERE is_deleted = 0""")
def lead_page_total(t):
    return L.lead_page_total(t.leads, per_page=P.PAGE_SIZE)


@register("lead_search", family="lists", oracle=f"""
SELECT id, lead_id, customer_name, mobile, tour_name, status, created_at
FROM crm_leads l WHERE {_like5(P.SEARCH_TEXT)}
{_NEWEST} LIMIT {P.SEARCH_LIMIT}""")
def lead_search(t):
    return L.lead_search(t.leads, P.SEARCH_TEXT, limit=P.SEARCH_LIMIT)


@register("recent_leads", family="lists", oracle=f"""
SELECT l.lead_id, l.id, l.customer_name, l.mobile, l.tour_name, l.status, l.created_at,
       u.full_name AS assigned_name
FROM (SELECT * FROM crm_leads {_NEWEST} LIMIT {P.RECENT_LIMIT}) l
LEFT JOIN crm_users u ON l.assigned_to = u.id""")
def recent_leads(t):
    return L.recent_leads(t.leads, t.users, P.RECENT_LIMIT)


@register("lead_with_assignee", family="lists", oracle="""
SELECT l.id, l.lead_id, l.assigned_to, u.full_name AS assigned_name
FROM crm_leads l LEFT JOIN crm_users u ON l.assigned_to = u.id""")
def lead_with_assignee(t):
    return L.lead_with_assignee(t.leads, t.users)


@register("new_leads_on_day", family="lists", oracle=f"""
SELECT id, lead_id, created_at FROM crm_leads
WHERE CAST(created_at AS DATE) = DATE '{P.NEW_LEADS_DAY}'""")
def new_leads_on_day(t):
    return L.new_leads_on_day(t.leads, P.NEW_LEADS_DAY)


@register("category_leads", family="lists", oracle=f"""
SELECT id, lead_id, customer_name, mobile, tour_name, status, created_at
FROM crm_leads WHERE tour_category_id = {P.CATEGORY_ID}
{_NEWEST} LIMIT {P.CATEGORY_LEADS_LIMIT}""")
def category_leads(t):
    return L.category_leads(t.leads, P.CATEGORY_ID, P.CATEGORY_LEADS_LIMIT)


@register("trash_list", family="lists", oracle="""
SELECT l.*, u.full_name AS assigned_name, d.full_name AS deleted_by_name
FROM crm_leads l
LEFT JOIN crm_users u ON l.assigned_to = u.id
LEFT JOIN crm_users d ON l.deleted_by = d.id
WHERE l.is_deleted = 1""")
def trash_list(t):
    return L.trash_list(t.leads, t.users)


@register("leads_orphan_assignee", family="lists", oracle="""
SELECT id, lead_id, assigned_to FROM crm_leads l
WHERE assigned_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM crm_users u WHERE u.id = l.assigned_to)""")
def leads_orphan_assignee(t):
    return L.leads_orphan_assignee(t.leads, t.users)


@register("bookable_leads", family="lists", oracle="""
SELECT id, lead_id, status FROM crm_leads l
WHERE is_deleted = 0 AND NOT EXISTS (SELECT 1 FROM crm_bookings b WHERE b.lead_id = l.id)""")
def bookable_leads(t):
    return L.bookable_leads(t.leads, t.bookings)


@register("duplicate_mobiles", family="lists", oracle="""
SELECT mobile, COUNT(*) AS leads, MAX(created_at) AS latest_at
FROM crm_leads GROUP BY mobile HAVING COUNT(*) > 1""")
def duplicate_mobiles(t):
    return L.duplicate_mobiles(t.leads)


_FOLLOWUPS = """
SELECT f.*, l.customer_name, l.mobile, l.tour_name, l.lead_id AS lead_code, l.id AS lead_pk,
       u.full_name AS staff_name
FROM crm_followups f
LEFT JOIN crm_leads l ON f.lead_id = l.id
LEFT JOIN crm_users u ON f.user_id = u.id
WHERE f.status = 'Pending' {extra}
ORDER BY f.followup_date, f.id"""


@register("followup_list", family="lists", oracle=_FOLLOWUPS.format(extra=""))
def followup_list(t):
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="all")


@register("followup_bucket_list", family="lists", oracle=_FOLLOWUPS.format(
    extra=f"AND f.followup_date < DATE '{P.FOLLOWUP_AS_OF}'"))
def followup_bucket_list(t):
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="overdue")


@register("followup_upcoming_list", family="lists", oracle=_FOLLOWUPS.format(
    extra=f"AND f.followup_date > DATE '{P.FOLLOWUP_AS_OF}' + INTERVAL 1 DAY"))
def followup_upcoming_list(t):
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="upcoming")


@register("followups_staff_scope", family="lists", oracle=_FOLLOWUPS.format(
    extra=f"AND f.user_id = {P.FOLLOWUP_STAFF} AND f.followup_date = DATE '{P.FOLLOWUP_AS_OF}'"))
def followups_staff_scope(t):
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="today",
                           role="staff", user_id=P.FOLLOWUP_STAFF)


@register("followups_staff_all", family="lists", oracle=_FOLLOWUPS.format(
    extra=f"AND f.user_id = {P.FOLLOWUP_STAFF}"))
def followups_staff_all(t):
    """F7 + F9 (unknown tab = every pending follow-up) for one staff member."""
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket=None,
                           role="staff", user_id=P.FOLLOWUP_STAFF)


@register("followup_today_list", family="lists", oracle=_FOLLOWUPS.format(
    extra=f"AND f.followup_date = DATE '{P.FOLLOWUP_AS_OF}'"))
def followup_today_list(t):
    """F9 'today' tab for every user."""
    return L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="today")


_BOOKING_ROWS = """
SELECT b.*, l.customer_name, l.mobile, l.tour_name, l.travel_date, u.full_name AS staff_name
FROM crm_bookings b
LEFT JOIN crm_leads l ON b.lead_id = l.id
LEFT JOIN crm_users u ON b.user_id = u.id"""


@register("booking_list_page", family="lists", oracle=_BOOKING_ROWS
          + f" ORDER BY b.created_at DESC NULLS LAST, b.id DESC LIMIT {P.PAGE_SIZE}")
def booking_list_page(t):
    return L.booking_list(t.bookings, t.leads, t.users, page_no=1, per_page=P.PAGE_SIZE)


@register("bookings_staff_scope", family="lists", oracle=_BOOKING_ROWS
          + f" WHERE b.user_id = {P.STAFF_USER}")
def bookings_staff_scope(t):
    return L.booking_list(t.bookings, t.leads, t.users, page_no=None, role="staff",
                          user_id=P.STAFF_USER)


@register("booking_search", family="lists", oracle=f"""
SELECT * FROM ({_BOOKING_ROWS}) x
WHERE {_contains(['booking_id', 'customer_name', 'mobile', 'tour_name'], P.BOOKING_SEARCH_TEXT)}""")
def booking_search(t):
    return L.booking_search(L.booking_rows(t.bookings, t.leads, t.users), P.BOOKING_SEARCH_TEXT)


@register("booking_page_totals", family="lists", oracle=f"""
WITH pg AS (SELECT id, final_amount FROM crm_bookings
            ORDER BY created_at DESC NULLS LAST, id DESC LIMIT {P.PAGE_SIZE}),
     pd AS (SELECT booking_id, SUM(amount) AS paid FROM crm_payments
            WHERE booking_id IN (SELECT id FROM pg) GROUP BY booking_id)
SELECT (SELECT COUNT(*) FROM crm_bookings) AS total_bookings,
       COUNT(*) AS page_rows,
       CAST(COALESCE(SUM(pg.final_amount), 0) AS DECIMAL(18,2)) AS page_final,
       CAST(COALESCE(SUM(COALESCE(pd.paid, 0)), 0) AS DECIMAL(18,2)) AS page_advance,
       CAST(COALESCE(SUM(pg.final_amount - COALESCE(pd.paid, 0)), 0) AS DECIMAL(18,2)) AS page_balance
FROM pg LEFT JOIN pd ON pd.booking_id = pg.id""")
def booking_page_totals(t):
    # The page order depends on bookings alone; the lead/user columns of the
    # list page are not needed to pick its ids.
    page_rows = L.page(t.bookings, L.newest_first(), 1, P.PAGE_SIZE)
    return L.booking_page_totals(t.bookings, t.payments, page_rows, P.PAGE_SIZE)


@register("activity_feed", family="lists", oracle=f"""
SELECT a.*, u.full_name
FROM (SELECT * FROM crm_activity_logs {_NEWEST} LIMIT {P.AUDIT_LIMIT}) a
LEFT JOIN crm_users u ON a.user_id = u.id""")
def activity_feed(t):
    return L.activity_feed(t.activity_logs, t.users, P.AUDIT_LIMIT)


@register("activity_search", family="lists", oracle=f"""
SELECT a.*, u.full_name FROM crm_activity_logs a LEFT JOIN crm_users u ON a.user_id = u.id
WHERE {_contains(['a.action', 'u.full_name', 'a.details'], P.ACTIVITY_SEARCH_TEXT)}""")
def activity_search(t):
    return L.activity_search(t.activity_logs, t.users, P.ACTIVITY_SEARCH_TEXT)


@register("assignment_history", family="lists", oracle="""
SELECT la.*, uf.full_name AS from_name, ut.full_name AS to_name, ub.full_name AS by_name
FROM crm_lead_assignments la
LEFT JOIN crm_users uf ON la.assigned_from = uf.id
LEFT JOIN crm_users ut ON la.assigned_to = ut.id
LEFT JOIN crm_users ub ON la.assigned_by = ub.id""")
def assignment_history(t):
    return L.assignment_history(t.lead_assignments, t.users)


@register("package_by_id", family="lists", oracle=f"""
SELECT * FROM crm_packages WHERE id = {P.PACKAGE_ID}""")
def package_by_id(t):
    return L.package_by_id(t.packages, P.PACKAGE_ID)
