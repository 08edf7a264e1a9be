"""Fixed parameters of the registered queries (replacing the wall clock).

Leads and bookings live in 1992-2001 in the driver tables, follow-ups and
the audit log in January 2024, so each stream has its own ``as_of``.
"""

AS_OF = "2001-08-01 00:00:00"          # leads / bookings "now"
AS_OF_DAY = "2001-08-01"
FOLLOWUP_AS_OF = "2024-01-20"          # follow-ups / activity "today"
ACTIVITY_AS_OF = "2024-01-20 12:00:00"
PAGE_SIZE = 20
LIST_PAGE = 2                          # second page: exercises OFFSET
RECENT_LIMIT = 10
SEARCH_LIMIT = 20
AUDIT_LIMIT = 100
CATEGORY_LEADS_LIMIT = 100
HISTORY_LIMIT = 5
DOC_PART_SIZE = 1000                   # children per lead_360 document part
TREE_PART_SIZE = 1000                  # sub-categories per category_tree row
SEARCH_TEXT = "1_3"                    # '_' is a live LIKE wildcard here
BOOKING_SEARCH_TEXT = "nation_1"             # literal, case-insensitive ("_" is plain)
ACTIVITY_SEARCH_TEXT = "_conv"         # literal: '_' is a plain character
STAFF_USER = 7                          # a staff member (id % 10 not in {0, 1})
FOLLOWUP_STAFF = 16                     # a staff member with follow-ups on FOLLOWUP_AS_OF
FILTER_STATUS = "Follow-up"
FILTER_ASSIGNEE = 12
CATEGORY_ID = 2
PACKAGE_ID = 1001
NEW_LEADS_DAY = "1998-07-15"
STREAM_FILES_PER_BATCH = 8              # files per micro-batch of the T2 stream
