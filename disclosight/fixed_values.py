"""Vocabularies, labels, thresholds and wording.

Everything in this module is a published vocabulary or an agreed constant that
results must carry verbatim. It holds no logic.
"""

from __future__ import annotations

# --- fixed values: disclosure vocabularies ---------------------------------
PTR_FILING_TYPE = "P"
DOC_KINDS = ("efiled", "scanned")
SOURCES = ("house_clerk", "senate_efd")
TXN_TYPES = ("P", "S", "E", "S (partial)")
RUN_STATUSES = ("success", "partial", "failed")
CURATION_METHODS = ("explicit_source", "amendment_match", "manual_review")
CURATION_CONFIDENCES = ("high", "medium", "low")
OWNER_TOKENS = ("SP", "SF", "DC", "JT")
TXN_TYPE_LABELS = {
    "P": "Purchase",
    "S": "Sale",
    "E": "Exchange",
    "S (partial)": "Sale (partial)",
}
SENATE_TXN_TYPES = {
    "purchase": "P",
    "sale (full)": "S",
    "sale (partial)": "S (partial)",
    "exchange": "E",
}

# --- fixed values: public document addresses -------------------------------
HOUSE_BASE_URL = "https://disclosures-clerk.house.gov/public_disc"
SENATE_BASE_URL = "https://efdsearch.senate.gov"

# --- fixed values: House asset type codes (public code list) ---------------
ASSET_TYPE_LABELS = {
    "4K": "401K and Other Non-Federal Retirement Accounts",
    "5C": "529 College Savings Plan",
    "5F": "529 Portfolio",
    "5P": "529 Prepaid Tuition Plan",
    "AB": "Asset-Backed Securities",
    "BA": "Bank Accounts, Money Market Accounts and CDs",
    "BK": "Brokerage Accounts",
    "CO": "Collectibles",
    "CS": "Corporate Securities (Bonds and Notes)",
    "CT": "Cryptocurrency",
    "DB": "Defined Benefit Pension",
    "DO": "Debts Owed to the Filer",
    "DS": "Delaware Statutory Trust",
    "EF": "Exchange Traded Funds (ETF)",
    "EQ": "Excepted/Qualified Blind Trust",
    "ET": "Exchange Traded Notes",
    "FA": "Farms",
    "FE": "Foreign Exchange Position (Currency)",
    "FN": "Fixed Annuity",
    "FU": "Futures",
    "GS": "Government Securities and Agency Debt",
    "HE": "Hedge Funds & Private Equity Funds (EIF)",
    "HN": "Hedge Funds & Private Equity Funds (non-EIF)",
    "IC": "Investment Club",
    "IH": "IRA (Held in Cash)",
    "IP": "Intellectual Property & Royalties",
    "IR": "IRA",
    "MA": "Managed Accounts (e.g., SMA and UMA)",
    "MF": "Mutual Funds",
    "MO": "Mineral/Oil/Solar Energy Rights",
    "OI": "Ownership Interest (Holding Investments)",
    "OL": "Ownership Interest (Engaged in a Trade or Business)",
    "OP": "Options",
    "OT": "Other",
    "PE": "Pensions",
    "PM": "Precious Metals",
    "PS": "Stock (Not Publicly Traded)",
    "RE": "Real Estate Invest. Trust (REIT)",
    "RF": "REIT (EIF)",
    "RN": "REIT (non-EIF)",
    "RP": "Real Property",
    "RS": "Restricted Stock Units (RSUs)",
    "SA": "Stock Appreciation Right",
    "ST": "Stocks (including ADRs)",
    "TR": "Trust",
    "VA": "Variable Annuity",
    "VI": "Variable Insurance",
    "WU": "Whole/Universal Insurance",
}

# --- fixed values: date-quality flags, in reporting order ------------------
FLAG_AFTER_NOTIFICATION = "transaction_date_after_notification"
FLAG_AFTER_FILING = "transaction_date_after_filing"
FLAG_AFTER_INGESTION = "transaction_date_after_ingestion_date"
FLAG_NOTIFICATION_AFTER_FILING = "notification_date_after_filing"
FLAG_MESSAGES = {
    "transaction_date_after_notification": "Transaction date is after the notification date.",
    "transaction_date_after_filing": "Transaction date is after the filing date.",
    "transaction_date_after_ingestion_date":
        "Transaction date is after the date this filing was ingested.",
    "notification_date_after_filing": "Notification date is after the filing date.",
}

# --- fixed values: cluster rule thresholds and wording ---------------------
TICKER_PATTERN = r"^[A-Z][A-Z0-9.\-]{0,5}$"
MIN_POLITICIANS = 3
MAX_GAP_DAYS = 7
MAX_SPAN_DAYS = 14
BUY_DESCRIPTION = (
    "Three or more politicians disclosing open-market purchases (P) of the "
    "same equity ticker, where consecutive purchases are no more than 7 "
    "days apart and the whole burst spans no more than 14 days."
)
SELL_DESCRIPTION = (
    "Three or more politicians disclosing open-market sales (S) of the "
    "same equity ticker, where consecutive sales are no more than 7 days "
    "apart and the whole burst spans no more than 14 days."
)
LIMITATION_TIMING = (
    "A cluster reflects disclosure timing only. It is not evidence that the "
    "politicians coordinated, and implies nothing about their intent."
)
LIMITATION_PARTIAL = (
    "Partial sales ('S (partial)') are a separate disclosure category and "
    "are not included here."
)
LIMITATION_BUY_DELAY = (
    "Purchases may predate one another by months and still surface together, "
    "because disclosure is filed after the transaction date."
)
LIMITATION_SELL_DELAY = (
    "Sales may predate one another by months and still surface together, "
    "because disclosure is filed after the transaction date."
)
LIMITATION_RANGES = "Amounts are disclosure ranges, so the total is a range, not an exact sum."
LIMITATION_SMALL = (
    "Small positions are reportable under STOCK Act rules, so cluster size "
    "does not imply unusually large positions."
)
LIMITATION_IDENTITY = (
    "Politician identity is derived from name and district rather than a "
    "legislative roster, so people are grouped heuristically."
)
LARGEST_REASON = (
    "Ranked by disclosed minimum amount. This is not necessarily the "
    "definitively largest transaction when disclosed ranges overlap."
)

# --- fixed values: report layout markers -----------------------------------
FILING_ID_LABEL = "Filing ID #"
HEADER_LABELS = {
    "name": "Name:",
    "status": "Status:",
    "state_district": "State/District:",
    "digitally_signed": "Digitally Signed:",
}
TABLE_END_MARKERS = ("* For the complete list", "I CERTIFY", "Digitally Signed:")
COLUMN_HEADER_WORDS = ("id", "owner", "asset", "transaction", "date", "notification",
                       "amount", "cap.")

# --- fixed values: names ----------------------------------------------------
NAME_SUFFIXES = ("jr", "sr", "junior", "senior", "ii", "iii", "iv", "v")
POSTNOMINAL_CREDENTIALS = ("md", "facs")
APOSTROPHES = "‘’ʼ＇"
TOKEN_TRIM = ".,'’"
# Common English given names and their short forms.
NICKNAMES = {
    "james": ("jim",),
    "william": ("bill", "billy", "will"),
    "michael": ("mike",),
    "robert": ("bob", "rob", "bobby", "robby"),
    "charles": ("chuck", "charlie"),
    "bernard": ("bernie",),
    "bernardo": ("bernie",),
    "richard": ("dick", "rich", "rick", "ricky"),
    "andrew": ("andy", "drew"),
    "stephen": ("steve", "steven"),
    "steven": ("steve",),
    "geoffrey": ("jeff",),
    "jeffrey": ("jeff",),
    "joseph": ("joe", "joey"),
    "gerald": ("jerry",),
    "thomas": ("tom", "thom", "tommy"),
    "john": ("jack", "johnny"),
    "jonathan": ("jon",),
    "mitchell": ("mitch",),
    "timothy": ("tim", "timmy"),
    "christopher": ("chris",),
    "joshua": ("josh",),
    "daniel": ("dan", "danny"),
    "ronald": ("ron", "ronnie"),
    "peter": ("pete",),
    "theodore": ("ted",),
    "alexander": ("alex", "sandy"),
    "samuel": ("sam", "sammy"),
    "edward": ("ed", "eddie", "ted"),
    "margaret": ("peg", "peggy", "maggie"),
    "elizabeth": ("beth", "betty", "liz", "lizzie"),
    "matthew": ("mat", "matt"),
    "anthony": ("tony",),
    "donald": ("don", "donnie"),
    "david": ("dave",),
    "randall": ("rand",),
    "deborah": ("deb",),
    "gregory": ("greg",),
    "rohit": ("ro",),
    "valerie": ("val", "valery"),
    "patrick": ("pat",),
    "cynthia": ("cindy",),
    "kenneth": ("ken",),
}

# --- fixed values: roster coverage and verified service corrections --------
ROSTER_HISTORY_START = "2000-01-01"
SENATE_SERVICE_CORRECTIONS = (
    # (bioguide_id, term start, corrected end)
    ("V000137", "2023-01-03", "2031-01-03"),
)

# --- fixed values: wording of run errors ---
INDEX_FAILURE = "failed to fetch %d index: %s"

# --- fixed values: wording of highlights ---
CLUSTER_SUMMARY = "%s — %d transactions involving %d members"
CLUSTER_REASON = ("At least {people} politicians disclosed {noun} of the same ticker, with no more than {gap} days between consecutive "
                  "transactions and a maximum {span}-day span.")
LARGEST_TITLE = "Largest Disclosed {} (by minimum amount)"
