"""Fixed values that must equal the studied scripts' for identical results.

Everything below is a constant of the domain (code lists, class names, bins,
merchant-category names); no logic lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# STATUS codes meaning the card/account is churned (status lifecycle).
CHURN_STATUSES = ["CLSB", "CLSC", "CLSD", "WROF", "EXPD", "EXPC", "LOST", "STLC", "FRAD", "PICK"]

# Status codes meaning inactive (active / historical split).
INACTIVE_STATUSES = ["CLSB", "CLSC", "LOST", "WROF", "CNCD", "SUSP", "FRAD", "CLSD", "BLOK", "NOAU",
                     "EXMU", "PICK", "BLCK", "STLC", "OFBL", "ONBL", "FREZ", "EXPD", "EXPC", "CLSS"]

# ACTIVATED flag values.
ACTIVE_VALUE = "A"
INACTIVE_VALUES = ["I", "D"]

# Lifecycle classes, in report order, with their churn flag.
ACTIVATION_CLASSES = [("deactivated_recent", 1), ("always_inactive", 1), ("disappeared", 1),
                      ("recently_active", 0), ("still_active", 0), ("new_customer", 0)]
STATUS_CLASSES = [("always_churned", 1), ("became_churned_recent", 1), ("became_churned_old", 1),
                  ("disappeared", 1), ("not_churned", 0), ("new_customer", 0)]
DISAGREE_TYPES = ["both_churn", "both_not_churn", "STATUS_churn_only", "ACTIVATION_churn_only",
                  "only_in_status_file", "only_in_activation_file"]

# Right-closed bins: (lower, upper] -> label.
AGE_BANDS = [(18, 25, "18-25"), (25, 35, "26-35"), (35, 50, "36-50"), (50, 65, "51-65"), (65, 100, "65+")]
LIMIT_BANDS = [(0, 10000, "Low"), (10000, 50000, "Medium"), (50000, 100000, "High"),
               (100000, 500000, "Very High"), (500000, None, "Premium")]

# Missing-share severity thresholds.
MISSING_RED = 0.30
MISSING_ORANGE = 0.05

# Merchant category code -> name.
MCC_NAMES = {
    4814: "Telecommunication Services",
    4900: "Utilities",
    5065: "Electrical Parts & Equipment",
    4121: "Taxicabs and Limousines",
    5331: "Variety Stores",
    5411: "Grocery Stores & Supermarkets",
    5499: "Convenience Stores",
    5541: "Service Stations / Gas",
    5732: "Electronic Sales",
    5814: "Fast Food Restaurants",
    6011: "Automated Cash Disbursements",
    7278: "Buying/Shopping Clubs",
    8099: "Medical Services",
    8299: "Educational Services",
    9222: "Fines",
    9399: "Government Services",
}

HOME_COUNTRY = "EGYPT"

# Column aliases normalised on read.
PRIME_ALIASES = {"RIM_NO": "RIMNO", "NAME": "PRODUCT_NAME", "Card account status ": "CARD_STATUS"}
TXN_ALIASES = {"DESCRIPTION": "PRODUCT_NAME"}

# Columns dropped from prime when present.
PRIME_UNUSED = ["MAPPING_ACCNO", "MIN_PAYMENT", "OVER_LIMIT", "TOTAL_HOLD"]

# Typed contract of the prime snapshot (optional columns).
PRIME_STRING = ["BRANCH_NAME", "ACTIVATED", "STATUS", "STATUS_NAME", "PRODUCT_NAME", "GENDER",
                "ORGANIZATION", "CUSTOMER_TYPE", "CARD_STATUS"]
PRIME_LONG = ["BRANCH_ID"]
PRIME_DOUBLE = ["CREDIT_LIMIT", "DELIQUENCY", "JOINING_FEE", "ANNUAL_FEE", "LEDGER_BALANCE",
                "AVAILABLE_LIMIT", "LAST_PAYMENT_AMOUNT", "OVERDUEAMOUNT", "NO_OF_CYCLES",
                "FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD", "SETTLEMENT AMT"]
PRIME_DATE = ["CREATION_DATE", "LAST_STATEMENT_DATE", "LAST_PAYMENT_DATE", "DOB", "CLOSURE_DATE"]

TXN_STRING = ["PRODUCT_NAME", "MERCHNAME", "MERCH_ID", "SOURCES", "BANKBRANCH", "TRXN_COUNTRY", "REVERSAL_FLAG"]
TXN_LONG = ["CCY", "MCC", "SETTLEMENT_CCY"]
TXN_DOUBLE = ["ORIG_AMOUNT", "EMBEDDED_FEE", "BILLING_AMT", "SETTLEMENT_AMT"]
# Casts that the cast report applies, per table.
PRIME_CAST_PLAN = {
    "string": ["BRANCH_NAME", "ACTIVATED", "STATUS", "STATUS_NAME", "PRODUCT_NAME", "GENDER", "CUSTOMER_TYPE", "CARD_STATUS"],
    "float": ["CREDIT_LIMIT", "DELIQUENCY", "LEDGER_BALANCE", "AVAILABLE_LIMIT", "OVERDUEAMOUNT",
              "FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD", "DOB_SERIAL"],
    "int": ["BRANCH_ID", "RIMNO"],
    "date": ["CREATION_DATE", "LAST_STATEMENT_DATE", "DOB", "CLOSURE_DATE"],
}
TXN_CAST_PLAN = {
    "string": ["MERCHNAME", "MERCH_ID", "SOURCES", "BANKBRANCH", "TRXN_COUNTRY", "REVERSAL_FLAG", "DESCRIPTION"],
    "float": ["ORIG_AMOUNT", "EMBEDDED_FEE", "BILLING_AMT", "SETTLEMENT_AMT"],
    "int": ["RIMNO", "CCY", "MCC", "SETTLEMENT_CCY"],
    "date": ["TRXN_DATE", "POST_DATE"],
}

# Formats that a date column may have, in order of preference among equals.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy",
                "dd.MM.yyyy", "dd-MMM-yyyy", "yyyyMMdd"]

# Columns of the categorical, demographic and correlation reports.
TXN_CATEGORICAL = ["PRODUCT_NAME", "CCY", "MCC", "SETTLEMENT_CCY", "BANKBRANCH", "TRXN_COUNTRY", "REVERSAL_FLAG"]
PRIME_CATEGORICAL = ["BRANCH_NAME", "FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD"]
DEMOGRAPHIC_COLUMNS = ["GENDER", "CUSTOMER_TYPE", "ACTIVATED", "STATUS_NAME"]
CORR_COLUMNS = ["CREDIT_LIMIT", "LEDGER_BALANCE", "OVERDUEAMOUNT", "LAST_PAYMENT_AMOUNT", "DELIQUENCY", "NO_OF_CYCLES",
                "ACCOUNT_TENURE_MONTHS", "DAYS_SINCE_LAST_PAYMENT", "AGE", "FEE_TO_LIMIT_RATIO",
                "CARD_REPLACEMENT_FREQ"]

# Histograms: (source, column, bins, trim quantile, strict trim).
HIST_SPECS = [("prime", c, 50, 0.99, False) for c in ["CREDIT_LIMIT", "LEDGER_BALANCE", "OVERDUEAMOUNT",
                                                       "LAST_PAYMENT_AMOUNT", "JOINING_FEE", "ANNUAL_FEE"]] + \
    [("txn", c, 60, 0.99, False) for c in ["BILLING_AMT", "ORIG_AMOUNT"]] + \
    [("features", "ACCOUNT_TENURE_MONTHS", 40, None, False), ("features", "DAYS_SINCE_LAST_PAYMENT", 40, 0.99, True)] + \
    [("rfm", c, 50, None, False) for c in ["TOTAL_SPEND", "AVG_TXN", "TXN_COUNT", "RECENCY"]]

TXN_TIMESTAMP = ["TRXN_DATE"]
TXN_DATE = ["POST_DATE"]
