"""DuckDB-side building blocks for the independent SQL oracle.

Only the driver's base tables exist in the oracle database, so every oracle
statement starts with these CTEs: the fixture views (same SQL text as the Spark
side) and the cleaned forms of prime and transactions written in plain SQL.
"""

from __future__ import annotations

from cardpulse.sources.fixtures import ABSENT, PRIME_SQL, TXN_SQL

_TABLES = {n: n for n in ("orders", "customer", "nation", "lineitem", "supplier")}

BASE_CTES = f"""
prime_raw AS ({PRIME_SQL.format(**_TABLES)}),
txn_raw AS ({TXN_SQL.format(**_TABLES)}),
prime AS (
  SELECT SNAP_MONTH, ROW_ID,
         nullif(replace(trim(RIMNO), ',', ''), '') AS RIMNO,
         trim(PRODUCT_NAME) AS PRODUCT_NAME,
         upper(trim(ACTIVATED)) AS ACTIVATED,
         upper(trim(STATUS)) AS STATUS,
         upper(trim(CARD_STATUS)) AS CARD_STATUS,
         CAST(try_strptime(trim(DOB), '%Y-%m-%d') AS DATE) AS DOB,
         DOB_SERIAL, GENDER, CUSTOMER_TYPE, BRANCH_NAME, CREDIT_LIMIT, LEDGER_BALANCE, AVAILABLE_LIMIT,
         OVERDUEAMOUNT, DELIQUENCY, ANNUAL_FEE, JOINING_FEE, FIRST_REPLACED_CARD, SECOND_REPLACED_CARD,
         THIRD_REPLACED_CARD, CREATION_DATE, LAST_PAYMENT_DATE, CLOSURE_DATE, LAST_PAYMENT_AMOUNT, NO_OF_CYCLES,
         STATUS_NAME, BRANCH_ID, ORGANIZATION, LAST_STATEMENT_DATE
  FROM prime_raw),
months AS (
  SELECT SNAP_MONTH, CAST(row_number() OVER (ORDER BY SNAP_MONTH) AS INTEGER) AS M_RANK,
         upper(strftime(SNAP_MONTH, '%Y-%b')) AS M_LABEL,
         CAST(count(*) OVER () AS INTEGER) AS N_MONTHS
  FROM (SELECT DISTINCT SNAP_MONTH FROM prime)),
primem AS (SELECT p.*, m.M_RANK, m.M_LABEL, m.N_MONTHS FROM prime p JOIN months m USING (SNAP_MONTH)),
txn AS (
  SELECT TXN_ID, nullif(replace(trim(RIMNO), ',', ''), '') AS RIMNO, trim(DESCRIPTION) AS PRODUCT_NAME,
         TRXN_DATE, POST_DATE, ORIG_AMOUNT, BILLING_AMT, SETTLEMENT_AMT, MCC, TRXN_COUNTRY, REVERSAL_FLAG,
         MERCHNAME, CCY, MERCH_ID, SOURCES, BANKBRANCH, SETTLEMENT_CCY, EMBEDDED_FEE
  FROM txn_raw)
"""


def _uneven(ctes: str) -> str:
    """The base CTEs with the columns that a month's file lacks set to null in ``prime``."""
    cut = ", ".join(
        f"CASE WHEN SNAP_MONTH NOT IN ({', '.join(f'DATE {m.isoformat()!r}' for m, gone in ABSENT.items() if c in gone)}) THEN {c} END AS {c}"
        for c in sorted(set().union(*ABSENT.values())))
    return ctes.replace("\nprime AS (", "\nprime_full AS (").replace(
        "\nmonths AS (", f"\nprime AS (SELECT * REPLACE ({cut}) FROM prime_full),\nmonths AS (")


def sql(body_ctes: str, final: str, uneven: bool = False) -> str:
    """Compose ``WITH <base>, <body ctes> <final select>``."""
    ctes = _uneven(BASE_CTES).strip() if uneven else BASE_CTES.strip()
    if body_ctes.strip():
        ctes += ",\n" + body_ctes.strip()
    return f"WITH {ctes}\n{final.strip()}\n"
