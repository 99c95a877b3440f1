"""Independent DuckDB SQL for each catalogue query.

Written set-style, close to how the studied scripts reason (id sets, EXCEPT,
INTERSECT, IN-lists), so it checks the Spark plans rather than restating them.
"""

from __future__ import annotations

from cardpulse.functions import contract
from cardpulse.plans.oracle_base import sql
from cardpulse.sources.fixtures import ABSENT, PRIME_COLUMNS, TXN_COLUMNS


def _lst(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


PCOLS = ", ".join(f"p.{c}" for c in PRIME_COLUMNS)
TCOLS = ", ".join(f"t.{c}" for c in TXN_COLUMNS)
CHURN_CODES = _lst(contract.CHURN_STATUSES)
INACTIVE_CODES = _lst(contract.INACTIVE_STATUSES)


def _stub_cols(label_cols: str) -> str:
    """Select list for stub rows: RIMNO, typed nulls elsewhere, then label columns."""
    parts = []
    for c in PRIME_COLUMNS:
        parts.append("g.RIMNO" if c == "RIMNO" else f"NULL AS {c}")
    return ", ".join(parts) + ", " + label_cols


ACTIVATION_SETS = """
hist AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK < N_MONTHS),
lat AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK = N_MONTHS),
ever_a AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK < N_MONTHS AND ACTIVATED = 'A'),
inact_latest AS (SELECT RIMNO FROM primem WHERE M_RANK = N_MONTHS AND RIMNO IN (SELECT RIMNO FROM hist)
                 GROUP BY RIMNO HAVING bool_and(coalesce(ACTIVATED IN ('I', 'D'), false))),
inact_prev AS (SELECT RIMNO FROM primem WHERE M_RANK = N_MONTHS - 1 AND RIMNO IS NOT NULL
               GROUP BY RIMNO HAVING bool_and(coalesce(ACTIVATED IN ('I', 'D'), false))),
always_inactive AS (SELECT RIMNO FROM inact_latest EXCEPT SELECT RIMNO FROM ever_a),
deact AS (SELECT RIMNO FROM inact_latest INTERSECT SELECT RIMNO FROM ever_a INTERSECT SELECT RIMNO FROM inact_prev),
recent AS ((SELECT RIMNO FROM inact_latest INTERSECT SELECT RIMNO FROM ever_a) EXCEPT SELECT RIMNO FROM inact_prev),
newc AS (SELECT RIMNO FROM lat EXCEPT SELECT RIMNO FROM hist),
gone AS (SELECT RIMNO FROM hist EXCEPT SELECT RIMNO FROM lat),
act_out AS (
  SELECT """ + PCOLS + """,
    CAST(CASE WHEN p.RIMNO IN (SELECT RIMNO FROM always_inactive) OR p.RIMNO IN (SELECT RIMNO FROM deact)
              THEN 1 ELSE 0 END AS INTEGER) AS ACTIVATION_CHURN,
    CASE WHEN p.RIMNO IN (SELECT RIMNO FROM newc) THEN 'new_customer'
         WHEN p.RIMNO IN (SELECT RIMNO FROM recent) THEN 'recently_active'
         WHEN p.RIMNO IN (SELECT RIMNO FROM deact) THEN 'deactivated_recent'
         WHEN p.RIMNO IN (SELECT RIMNO FROM always_inactive) THEN 'always_inactive'
         ELSE 'still_active' END AS ACTIVATION_CHURN_TYPE
  FROM primem p WHERE p.M_RANK = p.N_MONTHS
  UNION ALL
  SELECT """ + _stub_cols("CAST(1 AS INTEGER) AS ACTIVATION_CHURN, 'disappeared' AS ACTIVATION_CHURN_TYPE") + """
  FROM gone g)
"""

STATUS_SETS = """
s_hist AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK < N_MONTHS),
s_lat AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK = N_MONTHS),
s_ever_active AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK < N_MONTHS
                  AND NOT coalesce(STATUS IN (""" + CHURN_CODES + """), false)),
s_recent AS (SELECT DISTINCT RIMNO FROM primem WHERE RIMNO IS NOT NULL AND M_RANK IN (N_MONTHS - 1, N_MONTHS - 2)
             AND NOT coalesce(STATUS IN (""" + CHURN_CODES + """), false)),
s_churned AS (SELECT RIMNO FROM primem WHERE M_RANK = N_MONTHS AND RIMNO IN (SELECT RIMNO FROM s_hist)
              GROUP BY RIMNO HAVING bool_and(coalesce(STATUS IN (""" + CHURN_CODES + """), false))),
s_always AS (SELECT RIMNO FROM s_churned EXCEPT SELECT RIMNO FROM s_ever_active),
s_became AS (SELECT RIMNO FROM s_churned INTERSECT SELECT RIMNO FROM s_ever_active),
s_became_recent AS (SELECT RIMNO FROM s_became INTERSECT SELECT RIMNO FROM s_recent),
s_became_old AS (SELECT RIMNO FROM s_became EXCEPT SELECT RIMNO FROM s_recent),
s_new AS (SELECT RIMNO FROM s_lat EXCEPT SELECT RIMNO FROM s_hist),
s_gone AS (SELECT RIMNO FROM s_hist EXCEPT SELECT RIMNO FROM s_lat),
status_out AS (
  SELECT """ + PCOLS + """,
    CAST(CASE WHEN p.RIMNO IN (SELECT RIMNO FROM s_churned) THEN 1 ELSE 0 END AS INTEGER) AS CHURN,
    CASE WHEN p.RIMNO IN (SELECT RIMNO FROM s_new) THEN 'new_customer'
         WHEN p.RIMNO IN (SELECT RIMNO FROM s_always) THEN 'always_churned'
         WHEN p.RIMNO IN (SELECT RIMNO FROM s_became_recent) THEN 'became_churned_recent'
         WHEN p.RIMNO IN (SELECT RIMNO FROM s_became_old) THEN 'became_churned_old'
         ELSE 'not_churned' END AS CHURN_TYPE
  FROM primem p WHERE p.M_RANK = p.N_MONTHS
  UNION ALL
  SELECT """ + _stub_cols("CAST(1 AS INTEGER) AS CHURN, 'disappeared' AS CHURN_TYPE") + """
  FROM s_gone g)
"""


def _summary(out_cte: str, type_col: str, churn_col: str, classes) -> str:
    spine = " UNION ALL ".join(
        f"SELECT {i + 1} AS CLASS_ORDER, '{n}' AS {type_col}, {f} AS {churn_col}" for i, (n, f) in enumerate(classes))
    return f"""
SELECT CAST(s.CLASS_ORDER AS INTEGER) AS CLASS_ORDER, s.{type_col}, CAST(s.{churn_col} AS INTEGER) AS {churn_col},
       CAST(coalesce(c.n, 0) AS BIGINT) AS N_ROWS,
       round(coalesce(c.n, 0) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM {out_cte}), 4) AS PCT_ROWS
FROM ({spine}) s LEFT JOIN (SELECT {type_col}, count(*) AS n FROM {out_cte} GROUP BY 1) c USING ({type_col})
"""


IDENTITY = """
ids AS (SELECT RIMNO, DOB, CAST(row_number() OVER (ORDER BY RIMNO NULLS FIRST, DOB NULLS FIRST) AS BIGINT) AS CUSTOMER_ID
        FROM (SELECT DISTINCT RIMNO, DOB FROM prime)),
withid AS (SELECT p.*, i.CUSTOMER_ID FROM primem p LEFT JOIN ids i
           ON p.RIMNO IS NOT DISTINCT FROM i.RIMNO AND p.DOB IS NOT DISTINCT FROM i.DOB),
flagged AS (SELECT *, coalesce(STATUS IN (""" + INACTIVE_CODES + """), false)
                      AND coalesce(CARD_STATUS IN (""" + INACTIVE_CODES + """), false) AS IS_HIST FROM withid),
dup AS (SELECT SNAP_MONTH, RIMNO, PRODUCT_NAME, min(DOB) AS OLDEST_DOB FROM flagged
        WHERE NOT IS_HIST AND RIMNO IS NOT NULL AND PRODUCT_NAME IS NOT NULL
        GROUP BY SNAP_MONTH, RIMNO, PRODUCT_NAME HAVING count(DISTINCT CUSTOMER_ID) > 1),
seg AS (SELECT f.*, CASE WHEN f.IS_HIST THEN 'historical'
                         WHEN d.OLDEST_DOB IS NOT NULL AND f.DOB IS DISTINCT FROM d.OLDEST_DOB THEN 'relative'
                         ELSE 'active' END AS SEGMENT
        FROM flagged f LEFT JOIN dup d
        ON NOT f.IS_HIST AND f.SNAP_MONTH = d.SNAP_MONTH AND f.RIMNO = d.RIMNO AND f.PRODUCT_NAME = d.PRODUCT_NAME),
lookup AS (SELECT DISTINCT RIMNO, PRODUCT_NAME, CUSTOMER_ID FROM seg WHERE SEGMENT = 'active'),
mapped AS (SELECT """ + TCOLS + """, l.CUSTOMER_ID FROM txn t LEFT JOIN lookup l
           ON t.RIMNO = l.RIMNO AND t.PRODUCT_NAME IS NOT DISTINCT FROM l.PRODUCT_NAME)
"""

LOOKBACK = """
actv AS (SELECT DISTINCT CUSTOMER_ID, M_RANK, N_MONTHS FROM seg WHERE SEGMENT = 'active' AND CUSTOMER_ID IS NOT NULL),
lab AS (SELECT M_RANK, M_LABEL FROM months)
"""


def _lookback(window: int) -> str:
    if window == 1:
        return sql(IDENTITY + "," + LOOKBACK + """,
earlier AS (SELECT CUSTOMER_ID, max(M_RANK) AS LR FROM actv WHERE M_RANK < N_MONTHS GROUP BY CUSTOMER_ID),
last_ids AS (SELECT CUSTOMER_ID FROM actv WHERE M_RANK = N_MONTHS)""", """
SELECT e.CUSTOMER_ID,
       CASE WHEN e.CUSTOMER_ID IN (SELECT CUSTOMER_ID FROM last_ids)
            THEN (SELECT M_LABEL FROM months WHERE M_RANK = N_MONTHS) ELSE l.M_LABEL END AS LAST_SEEN,
       CAST(CASE WHEN e.CUSTOMER_ID IN (SELECT CUSTOMER_ID FROM last_ids) THEN 0 ELSE 1 END AS INTEGER) AS CHURN
FROM earlier e JOIN lab l ON l.M_RANK = e.LR
""")
    return sql(IDENTITY + "," + LOOKBACK + """,
earlier AS (SELECT CUSTOMER_ID, max(M_RANK) AS LR FROM actv WHERE M_RANK < N_MONTHS - 1 GROUP BY CUSTOMER_ID),
t_ids AS (SELECT CUSTOMER_ID FROM actv WHERE M_RANK = N_MONTHS),
t1_ids AS (SELECT CUSTOMER_ID FROM actv WHERE M_RANK = N_MONTHS - 1),
lt AS (SELECT M_LABEL FROM months WHERE M_RANK = N_MONTHS),
lt1 AS (SELECT M_LABEL FROM months WHERE M_RANK = N_MONTHS - 1)""", """
SELECT e.CUSTOMER_ID,
       CASE WHEN e.CUSTOMER_ID IN (SELECT * FROM t_ids) AND e.CUSTOMER_ID IN (SELECT * FROM t1_ids)
              THEN (SELECT M_LABEL FROM lt1) || ' & ' || (SELECT M_LABEL FROM lt)
            WHEN e.CUSTOMER_ID IN (SELECT * FROM t_ids) THEN (SELECT M_LABEL FROM lt)
            WHEN e.CUSTOMER_ID IN (SELECT * FROM t1_ids) THEN (SELECT M_LABEL FROM lt1)
            ELSE l.M_LABEL END AS LAST_SEEN,
       CAST(CASE WHEN e.CUSTOMER_ID IN (SELECT * FROM t_ids) OR e.CUSTOMER_ID IN (SELECT * FROM t1_ids)
                 THEN 0 ELSE 1 END AS INTEGER) AS CHURN
FROM earlier e JOIN lab l ON l.M_RANK = e.LR
""")


FIRST_LAST = """
base_rows AS (SELECT RIMNO, CARD_STATUS, row_number() OVER (PARTITION BY RIMNO ORDER BY ROW_ID DESC) AS rn
              FROM primem WHERE M_RANK = 1 AND RIMNO IS NOT NULL),
ref_ids AS (SELECT DISTINCT RIMNO FROM primem WHERE M_RANK = N_MONTHS AND RIMNO IS NOT NULL),
first_last AS (SELECT b.RIMNO, b.CARD_STATUS,
                      CAST(CASE WHEN b.RIMNO IN (SELECT RIMNO FROM ref_ids) THEN 0 ELSE 1 END AS INTEGER) AS churn
               FROM base_rows b WHERE rn = 1)
"""

COMPARISON = ACTIVATION_SETS + "," + STATUS_SETS + """,
s_one AS (SELECT RIMNO, max(CHURN) AS CHURN, min(CHURN_TYPE) AS CHURN_TYPE FROM status_out GROUP BY RIMNO),
a_one AS (SELECT RIMNO, max(ACTIVATION_CHURN) AS ACTIVATION_CHURN, min(ACTIVATION_CHURN_TYPE) AS ACTIVATION_CHURN_TYPE
          FROM activation_out_alias GROUP BY RIMNO),
cmp0 AS (SELECT coalesce(s.RIMNO, a.RIMNO) AS RIMNO, s.CHURN AS C0, s.CHURN_TYPE, a.ACTIVATION_CHURN AS A0,
                a.ACTIVATION_CHURN_TYPE,
                CASE WHEN s.k IS NOT NULL AND a.k IS NOT NULL THEN 'both'
                     WHEN s.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS MERGE
         FROM (SELECT *, 1 AS k FROM s_one) s FULL OUTER JOIN (SELECT *, 1 AS k FROM a_one) a
         ON s.RIMNO IS NOT DISTINCT FROM a.RIMNO),
cmp AS (SELECT RIMNO, CAST(coalesce(C0, -1) AS INTEGER) AS CHURN, CHURN_TYPE,
               CAST(coalesce(A0, -1) AS INTEGER) AS ACTIVATION_CHURN, ACTIVATION_CHURN_TYPE, MERGE,
               coalesce(C0, -1) = coalesce(A0, -1) AS AGREE,
               CASE WHEN MERGE = 'left_only' THEN 'only_in_status_file'
                    WHEN MERGE = 'right_only' THEN 'only_in_activation_file'
                    WHEN C0 = 1 AND A0 = 1 THEN 'both_churn'
                    WHEN C0 = 0 AND A0 = 0 THEN 'both_not_churn'
                    WHEN C0 = 1 AND A0 = 0 THEN 'STATUS_churn_only'
                    WHEN C0 = 0 AND A0 = 1 THEN 'ACTIVATION_churn_only'
                    ELSE '' END AS DISAGREE_TYPE
        FROM cmp0)
""".replace("activation_out_alias", "act_out")

DISAGREE_SPINE = " UNION ALL ".join(
    f"SELECT {i + 1} AS TYPE_ORDER, '{t}' AS DISAGREE_TYPE" for i, t in enumerate(contract.DISAGREE_TYPES))

CHANGE_COLS = [c for c in PRIME_COLUMNS if c not in ("SNAP_MONTH", "ROW_ID", "RIMNO", "PRODUCT_NAME")]
_DOUBLE_COLS = {"CREDIT_LIMIT", "LEDGER_BALANCE", "AVAILABLE_LIMIT", "OVERDUEAMOUNT", "DELIQUENCY", "ANNUAL_FEE",
                "JOINING_FEE", "FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD",
                "LAST_PAYMENT_AMOUNT", "NO_OF_CYCLES"}


def _img(c: str, alias: str) -> str:
    if c in _DOUBLE_COLS:
        return f"CAST(CAST({alias}.{c} AS DECIMAL(38,6)) AS VARCHAR)"
    return f"CAST({alias}.{c} AS VARCHAR)"


def _lacking(c: str) -> str:
    """Ranks of the transitions one of whose months lacks the column, in the uneven snapshots."""
    cut = ", ".join(f"DATE '{m.isoformat()}'" for m, gone in ABSENT.items() if c in gone)
    return f"SELECT x.M_RANK + d.d FROM months x, (VALUES (0), (-1)) d(d) WHERE x.SNAP_MONTH IN ({cut})" if cut else ""


def _changes(uneven: bool) -> str:
    parts = []
    for c in CHANGE_COLS:
        cut = f" AND A_RANK NOT IN ({_lacking(c)})" if uneven and _lacking(c) else ""
        parts.append(f"SELECT RIMNO, PRODUCT_NAME, A_RANK, {c}_OLD AS OLD_VALUE, {c}_NEW AS NEW_VALUE, '{c}' AS \"COLUMN\" FROM pairs "
                     f"WHERE {c}_OLD IS DISTINCT FROM {c}_NEW{cut}")
    return _PAIRS + ",\nchanges AS (" + "\nUNION ALL ".join(parts) + ")\n"


_PAIRS = """
pairs AS (SELECT a.RIMNO, a.PRODUCT_NAME, a.M_RANK AS A_RANK, """ + ", ".join(
    f"{_img(c, 'a')} AS {c}_OLD, {_img(c, 'b')} AS {c}_NEW" for c in CHANGE_COLS) + """
          FROM primem a JOIN primem b ON b.M_RANK = a.M_RANK + 1
          AND a.RIMNO = b.RIMNO AND a.PRODUCT_NAME IS NOT DISTINCT FROM b.PRODUCT_NAME)"""
CHANGE_PAIRS = _changes(False)

CHANGE_LOG = """
SELECT c.RIMNO, c.PRODUCT_NAME, c.OLD_VALUE, c.NEW_VALUE, c."COLUMN", f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH
FROM changes c JOIN months f ON f.M_RANK = c.A_RANK JOIN months t ON t.M_RANK = c.A_RANK + 1"""
CHANGE_RATES = """
SELECT f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH, c."COLUMN", m.MATCHED_PAIRS, c.CHANGED_ROWS,
       round_even(c.CHANGED_ROWS * CAST(100 AS DOUBLE) / m.MATCHED_PAIRS, 2) AS PCT_CHANGED
FROM (SELECT A_RANK, "COLUMN", count(*) AS CHANGED_ROWS FROM changes GROUP BY 1, 2) c
JOIN (SELECT A_RANK, count(*) AS MATCHED_PAIRS FROM pairs GROUP BY 1) m USING (A_RANK)
JOIN months f ON f.M_RANK = c.A_RANK JOIN months t ON t.M_RANK = c.A_RANK + 1"""


def _without_months(ctes: str, col: str) -> str:
    """The set CTEs with the history months that lack ``col`` left out of ``primem``."""
    cut = ", ".join(f"DATE '{m.isoformat()}'" for m, gone in ABSENT.items() if col in gone)
    return ctes.replace("FROM primem ", f"FROM (SELECT * FROM primem WHERE M_RANK = N_MONTHS OR SNAP_MONTH NOT IN ({cut})) primem ").replace(
        "primem p ", "p ")


def _status_uneven() -> str:
    """A month without STATUS counts its ids as history and shows no activity."""
    cut = ", ".join(f"DATE '{m.isoformat()}'" for m, gone in ABSENT.items() if "STATUS" in gone)
    return STATUS_SETS.replace("AND NOT coalesce(STATUS IN", f"AND SNAP_MONTH NOT IN ({cut}) AND NOT coalesce(STATUS IN")


def oracle_sql() -> dict[str, str]:
    q = {}
    q["activation_lifecycle"] = sql(ACTIVATION_SETS, "SELECT * FROM act_out")
    q["status_lifecycle"] = sql(STATUS_SETS, "SELECT * FROM status_out")
    q["activation_summary"] = sql(ACTIVATION_SETS, _summary("act_out", "ACTIVATION_CHURN_TYPE", "ACTIVATION_CHURN",
                                                            contract.ACTIVATION_CLASSES))
    q["status_summary"] = sql(STATUS_SETS, _summary("status_out", "CHURN_TYPE", "CHURN", contract.STATUS_CLASSES))
    q["customer_ids"] = sql(IDENTITY, "SELECT RIMNO, DOB, CUSTOMER_ID FROM ids")
    q["active_historical"] = sql(IDENTITY, """
SELECT ROW_ID, SNAP_MONTH, RIMNO, PRODUCT_NAME, CUSTOMER_ID,
       CASE WHEN IS_HIST THEN 'historical' ELSE 'active' END AS SEGMENT FROM flagged""")
    q["relatives"] = sql(IDENTITY, """
SELECT ROW_ID, SNAP_MONTH, RIMNO, PRODUCT_NAME, DOB, CUSTOMER_ID FROM seg WHERE SEGMENT = 'relative'""")
    q["txn_mapped"] = sql(IDENTITY, "SELECT * FROM mapped WHERE CUSTOMER_ID IS NOT NULL")
    q["txn_missing"] = sql(IDENTITY, "SELECT * FROM mapped WHERE CUSTOMER_ID IS NULL")
    q["mapping_coverage"] = sql(IDENTITY, """
SELECT 'prime' AS SOURCE, count(*) AS N_ROWS, count(CUSTOMER_ID) AS N_ASSIGNED,
       count(*) - count(CUSTOMER_ID) AS N_UNMATCHED FROM seg
UNION ALL
SELECT 'txn', count(*), count(CUSTOMER_ID), count(*) - count(CUSTOMER_ID) FROM mapped""")
    q["churn_1month"] = _lookback(1)
    q["churn_2month"] = _lookback(2)
    q["churn_first_last"] = sql(FIRST_LAST, "SELECT * FROM first_last")
    q["churn_rate"] = sql(FIRST_LAST, """
SELECT count(*) AS TOTAL, CAST(sum(churn) AS BIGINT) AS CHURNED, CAST(count(*) - sum(churn) AS BIGINT) AS RETAINED,
       round(sum(churn) * CAST(100 AS DOUBLE) / count(*), 4) AS CHURN_RATE_PCT FROM first_last""")
    q["label_comparison"] = sql(COMPARISON, "SELECT * FROM cmp")
    q["agreement_stats"] = sql(COMPARISON, f"""
SELECT CAST(s.TYPE_ORDER AS INTEGER) AS TYPE_ORDER, s.DISAGREE_TYPE, CAST(coalesce(c.n, 0) AS BIGINT) AS N,
       round(coalesce(c.n, 0) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM cmp), 4) AS PCT,
       (SELECT count(*) FROM cmp WHERE MERGE = 'both') AS N_BOTH,
       (SELECT count(*) FROM cmp WHERE MERGE = 'both' AND AGREE) AS N_AGREE,
       (SELECT count(*) FROM cmp WHERE MERGE = 'both' AND NOT AGREE) AS N_DISAGREE
FROM ({DISAGREE_SPINE}) s LEFT JOIN (SELECT DISAGREE_TYPE, count(*) AS n FROM cmp GROUP BY 1) c USING (DISAGREE_TYPE)""")
    q["label_crosstab"] = sql(COMPARISON, """
SELECT coalesce(CHURN_TYPE, 'All') AS CHURN_TYPE, coalesce(ACTIVATION_CHURN_TYPE, 'All') AS ACTIVATION_CHURN_TYPE,
       count(*) AS N
FROM (SELECT coalesce(CHURN_TYPE, '(missing)') AS CHURN_TYPE,
             coalesce(ACTIVATION_CHURN_TYPE, '(missing)') AS ACTIVATION_CHURN_TYPE FROM cmp)
GROUP BY CUBE (CHURN_TYPE, ACTIVATION_CHURN_TYPE)""")
    q["disagreement_sample"] = sql(COMPARISON, """
SELECT RIMNO, CHURN, CHURN_TYPE, ACTIVATION_CHURN, ACTIVATION_CHURN_TYPE FROM cmp
WHERE MERGE = 'both' AND NOT AGREE ORDER BY RIMNO NULLS LAST LIMIT 20""")
    q["month_new_missing"] = sql("""
pres AS (SELECT DISTINCT RIMNO, M_RANK FROM primem WHERE RIMNO IS NOT NULL),
tr AS (SELECT M_RANK AS TO_RANK FROM months WHERE M_RANK > 1)""", """
SELECT (SELECT M_LABEL FROM months WHERE M_RANK = tr.TO_RANK - 1) AS FROM_MONTH,
       (SELECT M_LABEL FROM months WHERE M_RANK = tr.TO_RANK) AS TO_MONTH,
       (SELECT count(*) FROM pres WHERE M_RANK = tr.TO_RANK - 1) AS N_PREV,
       (SELECT count(*) FROM pres WHERE M_RANK = tr.TO_RANK) AS N_CURR,
       (SELECT count(*) FROM (SELECT RIMNO FROM pres WHERE M_RANK = tr.TO_RANK
                              EXCEPT SELECT RIMNO FROM pres WHERE M_RANK = tr.TO_RANK - 1)) AS N_NEW,
       (SELECT count(*) FROM (SELECT RIMNO FROM pres WHERE M_RANK = tr.TO_RANK - 1
                              EXCEPT SELECT RIMNO FROM pres WHERE M_RANK = tr.TO_RANK)) AS N_MISSING
FROM tr""")
    q["missing_reappearance"] = sql("""
pres AS (SELECT DISTINCT RIMNO, M_RANK FROM primem WHERE RIMNO IS NOT NULL),
miss AS (SELECT a.RIMNO, a.M_RANK + 1 AS TO_RANK FROM pres a
         WHERE a.M_RANK < (SELECT max(M_RANK) FROM months)
           AND NOT EXISTS (SELECT 1 FROM pres b WHERE b.RIMNO = a.RIMNO AND b.M_RANK = a.M_RANK + 1))""", """
SELECT f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH, i.M_LABEL AS IN_MONTH, count(*) AS N_IDS
FROM miss m JOIN pres o ON o.RIMNO = m.RIMNO AND o.M_RANK NOT IN (m.TO_RANK, m.TO_RANK - 1)
JOIN months f ON f.M_RANK = m.TO_RANK - 1 JOIN months t ON t.M_RANK = m.TO_RANK JOIN months i ON i.M_RANK = o.M_RANK
GROUP BY 1, 2, 3""")
    q["change_log"] = sql(CHANGE_PAIRS, CHANGE_LOG)
    q["change_rates"] = sql(CHANGE_PAIRS, CHANGE_RATES)
    q["change_log_uneven"] = sql(_changes(True), CHANGE_LOG, uneven=True)
    q["change_rates_uneven"] = sql(_changes(True), CHANGE_RATES, uneven=True)
    q["change_log_counted"] = sql(CHANGE_PAIRS, f"SELECT *, count(*) AS N_PAIRS FROM ({CHANGE_LOG}) GROUP BY ALL")
    act_uneven = _without_months(ACTIVATION_SETS, "ACTIVATED")
    q["activation_lifecycle_uneven"] = sql(act_uneven, "SELECT * FROM act_out", uneven=True)
    q["status_lifecycle_uneven"] = sql(_status_uneven(), "SELECT * FROM status_out", uneven=True)
    q["label_comparison_uneven"] = sql(COMPARISON.replace(ACTIVATION_SETS, act_uneven).replace(STATUS_SETS, _status_uneven()),
                                       "SELECT * FROM cmp", uneven=True)
    q["lifecycle_totals"] = sql(ACTIVATION_SETS + "," + STATUS_SETS, """
SELECT 'activation' AS LABELS, count(*) AS TOTAL, count(*) FILTER (WHERE ACTIVATION_CHURN = 1) AS CHURN_1,
       count(*) FILTER (WHERE ACTIVATION_CHURN = 0) AS CHURN_0 FROM act_out
UNION ALL
SELECT 'status', count(*), count(*) FILTER (WHERE CHURN = 1), count(*) FILTER (WHERE CHURN = 0) FROM status_out""")
    q["idless_report"] = sql("""
idless AS (SELECT PRODUCT_NAME, M_RANK, count(*) AS n FROM primem WHERE RIMNO IS NULL GROUP BY 1, 2),
tr AS (SELECT DISTINCT PRODUCT_NAME, M_RANK AS A_RANK FROM idless UNION SELECT PRODUCT_NAME, M_RANK - 1 FROM idless)""", """
SELECT f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH, tr.PRODUCT_NAME, coalesce(a.n, 0) AS N_OLD, coalesce(b.n, 0) AS N_NEW,
       coalesce(a.n, 0) * coalesce(b.n, 0) AS N_PAIRS
FROM tr JOIN months f ON f.M_RANK = tr.A_RANK JOIN months t ON t.M_RANK = tr.A_RANK + 1
LEFT JOIN idless a ON a.PRODUCT_NAME IS NOT DISTINCT FROM tr.PRODUCT_NAME AND a.M_RANK = tr.A_RANK
LEFT JOIN idless b ON b.PRODUCT_NAME IS NOT DISTINCT FROM tr.PRODUCT_NAME AND b.M_RANK = tr.A_RANK + 1""")
    pres = "pres AS (SELECT DISTINCT RIMNO, M_RANK FROM primem WHERE RIMNO IS NOT NULL)"
    q["presence_changes"] = sql(pres, """
SELECT f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH, x.CHANGE, x.RIMNO
FROM (SELECT RIMNO, M_RANK AS TO_RANK, 'new' AS CHANGE FROM pres WHERE M_RANK > 1 AND (RIMNO, M_RANK - 1) NOT IN (SELECT (RIMNO, M_RANK) FROM pres)
      UNION ALL
      SELECT RIMNO, M_RANK + 1, 'missing' FROM pres WHERE M_RANK < (SELECT max(M_RANK) FROM months)
        AND (RIMNO, M_RANK + 1) NOT IN (SELECT (RIMNO, M_RANK) FROM pres)) x
JOIN months t ON t.M_RANK = x.TO_RANK JOIN months f ON f.M_RANK = x.TO_RANK - 1""")
    q["reappearing_ids"] = sql(pres + """,
miss AS (SELECT a.RIMNO, a.M_RANK + 1 AS TO_RANK FROM pres a
         WHERE a.M_RANK < (SELECT max(M_RANK) FROM months)
           AND NOT EXISTS (SELECT 1 FROM pres b WHERE b.RIMNO = a.RIMNO AND b.M_RANK = a.M_RANK + 1))""", """
SELECT f.M_LABEL AS FROM_MONTH, t.M_LABEL AS TO_MONTH, i.M_LABEL AS IN_MONTH, m.RIMNO
FROM miss m JOIN pres o ON o.RIMNO = m.RIMNO AND o.M_RANK NOT IN (m.TO_RANK, m.TO_RANK - 1)
JOIN months f ON f.M_RANK = m.TO_RANK - 1 JOIN months t ON t.M_RANK = m.TO_RANK JOIN months i ON i.M_RANK = o.M_RANK""")
    for name in ("status_lifecycle", "activation_lifecycle", "churn_2month", "churn_first_last"):   # the same rows from merged months
        q[f"{name}_state"] = q[name]
    q["relatives_located"], q["txn_mapped_located"] = q["relatives"], q["txn_mapped"]
    q["csv_scan"] = sql("", """
SELECT SNAP_MONTH, ROW_ID, RIMNO, PRODUCT_NAME, ACTIVATED, STATUS, CARD_STATUS, DOB, BRANCH_NAME, BRANCH_ID, CREDIT_LIMIT, DELIQUENCY,
       CREATION_DATE, CLOSURE_DATE, ORGANIZATION, FALSE AS HAS_UNUSED FROM prime""")
    q["partitioned_sink"] = sql(IDENTITY, """
SELECT SNAP_MONTH, SEGMENT, count(*) AS N_ROWS, count(DISTINCT ROW_ID) AS N_IDS FROM seg GROUP BY 1, 2""")
    q["id_report"] = sql("""
both_ids AS (SELECT RIMNO FROM prime WHERE RIMNO IS NOT NULL INTERSECT SELECT RIMNO FROM txn WHERE RIMNO IS NOT NULL)""", """
SELECT 'common ids: ' || count(*) AS LINE FROM both_ids UNION ALL SELECT RIMNO FROM both_ids""")
    q["label_comparison_state"] = q["label_comparison_uneven"]
    q["presence_matrix"] = sql(pres + """,
span AS (SELECT RIMNO, min(M_RANK) AS f, max(M_RANK) AS l, count(*) AS n FROM pres GROUP BY 1)""", """
SELECT a.M_LABEL AS FIRST_MONTH, b.M_LABEL AS LAST_MONTH, s.n AS MONTHS_PRESENT, s.l - s.f + 1 - s.n AS GAPS, count(*) AS N_IDS
FROM span s JOIN months a ON a.M_RANK = s.f JOIN months b ON b.M_RANK = s.l GROUP BY 1, 2, 3, 4""")
    q["id_set_report"] = sql("""
p AS (SELECT DISTINCT RIMNO FROM prime WHERE RIMNO IS NOT NULL), t AS (SELECT DISTINCT RIMNO FROM txn WHERE RIMNO IS NOT NULL)""", """
SELECT CASE WHEN t.RIMNO IS NULL THEN 'prime' WHEN p.RIMNO IS NULL THEN 'txn' ELSE 'prime+txn' END AS TABLES, count(*) AS N_IDS
FROM p FULL JOIN t ON p.RIMNO = t.RIMNO GROUP BY 1""")
    q["ambiguous_keys"] = sql(IDENTITY, """
SELECT RIMNO, PRODUCT_NAME, count(*) AS N_CUSTOMER_IDS FROM lookup GROUP BY 1, 2 HAVING count(*) > 1""")
    q["txn_mapped_latest"] = sql(IDENTITY + """,
ranked AS (SELECT RIMNO, PRODUCT_NAME, CUSTOMER_ID, row_number() OVER (PARTITION BY RIMNO, PRODUCT_NAME
           ORDER BY SNAP_MONTH DESC, CUSTOMER_ID) AS rn FROM seg WHERE SEGMENT = 'active')""", """
SELECT t.TXN_ID, t.RIMNO, t.PRODUCT_NAME, l.CUSTOMER_ID FROM txn t JOIN ranked l
ON l.rn = 1 AND t.RIMNO = l.RIMNO AND t.PRODUCT_NAME IS NOT DISTINCT FROM l.PRODUCT_NAME""")
    q["common_ids_count"] = sql("", """
SELECT count(*) AS N_IDS, min(RIMNO) AS FIRST_ID, max(RIMNO) AS LAST_ID
FROM (SELECT RIMNO FROM prime WHERE RIMNO IS NOT NULL INTERSECT SELECT RIMNO FROM txn WHERE RIMNO IS NOT NULL)""")
    q["change_summary"] = sql(CHANGE_PAIRS, """
SELECT "COLUMN", count(*) AS total_changes, count(DISTINCT RIMNO) AS unique_pairs_affected,
       round_even(count(DISTINCT RIMNO) * CAST(100 AS DOUBLE)
                  / (SELECT count(*) FROM (SELECT DISTINCT RIMNO, PRODUCT_NAME FROM pairs)), 2) AS pct_pairs_affected
FROM changes GROUP BY 1""")
    q["common_ids"] = sql("", """
SELECT RIMNO FROM prime WHERE RIMNO IS NOT NULL INTERSECT SELECT RIMNO FROM txn WHERE RIMNO IS NOT NULL""")
    from cardpulse.plans import oracle_profile
    q.update(oracle_profile.oracle_sql())
    return q
