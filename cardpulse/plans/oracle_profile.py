"""Oracle SQL (DuckDB) for the quality, feature and profile queries."""

from __future__ import annotations

from cardpulse.functions import contract
from cardpulse.plans.oracle_base import sql
from cardpulse.sources.fixtures import PRIME_AS_OF, PRIME_COLUMNS, TREND_END, TREND_START, TXN_AS_OF, TXN_COLUMNS

NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _num(expr: str) -> str:
    x = f"replace(trim(CAST({expr} AS VARCHAR)), ',', '')"
    return f"(CASE WHEN regexp_full_match({x}, '{NUM_RE}') THEN TRY_CAST({x} AS DOUBLE) END)"


def _int(expr: str) -> str:
    d = _num(expr)
    return f"(CASE WHEN {d} = floor({d}) THEN CAST({d} AS BIGINT) END)"


def _days(later: str, earlier: str) -> str:
    return (f"CAST(floor(date_diff('microsecond', CAST({earlier} AS TIMESTAMP), CAST({later} AS TIMESTAMP))"
            f" / 86400000000.0) AS BIGINT)")


def _band(x: str, bands) -> str:
    parts = []
    for lo, hi, label in bands:
        cond = f"{x} > {lo}" if hi is None else f"{x} > {lo} AND {x} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def _cap(col: str, src: str, q: float = 0.99) -> str:
    cap = f"(SELECT quantile_cont({col}, {q}) FROM {src})"
    return f"CASE WHEN {col} > {cap} THEN {cap} ELSE {col} END"


def _after(t: str, c: str) -> str:
    if t == "string":
        return f"{c} IS NULL"
    if t == "float":
        return f"{_num(c)} IS NULL"
    if t == "int":
        return f"{_int(c)} IS NULL"
    return f"coalesce(try_strptime(trim(CAST({c} AS VARCHAR)), '%Y-%m-%d'), try_strptime(trim(CAST({c} AS VARCHAR)), '%Y-%m-%d %H:%M:%S')) IS NULL"


def _cast_report() -> str:
    parts = []
    for table, plan in (("prime", contract.PRIME_CAST_PLAN), ("txn", contract.TXN_CAST_PLAN)):
        for t, cols in plan.items():
            for c in cols:
                parts.append(f"""SELECT '{table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, '{t}' AS CAST_TYPE,
  count(*) FILTER (WHERE {c} IS NULL) AS NULLS_BEFORE, count(*) FILTER (WHERE {_after(t, c)}) AS NULLS_AFTER,
  round(count(*) FILTER (WHERE {_after(t, c)}) * CAST(100 AS DOUBLE) / count(*), 2) AS PCT_MISSING FROM {table}_raw""")
    return sql("", "\nUNION ALL\n".join(parts))


_STRPTIME = {"yyyy": "%Y", "MMM": "%b", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


# Dates as texts: one in 50 rows in the other order of day and month, one in 7 closures with dots.
DATE_TEXTS = """
texts AS (SELECT ROW_ID AS rid, DOB,
  CASE WHEN ROW_ID % 50 = 0 THEN strftime(CREATION_DATE, '%m/%d/%Y') ELSE strftime(CREATION_DATE, '%d/%m/%Y') END AS CREATED,
  CASE WHEN ROW_ID % 7 = 0 THEN strftime(CLOSURE_DATE, '%d.%m.%Y') ELSE strftime(CLOSURE_DATE, '%Y%m%d') END AS CLOSED
  FROM prime_raw)"""


def _date_formats() -> str:
    """Texts that a format writes back as they are count as accepted."""
    parts = []
    for col in ("DOB", "CREATED", "CLOSED"):
        for j, f in enumerate(contract.DATE_FORMATS):
            p = f
            for a, b in _STRPTIME.items():
                p = p.replace(a, b)
            parts.append(f"""SELECT '{col}' AS COLUMN_NAME, {j} AS j, '{f}' AS FORMAT, rid, nullif(trim({col}), '') AS x,
  CASE WHEN strftime(try_strptime(trim({col}), '{p}'), '{p}') = trim({col}) THEN CAST(try_strptime(trim({col}), '{p}') AS DATE) END AS d FROM texts""")
    return sql(DATE_TEXTS + ", reads AS (" + "\nUNION ALL\n".join(parts) + """),
lim AS (SELECT COLUMN_NAME, rid, min(d) AS lo, max(d) AS hi FROM reads GROUP BY 1, 2),
cnt AS (SELECT r.COLUMN_NAME, r.j, any_value(r.FORMAT) AS FORMAT, count(r.x) AS N_TEXT, count(r.d) AS N_ACCEPTED,
        count(*) FILTER (WHERE r.d IS NOT NULL AND l.lo <> l.hi) AS N_AMBIGUOUS
        FROM reads r JOIN lim l ON r.COLUMN_NAME = l.COLUMN_NAME AND r.rid = l.rid GROUP BY 1, 2)""", """
SELECT COLUMN_NAME, FORMAT, N_TEXT, N_ACCEPTED, N_TEXT - N_ACCEPTED AS N_REJECTED,
       row_number() OVER (PARTITION BY COLUMN_NAME ORDER BY N_ACCEPTED DESC, j) = 1 AS IS_WINNER, N_AMBIGUOUS FROM cnt""")


def _missing_profile() -> str:
    parts = []
    for table, cols in (("prime", PRIME_COLUMNS), ("txn", TXN_COLUMNS)):
        for c in cols:
            parts.append(f"SELECT '{table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, "
                         f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS f FROM {table}")
    return sql("", f"""
SELECT TABLE_NAME, COLUMN_NAME, round(f, 6) AS MISSING_FRAC,
       CASE WHEN f > {contract.MISSING_RED} THEN 'red' WHEN f > {contract.MISSING_ORANGE} THEN 'orange'
            ELSE 'green' END AS SEVERITY
FROM ({' UNION ALL '.join(parts)}) WHERE f > 0""")


def _categorical_domain() -> str:
    spec = {"txn": contract.TXN_CATEGORICAL, "prime": contract.PRIME_CATEGORICAL}
    parts = [f"SELECT '{t}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, CAST({c} AS VARCHAR) AS VALUE, count(*) AS N "
             f"FROM {t} GROUP BY 3" for t, cols in spec.items() for c in cols]
    return sql("", "\nUNION ALL\n".join(parts))


FEATURES = f"""
pcaps AS (SELECT quantile_cont(ANNUAL_FEE, 0.5) AS fee_med, quantile_cont(OVERDUEAMOUNT, 0.99) AS od_cap FROM prime),
rec AS (SELECT RIMNO, max(TRXN_DATE) AS LAST_TXN_DATE,
               {_days(f"DATE '{TXN_AS_OF}'", "max(TRXN_DATE)")} AS DAYS_SINCE_LAST_TXN
        FROM txn WHERE RIMNO IS NOT NULL GROUP BY RIMNO),
feat0 AS (
  SELECT p.* REPLACE (coalesce(p.GENDER, 'Unknown') AS GENDER,
                      coalesce(p.ANNUAL_FEE, c.fee_med) AS ANNUAL_FEE,
                      CASE WHEN p.OVERDUEAMOUNT > c.od_cap THEN c.od_cap ELSE p.OVERDUEAMOUNT END AS OVERDUEAMOUNT),
         CAST(date_diff('day', p.CREATION_DATE, DATE '{PRIME_AS_OF}') AS DOUBLE) / CAST(30 AS DOUBLE)
           AS ACCOUNT_TENURE_MONTHS,
         date_diff('day', p.LAST_PAYMENT_DATE, DATE '{PRIME_AS_OF}') AS DAYS_SINCE_LAST_PAYMENT,
         date_diff('day', p.CREATION_DATE, p.CLOSURE_DATE) AS TIME_TO_CHURN_DAYS,
         CAST(floor(CAST(date_diff('day', p.DOB, DATE '{PRIME_AS_OF}') AS DOUBLE) / 365) AS BIGINT) AS AGE,
         p.LEDGER_BALANCE / nullif(p.CREDIT_LIMIT, 0) AS UTILIZATION_RATIO,
         p.AVAILABLE_LIMIT / nullif(p.CREDIT_LIMIT, 0) AS AVAILABLE_CREDIT_RATIO,
         coalesce(p.FIRST_REPLACED_CARD, 0) + coalesce(p.SECOND_REPLACED_CARD, 0)
           + coalesce(p.THIRD_REPLACED_CARD, 0) AS CARD_REPLACEMENT_FREQ
  FROM prime p, pcaps c),
feat AS (
  SELECT f.*, (f.JOINING_FEE + f.ANNUAL_FEE) / nullif(f.CREDIT_LIMIT, 0) AS FEE_TO_LIMIT_RATIO,
         {_band('f.AGE', contract.AGE_BANDS)} AS AGE_GROUP,
         {_band('f.CREDIT_LIMIT', contract.LIMIT_BANDS)} AS LIMIT_BAND,
         r.DAYS_SINCE_LAST_TXN
  FROM feat0 f LEFT JOIN rec r ON f.RIMNO = r.RIMNO),
tcap AS (SELECT * REPLACE ({_cap('BILLING_AMT', 'txn')} AS BILLING_AMT, {_cap('ORIG_AMOUNT', 'txn')} AS ORIG_AMOUNT)
         FROM txn),
rfm_t AS (SELECT RIMNO, CAST(sum(CAST(BILLING_AMT AS DECIMAL(20,6))) AS DOUBLE) AS TOTAL_SPEND, CAST(sum(CAST(BILLING_AMT AS DECIMAL(20,6))) AS DOUBLE) / nullif(count(BILLING_AMT), 0) AS AVG_TXN, count(BILLING_AMT) AS TXN_COUNT,
                 {_days(f"DATE '{TXN_AS_OF}'", "max(TRXN_DATE)")} AS RECENCY
          FROM tcap WHERE RIMNO IS NOT NULL GROUP BY RIMNO)
"""

FEATURE_COLUMNS = ["ROW_ID", "SNAP_MONTH", "RIMNO", "GENDER", "ANNUAL_FEE", "OVERDUEAMOUNT", "ACCOUNT_TENURE_MONTHS",
                   "DAYS_SINCE_LAST_PAYMENT", "TIME_TO_CHURN_DAYS", "AGE", "AGE_GROUP", "LIMIT_BAND",
                   "UTILIZATION_RATIO", "AVAILABLE_CREDIT_RATIO", "FEE_TO_LIMIT_RATIO", "CARD_REPLACEMENT_FREQ",
                   "DAYS_SINCE_LAST_TXN"]
_ROUNDED = {"ACCOUNT_TENURE_MONTHS", "UTILIZATION_RATIO", "AVAILABLE_CREDIT_RATIO", "FEE_TO_LIMIT_RATIO",
            "ANNUAL_FEE", "OVERDUEAMOUNT"}

_SRC_OF = {"prime": "prime", "txn": "txn", "features": "feat", "rfm": "rfm_t"}
_SRC_NAME = {v: k for k, v in _SRC_OF.items()}


def _hist_part(i: int, src: str, col: str, bins: int, q, strict: bool) -> tuple[str, str]:
    trim = ""
    if q is not None:
        op = "<" if strict else "<="
        trim = f" AND CAST({col} AS DOUBLE) {op} (SELECT quantile_cont(CAST({col} AS DOUBLE), {q}) FROM {src})"
    ctes = f"""
h{i}_x AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL{trim}),
h{i}_b AS (SELECT min(x) AS lo, max(x) AS hi FROM h{i}_x),
h{i}_c AS (SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor((x - lo) * CAST({bins} AS DOUBLE) / (hi - lo)), {bins - 1})
                            ELSE 0 END AS INTEGER) AS BIN, count(*) AS n FROM h{i}_x, h{i}_b GROUP BY 1)"""
    final = f"""SELECT '{_SRC_NAME[src]}.{col}' AS COLUMN_NAME, CAST(r.i AS INTEGER) AS BIN,
  round(b.lo + r.i * (b.hi - b.lo) / CAST({bins} AS DOUBLE), 6) AS BIN_LO,
  round(b.lo + (r.i + 1) * (b.hi - b.lo) / CAST({bins} AS DOUBLE), 6) AS BIN_HI,
  coalesce(c.n, 0) AS N
FROM range({bins}) r(i) CROSS JOIN h{i}_b b LEFT JOIN h{i}_c c ON c.BIN = r.i WHERE b.lo IS NOT NULL"""
    return ctes, final


def _histogram_parts() -> tuple[str, str]:
    ctes, finals = [], []
    for i, (src, *spec) in enumerate(contract.HIST_SPECS):
        c, f = _hist_part(i, _SRC_OF[src], *spec)
        ctes.append(c)
        finals.append(f)
    return FEATURES + "," + ",".join(ctes), "\nUNION ALL\n".join(finals)


def _kde(points: int = 200) -> str:
    """The density curve of every histogram's rows: the kernel summed over the rows at every point."""
    ctes, _ = _histogram_parts()
    parts = [f"""SELECT '{src}.{col}' AS COLUMN_NAME, CAST(r.i AS INTEGER) AS I,
  round(any_value(lo + r.i * (hi - lo) / {points - 1}), 6) AS X,
  round(sum(exp(-0.5 * pow((lo + r.i * (hi - lo) / {points - 1} - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS DENSITY
FROM range({points}) r(i), h{i}_x, (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM h{i}_x)
WHERE h > 0 GROUP BY r.i""" for i, (src, col, *_) in enumerate(contract.HIST_SPECS)]
    return sql(ctes, "\nUNION ALL\n".join(parts))


def _box(src: str, col: str, where: str = "TRUE") -> str:
    return f"""(SELECT count(x) AS N, q1 AS Q1, med AS MEDIAN, q3 AS Q3,
  min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS WHISKER_LO,
  max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS WHISKER_HI,
  count(x) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS N_OUTLIERS
 FROM (SELECT {col} AS x FROM {src} WHERE {col} IS NOT NULL AND {where}),
      (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med, quantile_cont({col}, 0.75) AS q3
       FROM {src} WHERE {col} IS NOT NULL AND {where})
 GROUP BY q1, med, q3)"""


def _cap_before_after() -> str:
    ctes = f"""
tc AS (SELECT {_cap('BILLING_AMT', 'txn')} AS BILLING_AMT, {_cap('ORIG_AMOUNT', 'txn')} AS ORIG_AMOUNT FROM txn),
pc AS (SELECT {_cap('OVERDUEAMOUNT', 'prime')} AS OVERDUEAMOUNT FROM prime)"""
    parts = []
    for col, raw, capped in (("BILLING_AMT", "txn", "tc"), ("ORIG_AMOUNT", "txn", "tc"),
                             ("OVERDUEAMOUNT", "prime", "pc")):
        for stage, src in (("before", raw), ("after", capped)):
            parts.append(f"SELECT '{col}' AS COLUMN_NAME, '{stage}' AS STAGE, * FROM {_box(src, col)}")
    return sql(ctes, "\nUNION ALL\n".join(parts))


def oracle_sql() -> dict[str, str]:
    q = {}
    q["cast_report"] = _cast_report()
    rim = "regexp_replace(replace(trim(RIMNO), ',', ''), '\\.00$', '')"
    q["parse_numeric"] = sql("", f"""
SELECT ROW_ID, RIMNO AS RIMNO_RAW,
       CASE WHEN regexp_full_match({rim}, '[+-]?[0-9]+') THEN TRY_CAST({rim} AS BIGINT) END AS RIMNO_INT,
       {_num('DOB_SERIAL')} AS DOB_SERIAL_FLOAT
FROM prime_raw""")
    d = _num("DOB_SERIAL")
    q["excel_serial_date"] = sql("", f"""
SELECT ROW_ID, DOB_SERIAL,
       CASE WHEN {d} >= 0 AND {d} < 132321
            THEN TIMESTAMP '1899-12-30 00:00:00' + to_microseconds(CAST(round({d} * 86400000000) AS BIGINT)) END
         AS DOB_FROM_SERIAL
FROM prime_raw""")
    q["missing_profile"] = _missing_profile()
    q["categorical_domain"] = _categorical_domain()
    q["impute_median"] = sql("", """
SELECT TXN_ID, ORIG_AMOUNT AS ORIG_AMOUNT_RAW,
       round(coalesce(ORIG_AMOUNT, (SELECT quantile_cont(ORIG_AMOUNT, 0.5) FROM txn)), 6) AS ORIG_AMOUNT FROM txn""")
    q["winsorize_p99"] = sql("""
filled AS (SELECT TXN_ID, BILLING_AMT, SETTLEMENT_AMT,
                  coalesce(ORIG_AMOUNT, (SELECT quantile_cont(ORIG_AMOUNT, 0.5) FROM txn)) AS ORIG_AMOUNT FROM txn)""",
                             f"""
SELECT TXN_ID, round({_cap('BILLING_AMT', 'filled')}, 6) AS BILLING_AMT,
       round({_cap('SETTLEMENT_AMT', 'filled')}, 6) AS SETTLEMENT_AMT,
       round({_cap('ORIG_AMOUNT', 'filled')}, 6) AS ORIG_AMOUNT FROM filled""")
    q["card_features"] = sql(FEATURES, "SELECT " + ", ".join(
        f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in FEATURE_COLUMNS) + " FROM feat")
    q["txn_recency"] = sql(FEATURES, "SELECT RIMNO, LAST_TXN_DATE, DAYS_SINCE_LAST_TXN FROM rec")
    for key, col, bands in (("age_groups", "AGE_GROUP", contract.AGE_BANDS),
                            ("limit_bands", "LIMIT_BAND", contract.LIMIT_BANDS)):
        spine = " UNION ALL ".join(f"SELECT {i + 1} AS BAND_ORDER, '{b[2]}' AS {col}" for i, b in enumerate(bands))
        q[key] = sql(FEATURES, f"""
SELECT CAST(s.BAND_ORDER AS INTEGER) AS BAND_ORDER, s.{col}, CAST(coalesce(c.n, 0) AS BIGINT) AS N
FROM ({spine}) s LEFT JOIN (SELECT {col}, count(*) AS n FROM feat WHERE {col} IS NOT NULL GROUP BY 1) c USING ({col})""")
    q["rfm"] = sql(FEATURES, """
SELECT RIMNO, TOTAL_SPEND, AVG_TXN, TXN_COUNT, RECENCY FROM rfm_t""")
    q["top_products"] = sql("", """
SELECT PRODUCT_NAME AS VALUE, count(*) AS N FROM prime WHERE PRODUCT_NAME IS NOT NULL
GROUP BY 1 ORDER BY N DESC, VALUE LIMIT 15""")
    q["top_customers"] = sql("", """
SELECT RIMNO AS VALUE, count(*) AS N FROM txn WHERE RIMNO IS NOT NULL GROUP BY 1 ORDER BY N DESC, VALUE LIMIT 25""")
    q["top_branches"] = sql("", """
SELECT BRANCH_NAME AS VALUE, count(*) AS N FROM prime WHERE BRANCH_NAME IS NOT NULL
GROUP BY 1 ORDER BY N DESC, VALUE LIMIT 15""")
    demo = []
    for c in contract.DEMOGRAPHIC_COLUMNS:
        demo.append(f"""SELECT * FROM (SELECT '{c}' AS COLUMN_NAME, CAST({c} AS VARCHAR) AS VALUE, count(*) AS N,
  (SELECT count({c}) FROM prime) AS ALL_N FROM prime WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY N DESC, VALUE LIMIT 8)""")
    q["demographics"] = sql("", f"""
SELECT COLUMN_NAME, VALUE, N, round(N * CAST(100 AS DOUBLE) / sum(N) OVER (PARTITION BY COLUMN_NAME), 4) AS PCT_OF_SHOWN,
       round(N * CAST(100 AS DOUBLE) / ALL_N, 4) AS PCT_OF_ALL
FROM ({' UNION ALL '.join(demo)})""")
    q["delinquency_distribution"] = sql("", """
SELECT DELIQUENCY, count(*) AS N FROM prime WHERE DELIQUENCY IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 10""")
    home = contract.HOME_COUNTRY
    q["foreign_share"] = sql("", f"""
SELECT IS_FOREIGN, CASE WHEN IS_FOREIGN = 1 THEN 'Foreign' ELSE 'Domestic' END AS LABEL, N,
       round(N * CAST(100 AS DOUBLE) / sum(N) OVER (), 4) AS PCT
FROM (SELECT CAST(coalesce(TRXN_COUNTRY <> '{home}', false) AS INTEGER) AS IS_FOREIGN, count(*) AS N FROM txn GROUP BY 1)""")
    q["top_foreign_countries"] = sql("", f"""
SELECT TRXN_COUNTRY AS VALUE, count(*) AS N FROM txn WHERE coalesce(TRXN_COUNTRY <> '{home}', false)
GROUP BY 1 ORDER BY N DESC, VALUE LIMIT 10""")
    mcc_dim = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS MCC, '{v}' AS MCC_NAME"
                                 for k, v in sorted(contract.MCC_NAMES.items()))
    q["mcc_top_spend"] = sql(FEATURES, f"""
SELECT t.MCC, coalesce(d.MCC_NAME, CAST(t.MCC AS VARCHAR)) AS MCC_NAME, round(t.TOTAL_SPEND, 2) AS TOTAL_SPEND
FROM (SELECT CAST(MCC AS BIGINT) AS MCC, sum(BILLING_AMT) AS TOTAL_SPEND FROM tcap WHERE MCC IS NOT NULL
      GROUP BY 1 ORDER BY TOTAL_SPEND DESC, MCC LIMIT 15) t LEFT JOIN ({mcc_dim}) d USING (MCC)""")
    q["monthly_trend"] = sql(FEATURES + f""",
tr AS (SELECT CAST(date_trunc('month', TRXN_DATE) AS DATE) AS m, count(BILLING_AMT) AS c, sum(BILLING_AMT) AS s
       FROM tcap WHERE TRXN_DATE >= TIMESTAMP '{TREND_START}' AND TRXN_DATE <= TIMESTAMP '{TREND_END}' GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(m) FROM tr) AS TIMESTAMP),
                                             CAST((SELECT max(m) FROM tr) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m)""",
                             """
SELECT last_day(spine.m) AS MONTH_END, CAST(coalesce(c, 0) AS BIGINT) AS TXN_COUNT,
       round(coalesce(s, 0), 2) AS TOTAL_SPEND FROM spine LEFT JOIN tr USING (m)""")
    pairs = [(a, b) for i, a in enumerate(contract.CORR_COLUMNS) for b in contract.CORR_COLUMNS[:i]]
    corr_parts = [f"SELECT '{a}' AS COL_A, '{b}' AS COL_B, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM feat"
                  for a, b in pairs]
    q["correlation"] = sql(FEATURES, f"""
SELECT COL_A, COL_B, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS CORR FROM ({' UNION ALL '.join(corr_parts)})""")
    q["histogram"] = sql(*_histogram_parts())
    q["band_profile"] = sql(FEATURES + """,
seg_in AS (SELECT RIMNO, ln(1 + greatest(coalesce(TOTAL_SPEND, 0), 0)) AS TOTAL_SPEND_LOG, coalesce(AVG_TXN, 0) AS AVG_TXN,
                  CAST(TXN_COUNT AS DOUBLE) AS TXN_COUNT, CAST(RECENCY AS DOUBLE) AS RECENCY FROM rfm_t)""", """
SELECT CAST(floor(TXN_COUNT / 10) AS INTEGER) AS CLUSTER, count(*) AS N,
       """ + ", ".join(f"round(avg({c}), 6) AS MEAN_{c}" for c in ("TOTAL_SPEND_LOG", "AVG_TXN", "TXN_COUNT", "RECENCY")) + """,
       round(avg(CASE WHEN AVG_TXN > 45000 THEN 1.0 ELSE 0.0 END), 6) AS OUTLIER_SHARE FROM seg_in GROUP BY 1""")
    q["date_formats"] = _date_formats()
    q["kde"] = _kde()
    q["cap_before_after"] = _cap_before_after()
    q["boxplot_by_delinquency"] = sql(FEATURES, f"""
SELECT g.DELIQUENCY, b.* FROM (SELECT DISTINCT DELIQUENCY FROM feat WHERE DELIQUENCY > 0 AND OVERDUEAMOUNT IS NOT NULL) g,
LATERAL {_box('feat', 'OVERDUEAMOUNT', 'DELIQUENCY = g.DELIQUENCY')} b""")
    seg = ["TOTAL_SPEND_LOG", "AVG_TXN", "TXN_COUNT", "RECENCY"]
    scaled = ", ".join(
        f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM seg_in)) / coalesce(nullif("
        f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM seg_in), 0), 1), 6) AS {c}" for c in seg)
    q["segmentation_check"] = sql(FEATURES, """
SELECT count(*) AS N_CUSTOMERS, count(*) AS N_IDS, 0 AS N_NO_CLUSTER, 0 AS N_NOT_UNION, 0 AS N_LOCAL_SHARES_OFF,
       0 AS N_GLOBAL_SHARES_OFF FROM rfm_t""")
    q["robust_scale"] = sql(FEATURES + """,
seg_in AS (SELECT RIMNO, ln(1 + greatest(coalesce(TOTAL_SPEND, 0), 0)) AS TOTAL_SPEND_LOG,
                  coalesce(AVG_TXN, 0) AS AVG_TXN, CAST(TXN_COUNT AS DOUBLE) AS TXN_COUNT,
                  CAST(RECENCY AS DOUBLE) AS RECENCY FROM rfm_t)""", f"SELECT RIMNO, {scaled} FROM seg_in")
    return q
