"""Prime and transaction inputs derived from the driver's TPC-H-style tables.

The SQL text is shared verbatim by Spark (tables bound as DataFrame parameters of
``spark.sql``, so no session-global views are created) and by the DuckDB oracle
(plain table names).  Both produce the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.functions import norm
from cardpulse.session import scratch_path

PRIME_SQL = """
select
 case when year(o_orderdate) <= 2000 then make_date(2025, cast(year(o_orderdate) as int) - 1988, 1) else make_date(2026, 1, 1) end as SNAP_MONTH,
 o_orderkey as ROW_ID,
 case when o_orderkey % 211 = 0 then null
      when o_orderkey % 5 = 0 and o_custkey >= 1000 then concat(cast(cast(floor(o_custkey / 1000) as bigint) as string), ',', lpad(cast(o_custkey % 1000 as string), 3, '0'))
      when o_orderkey % 7 = 0 then concat(' ', cast(o_custkey as string), ' ')
      else cast(o_custkey as string) end as RIMNO,
 concat('CARD_', cast(o_orderkey % 3 as string)) as PRODUCT_NAME,
 case when o_orderkey % 97 = 0 then null when o_orderstatus = 'F' then 'A' when o_orderstatus = 'O' then 'i ' else 'D' end as ACTIVATED,
 case o_orderpriority when '1-URGENT' then 'NORM' when '2-HIGH' then 'CLSB' when '3-MEDIUM' then ' expd' when '4-NOT SPECIFIED' then 'LOST' else 'BLCK' end as STATUS,
 case when o_orderkey % 4 = 0 then 'NORM' when o_orderkey % 4 = 1 then 'CLSC' when o_orderkey % 4 = 2 then 'SUSP' else 'NORM' end as CARD_STATUS,
 case when o_orderkey % 89 = 0 then null when o_orderkey % 101 = 0 then 'n/a'
      when o_orderkey % 13 = 0 then cast(make_date(cast(1985 + o_custkey % 20 as int), 6, 15) as string)
      else cast(make_date(cast(1950 + o_custkey % 35 as int), cast(1 + o_custkey % 12 as int), cast(1 + o_custkey % 28 as int)) as string) end as DOB,
 case when o_orderkey % 103 = 0 then 'x' else cast((o_orderkey * 37) % 60000 - 500 as string) end as DOB_SERIAL,
 case when o_orderkey % 17 = 0 then null when o_custkey % 2 = 0 then 'M' else 'F' end as GENDER,
 c_mktsegment as CUSTOMER_TYPE, n_name as BRANCH_NAME,
 case when o_orderkey % 53 = 0 then 0.0 else o_totalprice end as CREDIT_LIMIT,
 c_acctbal as LEDGER_BALANCE, o_totalprice - c_acctbal as AVAILABLE_LIMIT,
 case when o_orderkey % 6 = 0 then o_totalprice * 0.1 else 0.0 end as OVERDUEAMOUNT,
 cast(o_orderkey % 6 as double) as DELIQUENCY,
 case when o_orderkey % 19 = 0 then null else cast(100 * (o_orderkey % 4) as double) end as ANNUAL_FEE,
 cast(50 * (o_orderkey % 3) as double) as JOINING_FEE,
 case when o_orderkey % 10 = 0 then cast(1 as double) end as FIRST_REPLACED_CARD,
 case when o_orderkey % 20 = 0 then cast(1 as double) end as SECOND_REPLACED_CARD,
 cast(null as double) as THIRD_REPLACED_CARD,
 cast(o_orderdate as date) as CREATION_DATE,
 case when o_orderkey % 9 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 200 as int) end as LAST_PAYMENT_DATE,
 case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 900 as int) end as CLOSURE_DATE,
 case when o_orderkey % 9 = 0 then null else o_totalprice * 0.05 end as LAST_PAYMENT_AMOUNT,
 cast(o_orderkey % 13 as double) as NO_OF_CYCLES,
 case o_orderpriority when '1-URGENT' then 'Normal' when '2-HIGH' then 'Closed' when '3-MEDIUM' then 'Expired' when '4-NOT SPECIFIED' then 'Lost' else 'Blocked' end as STATUS_NAME,
 cast(c_nationkey as bigint) as BRANCH_ID, concat('ORG_', cast(o_custkey % 5 as string)) as ORGANIZATION,
 cast(o_orderdate as date) + cast(o_orderkey % 45 as int) as LAST_STATEMENT_DATE
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

TXN_SQL = """
select l_orderkey * 10 + l_linenumber as TXN_ID,
 case when l_orderkey % 211 = 0 then null else cast(o_custkey + case when l_orderkey % 23 = 0 then 1000000 else 0 end as string) end as RIMNO,
 concat(' CARD_', cast(l_partkey % 3 as string)) as DESCRIPTION,
 l_shipdate as TRXN_DATE, cast(l_shipdate as date) + 2 as POST_DATE,
 case when l_partkey % 31 = 0 then null else l_extendedprice end as ORIG_AMOUNT,
 l_extendedprice * (1 - l_discount) as BILLING_AMT, l_extendedprice * l_tax as SETTLEMENT_AMT,
 case l_partkey % 5 when 0 then 5411 when 1 then 5541 when 2 then 6011 when 3 then 4814 else 7000 + l_suppkey % 20 end as MCC,
 case when l_partkey % 41 = 0 then null when s_nationkey % 3 <> 0 then 'EGYPT' else n_name end as TRXN_COUNTRY,
 l_returnflag as REVERSAL_FLAG, s_name as MERCHNAME, 818 as CCY,
 concat('M', cast(l_suppkey as string)) as MERCH_ID, l_linestatus as SOURCES, concat('BR', cast(l_suppkey % 7 as string)) as BANKBRANCH,
 case when l_linenumber % 2 = 0 then 818 else 840 end as SETTLEMENT_CCY, l_extendedprice * 0.01 as EMBEDDED_FEE
from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
"""

# Reference dates of the fixture data (prime snapshots end JAN 2026; transactions
# are dated 1995-2001) and the monthly-trend window that fits the data.
PRIME_AS_OF = "2026-02-01"
TXN_AS_OF = "2002-01-01"
TREND_START = "2000-01-01"
TREND_END = "2001-03-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}
FEW_ROWS = 1 << 22


def _derived(spark: SparkSession, sf_dir: str, name: str, text: str, tables: list[str]) -> DataFrame:
    """The input that ``text`` derives from whole driver tables, written once in a session for all queries on the
    folder (as a Parquet table in the shared scratch folder, so scans of it are pruned as usual).

    Rows are written as the last join leaves them, without a shuffle of their own; only a table of few rows, which may
    come from fewer tasks than there are cores, is dealt out over the cores.  ``tables`` begins with the one that has a
    row for each row of the input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        df = spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})
        path = scratch_path(spark)
        few = table(spark, sf_dir, tables[0]).count() < FEW_ROWS                      # from the files' footers
        (df.repartition(spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
        _DERIVED[key] = spark.read.schema(df.schema).parquet(path)
    return _DERIVED[key]


def prime_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "prime", PRIME_SQL, ["orders", "customer", "nation"])


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "txn", TXN_SQL, ["lineitem", "orders", "supplier", "nation"])


def clean_prime(raw: DataFrame) -> DataFrame:
    """Typed, normalised prime: canonical ids, trimmed upper-case codes, parsed DOB."""
    return raw.withColumns({
        "RIMNO": norm.norm_id("RIMNO"),
        "PRODUCT_NAME": norm.strip("PRODUCT_NAME"),
        "ACTIVATED": norm.norm_code("ACTIVATED"),
        "STATUS": norm.norm_code("STATUS"),
        "CARD_STATUS": norm.norm_code("CARD_STATUS"),
        "DOB": norm.parse_date("DOB"),
    })


def clean_txn(raw: DataFrame) -> DataFrame:
    return (raw.withColumn("RIMNO", norm.norm_id("RIMNO"))
               .withColumn("DESCRIPTION", norm.strip("DESCRIPTION"))
               .withColumnRenamed("DESCRIPTION", "PRODUCT_NAME"))


def prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_prime(prime_raw(spark, sf_dir))


# Months whose file lacks columns, in the uneven variant of the snapshots.
ABSENT = {dt.date(2025, 7, 1): {"ACTIVATED"}, dt.date(2025, 8, 1): {"ACTIVATED", "GENDER"}, dt.date(2025, 9, 1): {"ACTIVATED"},
          dt.date(2025, 10, 1): {"STATUS"}, dt.date(2025, 11, 1): {"CREDIT_LIMIT"}, dt.date(2025, 12, 1): {"STATUS"}}


def prime_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots as a reader of unlike files returns them: null in every row of a month that lacks a column."""
    out = prime(spark, sf_dir)
    for c in sorted(set().union(*ABSENT.values())):
        out = out.withColumn(c, F.when(~F.col("SNAP_MONTH").isin([m for m, gone in ABSENT.items() if c in gone]), F.col(c)))
    return out


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_txn(txn_raw(spark, sf_dir))


PRIME_COLUMNS = ["SNAP_MONTH", "ROW_ID", "RIMNO", "PRODUCT_NAME", "ACTIVATED", "STATUS", "CARD_STATUS", "DOB",
                 "DOB_SERIAL", "GENDER", "CUSTOMER_TYPE", "BRANCH_NAME", "CREDIT_LIMIT", "LEDGER_BALANCE",
                 "AVAILABLE_LIMIT", "OVERDUEAMOUNT", "DELIQUENCY", "ANNUAL_FEE", "JOINING_FEE",
                 "FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD", "CREATION_DATE",
                 "LAST_PAYMENT_DATE", "CLOSURE_DATE", "LAST_PAYMENT_AMOUNT", "NO_OF_CYCLES", "STATUS_NAME", "BRANCH_ID",
                 "ORGANIZATION", "LAST_STATEMENT_DATE"]
TXN_COLUMNS = ["TXN_ID", "RIMNO", "PRODUCT_NAME", "TRXN_DATE", "POST_DATE", "ORIG_AMOUNT", "BILLING_AMT",
               "SETTLEMENT_AMT", "MCC", "TRXN_COUNTRY", "REVERSAL_FLAG", "MERCHNAME", "CCY", "MERCH_ID", "SOURCES", "BANKBRANCH",
               "SETTLEMENT_CCY", "EMBEDDED_FEE"]

