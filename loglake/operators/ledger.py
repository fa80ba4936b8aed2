"""The ledger projection over a log: balances, totals and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.operators.append import running_total

PAYLOAD = "accountId string, amount decimal(18,2), entryType string, reference string, postedAt timestamp"


def decoded(log: DataFrame, payload: str = "payload") -> DataFrame:
    """log with the fields of its JSON payload."""
    return log.withColumn("_entry", F.from_json(F.col(payload).cast("string"), PAYLOAD)).select("*", "_entry.*").drop("_entry")


def signed(amount: Column, credit: Column) -> Column:
    return F.when(credit, amount).otherwise(-amount)


def running_balance(entries: DataFrame, account: str, amount: Column, initial: DataFrame | None = None) -> DataFrame:
    """entries with balance after each, by seq_no within the account; initial: (account, initial) balances to start from."""
    out = running_total(entries, amount, "balance", keys=(account,))
    if initial is not None:
        first = initial.select(F.col(account).alias("_account"), F.col("initial"))
        out = out.join(first, F.col(account) == F.col("_account"), "left").withColumn("balance", F.col("balance") + F.coalesce("initial", F.lit(0))).drop("_account", "initial")
    return out


def reconciliation(entries: DataFrame, amount: str, credit: Column) -> DataFrame:
    """Credits, debits and net of all entries."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).cast("long")
    return entries.agg(total(credit).alias("credits"), total(~credit).alias("debits")).withColumn("net", F.col("credits") - F.col("debits"))


def resumed(entries: DataFrame, account: str, amount: Column, after: int) -> DataFrame:
    """The entries past `after`, with balances carried on from those before: one pass sums up, one runs on."""
    before = entries.where(F.col("seq_no") <= after).groupBy(account).agg(F.sum(amount).alias("initial"))
    return running_balance(entries.where(F.col("seq_no") > after), account, amount, before)
