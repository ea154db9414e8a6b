"""Bank exports: CSV of known and unknown layouts, OFX, and the import that skips what is already there."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dates import parse_bank_date
from ..functions.quantities import parse_bank_amount

# Header names by field, in order of preference.
CANDIDATES = {
    "date": ("date", "transaction date", "booking date", "value date", "completed date", "datum", "ημερομηνία", "дата"),
    "description": ("description", "payee", "details", "memo", "reference", "payment reference", "περιγραφή", "описание"),
    "amount": ("amount", "amount (eur)", "value", "sum", "betrag", "ποσό", "сумма"),
    "currency": ("currency", "ccy", "währung", "νόμισμα", "валюта"),
}


def detect_format(spark: SparkSession, path: str) -> str:
    """n26, revolut, generic or unknown, by the header line alone."""
    head = [r.value.lower() for r in spark.read.text(path).limit(1).collect()]
    h = head[0] if head else ""
    if "payee" in h and "amount (eur)" in h:
        return "n26"
    if "completed date" in h and "state" in h:
        return "revolut"
    fields = [x.strip().strip('"') for x in re.split("[,;\t]", h)]
    return "generic" if any(c in fields for c in CANDIDATES["date"]) and any(c in fields for c in CANDIDATES["amount"]) else "unknown"


def row_hash(date: Column, amount: Column, label: Column) -> Column:
    """The first 16 hex digits of SHA-256 over date, amount and vendor or description."""
    return F.substring(F.sha2(F.concat_ws("|", date.cast("string"), amount.cast("string"), F.coalesce(label, F.lit(""))), 256), 1, 16)


def _shaped(df: DataFrame, date: Column, vendor: Column, description: Column, amount: Column, currency: Column) -> DataFrame:
    out = df.select(date.alias("date"), vendor.alias("vendor"), description.alias("description"), amount.alias("amount"), currency.alias("currency"))
    return out.where("date is not null and amount is not null").withColumn("hash", row_hash(F.col("date"), F.col("amount"), F.coalesce("vendor", "description")))


def read_csv(spark: SparkSession, path: str, layout: str | None = None, mapping: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """date, vendor, description, amount, currency, hash; rows that can't be parsed are left out."""
    layout = layout or detect_format(spark, path)
    df = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE")
    c = lambda n: F.col(f"`{n}`")
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    if layout == "n26":
        return _shaped(df, parse_bank_date(c("Date")), blank(c("Payee")), blank(c("Payment reference")), parse_bank_amount(c("Amount (EUR)")), F.lit("EUR"))
    if layout == "revolut":
        ok = F.upper(F.coalesce(F.trim(c("State")), F.lit(""))).isin("COMPLETED", "")
        when = parse_bank_date(F.coalesce(blank(c("Completed Date")), c("Started Date")))
        return _shaped(df.where(ok), when, F.regexp_replace(c("Description"), r"(?i)^(?:to|from) ", ""), blank(c("Description")), parse_bank_amount(c("Amount")), c("Currency"))
    names = {n.strip().lower(): n for n in df.columns}
    found = {f: (mapping or {}).get(f) or next((names[x] for x in cands if x in names), None) for f, cands in CANDIDATES.items()}
    if not found["date"] or not found["amount"]:
        raise ValueError(f"no date or amount among {df.columns}")
    text = blank(c(found["description"])) if found["description"] else F.lit(None).cast("string")
    return _shaped(df, parse_bank_date(c(found["date"])), text, text, parse_bank_amount(c(found["amount"])), F.coalesce(c(found["currency"]), F.lit("EUR")) if found["currency"] else F.lit("EUR"))


def is_ofx(head: Column) -> Column:
    return F.upper(F.substring(head, 1, 512)).rlike("OFXHEADER|<OFX>|<\\?OFX")


OFX_SCHEMA = "account string, posted string, amount string, payee string, memo string, fitid string, currency string"


def parse_ofx(text: str) -> list[tuple]:
    """Statement transactions of one file; unclosed SGML tags and XML alike."""
    tag = lambda name, s: (m.group(1).strip() if (m := re.search(rf"<{name}>([^<\r\n]*)", s, re.I)) else None)
    account, currency = tag("ACCTID", text), tag("CURDEF", text)
    blocks = re.findall(r"<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)", text, re.S | re.I)
    return [(account, tag("DTPOSTED", b), tag("TRNAMT", b), tag("NAME", b), tag("MEMO", b), tag("FITID", b), currency) for b in blocks]


class OfxDataSource(DataSource):
    """spark.read.format('ofx').load(path): one partition for each file of a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "ofx"

    def schema(self) -> str:
        return OFX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _OfxReader(self.options["path"])


class _OfxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        import os

        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.lower().endswith((".ofx", ".qfx")))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        with open(partition.value, errors="replace") as f:
            yield from parse_ofx(f.read())


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """The same columns as read_csv. Files come through Spark's own reader, so any store it knows will do."""
    raw = spark.read.text(path, wholetext=True).select("value").where(is_ofx(F.col("value")))

    def part(frames):
        import pandas as pd

        names = [x.split()[0] for x in OFX_SCHEMA.split(", ")]
        for f in frames:
            yield pd.DataFrame([r for t in f["value"] for r in parse_ofx(t)], columns=names, dtype=object)

    t = raw.mapInPandas(part, OFX_SCHEMA)
    date = F.try_to_timestamp(F.substring("posted", 1, 8), F.lit("yyyyMMdd")).cast("date")
    return _shaped(t, date, F.col("payee"), F.concat_ws(" - ", "payee", "memo"), parse_bank_amount(F.col("amount")), F.coalesce("currency", F.lit("EUR")))


def import_transactions(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """New facts: hashes that aren't known, once each; not negative: refund, else purchase; the amount without its sign."""
    new = parsed.dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")
    return new.select("hash", "date", "vendor", "description", F.abs("amount").alias("total_amount"), F.when(F.col("amount") >= 0, "refund").otherwise("purchase").alias("fact_type"), "currency", F.lit("needs_review").alias("status"))
