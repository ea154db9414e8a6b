"""Folders of documents, content hashes, extraction files, exports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types by folder name.
FOLDER_TYPES = {"receipts": "receipt", "invoices": "invoice", "payments": "payment_confirmation", "statements": "statement", "warranties": "warranty", "contracts": "contract"}


def scan_inbox(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files below a path, with their context and, if asked for, their SHA-256. Without content no bytes are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = F.lower("path").rlike(r"\.(?:jpe?g|png|webp|heic|pdf|csv|ofx|qfx|ya?ml|txt)$")
    cols = ["path", "modificationTime", "length", folder_context(F.col("path")).alias("context")]
    return f.where(keep).select(*cols, *([F.sha2("content", 256).alias("file_hash")] if content else []))


def folder_context(path: Column) -> Column:
    """struct(kind, country, vendor) by the folders above a file."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    kinds = F.create_map(*[F.lit(x) for kv in FOLDER_TYPES.items() for x in kv])
    kind = F.try_element_at(F.filter(F.transform(parts, lambda p: F.try_element_at(kinds, F.lower(p))), lambda x: x.isNotNull()), F.lit(-1))
    country = F.try_element_at(F.filter(parts, lambda p: p.rlike("^[A-Z]{2}$")), F.lit(-1))
    last = F.element_at(parts, -1)
    vendor = F.when(F.try_element_at(kinds, F.lower(last)).isNull() & ~last.rlike("^[A-Z]{2}$"), last)
    return F.struct(kind.alias("kind"), country.alias("country"), vendor.alias("vendor"))


def new_documents(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """One file for each content hash that isn't known."""
    return scanned.dropDuplicates(["file_hash"]).join(known.select("file_hash"), "file_hash", "left_anti")


def changed_extractions(files: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """files: path, hash, confidence; known: path, hash. Files that changed, are new, or are unsure."""
    k = known.select("path", F.col("hash").alias("_h"))
    return files.join(k, "path", "left").where("_h is null or _h <> hash").drop("_h").unionByName(files.join(k, "path").where((F.col("_h") == F.col("hash")) & (F.col("confidence") < least)).drop("_h"))


def export_transactions(facts: DataFrame, date_from=None, date_to=None) -> DataFrame:
    from ..operators.spend import in_range

    return in_range(facts, date_from, date_to).select("id", F.col("event_date").alias("date"), "vendor", F.col("total_amount").alias("amount"), "currency", F.col("fact_type").alias("type"), "country").orderBy(F.desc("date"), "id")


def export_line_items(stars: DataFrame, filters: dict | None = None) -> DataFrame:
    from ..operators.stars import star_filter

    return stars.where(star_filter(filters)).select("fact_id", "line", "name", "category", "brand", "quantity", "unit", "total_price", "currency", "vendor", "vendor_key", "event_date", "country")


def fact_provenance(facts: DataFrame, bundles: DataFrame, documents: DataFrame) -> DataFrame:
    """fact_id, source, user of the documents behind a fact: facts (id, cloud_id), bundles (cloud_id, document_id), documents (id, source, user_id).

    Documents without a source don't count; of several the one of least id. They are reduced to one a cloud before the facts join, so a large cloud is aggregated on the map side.
    """
    d = documents.where("source is not null").select(F.col("id").alias("document_id"), "source", "user_id")
    best = bundles.select("cloud_id", "document_id").join(d, "document_id").groupBy("cloud_id").agg(F.min_by(F.struct("source", "user_id"), F.struct("document_id", "source", "user_id")).alias("_d"))
    return facts.select(F.col("id").alias("fact_id"), "cloud_id").join(best, "cloud_id").select("fact_id", F.col("_d.source").alias("source"), F.col("_d.user_id").alias("user"))


def export_payload(facts: DataFrame, items: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """A JSON text for each fact with its items; source and user by provenance (fact_id, source, user), cli and system where there is none or a null or empty one."""
    i = items.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("quantity").try_cast("double").alias("quantity"), F.col("total_price").try_cast("double").alias("total_price")))).alias("items"))
    f = with_provenance(facts, provenance).join(i, F.col("id") == F.col("fact_id"), "left").drop("fact_id")
    return f.select("id", F.to_json(F.struct(*[c for c in f.columns])).alias("payload"))


def with_provenance(facts: DataFrame, provenance: DataFrame | None) -> DataFrame:
    """facts with source and user."""
    if provenance is None:
        return facts.withColumns({"source": F.lit("cli"), "user": F.lit("system")})
    p = provenance.select(F.col("fact_id").alias("_f"), F.nullif("source", F.lit("")).alias("_s"), F.nullif("user", F.lit("")).alias("_u"))
    return facts.join(p, F.col("id") == F.col("_f"), "left").withColumns({"source": F.coalesce("_s", F.lit("cli")), "user": F.coalesce("_u", F.lit("system"))}).drop("_f", "_s", "_u")


def write_export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A folder of part files; one file only for results that are small by their own limit."""
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if kind == "csv" else w.json(path)


def export_all(path: str, kind: str = "csv", **tables: DataFrame) -> None:
    for name, df in tables.items():
        write_export(df, f"{path}/{name}", kind)


def snapshot(items: DataFrame, path: str, version: str, fields: list[str]) -> None:
    items.select("id", *fields).write.parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def render(df: DataFrame, kind: str = "markdown", limit: int = 1000) -> str:
    """A small result as Markdown, CSV, HTML or JSON (at most limit rows; reports are bounded by their own limits)."""
    import html
    import json

    rows, names = [r.asDict() for r in df.limit(limit).collect()], df.columns
    text = lambda v: "" if v is None else str(v)
    if kind == "json":
        return json.dumps(rows, default=str, ensure_ascii=False)
    if kind == "csv":
        import csv
        import io

        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(names)
        w.writerows([[text(r[n]) for n in names] for r in rows])
        return out.getvalue()
    if kind == "html":
        cells = lambda tag, vs: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in vs) + "</tr>"
        return "<table>" + cells("th", names) + "".join(cells("td", [text(r[n]) for n in names]) for r in rows) + "</table>"
    line = lambda vs: "| " + " | ".join(v.replace("|", "\\|") for v in vs) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *[line([text(r[n]) for n in names]) for r in rows]])
