"""Extracted records refined by type: each type is a table of rules, and all of them are one select over the records.

records: id, record_type, raw (map of texts), and optionally lines (array of maps of texts), artifact_id and confidence. Raw
fields are what a reader of documents found, under any of several names; refined columns are typed. A rule takes the first of
its fields that is there, even one without a value, so a null isn't replaced by a less exact field.

Defined results: a null or empty map gives nulls (and the currency of its type); an unknown or null type gets the common
fields only; a value that can't be read is null, and its field is named in unread; a record without lines gives no lines;
repeated records are refined alike; other columns of the records are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import barcodes, dates, quantities, vendors
from ..functions.money import money_sum

PROCESSOR = "penstock.refine"

# Words of a field and what they stand for, in the order in which they are looked for.
PAYMENT_METHODS = {
    "card": "card", "credit card": "card", "debit card": "card", "cash": "cash", "bank transfer": "bank_transfer", "transfer": "bank_transfer",
    "paypal": "paypal", "apple pay": "apple_pay", "google pay": "google_pay",
}
PAYMENT_TERMS = {
    "monthly": "monthly", "annual": "annual", "yearly": "annual", "quarterly": "quarterly", "one-time": "one-time", "one time": "one-time",
    "upfront": "one-time", "weekly": "weekly", "biweekly": "biweekly",
}
RENEWALS = {"auto": "auto", "automatic": "auto", "manual": "manual", "none": "none", "no": "none"}
WARRANTY_TYPES = {w: w for w in ("manufacturer", "extended", "lifetime", "limited", "full", "store", "seller")}
TAX_KINDS = {"vat": "vat", "sales": "sales_tax", "gst": "gst", "exempt": "exempt", "included": "included"}
INVOICE_PREFIXES = ("INV-", "INVOICE-", "INV#", "#")
POLICY_PREFIXES = ("POL-", "POLICY-", "POL#", "#")
# Fields of amounts, the first that can be read counts; usual gram counts at the end of a name.
AMOUNT_FIELDS = ("amount", "total", "total_price", "total_amount")
GRAM_COUNTS = (50, 75, 100, 125, 150, 175, 200, 250, 300, 330, 350, 400, 450, 500, 750, 800, 1000)
# Unit -> (how many make up the unit of comparison, that unit).
PER_UNIT = {"g": (1000, "kg"), "kg": (1, "kg"), "lb": (2.20462, "kg"), "oz": (35.274, "kg"), "ml": (1000, "l"), "l": (1, "l"), "gal": (0.264172, "l")}

Read = Callable[[Column], Column]


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def text(c: Column) -> Column:
    return _filled(c)


def as_is(c: Column) -> Column:
    return c


def amount(c: Column) -> Column:
    return quantities.parse_number(c).cast("decimal(18,4)")


def amounts(*texts: Column) -> Column:
    """An array of amounts read by one expression: spelled out for each text, it outgrows what the compiler takes."""
    return F.transform(F.array(*texts), amount)


def vendor(c: Column) -> Column:
    return _filled(vendors.display_name(c))


def one_of(words: dict[str, str]) -> Read:
    """The whole lower-case text looked up; an unknown one stays."""
    return lambda c: F.coalesce(F.try_element_at(_map(words), F.lower(_filled(c))), F.lower(_filled(c)))


def word_of(words: dict[str, str], lower: bool = False) -> Read:
    """The first word of the table that the text contains; a text without any stays as it is, or in lower case."""

    def read(c: Column) -> Column:
        small = F.lower(_filled(c))
        rest = small if lower else _filled(c)
        return reduce(lambda out, kv: F.when(small.contains(kv[0]), kv[1]).otherwise(out), reversed(words.items()), rest)

    return read


def number(prefixes: tuple[str, ...]) -> Read:
    """In upper case without the prefixes, each taken off once, in their order."""

    def read(c: Column) -> Column:
        out = F.upper(_filled(c))
        for p in prefixes:
            out = F.when(out.startswith(p), F.trim(F.substring(out, F.lit(len(p) + 1), F.length(out)))).otherwise(out)
        return _filled(out)

    return read


def masked_account(c: Column) -> Column:
    """The first two and the last four signs, the others starred; up to six signs stay."""
    n = _filled(F.regexp_replace(c, "[ -]", ""))
    return F.when(F.length(n) > 6, F.concat(F.substring(n, 1, 2), F.repeat(F.lit("*"), F.length(n) - 6), F.substring(n, -4, 4))).otherwise(n)


def last_four(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(" "), F.lit("")), r"(\d{4})$", 1), F.lit(""))


def first_there(fields: Column, *names: str) -> Column:
    """The value of the first of these fields that the map has, null included."""
    return reduce(lambda out, n: F.when(F.map_contains_key(fields, F.lit(n)), F.try_element_at(fields, F.lit(n))).otherwise(out), reversed(names), F.lit(None).cast("string"))


_DATE = dates.parse_date
#: Columns that every record has, whatever its type.
COMMON: dict[str, tuple[tuple[str, ...], Read]] = {n: ((n,), _DATE) for n in ("date", "transaction_date", "document_date", "due_date", "issue_date", "warranty_expires", "renewal_date", "period_start", "period_end")}
#: type -> column -> (fields, how they are read).
RULES: dict[str, dict[str, tuple[tuple[str, ...], Read]]] = {
    "payment": {
        "vendor": (("vendor",), vendor), "payment_method": (("payment_method",), one_of(PAYMENT_METHODS)), "card_last4": (("card_last4",), last_four),
        "date": (("date", "transaction_date"), _DATE),
    },
    "purchase": {
        "vendor": (("vendor",), vendor), "vendor_vat": (("vendor_vat", "vendor_id"), as_is), "subtotal": (("subtotal",), amount), "tax_amount": (("tax_amount",), amount),
        "discount_amount": (("discount_amount",), amount),
    },
    "invoice": {
        "issuer": (("issuer", "vendor"), vendor), "vendor_address": (("vendor_address", "issuer_address"), as_is), "vendor_phone": (("vendor_phone", "issuer_phone"), as_is),
        "vendor_website": (("vendor_website", "issuer_website"), as_is), "vendor_vat": (("vendor_vat", "issuer_vat", "issuer_id", "issuer_registration"), as_is),
        "vendor_tax_id": (("vendor_tax_id", "issuer_tax_id"), as_is), "invoice_number": (("invoice_number", "invoice_id"), number(INVOICE_PREFIXES)),
        "due_date": (("due_date", "payment_due"), _DATE), "date": (("date", "issue_date", "invoice_date"), _DATE),
    },
    "warranty": {
        "vendor": (("vendor", "issuer"), vendor), "warranty_type": (("warranty_type",), word_of(WARRANTY_TYPES, lower=True)), "product": (("product", "product_name"), text),
        "model": (("model",), text), "serial_number": (("serial_number",), text), "date": (("date", "warranty_expires"), _DATE),
    },
    "insurance": {
        "policy_number": (("policy_number", "policy_id"), number(POLICY_PREFIXES)), "coverage": (("coverage", "coverage_type"), text), "premium": (("premium", "premium_amount"), amount),
        "renewal_date": (("renewal_date", "expiration_date"), _DATE), "issuer": (("issuer", "provider", "vendor"), vendor), "date": (("date", "issue_date", "policy_date"), _DATE),
    },
    "statement": {
        "account_number": (("account_number", "account"), masked_account), "issuer": (("issuer", "bank", "account_holder"), vendor), "opening_balance": (("opening_balance",), amount),
        "closing_balance": (("closing_balance", "balance"), amount),
    },
    "contract": {
        "payment_terms": (("payment_terms",), word_of(PAYMENT_TERMS)), "vendor": (("vendor", "issuer"), vendor), "customer": (("customer",), text),
        "date": (("date", "start_date"), _DATE), "renewal": (("renewal",), word_of(RENEWALS)),
    },
}
#: Types whose records are in EUR where nothing else is said.
EUR_TYPES = ("payment", "purchase", "invoice", "insurance", "statement")


def _currency(raw: Column, kind: Column) -> Column:
    """The field, else what the amount shows (EUR says nothing), else EUR for the types that have a default."""
    shown = quantities.find_currency(F.try_element_at(raw, F.lit("amount")))
    rest = F.when(shown != "EUR", shown).otherwise(F.when(kind.isin(*EUR_TYPES), "EUR"))
    return F.when(F.map_contains_key(raw, F.lit("currency")), quantities.normalize_currency(F.try_element_at(raw, F.lit("currency")))).otherwise(rest)


def refine_records(records: DataFrame) -> DataFrame:
    """One row for each record: id, record_type, currency, amount, every column of the rules, unread and provenance. No shuffle.

    A first select picks each column's text by type, a second one reads it, so each way of reading is planned once a column.
    """
    raw, kind = F.coalesce(F.col("raw"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.lower(F.trim("record_type"))
    names = sorted({*COMMON, *(c for rules in RULES.values() for c in rules)})
    fields, reads = {}, {}
    for name in names:
        of = {k: rules[name] for k, rules in RULES.items() if name in rules}
        rest = first_there(F.col("_raw"), *COMMON[name][0]) if name in COMMON else F.lit(None).cast("string")
        fields[name] = reduce(lambda out, kv: F.when(F.col("record_type") == kv[0], first_there(F.col("_raw"), *kv[1][0])).otherwise(out), of.items(), rest)
        (reads[name],) = {r for _, r in [*of.values(), *([COMMON[name]] if name in COMMON else [])]}
    given = lambda c, t: F.col(c).cast(t) if c in records.columns else F.lit(None).cast(t)
    provenance = F.struct(F.lit("ai_refinement").alias("source_type"), given("artifact_id", "string").alias("source_id"), given("confidence", "double").alias("confidence"), F.lit(PROCESSOR).alias("processor"))
    at = lambda n: F.try_element_at("_raw", F.lit(n))
    rows = records.select("id", kind.alias("record_type"), raw.alias("_raw"), provenance.alias("provenance"))
    ends, has = F.split(at("statement_period"), " to "), lambda n: F.map_contains_key("_raw", F.lit(n))
    # A statement's period may be one text of two dates.
    split = (F.col("record_type") == "statement") & (F.size(ends) == 2) & ~has("period_start") & ~has("period_end")
    fields["period_start"] = F.when(split, ends[0]).otherwise(fields["period_start"])
    fields["period_end"] = F.when(split, ends[1]).otherwise(fields["period_end"])
    totals = [F.when(has("amount"), at(n)).alias(f"_{n}") for n in AMOUNT_FIELDS]
    rows = rows.select(
        "id", "record_type", "provenance", *[fields[n].alias(f"_{n}_text") for n in names], *totals, _currency(F.col("_raw"), F.col("record_type")).alias("currency"),
        # An invoice's vendor is its own field as it is, else the issuer in order.
        F.when(F.col("record_type") == "invoice", has("vendor")).alias("_own"), at("vendor").alias("_own_vendor"),
    )
    money, days = [n for n in names if reads[n] is amount], [n for n in names if reads[n] is _DATE]
    rows = rows.withColumns({"_read": amounts(*[F.col(f"_{n}") for n in AMOUNT_FIELDS], *[F.col(f"_{n}_text") for n in money]), "_days": F.transform(F.array(*[F.col(f"_{n}_text") for n in days]), _DATE)})
    at_money = lambda n: F.col("_read")[len(AMOUNT_FIELDS) + money.index(n)]
    read = lambda n: at_money(n) if n in money else F.col("_days")[days.index(n)] if n in days else reads[n](F.col(f"_{n}_text"))
    rows = rows.select("id", "record_type", "provenance", "currency", "_own", "_own_vendor", "_amount", F.coalesce(*[F.col("_read")[k] for k in range(len(AMOUNT_FIELDS))]).alias("amount"), *[read(n).alias(n) for n in names], *[f"_{n}_text" for n in sorted(COMMON)])
    vendor_ = F.when(F.col("_own"), F.col("_own_vendor")).when(F.col("record_type") == "invoice", F.col("issuer")).otherwise(F.col("vendor"))
    unread = [F.when(F.col(n).isNull() & _filled(F.col(f"_{n}_text")).isNotNull(), n) for n in sorted(COMMON)] + [F.when(F.col("amount").isNull() & _filled(F.col("_amount")).isNotNull(), "amount")]
    columns = [vendor_.alias(n) if n == "vendor" else F.col(n) for n in names]
    return rows.select("id", "record_type", "amount", "currency", *columns, F.array_compact(F.array(*unread)).alias("unread"), "provenance")


# Units looked for in names. Centilitres are known as a unit, but not believed.
NAME_UNITS = ("kg", "g", "gr", "ml", "l", "lt", "ltr", "cl", "oz", "lb", "lbs")
_UNIT = "|".join(NAME_UNITS)
_SPELLED = {w: u for u, words in quantities.UNITS.items() for w in words if w in NAME_UNITS}


def content_of_name(name: Column) -> Column:
    """struct(unit_raw, unit, quantity, name): a number with a unit, else a unit at the end, else a usual gram count at the end; the name is left without it. Nulls where a name has none."""
    full = rf"(?is)^(.*?)\b(\d+(?:[.,]\d+)?)\s*({_UNIT})\b(.*)$"
    tail, bare = rf"(?is)^(.*?)\s+({_UNIT})\s*$", r"(?s)^(.*)\s(\d{2,4})\s*$"
    part = lambda p, k: F.regexp_extract(name, p, k)
    unit = lambda u: F.try_element_at(_map(_SPELLED), F.lower(u))
    known = lambda u: unit(u).isNotNull()
    before = F.trim(F.regexp_replace(F.trim(part(full, 1)), "-+$", ""))
    a, b = name.rlike(full) & known(part(full, 3)), name.rlike(tail) & known(part(tail, 2))
    c = part(bare, 2).try_cast("int").isin(*GRAM_COUNTS) & (F.trim(part(bare, 1)) != "")
    pick = lambda x, y, z: F.when(a, x).when(b, y).when(c, z)
    raw = pick(part(full, 3), part(tail, 2), F.lit("g"))
    return F.struct(
        raw.alias("unit_raw"),
        unit(raw).alias("unit"),
        pick(F.replace(part(full, 2), F.lit(","), F.lit(".")).try_cast("double"), F.lit(None).cast("double"), part(bare, 2).try_cast("double")).alias("quantity"),
        pick(F.when(before == "", F.trim(part(full, 4))).otherwise(before), F.trim(part(tail, 1)), F.trim(part(bare, 1))).alias("name"),
    )


def tax_codes(raw_text: Column) -> Column:
    """The receipt's own table as an array of (code, rate): '103 5.00%'."""
    p = r"\b(\d{2,3})\s+(\d+(?:\.\d+)?)\s*%"
    pairs = F.arrays_zip(F.regexp_extract_all(raw_text, F.lit(p), 1).alias("code"), F.regexp_extract_all(raw_text, F.lit(p), 2).alias("rate"))
    return F.coalesce(pairs, F.array().cast("array<struct<code:string,rate:string>>"))


def refine_lines(records: DataFrame) -> DataFrame:
    """The lines of purchases and invoices, one row each: id, line (from 0), name, quantity, unit, unit_quantity, prices, tax, discounts, price of comparison, barcode and what else the line says.

    A line without a name goes. A barcode that isn't valid, or stands on lines of different names in one record, is null; those
    are found by one aggregate over (record, barcode). A tax rate over 50 is a code of the receipt's table, up to 1 a share.
    """
    kind = F.lower(F.trim("record_type"))
    raw_text = F.when(kind == "purchase", F.try_element_at("raw", F.lit("raw_text")))
    rows = records.where(kind.isin("purchase", "invoice")).select("id", _currency(F.col("raw"), kind).alias("currency"), F.try_element_at("raw", F.lit("language")).alias("_language"), tax_codes(raw_text).alias("_codes"), F.posexplode("lines").alias("line", "_l"))
    at = lambda n: F.try_element_at("_l", F.lit(n))
    has = lambda n: F.coalesce(F.map_contains_key("_l", F.lit(n)), F.lit(False))
    any_of = lambda *ns: F.coalesce(*[F.nullif(at(n), F.lit("")) for n in ns])
    shape = r"^([\d.,]+)\s*([a-zA-Z]+)?$"
    rows = rows.withColumns({"_name": F.trim(any_of("name", "description", "item")), "_count": F.trim(at("quantity")), "_told": F.nullif(at("unit_raw"), F.lit("")), "_texts": F.array(any_of("total_price", "price", "total"), at("unit_price"), at("tax_amount"), at("discount_amount"))}).where("_name is not null")
    counted = F.replace(F.regexp_extract("_count", shape, 1), F.lit(","), F.lit(".")).try_cast("double")
    rows = rows.withColumns({"_c": content_of_name(F.col("_name")), "_counted": counted, "_in_count": F.nullif(F.regexp_extract("_count", shape, 2), F.lit("")), "_read": F.transform("_texts", amount)}).withColumns({n: F.col("_read")[k] for k, n in enumerate(("_total", "_each", "_tax", "_off"))})
    # Units of the count and of the field are read by one expression over both.
    both = F.transform(F.array(F.when(F.col("_counted").isNotNull(), F.col("_in_count")), F.col("_told")), lambda u: F.when(u.isNotNull(), quantities.normalize_unit(u)))
    rows = rows.withColumn("_units", both).withColumns({"_counted_unit": F.col("_units")[0], "_told_unit": F.col("_units")[1], "_q": F.coalesce("_counted", F.lit(1.0))})
    exact = F.coalesce(~F.col("_told_unit").isin("pcs", "other"), F.lit(False))
    by_name = exact | F.col("_counted_unit").isNull()
    rows = rows.withColumns({
        "name": F.when(by_name, F.coalesce("_c.name", "_name")).otherwise(F.col("_name")),
        "unit": F.when(exact, F.col("_told_unit")).otherwise(F.coalesce("_counted_unit", "_c.unit", "_told_unit", F.lit("pcs"))),
        "unit_raw": F.when(exact, F.col("_told")).when(F.col("_counted_unit").isNotNull(), F.col("_in_count")).otherwise(F.coalesce("_c.unit_raw", "_told")),
        "_content": F.coalesce(F.when(by_name, F.col("_c.quantity")), at("unit_quantity").try_cast("double")),
    })
    total_there = has("total_price") | has("price") | has("total")
    rows = rows.withColumns({
        "unit_price": F.when(has("unit_price"), F.col("_each").cast("double")).when((F.col("_total") != 0) & (F.col("_q") != 0), F.col("_total").cast("double") / F.col("_q")),
        "total_price": F.when(total_there, F.col("_total").cast("double")).when(F.col("_each") != 0, F.col("_each").cast("double") * F.col("_q")),
    })
    # A weight read as a count: the content is a factor of 1000, or missing, or the same number again.
    q, content, unit = F.col("_q"), F.col("_content"), F.col("unit")
    broken = unit.isin("kg", "l", "lb") & (q > 0) & (q < 100) & (q % 1 != 0)
    factor = unit.isin("kg", "l") & (q != 0) & (content == 1000)
    moved = F.coalesce(factor, F.lit(False)) | (broken & content.isNull())
    rows = rows.withColumns({"quantity": F.when(moved | F.coalesce(broken & (content == q), F.lit(False)), 1.0).otherwise(q), "unit_quantity": F.when(moved, q).otherwise(content)})
    holds = F.col("quantity") * F.when(F.col("unit_quantity") > 0, F.col("unit_quantity")).otherwise(1.0)
    by = F.coalesce(F.try_element_at(_map({u: float(v[0]) for u, v in PER_UNIT.items()}), unit), F.lit(1.0))
    per = F.when((F.col("total_price") != 0) & (holds != 0), F.bround((F.col("total_price") * by / holds).cast("decimal(24,8)"), 2).cast("double"))
    rate_text = F.replace(F.trim(at("tax_rate")), F.lit("%"), F.lit(""))
    rate = F.when(rate_text.rlike(r"^\d"), rate_text.try_cast("double"))
    coded = F.try_element_at(F.filter("_codes", lambda x: x["code"] == F.floor(rate).cast("string")), F.lit(-1))["rate"].try_cast("double")
    percent = F.when(rate > 50, coded).when(rate > 1, rate).otherwise(rate * 100)
    told_tax = word_of(TAX_KINDS)(at("tax_type"))
    told_tax = F.when(told_tax.isin(*TAX_KINDS.values()), told_tax)
    out = rows.select(
        "id", "line", "name", "quantity", "unit_raw", "unit", "unit_quantity", "unit_price", "total_price", "currency",
        F.coalesce(told_tax, F.when(percent.isNotNull(), "vat"), F.lit("none")).alias("tax_type"), percent.alias("tax_rate"), F.col("_tax").cast("double").alias("tax_amount"),
        F.col("_off").cast("double").alias("discount_amount"), at("discount_percentage").try_cast("double").alias("discount_percentage"),
        per.alias("comparable_unit_price"), F.when(per.isNotNull(), F.coalesce(F.try_element_at(_map({u: v[1] for u, v in PER_UNIT.items()}), unit), unit)).alias("comparable_unit"),
        _filled(at("name_en")).alias("name_normalized"), _filled(F.coalesce(F.nullif(at("original_language"), F.lit("")), F.nullif(at("language"), F.lit("")), F.col("_language"))).alias("original_language"),
        at("category").alias("category"), at("subcategory").alias("subcategory"), at("brand").alias("brand"), at("barcode").alias("_barcode_text"),
    )
    out = out.withColumn("_code", barcodes.canonical_barcode(F.col("_barcode_text"))).drop("_barcode_text")
    sign = F.lower(F.regexp_replace(F.col("name"), r"\s+", " "))
    shared = out.where("_code is not null").groupBy("id", "_code").agg(F.min(sign).alias("_a"), F.max(sign).alias("_b")).where("_a <> _b").select("id", "_code", F.lit(True).alias("_shared"))
    return out.join(shared, ["id", "_code"], "left").withColumn("barcode", F.when(F.col("_shared").isNull(), F.col("_code"))).drop("_code", "_shared")


def check_totals(refined: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Purchases with an amount other than 0 and lines: id, amount, lines_total and whether they agree within a share of the amount. Lines are summed before they meet the records; ids must be unique."""
    sums = lines.groupBy("id").agg(money_sum("total_price").alias("lines_total"))
    rows = refined.where("record_type = 'purchase'").select("id", F.col("amount").cast("double").alias("amount")).join(sums, "id")
    total = F.coalesce("lines_total", F.lit(0.0))
    # Amounts of 0 are told after the join: as a filter below it, the amounts would be read again for the filter, several times a record.
    agrees = F.when(F.col("amount") != 0, F.abs(F.col("amount") - total) <= F.abs("amount") * tolerance)
    return rows.select("id", "amount", total.alias("lines_total"), agrees.alias("agrees")).where("agrees is not null")


def refine_transactions(records: DataFrame) -> DataFrame:
    """The entries of statements that have a date and a readable amount: id, line (from 0), transaction_date, amount, currency of the statement, description, vendor, type (expense, income or null) and reference."""
    kind = F.lower(F.trim("record_type"))
    rows = records.where(kind == "statement").select("id", _currency(F.col("raw"), kind).alias("currency"), F.posexplode("lines").alias("line", "_l"))
    at = lambda n: F.try_element_at("_l", F.lit(n))
    day, said = F.coalesce(F.nullif(at("date"), F.lit("")), F.nullif(at("transaction_date"), F.lit(""))), F.lower(at("type"))
    side = F.when(said.contains("debit") | said.contains("expense"), "expense").when(said.contains("credit") | said.contains("income"), "income")
    rows = rows.select("id", "line", day.alias("_day"), amounts(at("amount"))[0].alias("amount"), "currency", F.trim(at("description")).alias("description"), F.trim(first_there(F.col("_l"), "vendor", "merchant")).alias("vendor"), side.alias("type"), F.trim(at("reference")).alias("reference"))
    return rows.where("_day is not null and amount is not null").select("id", "line", _DATE("_day").alias("transaction_date"), "amount", "currency", "description", "vendor", "type", "reference")
