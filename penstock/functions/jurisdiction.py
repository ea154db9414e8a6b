"""Where a document was issued and which currency its total is in, from what is printed on it, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantities import normalize_currency

# Currency by jurisdiction, place names in capitals without accents, and what names a tax or a currency.
CURRENCY_OF = {"CY": "EUR", "CY-NORTH": "TRY", "AT": "EUR", "DE": "EUR", "GR": "EUR", "FR": "EUR", "IT": "EUR", "ES": "EUR", "TR": "TRY", "CA": "CAD", "US": "USD", "GB": "GBP", "RU": "RUB"}
PLACES = {
    "CY-NORTH": ("KKTC", "K.K.T.C", "KUZEY KIBRIS", "LEFKOSA", "GIRNE", "MAGUSA", "GAZIMAGUSA", "GUZELYURT", "ISKELE", "LEFKE", "KAPLICA", "KARPAZ", "DIPKARPAZ", "BAFRA", "ESENTEPE", "CATALKOY", "ALSANCAK", "LAPTA", "TATLISU", "BOGAZ", "YENIBOGAZICI"),
    "CA": ("ONTARIO", "QUEBEC", "BRITISH COLUMBIA", "ALBERTA", "MANITOBA", "SASKATCHEWAN", "NOVA SCOTIA", "TORONTO", "MONTREAL", "VANCOUVER", "OTTAWA", "GUELPH", "CALGARY", "EDMONTON", "WINNIPEG", "HALIFAX", "WATERLOO", "KITCHENER"),
    "AT": ("AUSTRIA", "OSTERREICH", "WIEN", "GRAZ", "LINZ", "SALZBURG", "INNSBRUCK", "KLAGENFURT", "VILLACH", "WELS"),
    "TR": ("TURKIYE", "ISTANBUL", "ANKARA", "IZMIR", "BURSA", "ANTALYA", "KONYA"),
    "RU": ("RUSSIA", "MOSCOW", "MOSKVA", "SAINT PETERSBURG", "ST PETERSBURG", "PETERSBURG", "NOVOSIBIRSK", "YEKATERINBURG", "KAZAN", "ROSSIYA"),
    "CY": ("CYPRUS", "KYPROS", "LIMASSOL", "LEMESOS", "NICOSIA", "LEFKOSIA", "LARNACA", "LARNAKA", "PAPHOS", "PAFOS", "PARALIMNI", "AYIA NAPA", "STROVOLOS", "ENGOMI", "AGLANTZIA"),
}
GREEK_PLACES = ("ΚΥΠΡΟΣ", "ΛΕΜΕΣΟΣ", "ΛΕΥΚΩΣΙΑ", "ΛΑΡΝΑΚΑ", "ΠΑΦΟΣ")
CYRILLIC_PLACES = ("РОССИЯ", "МОСКВА", "САНКТ-ПЕТЕРБУРГ", "ПЕТЕРБУРГ", "НОВОСИБИРСК", "ЕКАТЕРИНБУРГ", "КАЗАНЬ")
CANADIAN_BRANDS = ("CANADA DRY", "AIR CANADA", "CANADIAN CLUB", "CANADA GOOSE", "CANADA POST")
CANADIAN_TAXES = ("HST", "PST", "QST", "TPS", "TVQ")
LIRA_WORDS, ROUBLE_WORDS = ("₺", "KDV", "TURK LIRASI"), ("₽", "РУБ", "НДС")
ACCENTED, PLAIN = "ÄÖÜẞŞĞİÇÉÈÀÂÊÔÛŪ", "AOUSSGICEEAAEOUU"
GST_LINE = r"(?U)\bGST\b\s*[:#]?\s*(?:\d+[.,]\d|\$|\d+\s*%)"
AUSTRIAN_VAT = r"(?U)\bATU\s?\d{8}\b"
GREEK_VAT = "[ΦF][ΠP][AΑ]"
LIRA_AMOUNT = r"(?<![A-Z0-9])(?:\d[\d.,]*\s*TL|TL\s*[:=]?\s*\d)(?![A-Z0-9])"
ROUBLE_AMOUNT = r"(?U)\d[\d.,]*\s*(?:₽|РУБ|Р\.|\bRUB\b)"
#: So many letters of a script make a text one of that script.
SCRIPT_LETTERS = 5

PRINTED = ("vendor", "vendor_address", "vendor_legal_name", "vendor_vat", "raw_text")


def _one_of(words) -> str:
    return "|".join(map(re.escape, words))


def _has(text: Column, *words: str) -> Column:
    """Any of the words, not inside a longer one."""
    return text.rlike(f"(?<![A-Z0-9])(?:{_one_of(words)})(?![A-Z0-9])")


def _letters(text: Column, script: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{script}]+", ""))


def _shown(text: Column) -> dict[str, Column]:
    """By currency: whether its mark, code or tax is printed. A lone $ tells nothing."""
    return {
        "EUR": text.contains("€") | _has(text, "EUR"),
        "GBP": text.contains("£") | _has(text, "GBP"),
        "USD": _has(text, "USD"),
        "RUB": text.contains("₽") | _has(text, *ROUBLE_WORDS) | text.rlike(ROUBLE_AMOUNT),
        "TRY": text.contains("₺") | _has(text, *LIRA_WORDS) | text.rlike(LIRA_AMOUNT),
    }


def _only(shown: Column) -> Column:
    """The printed currency, if there is exactly one."""
    return F.when(F.size(shown) == 1, shown[0])


def apply_jurisdiction(docs: DataFrame, default_country: str | None = None) -> DataFrame:
    """docs with `country` and `currency` set from the columns of PRINTED (absent ones are blank); a country or currency that stood there stays where nothing is found.

    The first cue that applies names the jurisdiction, places before currencies before scripts. Its currency holds, unless one other currency alone is printed. The default names a country only, never a currency."""
    blank = F.lit("")
    part = {c: F.coalesce(F.col(c).cast("string"), blank) if c in docs.columns else blank for c in PRINTED}
    x = docs.withColumn("_text", F.translate(F.upper(F.concat_ws(" ", *part.values())), ACCENTED, PLAIN)).withColumn("_own", F.upper(F.concat_ws(" ", part["vendor_address"], part["raw_text"])))
    text, own = F.col("_text"), F.col("_own")
    codes = F.array_compact(F.array(*[F.when(hit, c) for c, hit in _shown(text).items()]))
    x = x.withColumn("_shown", codes)
    shown = F.col("_shown")
    shows = lambda c: F.array_contains(shown, c)
    canada = (_has(text, "CANADA") & ~text.rlike(_one_of(CANADIAN_BRANDS))) | _has(text, *PLACES["CA"], *CANADIAN_TAXES) | text.rlike(GST_LINE)
    russian_text = (_letters(text, "А-Яа-яЁё") >= SCRIPT_LETTERS) & F.coalesce(_only(shown) == "RUB", F.lit(True))
    cues = [
        ("CY-NORTH", _has(text, *PLACES["CY-NORTH"])),
        ("CA", canada),
        ("AT", _has(text, *PLACES["AT"]) | text.rlike(AUSTRIAN_VAT)),
        ("TR", _has(text, *PLACES["TR"])),
        ("RU", _has(text, *PLACES["RU"]) | own.rlike(_one_of(CYRILLIC_PLACES)) | shows("RUB") | russian_text),
        ("CY", _has(text, *PLACES["CY"]) | own.rlike(_one_of(GREEK_PLACES)) | text.rlike(GREEK_VAT) | own.rlike(GREEK_VAT)),
        ("TR", shows("TRY")),
        ("CA", _has(text, "CAD", "C$")),
        ("CY", _letters(text, "Α-Ωα-ω") >= SCRIPT_LETTERS),
    ]
    x = x.withColumn("_found", F.coalesce(*[F.when(hit, code) for code, hit in cues]))
    canonical = F.try_element_at(F.create_map(*[F.lit(v) for kv in CURRENCY_OF.items() for v in kv]), F.col("_found"))
    lira = F.col("_found").isin("TR", "CY-NORTH")
    marked = reduce(lambda a, c: F.coalesce(a, F.when(shows(c), c)), ("TRY", "RUB"), F.lit(None).cast("string"))
    sign = F.when(text.contains("€"), "EUR").when(text.contains("£"), "GBP")
    stood = F.col("currency") if "currency" in docs.columns else F.lit(None).cast("string")
    kept = F.when(F.trim(stood) != "", normalize_currency(stood))
    held = F.when(lira, canonical).when(F.array_contains(shown, canonical), canonical).otherwise(F.coalesce(_only(shown), canonical))
    currency = F.when(canonical.isNotNull(), held).otherwise(F.coalesce(_only(shown), marked, sign, kept))
    was = F.col("country") if "country" in docs.columns else F.lit(None).cast("string")
    fallback = F.lit((default_country or "").strip().upper() or None).cast("string")
    out = x.withColumn("_country", F.coalesce("_found", fallback, was)).withColumn("_currency", F.coalesce(currency, stood))
    return out.drop("country", "currency", "_text", "_own", "_shown", "_found").withColumnsRenamed({"_country": "country", "_currency": "currency"})
