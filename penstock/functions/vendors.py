"""Vendor names: slugs, intermediaries, registrations and keys as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, in the order in which they are stripped, and transliterations.
LEGAL_SUFFIXES = (
    "incorporated", "corporation", "limited", "s.a.r.l", "s.r.l.", "gmbh", "corp", "sarl", "s.a.", "b.v.", "n.v.", "ltd", "llc", "inc", "srl",
    "a/s", "aps", "oyj", "ike", "επε", "epe", "sa", "ag", "bv", "nv", "ab", "oy", "as", "co", "εε", "αε", "ae", "ee",
)
LEGAL_PREFIXES = ("ooo", "zao", "oao")
DISPLAY_PREFIXES = ("the", "ооо", "зао", "оао")
GREEK = {
    "α": "a", "ά": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "έ": "e", "ζ": "z", "η": "i", "ή": "i", "θ": "th", "ι": "i", "ί": "i", "ϊ": "i", "ΐ": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "ό": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "ύ": "y", "ϋ": "y", "ΰ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o", "ώ": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
SENTINELS = ("", "null", "none", "nil", "n/a", "n.a.", "na", "nan", "-", "--", "unknown")
INTERMEDIARIES = (
    r"PAYMENT\s+(?:SYSTEMS?|SOLUTIONS?|SERVICES?)", r"ACQUIR(?:ING|ER)", "ATM", r"J[CG]C\s+PAYMENT", "P3T", r"Т[-\s]?БАНК", "ТИНЬКОФФ", "СБЕРБАНК",
    r"АЛЬФА[-\s]?БАНК", "ВТБ", "ГАЗПРОМБАНК", "РАЙФФАЙЗЕН(?:БАНК)?", "РОСБАНК",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def transliterate(c: Column) -> Column:
    """Greek and Cyrillic small letters in Latin: one translate for single letters, one replacement for each longer one."""
    table = GREEK | CYRILLIC
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    for k, v in table.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join([*single, *gone]), "".join(single.values()))


def slug(name: Column | str) -> Column:
    """Lower case, Latin letters, no legal form, no punctuation."""
    c = transliterate(F.trim(F.lower(_c(name))))
    c = F.regexp_replace(c, rf"^(?:{'|'.join(LEGAL_PREFIXES)})\s+", "")
    for s in LEGAL_SUFFIXES:
        c = F.regexp_replace(c, rf"[\s,]+{re.escape(s)}\.?$", "")
    return F.regexp_replace(c, r"""[\s\-_.,;:!?'"()&/]+""", "")


def is_intermediary(name: Column | str) -> Column:
    """Card acquirers, processors and cash machines; null is none."""
    return F.coalesce(_c(name).rlike("(?iuU)" + "|".join(rf"\b{p}\b" for p in INTERMEDIARIES)), F.lit(False))


def clean_registration(reg: Column | str) -> Column:
    r = F.trim(_c(reg))
    return F.when(~F.lower(r).isin(*SENTINELS), r)


def vendor_key(reg: Column | str, name: Column | str) -> Column:
    """The registration without spaces in upper case, else a hash of the slug, else null."""
    r = F.upper(F.regexp_replace(clean_registration(reg), r"\s+", ""))
    s = slug(name)
    return F.coalesce(r, F.when(s != "", F.concat(F.lit("noid_"), F.substring(F.sha2(s, 256), 1, 10))))


def slugs_match(a: Column, b: Column, least: int = 4) -> Column:
    """Equal, or one contains the other and is at least `least` long."""
    inside = lambda x, y: (F.length(x) >= least) & y.contains(x)
    return F.coalesce((a != "") & (b != "") & ((a == b) | inside(a, b) | inside(b, a)), F.lit(False))


def display_name(name: Column | str) -> Column:
    """Title case without leading articles and trailing legal forms; a name of nothing else stays."""
    c = F.trim(F.regexp_replace(_c(name), r"\s+", " "))
    c = F.regexp_replace(c, rf"^(?iu)(?:{'|'.join(DISPLAY_PREFIXES)})\s+(?=\S)", "")
    forms = "|".join(re.escape(s) for s in LEGAL_SUFFIXES)
    for _ in range(2):
        c = F.regexp_replace(c, rf"(?iu)(?<=\S)[\s,]+(?:{forms})\.?$", "")
    return F.initcap(F.lower(F.translate(c, ".,:;'\"!?", "")))


def strip_country_prefix(key: Column) -> Column:
    return F.regexp_replace(key, r"^[A-Z]{2}(?=[0-9])", "")
