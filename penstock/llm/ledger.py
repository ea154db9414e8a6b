"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once; a row keeps the measurements and one bit per failed rule. A policy is a named, versioned
mask over those bits, so policies are applied, compared and ablated on the ledger alone, by bitwise aggregation, and no
text is read again.

Defined results: a null or wordless text has no words, fails few_words and has zeros elsewhere; a text shorter than five
words has no window; a very long text is measured whole; a row is judged alone, so ties, repeated rows and other columns play no part; an empty table gives
an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
_SPACE = " \t\n\x0b\x0c\r"


def _bind(x: Column, f) -> Column:
    """f of x with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _count(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _windows(words: Column) -> Column:
    """The 64-bit hash of each five-word window, in order of position."""
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    )


def _repeat_words(h: Column) -> Column:
    """Words inside windows that occur twice or more; h: the windows' hashes. Hash and position are packed into one long, so a primitive sort brings equal windows together; the packing cuts the hash, so where windows of different whole hashes fall together, the candidates are sorted by the whole ones."""
    b = F.ceil(F.log2(F.size(h) + 1)).cast("int")
    top = lambda x: F.call_function("shiftrightunsigned", x, b)
    whole = lambda x: F.get(h, x.cast("int"))
    five = F.lit(WINDOW).cast("long")

    def candidates(s: Column) -> Column:
        """Positions whose cut hash occurs twice, in the order of cut hash and position."""
        return F.transform(F.filter(s, lambda x, i: (top(F.get(s, i - 1)) == top(x)) | (top(F.get(s, i + 1)) == top(x))), lambda x: x - F.call_function("shiftleft", top(x), b))

    def apart(c: Column) -> Column:
        """Whether a candidate has a neighbour of the same cut and another whole hash."""
        cut = lambda x: F.call_function("shiftleft", whole(x), b)
        return F.exists(F.transform(c, lambda x, i: (cut(F.get(c, i + 1)) == cut(x)) & (whole(F.get(c, i + 1)) != whole(x))), lambda x: x)

    def exact(c: Column) -> Column:
        """The candidates whose whole hash occurs twice."""
        pairs = F.sort_array(F.transform(c, lambda x: F.struct(whole(x).alias("h"), x.alias("at"))))
        twice = lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["at"])
        return _bind(pairs, twice)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(five, F.coalesce(F.get(p, i + 1) - x, five))), F.lit(0).cast("long"), lambda a, x: a + x)

    packed = F.transform(h, lambda x, i: F.call_function("shiftleft", x, b).bitwiseOR(i.cast("long")))
    repeated = _bind(_bind(F.sort_array(packed), candidates), lambda c: F.sort_array(F.when(apart(c), exact(c)).otherwise(c)))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bind(repeated, covered))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every row; the text goes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    # The words stay inside one lambda: written to a row between two projections, strings would be decoded again at each access. The hashes do leave it, for array_distinct's compiled form.
    by_word = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _windows(w).alias("h")))
    x = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), by_word.alias("w"), F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    return x.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        _count(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w.h")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        _count(F.col("text"), "!").alias("n_exclaims"),
    )


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, never reused. fails: true where a document fails; tests only measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "upper_case", "10 * n_upper > 3 * word_chars"),
    Rule(4, "exclamations", "10 * n_exclaims > n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
)
BASE = 0b11
#: Versions of the policy: a document is kept if it fails none of the mask's rules.
POLICIES = {"base": BASE, "v1": BASE | 0b0011100, "v2": BASE | 0b1111100}
CURRENT = "v2"


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with fail_bits, one bit per failed rule."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("every rule needs a bit of its own, 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits)


def kept(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(entries: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: how many rows fail it, fail it alone, and would be kept without it. One aggregation over the distinct bit patterns."""
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("p")).agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    own = [r for r in rules if mask >> r.bit & 1]
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in own]))
    hit, alone = F.col("p").bitwiseAND(F.col("r.b")) != 0, F.col("p") == F.col("r.b")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    return patterns.select("p", "n", "w", table.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(total(hit, "n").alias("failed"), total(alone, "n").alias("failed_alone"), total(alone, "w").alias("words_regained"), total(F.col("p") == 0, "n").alias("kept_now"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the ledger of every document under the current policy."""
    from .common import documents

    out = ledger(documents(spark, sf_dir))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept(POLICIES[CURRENT]).alias("kept"), "fail_bits", "n_lines", "n_upper", "n_exclaims")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, t, w, l, len(w) AS n, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END AS win FROM d),
u AS (SELECT doc_id, unnest(win) AS s, unnest(range(1, len(win) + 1)) AS i FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM u),
v AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS rep FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r WHERE c > 1) GROUP BY doc_id),
m AS (SELECT g.doc_id, n AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM g LEFT JOIN v USING (doc_id)),
f AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_upper > 3 * word_chars)::INT
    + 16 * (10 * n_exclaims > n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT + 64 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT AS b FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  b & 3 <> 0 AS base_failed, b = 0 AS kept, b::BIGINT AS fail_bits, n_lines::BIGINT AS n_lines, n_upper::BIGINT AS n_upper, n_exclaims::BIGINT AS n_exclaims
FROM f
"""
