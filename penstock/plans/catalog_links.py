"""Catalog, fourth part: operators that link rows, each over whole tables and with rows that make every rule act."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vendors
from ..operators import duplicates, graph, learning, merges, ranking, recollapse, reconcile, resolution, stats
from . import catalog_entities as entities
from .catalog import facts, items, query

# Places: vendors stand a kilometre apart, their visits a few dozen metres

_SPOTS = "SELECT id, vendor_key, total_amount, CAST(34.5 AS DOUBLE) + CAST(CAST(vendor_key AS BIGINT) % 10 AS DOUBLE) / 100 + CAST(id % 7 AS DOUBLE) * 3 / 10000 AS lat, CAST(33.0 AS DOUBLE) + CAST(CAST(vendor_key AS BIGINT) % 7 AS DOUBLE) / 100 + CAST(id % 5 AS DOUBLE) * 4 / 10000 AS lng FROM facts"


def _spots(s, d):
    k = F.col("vendor_key").cast("long")
    step = lambda m, by: (F.col("id") % m).cast("double") * by / 10000
    return facts(s, d).select("id", "vendor_key", "total_amount", (34.5 + (k % 10).cast("double") / 100 + step(7, 3)).alias("lat"), (33.0 + (k % 7).cast("double") / 100 + step(5, 4)).alias("lng"))


def _greedy(points: str, radius: int, by: str = "") -> str:
    """The scan in order of id: each step takes the first spot left and all within its radius."""
    far = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
    part = f"PARTITION BY {by} " if by else ""
    own = f"{by}, " if by else ""
    first = "first_value(id) OVER w AS sid, first_value(lat) OVER w AS slat, first_value(lng) OVER w AS slng"
    near = "*, pow(sin((radians(lat) - radians(slat)) / 2), 2) + cos(radians(slat)) * cos(radians(lat)) * pow(sin(radians(lng - slng) / 2), 2) AS a"
    return f"""WITH RECURSIVE p AS ({points}), spots AS (SELECT {own}lat, lng, min(id) AS id FROM p GROUP BY ALL),
g AS (SELECT {own}lat, lng, id, {first} FROM spots WINDOW w AS ({part}ORDER BY id)
  UNION ALL SELECT {own}lat, lng, id, {first} FROM (SELECT {near} FROM g) WHERE {far} > {radius} WINDOW w AS ({part}ORDER BY id)),
placed AS (SELECT {own}lat, lng, sid AS place FROM (SELECT {near} FROM g) WHERE {far} <= {radius}),
c AS (SELECT p.*, place FROM p JOIN placed USING ({own}lat, lng)) """


@query(_greedy(_SPOTS, 100) + "SELECT place, count(*) AS visits, {S:total_amount} AS total, {A:total_amount} AS mean, count(DISTINCT vendor_key) AS vendors FROM c GROUP BY 1")
def visits_by_place(s, d):
    return stats.spending_by_place(stats.place_clusters(_spots(s, d)))


@query(
    _greedy(_SPOTS.replace("SELECT id, vendor_key, total_amount, ", "SELECT id, vendor_key, total_amount, round(").replace(" AS lat, ", ", 5) AS lat, round(").replace(" AS lng", ", 5) AS lng"), 60, "vendor_key")
    + """, b AS (SELECT vendor_key, place, count(*) AS visits, {A:total_amount} AS mean FROM c GROUP BY ALL),
t AS (SELECT vendor_key, count(*) AS n, arg_max(place, (visits, -place)) AS v, arg_max(place, (mean, -place)) AS m FROM b GROUP BY 1)
SELECT vendor_key, place, visits, mean, place = v AS most_visited, place = m AS dearest FROM b JOIN t USING (vendor_key) WHERE n >= 2"""
)
def branches_of_vendors(s, d):
    return stats.vendor_branches(_spots(s, d), 60.0)


# Duplicates: every fact came in twice, the second time with another registration, name or day


def _twice(s, d):
    k = F.lpad(((F.col("id") * 7919 + 12_345) % 9_999_999_967).cast("string"), 10, "0")
    name = vendors.slug("vendor")
    f = facts(s, d).select("id", "event_date", "total_amount", "currency", k.alias("vendor_key"), name.alias("slug"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("string").alias("event_time"))
    v = F.col("id") % 6
    slip = F.concat(F.substring("vendor_key", 1, 9), ((F.substring("vendor_key", 10, 1).cast("int") + 1) % 10).cast("string"))
    key = F.when(v == 0, F.concat(F.lit("CY"), "vendor_key")).when(v == 1, slip).when(v == 4, F.translate("vendor_key", "0123456789", "QRSTUVWXYZ")).when(v == 5, F.col("vendor_key"))
    copy = f.withColumns({"event_date": F.when(v == 5, F.date_add("event_date", 1)).otherwise(F.col("event_date")), "vendor_key": key, "slug": F.when(v == 3, F.concat("slug", F.lit("shop"))).otherwise(F.col("slug"))})
    return f.withColumn("id", F.col("id") * 4).unionByName(copy.withColumn("id", F.col("id") * 4 + 1))


@query('SELECT id * 4 + k AS id, id * 4 AS "group" FROM facts, (VALUES (0), (1)) v(k) WHERE id % 6 < 4')
def compatible_duplicates(s, d):
    """A prefix, a slip, a missing registration and a longer name are found; another registration or day isn't."""
    return duplicates.duplicate_groups(_twice(s, d))


@query("SELECT id * 4 AS keeper, id * 4 + 1 AS other, CASE WHEN id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM fact_items WHERE fact_id = id) THEN 'merge_no_items' WHEN id % 5 = 1 THEN 'review' ELSE 'merge_prices' END AS verdict FROM facts WHERE id % 6 < 4")
def compatible_duplicate_verdicts(s, d):
    """The second one of a fact has no items, other prices or the same."""
    f = _twice(s, d)
    i = items(s, d).select("fact_id", "total_price")
    other = i.where("fact_id % 5 > 0").select((F.col("fact_id") * 4 + 1).alias("fact_id"), (F.col("total_price") + F.when(F.col("fact_id") % 5 == 1, 1_000_000).otherwise(0)).alias("total_price"))
    i = i.withColumn("fact_id", F.col("fact_id") * 4).unionByName(other)
    grouped = f.join(duplicates.duplicate_groups(f), "id")
    return resolution.duplicate_facts(grouped, i, ["group"]).select("keeper", "other", "verdict")


# Names that mean the same

_NAMES = "SELECT comparable_name || v.tail AS name, unit, count(*) - length(v.tail) AS n FROM fact_items, (VALUES (''), ('s'), (' bio')) v(tail) GROUP BY comparable_name, unit, v.tail"
_TRIGRAMS = "list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: (ascii(t[i]) * 961 + ascii(t[i + 1]) * 31 + ascii(t[i + 2])) % 64)"


@query(
    f"""WITH RECURSIVE names AS ({_NAMES}), t AS (SELECT *, ' ' || lower(name) || ' ' AS t FROM names), b AS (SELECT unit, name, n, {_TRIGRAMS} AS b FROM t),
e AS (SELECT unit, name, n, list_transform(range(64), lambda k: CAST(len(list_filter(b, lambda x: x = k)) AS DOUBLE)) AS e FROM b),
near AS (SELECT x.unit, x.name AS a, y.name AS b FROM e x JOIN e y ON x.unit = y.unit WHERE list_cosine_similarity(x.e, y.e) >= 0.8713),
r AS (SELECT unit, name AS a, name AS b FROM names UNION SELECT r.unit, r.a, near.b FROM r JOIN near ON near.unit = r.unit AND near.a = r.b),
g AS (SELECT r.unit, r.a AS name, arg_min(names.name, (-names.n, length(names.name), names.name)) AS canonical, count(*) AS members FROM r JOIN names ON names.unit = r.unit AND names.name = r.b GROUP BY ALL)
SELECT unit, name, canonical FROM g WHERE members > 1"""
)
def name_merges_of_items(s, d):
    base = items(s, d).groupBy("comparable_name", "unit").agg(F.count("*").alias("c"))
    tails = base.withColumn("tail", F.explode(F.array(F.lit(""), F.lit("s"), F.lit(" bio"))))
    names = tails.select(F.concat("comparable_name", "tail").alias("name"), "unit", (F.col("c") - F.length("tail")).alias("n"))
    named = names.select(F.xxhash64("unit", "name").alias("id"), "unit", "name", "n", merges.trigram_vector(F.col("name")).alias("embedding"))
    out = merges.name_merges(named, 0.8713)
    return out.join(named.select("id", "unit"), "id").select("unit", "name", "canonical")


# Ranked retrieval

_TOKENS = "list_filter(regexp_split_to_array(translate(lower(coalesce({0}, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25(texts: str, queries: str) -> str:
    """texts: key, text; queries: q, text."""
    return f"""WITH d AS (SELECT key, {_TOKENS.format("text")} AS w FROM ({texts})), st AS (SELECT count(*) AS total, CAST(sum(len(w)) AS DOUBLE) / count(*) AS mean FROM d),
i AS (SELECT token, key, length, count(*) AS tf FROM (SELECT key, len(w) AS length, unnest(w) AS token FROM d) GROUP BY ALL),
a AS (SELECT q, len(t) AS n, unnest(t) AS prefix, unnest(range(len(t))) AS k FROM (SELECT q, {_TOKENS.format("text")}[1:5] AS t FROM ({queries}))),
h AS (SELECT q, k, n, prefix, key, length, sum(tf) AS tf FROM a JOIN i ON starts_with(token, prefix) GROUP BY ALL), df AS (SELECT prefix, count(DISTINCT key) AS df FROM h GROUP BY 1),
s AS (SELECT q, key, n, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS hits FROM h JOIN df USING (prefix), st GROUP BY ALL),
w AS (SELECT *, bool_or(hits = n) OVER (PARTITION BY q) AS whole FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM w WHERE NOT whole OR hits = n)
SELECT q, key, hits, score, rank FROM r WHERE rank <= CASE WHEN whole THEN 100 ELSE 200 END"""


@query(_bm25("SELECT DISTINCT name || ' ' || lower(category) AS key, name || ' ' || lower(category) AS text FROM fact_items", "SELECT DISTINCT name AS q, left(name, 1) || ' ' || left(split_part(name, ' ', 2), 2) || CASE WHEN length(name) % 2 = 0 THEN ' zz' ELSE '' END AS text FROM fact_items"))
def ranked_names(s, d):
    """Names by the first letters of their words; every other query has a word that nothing begins with."""
    i = items(s, d).select("name", "category").distinct()
    texts = i.select(F.concat_ws(" ", "name", F.lower("category")).alias("key"))
    short = F.concat(F.substring("name", 1, 1), F.lit(" "), F.substring(F.split("name", " ")[1], 1, 2), F.when(F.length("name") % 2 == 0, " zz").otherwise(""))
    return ranking.ranked(texts, i.select(F.col("name").alias("q"), short.alias("text")).distinct(), "key")


@query(_bm25("SELECT doc_id AS key, text FROM documents", "SELECT item_id AS q, text FROM benchmark"))
def ranked_documents(s, d):
    """Whole documents by the first words of every benchmark passage."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    asked = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q"), "text")
    return ranking.ranked(docs, asked, "key", "text")


# Line totals that miss the printed total: of most facts one line was multiplied by its quantity, some totals fit nothing


def _receipts(s, d):
    i = items(s, d).select("fact_id", F.row_number().over(entities._w()).alias("line"), F.col("quantity").cast("bigint").alias("quantity"), F.round(F.col("total_price") * 100).cast("bigint").alias("t"))
    bad = (F.col("line") == 1 + F.col("fact_id") % 3) & (F.col("fact_id") % 4 > 0)
    money = lambda c: (c.cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    lines = i.select("fact_id", "line", "quantity", money(F.when(bad, F.col("t") * F.col("quantity")).otherwise(F.col("t"))).alias("total_price"), money(F.when(bad, F.col("t")).otherwise(F.floor(F.col("t") / F.col("quantity")))).alias("unit_price"))
    printed = i.groupBy("fact_id").agg(money(F.sum("t") + F.when(F.col("fact_id") % 11 == 0, 10_000_000).otherwise(0)).alias("printed_total"))
    return lines, printed


_RECEIPTS = """WITH RECURSIVE l AS (SELECT fact_id, row_number() OVER (PARTITION BY fact_id ORDER BY line, part_id, quantity, total_price) AS k, CAST(quantity AS BIGINT) AS q, CAST(round(total_price * 100) AS BIGINT) AS t FROM fact_items),
o AS (SELECT fact_id, k, q, t, CASE WHEN bad THEN t * q ELSE t END AS total, CASE WHEN bad THEN t ELSE CAST(floor(t / q) AS BIGINT) END AS unit FROM (SELECT *, k = 1 + fact_id % 3 AND fact_id % 4 > 0 AS bad FROM l)),
c AS (SELECT *, list_distinct(CASE WHEN q = 1 THEN [total, unit] ELSE [total, unit, total // q + CASE WHEN 2 * (total % q) > q OR (2 * (total % q) = q AND (total // q) % 2 = 1) THEN 1 ELSE 0 END] END) AS opts FROM o),
f AS (SELECT fact_id, count(*) AS lines, sum(t)::BIGINT + CASE WHEN fact_id % 11 = 0 THEN 10000000 ELSE 0 END AS printed, sum(total)::BIGINT AS old, count(CASE WHEN len(opts) > 1 THEN 1 END) AS free, product(len(opts)) AS combos FROM c GROUP BY 1),
g AS (SELECT *, greatest(5, printed * 6 // 1000 + CASE WHEN 2 * (printed * 6 % 1000) > 1000 OR (2 * (printed * 6 % 1000) = 1000 AND (printed * 6 // 1000) % 2 = 1) THEN 1 ELSE 0 END) AS tol FROM f),
s AS (SELECT fact_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, 0 AS moved, CAST([] AS BIGINT[]) AS picks FROM g WHERE free BETWEEN 1 AND 16 AND combos <= 100000
  UNION ALL SELECT fact_id, k, s + v, moved + CASE WHEN v <> total THEN 1 ELSE 0 END, list_append(picks, v) FROM (SELECT s.fact_id, c.k, s.s, s.moved, s.picks, c.total, unnest(c.opts) AS v FROM s JOIN c ON c.fact_id = s.fact_id AND c.k = s.k + 1)),
w AS (SELECT fact_id, count(*) AS ways, min(s.s) AS s, min(moved) AS moved, any_value(picks) AS picks FROM s JOIN g USING (fact_id) WHERE s.k = lines AND abs(s.s - printed) <= tol GROUP BY 1),
r AS (SELECT g.*, w.s, w.picks, CASE WHEN free = 0 THEN 'no adjustable lines' WHEN free > 16 THEN 'too ambiguous' WHEN combos > 100000 THEN 'too many combinations' WHEN ways IS NULL THEN 'none fits' WHEN ways > 1 THEN 'ambiguous' WHEN moved > 0 THEN 'reconciled' ELSE 'already reconciled' END AS reason FROM g LEFT JOIN w USING (fact_id)) """


@query(_RECEIPTS + "SELECT fact_id, reason = 'reconciled' AS reconciles, reason, printed / 100 AS printed_total, old / 100 AS old_sum, CASE WHEN reason = 'reconciled' THEN s ELSE old END / 100 AS new_sum FROM r")
def reconcile_plans(s, d):
    return reconcile.plans(*_receipts(s, d)).drop("chosen")


@query(
    _RECEIPTS
    + ", u AS (SELECT c.*, picks[k] AS v FROM c JOIN r USING (fact_id) WHERE reason = 'reconciled') SELECT fact_id, k AS line, total / 100 AS old_total, v / 100 AS new_total, (v // q + CASE WHEN 2 * (v % q) > q OR (2 * (v % q) = q AND (v // q) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS new_unit FROM u WHERE v <> total"
)
def reconcile_fixes(s, d):
    """The lines of the only way that is left: mostly the one that was multiplied."""
    lines, printed = _receipts(s, d)
    return reconcile.fixes(lines, reconcile.plans(lines, printed)).withColumn("line", F.col("line").cast("bigint"))


# What corrections teach, and clouds brought up to date


def _slips_without_amount(s, d):
    """A basket and a slip of the same day for every order, whose slip has lost its amount: alone, vendor and day don't link them."""
    late = (F.col("bundle_type") == "payment_record") & (F.floor(F.col("ord") / 2) % 2 == 0)
    b = entities._noisy_bundles(s, d).withColumn("event_date", F.when(late, F.date_sub("event_date", 1)).otherwise(F.col("event_date")))
    return b.withColumn("amount", F.when(F.col("bundle_type") == "basket", F.col("amount")))


def _history(s, d):
    """Three false positives of every third vendor, in which only the amount agreed, and two that name every third one twice."""
    v = facts(s, d).select("vendor_key").distinct().withColumn("k", F.col("vendor_key").cast("bigint") % 3)
    taught = v.where("k < 2").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("other", F.concat(F.lit("other "), "vendor_key"))
    named = v.where("k = 1").withColumn("n", F.explode(F.array(F.lit(4), F.lit(5)))).withColumn("other", F.col("vendor_key"))
    kind = {"vendor_similarity": F.lit(0.2), "amount_diff": F.lit(0.5), "date_diff_days": F.lit(1), "item_overlap": F.lit(0.0), "was_false_positive": F.lit(True)}
    return taught.unionByName(named).select((F.col("vendor_key").cast("bigint") * 10 + F.col("n")).alias("ord"), F.col("n").alias("at"), F.col("vendor_key").alias("vendor_key_a"), F.col("other").alias("vendor_key_b"), *[c.alias(k) for k, c in kind.items()])


_ALL = "SELECT id * 2 AS ord, vendor_key, event_date FROM facts UNION ALL SELECT id * 2 + 1, vendor_key, event_date FROM facts"


@query(f"SELECT ord, CASE WHEN CAST(vendor_key AS BIGINT) % 3 = 0 THEN min(ord) OVER (PARTITION BY vendor_key, event_date) ELSE ord END AS cloud FROM ({_ALL})")
def clouds_after_corrections(s, d):
    """Learned weights link what was apart for a third of the vendors; for another third the veto keeps it apart; nothing is known of the last."""
    history = _history(s, d)
    return resolution.form_clouds(_slips_without_amount(s, d), None, learning.false_pairs(history), learning.weights(history))


@query("SELECT vendor_key, 1.3::DOUBLE AS vendor, 0.85::DOUBLE AS amount FROM (SELECT DISTINCT vendor_key FROM facts) WHERE CAST(vendor_key AS BIGINT) % 3 = 0")
def learned_weights(s, d):
    """The multipliers of the vendors whose false positives agreed in the amount alone."""
    w = learning.weights(_history(s, d))
    return w.where("try_cast(vendor_key as bigint) % 3 = 0").select("vendor_key", "vendor", F.round("amount", 6).alias("amount"))


@query("SELECT id * 2 + 1 AS ord, 1.0::DOUBLE AS vendor_similarity, CASE WHEN id % 5 = 0 THEN 2.5 ELSE 0.0 END::DOUBLE AS amount_diff, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END::INT AS date_diff_days, id % 3 = 0 AS was_false_positive FROM facts")
def move_features(s, d):
    """Every slip is moved into its basket's cloud; each fifth one differs in the amount."""
    b = entities._noisy_bundles(s, d)
    b = b.withColumn("amount", F.when((F.col("ord") % 2 == 1) & (F.floor(F.col("ord") / 2) % 5 == 0), F.col("amount") + F.lit(2.5).cast("decimal(18,2)")).otherwise(F.col("amount")).cast("decimal(18,2)"))
    clouds = b.select("ord", (F.col("ord") - F.col("ord") % 2).alias("cloud"))
    moves = clouds.where("ord % 2 = 1").select("ord", "cloud", (F.floor(F.col("ord") / 2) % 3 == 0).alias("was_false_positive"), F.lit(1).alias("at"))
    return learning.correction_features(b, clouds, moves).select("ord", "vendor_similarity", "amount_diff", "date_diff_days", "was_false_positive")


def _changed(s, d):
    """All clouds as they were; then each hundredth order's slip has another amount, and each hundredth order is gone."""
    b = graph.cut_lineage(entities._noisy_bundles(s, d))
    order = F.floor(F.col("ord") / 2)
    other = (F.col("ord") % 2 == 1) & (order % 100 == 7)
    after = b.where(order % 100 != 9).withColumn("amount", F.when(other, F.col("amount") + 1000).otherwise(F.col("amount")).cast("decimal(18,2)"))
    changed = b.where(other | (order % 100 == 9)).select("ord")
    parents = graph.cut_lineage(resolution.best_partners(b))
    clouds = parents.select(F.col("node").alias("ord"), F.col("parent").alias("cloud"))  # pairs: a parent is a root
    return b, after, parents, clouds, changed


@query("SELECT id * 2 + k AS ord, CASE WHEN id % 100 = 7 THEN id * 2 + k ELSE id * 2 END AS cloud FROM facts, (VALUES (0), (1)) v(k) WHERE id % 100 <> 9")
def recollapsed_clouds(s, d):
    _, after, parents, clouds, changed = _changed(s, d)
    return recollapse.recollapse(after, parents, clouds, changed)[1]


@query("SELECT id * 2 + CASE WHEN id % 100 = 7 THEN k ELSE 0 END AS cloud, CAST(max(total_amount) + CASE WHEN id % 100 = 7 AND max(k) = 1 THEN 1000 ELSE 0 END AS DECIMAL(18,2)) AS total_amount, count(*) AS n, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM facts, (VALUES (0), (1)) v(k) WHERE id % 100 <> 9 GROUP BY id, CASE WHEN id % 100 = 7 THEN k ELSE 0 END")
def recollapsed_facts(s, d):
    """The facts of touched clouds are swapped, the others stay."""
    before, after, parents, clouds, changed = _changed(s, d)
    facts_before = resolution.collapse_clouds(before, clouds)
    _, now, touched = recollapse.recollapse(after, parents, clouds, changed)
    return recollapse.swap_facts(facts_before, after, now, touched).select("cloud", F.col("total_amount").cast("decimal(18,2)").alias("total_amount"), "n", F.col("confidence").cast("double").alias("confidence"))
