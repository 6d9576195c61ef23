"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask over consecutive tokens that ignores some positions, so a substituted token
in an ignored place does not hide a match. Both sides hash the tokens under each mask, the
hashes are joined, and every hit is verified along its diagonal: in some window of the
benchmark item, at least ``share`` of the tokens must equal those of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks of five positions. Together they hit every window of 8 to 15 tokens in which a fifth is substituted, wherever the substitutions are (tested by enumeration).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
WINDOW = 15
MIN_TOKENS = 8
SHARE = 0.8
#: A seed table of more bytes than this is joined by shuffle.
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 32


#: Scripts written without spaces (fixed values).
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def tokens(text: str) -> Column:
    """Lower-case runs of letters and digits, single characters in scripts without spaces; NULL gives none."""
    apart = "([" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "])"
    spaced = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(apart), F.lit(" $1 "))
    return F.regexp_extract_all(spaced, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def hashed(text: str) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(array: Column, place: Column, size: Column) -> Column:
    """The hash of each mask laid at a place; masks that reach over the end give NULL."""
    at = lambda k: F.get(array, place + k)
    return F.array(*[
        F.when(place + mask[-1] < size, F.xxhash64(F.lit(i), *[at(k) for k in mask])) for i, mask in enumerate(MASKS)
    ])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, min_tokens: int = MIN_TOKENS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Verified overlaps: doc_id, item_id, place (first token of the item in the document, may be negative), matches.

    An item overlaps a document if in some window of ``window`` tokens of the item (the whole
    item if shorter), laid on the document without leaving it, at least ``share`` of the
    tokens are equal. Items of fewer than ``min_tokens`` tokens must occur unchanged; those
    of fewer than a mask, which turn up in any text, must be all of the document.
    ``matches`` is the most equal tokens in a window. A document that holds an item in several
    places has several rows; repeated rows of an input count once, texts that share an id are
    judged each; NULL and empty texts overlap nothing; either table may be empty.
    """
    least = len(MASKS[0])
    named = benchmark.select("item_id", hashed("text").alias("__item"))
    items = named.where(F.size("__item") >= least)
    placed = items.select("item_id", "__item", F.explode(F.sequence(F.lit(0), F.size("__item") - 1)).alias("__q"))
    sown = placed.select(F.explode(seeds(F.col("__item"), F.col("__q"), F.size("__item"))).alias("__seed"), "item_id", F.size("__item").alias("__len"), "__q").where("__seed IS NOT NULL")
    # the size check: characters of the benchmark bound its tokens, and those its seeds
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    small = total * len(MASKS) * SEED_BYTES <= broadcast_bytes
    texts = docs.select("doc_id", hashed("text").alias("__doc"))
    long = texts.where(F.size("__doc") >= least).withColumn("__name", F.xxhash64("__doc"))
    windows = long.select("doc_id", "__name", "__doc", F.explode(F.sequence(F.lit(0), F.size("__doc") - least)).alias("__p"))
    laid = F.explode(seeds(F.col("__doc"), F.col("__p"), F.size("__doc"))).alias("__s")
    place = F.col("__p") - F.col("__q")
    start = F.greatest(F.col("place"), F.lit(0))
    stop = F.least(F.col("place") + F.col("__len"), F.size("__doc"))
    part = F.slice("__doc", start + 1, stop - start).alias("__part")
    key = ["doc_id", "__name", "item_id", "place", "__len"]
    # many hits lie on one diagonal: one row each before verification
    if small:
        hits = windows.select("doc_id", "__name", "__doc", "__p", laid).join(F.broadcast(sown), F.col("__s") == F.col("__seed"))
        diagonals = hits.withColumn("place", place).select(*key, part).groupBy(*key).agg(F.first("__part").alias("__part"))
    else:  # seeds travel without their texts, which only the diagonals fetch
        hits = windows.select("doc_id", "__name", "__p", laid).where("__s IS NOT NULL").join(sown, F.col("__s") == F.col("__seed"))
        hits = hits.withColumn("place", place).select(*key).distinct()
        owners = long.select(F.col("doc_id").alias("__id"), F.col("__name").alias("__own"), "__doc").dropDuplicates(["__id", "__own"])
        diagonals = hits.join(owners, (F.col("__name") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select(*key, part)
    diagonals = diagonals.withColumn("__from", F.greatest(-F.col("place"), F.lit(0)))
    items = items.select(F.col("item_id").alias("__id"), "__item").distinct()
    diagonals = diagonals.join(F.broadcast(items) if small else items, F.col("item_id").eqNullSafe(F.col("__id")) & (F.col("__len") == F.size("__item")))
    span = F.least(F.lit(window), F.col("__len"))
    equal = F.transform(F.col("__part"), lambda w, i: F.when(w == F.get(F.col("__item"), F.col("__from") + i), 1).otherwise(0))
    diagonals = diagonals.where(F.size("__part") >= span).withColumn("__equal", equal).withColumn("__span", span)
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("__equal") - F.col("__span") + 1),
        lambda s: F.aggregate(F.slice(F.col("__equal"), s, F.col("__span")), F.lit(0), lambda a, x: a + x)))
    need = F.when(F.col("__len") < min_tokens, F.col("__len")).otherwise(F.ceil(F.round(F.col("__span") * F.lit(share), 6)))
    found = diagonals.withColumn("matches", best).where(F.col("matches") >= need).select("doc_id", "item_id", "place", "matches")
    short = lambda df, name: df.where(F.size(name).between(1, least - 1))
    tiny = short(named, "__item").distinct()
    whole = short(texts, "__doc").join(F.broadcast(tiny) if small else tiny, F.col("__doc") == F.col("__item"))
    whole = whole.select("doc_id", "item_id", F.lit(0).alias("place"), F.size("__doc").alias("matches"))
    return found.unionByName(whole).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document that holds benchmark text: doc_id, items (ids, ascending), n_items, matches (the most)."""
    found = overlaps(docs, benchmark, **settings).groupBy("doc_id", "item_id").agg(F.max("matches").alias("matches"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.count("*").alias("n_items"), F.max("matches").alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark text; rows with a NULL id are judged as one document."""
    bad = contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")


#: The same by definition: equal tokens along every diagonal, counted in windows that start at one.
_SPACED = "regexp_replace(lower(coalesce(text, '')), '([" + "".join(rf"\p{{{s}}}" for s in UNSPACED) + r"])', ' \1 ', 'g')"
SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_SPACED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all({_SPACED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark),
dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
bt AS (SELECT item_id, len(t) AS l, unnest(t) AS w, unnest(range(len(t))) AS q FROM b),
eq AS (SELECT doc_id, item_id, p - q AS place, n, l, q FROM dt JOIN bt USING (w)
  QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, p - q) >= least(l, {MIN_TOKENS}) * 0.75),
best AS (SELECT doc_id, item_id, place, n, l, count(*) OVER (PARTITION BY doc_id, item_id, place ORDER BY q
    RANGE BETWEEN CURRENT ROW AND (least({WINDOW}, l) - 1) FOLLOWING) AS m FROM eq),
ok AS (SELECT doc_id, item_id, max(m) AS m FROM best WHERE least(place + l, n) - greatest(place, 0) >= least({WINDOW}, l)
  AND (l >= {len(MASKS[0])} OR l = n) AND m >= CASE WHEN l < {MIN_TOKENS} THEN l ELSE ceil(round(least({WINDOW}, l) * {SHARE}, 6)) END GROUP BY doc_id, item_id)
SELECT doc_id, list(item_id ORDER BY item_id) AS items, count(*) AS n_items, max(m) AS matches FROM ok GROUP BY doc_id"""
