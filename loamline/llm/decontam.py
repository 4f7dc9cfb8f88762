"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over consecutive words: the words at its selected
positions are hashed, the others may be anything. Hashes of all positions of the
benchmark items are joined with those of all positions of the documents; around
each hit the two word sequences are laid side by side and compared, so that
substituted words cost a little of the overlap instead of all of it.

An item too short for a mask has one seed, all of its words. One of SHORT words
or more is looked for anywhere in a document; a still shorter one, which says
little within a text, only as a document's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import marked, marks, stored

#: Selected positions of each mask: weight 6, span 9.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 4, 6, 7, 8))
SPAN = 9
#: Words of the shortest item that is looked for within documents.
SHORT = 5
#: Words compared before and from the seed's start on; the least number compared (or the whole item, if it is shorter); the least share that is equal.
BEFORE, AFTER, LEAST, OVERLAP = 8, 16, 13, 0.75
#: Seeds and item words that are broadcast at most; larger benchmarks are joined by exchange.
BROADCAST_SEEDS, BROADCAST_WORDS = 500_000, 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null counts as empty."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _seeds(w: DataFrame, lengths: list[int], whole: bool, *keep: str) -> DataFrame:
    """A row per seed: keep, at, seed. lengths: of the items under SPAN words; they are runs of that many words, the whole text for items and for those under SHORT."""
    least, ahead = min([SPAN, *lengths]), F.size("words") - F.col("at")
    at = w.where(F.size("words") >= least).select(*{*keep, "words"}, F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    hashes = [F.when(ahead >= SPAN, F.xxhash64(F.lit(m), *(F.get("words", F.col("at") + p) for p in mask))) for m, mask in enumerate(MASKS)]
    fits = lambda n: (F.size("words") == n) if whole or n < SHORT else (ahead >= n)
    hashes += [F.when(fits(n), F.xxhash64(F.lit(-n), *(F.get("words", F.col("at") + p) for p in range(n)))) for n in lengths]
    # No higher-order function here: the words would be copied for each position.
    return at.select(*keep, "at", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, hits, matched, compared, doc_word, item_word.

    hits counts the seeds that led to a verified overlap; in the best one (the
    most equal words, then the greatest share, then the first) matched of
    compared words are equal, from word doc_word of the document and item_word
    of the item on, counted from 0. An overlap reaches from BEFORE words before
    the seed to AFTER words from its start on, as far as both texts go, or is a
    stretch of LEAST words of that around the seed; it must compare LEAST words,
    or all of a shorter item, of which the share OVERLAP is equal. Items under
    SPAN words must be there word for word (see SHORT); empty ones have no rows.
    Null texts count as empty, null ids (of documents and items) are ids like any
    other, rows that repeat an id are counted together. Other columns are ignored.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where("words[0] <> ''").withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "words")).dropDuplicates(["item"])
    sizes = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("all"), F.array_sort(F.collect_set(F.when(F.size("words") < SPAN, F.size("words")))).alias("short")).first()
    seeds = _seeds(items, sizes["short"], True, "item", "words").select("item", F.col("at").alias("item_at"), F.size("words").alias("item_len"), "seed")
    src = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    if sizes["all"] <= BROADCAST_WORDS and sizes["all"] * len(MASKS) <= BROADCAST_SEEDS:
        items = F.broadcast(items)
        hit = _seeds(src, sizes["short"], False, "doc_id", "words").join(F.broadcast(seeds), "seed")
    else:
        # Seeds are exchanged without texts; the words of those that hit are fetched by row.
        rows = stored(src.withColumn("row", F.monotonically_increasing_id()), "decontam")
        hit = _seeds(rows.select("row", "words"), sizes["short"], False, "row").join(seeds, "seed").drop("seed").join(rows, "row")
    # The stretch both have: from `back` words before the seed, `n` words long.
    back = F.least(F.lit(BEFORE), F.col("at"), F.col("item_at"))
    ahead = F.least(F.lit(AFTER), F.size("words") - F.col("at"), F.col("item_len") - F.col("item_at"))
    hit = hit.select("doc_id", "item", "item_len", back.alias("back"), (F.col("at") - back).alias("doc_start"), (F.col("item_at") - back).alias("item_start"), (back + ahead).alias("n"), F.slice("words", F.col("at") - back + 1, back + ahead).alias("stretch"))
    hit = hit.where(F.col("n") >= F.least(F.lit(LEAST), F.col("item_len"))).join(items, "item")
    hit = hit.withColumn("equal", F.zip_with("stretch", F.slice("words", F.col("item_start") + 1, F.col("n")), lambda a, b: (a == b).cast("int")))

    def overlap(start, n):
        matched = F.aggregate(F.slice("equal", start + 1, n), F.lit(0), lambda s, x: s + x)
        return F.struct(matched.alias("matched"), (-n).alias("n"), (-(F.col("doc_start") + start)).alias("d"), (-(F.col("item_start") + start)).alias("i"))

    around = F.when(F.col("n") > LEAST, F.transform(F.sequence(F.greatest(F.lit(0), F.col("back") + SPAN - LEAST), F.least("back", F.col("n") - LEAST)), lambda s: overlap(s, F.lit(LEAST))))
    both = F.concat(F.array(overlap(F.lit(0), F.col("n"))), F.coalesce(around, F.array().cast("array<struct<matched:int,n:int,d:int,i:int>>")))
    share = F.when(F.col("item_len") < SPAN, 1.0).otherwise(OVERLAP)
    hit = hit.withColumn("best", F.array_max(F.filter(both, lambda x: x["matched"] >= -x["n"] * share))).where("best is not null")
    found = hit.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"), F.max("best").alias("best"))
    return found.select("doc_id", "item_id", "hits", F.col("best.matched").alias("matched"), (-F.col("best.n")).alias("compared"), (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns. Its rows are numbered in a stored copy, so that null and repeated ids don't matter."""
    row = "loamline_row"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found = marks(contaminated(numbered, benchmark, row, text_col).select(F.col("doc_id").alias(row)), row, "contaminated")
    return marked(numbered, row, found, False).drop(row)


def oracle_sql() -> str:
    """The same result in DuckDB, from the words themselves in place of their hashes."""
    key = "CASE m " + " ".join(f"WHEN {m} THEN [{', '.join(f'words[pos + {p + 1}]' for p in mask)}]" for m, mask in enumerate(MASKS)) + " END"
    spaced = f"SELECT *, {key} AS seed FROM (SELECT *, unnest(range(len(words) - {SPAN} + 1)) AS pos FROM {{}} WHERE len(words) >= {SPAN}), (SELECT unnest(range({len(MASKS)})) AS m)"
    words_sql = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    return f"""
        WITH d AS (SELECT doc_id, {words_sql} AS words FROM documents),
        b AS (SELECT item_id, {words_sql} AS words FROM benchmark),
        ds AS ({spaced.format("d")} UNION ALL
               SELECT doc_id, words, pos, -len(s) AS m, s AS seed FROM (SELECT doc_id, words, pos, words[pos + 1 : pos + n] AS s FROM (SELECT *, unnest(range(len(words) - n + 1)) AS pos FROM d, (SELECT DISTINCT len(words) AS n FROM b WHERE len(words) < {SPAN}) WHERE len(words) >= n AND (n >= {SHORT} OR len(words) = n)))),
        bs AS ({spaced.format("b")} UNION ALL SELECT item_id, words, 0 AS pos, -len(words) AS m, words AS seed FROM b WHERE len(words) < {SPAN} AND words[1] <> ''),
        h AS (SELECT row_number() OVER () AS hid, ds.doc_id, bs.item_id, ds.words AS dw, bs.words AS bw, ds.pos AS da, bs.pos AS ba,
                     least({BEFORE}, ds.pos, bs.pos) AS back, least({AFTER}, len(ds.words) - ds.pos, len(bs.words) - bs.pos) AS ahead
              FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
        v AS (SELECT hid, doc_id, item_id, back, back + ahead AS n, da - back AS d, ba - back AS i, CASE WHEN len(bw) < {SPAN} THEN 1 ELSE {OVERLAP} END AS share,
                     list_transform(range(back + ahead), lambda k: (dw[da - back + k + 1] = bw[ba - back + k + 1])::INT) AS e
              FROM h WHERE back + ahead >= least({LEAST}, len(bw))),
        w AS (SELECT hid, doc_id, item_id, share, list_sum(e) AS matched, n, d, i FROM v UNION ALL
              SELECT hid, doc_id, item_id, share, list_sum(e[s + 1 : s + {LEAST}]) AS matched, {LEAST} AS n, d + s AS d, i + s AS i FROM (SELECT *, unnest(range(greatest(0, back + {SPAN - LEAST}), least(back, n - {LEAST}) + 1)) AS s FROM v WHERE n > {LEAST}))
        SELECT doc_id, item_id, count(DISTINCT hid) AS hits, arg_max(matched, row(matched, -n, -d, -i))::INT AS matched, arg_max(n, row(matched, -n, -d, -i)) AS compared,
               arg_max(d, row(matched, -n, -d, -i)) AS doc_word, arg_max(i, row(matched, -n, -d, -i)) AS item_word
        FROM w WHERE matched >= share * n GROUP BY doc_id, item_id
    """
