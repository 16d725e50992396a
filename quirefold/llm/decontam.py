"""Benchmark decontamination by a distributed positional inverted index.

Only DataFrame functions are used. The index holds postings (term, doc_id, pos) of training
tokens. Which lists are needed is known from the test side: each test window of ``size`` words
is looked up by its ``anchors`` rarest terms, counted over the whole corpus, so only those lists
are stored; no other list would ever be read. A window's occurrences are the intersection of the
lists after each has been shifted by its term's offset, rarest first, and each survivor is checked
word by word against the document.

Terms are indexed under ``lower()``, which folds at least what A-Z folding does; the final check
uses A-Z folding, so the result is exact.

Edge cases: null or wordless texts have no words and no hits; an item with no words has no window;
rows that share a doc_id are judged together; a null doc_id gets its n_words and no hits; extra
columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, UPPER, small, stored

#: In raw text; together with A-Z folding these are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Test-side tables above this many rows are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def fold(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def test_windows(items: DataFrame, size: int) -> DataFrame:
    """(wid, item_id, words): every run of ``size`` item words; a shorter item is one window."""
    words = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.transform(raw_words(F.col("text")), fold).alias("all")
    ).filter(F.size("all") > 0)
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))))
    cut = starts.select("item_id", F.slice("all", F.col("start"), F.lit(size)).alias("words")).distinct()
    return cut.withColumn("wid", F.concat_ws(":", F.coalesce("item_id", F.lit("")), F.array_join("words", " ")))


def token_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): the training tokens, positions from 0."""
    return docs.select("doc_id", F.posexplode(raw_words(F.col("text"))).alias("pos", "word")).select(
        "doc_id", "pos", F.lower("word").alias("term")
    )


def keyed(df: DataFrame) -> DataFrame:
    """A 64-bit key beside the term makes the hash join's probe cheap; the term still decides."""
    return df.withColumn("key", F.xxhash64("term"))


def rarest_terms(docs: DataFrame, windows: DataFrame, anchors: int) -> DataFrame:
    """(wid, item_id, words, terms[], offs[]) with the ``anchors`` rarest terms of each window.

    A window of fewer words repeats its rarest term, which changes nothing in an intersection.
    """
    terms = windows.select("wid", F.posexplode("words").alias("off", "word")).select(
        "wid", "off", F.lower("word").alias("term")
    )
    vocabulary = small(keyed(terms.select("term").distinct()), BROADCAST_ROWS)
    counts = (
        keyed(token_stream(docs)).join(vocabulary, ["key", "term"]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = (
        terms.join(counts, "term", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("n", "term", "off")))
        .filter(F.col("rank") <= anchors)
    )
    best = ranked.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "off"))).alias("a"))
    full = F.transform(
        F.sequence(F.lit(0), F.lit(anchors - 1)), lambda i: F.coalesce(F.get("a", i), F.get("a", F.lit(0)))
    )
    return windows.join(best, "wid").select(
        "wid", "item_id", "words", full["term"].alias("terms"), full["off"].alias("offs")
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos): the index's lists of the given ``terms``, written to the shared folder."""
    wanted = small(keyed(terms.select("term").distinct()), BROADCAST_ROWS)
    found = keyed(token_stream(docs)).join(wanted, ["key", "term"]).select("term", "doc_id", "pos")
    return stored(found.filter(F.col("doc_id").isNotNull()), "postings")


def phrase_candidates(index: DataFrame, windows: DataFrame, anchors: int) -> DataFrame:
    """(doc_id, start, item_id, words): starts at which all anchor lists of a window meet."""
    first = windows.withColumn("term", F.col("terms")[0])
    hits = (
        index.join(small(first, BROADCAST_ROWS), "term")
        .withColumn("start", F.col("pos") - F.col("offs")[0])
        .filter(F.col("start") >= 0)
        .select("doc_id", "start", "item_id", "words", "terms", "offs")
    )
    for k in range(1, anchors):
        other = index.select("doc_id", F.col("term").alias("t"), F.col("pos").alias("p"))
        hits = (
            hits.withColumn("t", F.col("terms")[k])
            .withColumn("p", F.col("start") + F.col("offs")[k])
            .join(other, ["doc_id", "t", "p"], "left_semi")
        )
    return hits.select("doc_id", "start", "item_id", "words")


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, pos): places of a query's rarest term that have all its terms near.

    ``queries`` is (query_id, terms ARRAY<STRING>); a term is near at most ``within`` words away,
    in any order. Null or empty term lists match nothing.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).select(
        "query_id", F.lower("term").alias("term")
    ).distinct()
    index = postings(docs, terms)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "term")))
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    seeds = index.join(ranked.filter("rank = 1").select("query_id", "term"), "term").select("query_id", "doc_id", "pos")
    others = index.join(ranked.select("query_id", "term"), "term").select(
        "query_id", "doc_id", F.col("term").alias("other"), F.col("pos").alias("at")
    )
    # Equi-join on cells of ``within`` words, each seed looking into its own and both next cells.
    width = max(within, 1)
    others = others.withColumn("cell", F.floor(F.col("at") / width))
    probes = seeds.withColumn("cell", F.floor(F.col("pos") / width)).withColumn(
        "cell", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)]))
    )
    near = probes.join(others, ["query_id", "doc_id", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    return (
        near.groupBy("query_id", "doc_id", "pos")
        .agg(F.countDistinct("other").alias("met"))
        .join(need, "query_id")
        .filter("met = need")
        .select("query_id", "doc_id", "pos")
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, anchors: int = 3) -> DataFrame:
    """One row per document row: n_words, n_hit, items (sorted ids) and text; see the module."""
    windows = stored(rarest_terms(docs, test_windows(items, size), anchors), "windows")
    index = postings(docs, windows.select(F.explode("terms").alias("term")))
    found = (
        phrase_candidates(index, windows, anchors)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("start", "item_id", "words")).alias("cands"))
    )
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left")
    words = raw_words(F.col("text"))
    holds = lambda c: F.transform(F.slice(F.col("all"), c["start"] + 1, F.size(c["words"])), fold) == c["words"]
    kept = joined.withColumn("all", words).withColumn(
        "hits", F.when(F.col("cands").isNotNull(), F.filter("cands", holds)).otherwise(F.expr("filter(cands, x -> false)"))
    )
    covered = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1)))
    return kept.select(
        "doc_id",
        "text",
        F.size("all").cast("long").alias("n_words"),
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.col("hits")["item_id"])), F.array().cast("array<string>")).alias("items"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("items") > 0, F.col("n_hit")).otherwise(0).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )
