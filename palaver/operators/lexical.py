"""Plain-text retrieval: every word of a query must occur, and BM25 ranks what matches.

Two ways to the same result.  ``scan_search`` reads the corpus and computes the terms
of the query alone, in one pass without a shuffle of the texts.  ``build_postings``
writes an inverted index, clustered by term, from which ``index_search`` reads the
terms of the query only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.binding import bind
from palaver.functions.text import bounded_index_text, index_text, tokens

K1, B = 1.2, 0.75
TERM_BUCKETS = 16


def query_phrases(query: str) -> list[list[str]]:
    """The words of a query, each as the tokens it is made of: all words must match, tokens of one word side by side.  Nothing in a query is an operator."""
    phrases = [[t.lower() for t in re.findall(r"[^\W_]+", word)] for word in query.split()]
    return [p for p in phrases if p]


def indexed_tokens(text: Column) -> Column:
    return tokens(index_text(bounded_index_text(text)))


def _holds_phrase(line: Column, phrase: list[str]) -> Column:
    """On tokens written as a line with a space around each."""
    return F.contains(line, F.lit(f" {' '.join(phrase)} "))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(tf: Column, df: Column, length: Column, docs: Column, mean_length: Column) -> Column:
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def scan_search(corpus: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, bm25) of the rows that hold every word of the query; an empty query matches nothing.

    Only counts of the query's terms leave the one scan; the statistics are one row, broadcast.
    """
    phrases = query_phrases(query)
    if not phrases:
        return corpus.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    terms = list(dict.fromkeys(t for p in phrases for t in p))

    def count(words: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        tf = [_count(words, t).alias(f"tf{k}") for k, t in enumerate(terms)]
        return F.struct(F.size(words).alias("dl"), *tf, _all([_holds_phrase(line, p) for p in phrases]).alias("matched"))

    told = bind(indexed_tokens(F.coalesce(F.col(text_col), F.lit(""))), count)
    # Statistics and scores read the same columns of one exchange, so the texts are read and cut into words once.
    counted = corpus.select(F.col(id_col).alias("id"), told.alias("t")).select("id", "t.*").repartition("id")
    seen = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.count("id").alias("ids"), F.count_if("matched").alias("hits"), *seen)
    scored = counted.crossJoin(F.broadcast(stats))  # one row
    score = sum((bm25(F.col(f"tf{k}"), F.col(f"df{k}"), F.col("dl"), F.col("n"), F.col("avgdl")) for k in range(len(terms))), F.lit(0.0))
    return scored.select("id", F.when(F.col("matched") & (F.col("hits") > 0), score).alias("bm25")).filter("bm25 IS NOT NULL")


def build_postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, term, id, tf, positions, dl): the length of the row travels along, so scoring needs no join for it."""
    words = corpus.select(F.col(id_col).alias("id"), indexed_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("dl", F.size("w"))
    one = words.select("id", "dl", F.posexplode("w").alias("pos", "term"))
    grouped = one.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select(F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int").alias("bucket"), "term", "id", "tf", "positions", "dl")


def write_index(corpus: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings in folders by hashed term, sorted by term in each file, and one row of statistics.

    Tasks take ranges of (bucket, term, id), so each writes few files, and a common term's postings are spread over tasks by their ids.
    """
    postings = build_postings(corpus, id_col, text_col)
    dealt = postings.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths = corpus.select(F.size(indexed_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("dl"))
    kind = dict(corpus.dtypes)[id_col]
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.lit(kind).alias("id_type")).write.parquet(f"{path}/stats")


def index_search(spark, path: str, query: str) -> DataFrame:
    """(id, bm25) from a written index: partition pruning by bucket, row groups by term."""
    phrases = query_phrases(query)
    stats = spark.read.schema("n long, avgdl double, id_type string").parquet(f"{path}/stats")
    kind = stats.first()["id_type"]
    postings = spark.read.schema(f"term string, id {kind}, tf int, positions array<int>, dl int, bucket int").parquet(f"{path}/postings")
    terms = list(dict.fromkeys(t for p in phrases for t in p))
    if not terms:
        return postings.select("id", F.lit(0.0).alias("bm25")).limit(0)
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(TERM_BUCKETS)).alias("b")).collect()]
    mine = postings.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term of the query
    scored = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    per_doc = scored.groupBy("id").agg(
        F.sum(bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))).alias("bm25"),
        F.count(F.lit(1)).alias("hits"),
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("where"),
    )
    ok = F.col("hits") == len(terms)
    for p in phrases:
        if len(p) > 1:
            ok = ok & _side_by_side(p)
    return per_doc.filter(ok).select("id", "bm25")


def _side_by_side(phrase: list[str]) -> Column:
    at = [F.element_at("where", F.lit(t)) for t in phrase]
    return F.exists(at[0], lambda s: _all([F.array_contains(at[k], s + k) for k in range(1, len(phrase))]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
