"""Full-text search: postings and BM25 over several fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.session import materialize

K1, B = 1.2, 0.75


def postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, field, key, tf)."""
    named = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("terms")) for f in fields))
    rows = df.select(key, F.explode(named).alias("x")).select(key, "x.field", F.explode("x.terms").alias("term"))
    return rows.groupBy("term", "field", key).agg(F.count("*").alias("tf"))


class Index:
    """Written tables of a full-text index: postings (term, field, key, tf), lengths (key, field, len)."""

    def __init__(self, df: DataFrame, key: str, fields: list[str]):
        self.key, self.fields = key, fields
        self.postings = materialize(postings(df, key, fields).sortWithinPartitions("term"), "postings")
        named = F.array(*(F.struct(F.lit(f).alias("field"), F.size(T.tokens(F.col(f))).alias("len")) for f in fields))
        self.lengths = materialize(df.select(key, F.explode(named).alias("x")).select(key, "x.field", "x.len"), "lengths")

    def search(self, query: str, k: int = 10, every: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
        """(key, score) of the k best rows for the query's terms, all of them (`every`) or any; ties by key.

        The query is cut into terms as texts are. Only postings of its terms are read (each part of the table is sorted by term).
        """
        spark, key = self.postings.sparkSession, self.key
        terms = sorted(set(spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first()[0]))
        weights = weights or {}
        sizes = self.lengths.groupBy("field").agg(F.avg("len").alias("avg_len"), F.countDistinct(key).alias("n_docs"))  # one row for each field
        tf = self.postings.filter(F.col("term").isin(terms) if terms else F.lit(False)).join(self.lengths, [key, "field"])
        df_ = tf.groupBy("term").agg(F.countDistinct(key).alias("df"))  # one row for each query term
        weight = F.create_map(*[F.lit(x) for f in self.fields for x in (f, float(weights.get(f, 1.0)))])
        scored = tf.join(F.broadcast(df_), "term").join(F.broadcast(sizes), "field")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = weight[F.col("field")] * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        per = scored.groupBy(key).agg(F.sum(part).alias("score"), F.countDistinct("term").alias("n"))
        per = per.filter(F.col("n") == len(terms)) if every else per
        return per.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def snippet(c: Column, most: int = 150) -> Column:
    """The start of a text, as shown with a hit."""
    return F.left(F.coalesce(c, F.lit("")), F.lit(most))
