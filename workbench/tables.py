"""Test tables as domain tables. ``workbench/sql.py`` states the same rules in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlens.functions.text import tokens
from paperlens.operators.frames import computed_once
from paperlens.schemas import AUTHOR, PAPER_SOURCE, RAW_PAPER

VECTOR_DIMENSION = 64
WORD_DIMENSION = 100


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        """Files of fewer splits than cores (such as one row group) are dealt to all cores."""
        cores, df = self.spark.sparkContext.defaultParallelism, self.given("documents")
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def raw_papers(self) -> DataFrame:
        """Every 11th paper lacks its title, every 13th has a malformed date."""
        d = F.col("doc_id")
        year, month = 2015 + F.floor(d / 20) % 5, 1 + d % 12
        datesort = F.when(d % 13 == 0, F.lit("2015-01-01")).otherwise(
            F.concat(year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("15"))
        )

        def author(letter: str, number: Column) -> Column:
            values = {
                "auid": F.concat(F.lit(letter), number.cast("string")),
                "indexed_name": F.concat(F.lit("N"), (d % 5).cast("string")),
                "surname": F.concat(F.lit("S"), (number % 7).cast("string")),
            }
            return F.struct(*[
                values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AUTHOR.fields
            ])

        source = {
            "publishername": F.col("lang"), "sourcetitle": F.concat(F.lit("Journal "), F.col("source")),
            "sourcetitle_abbrev": F.col("source"),
        }
        return self.documents().select(
            datesort.alias("datesort"), d.cast("string").alias("eid"), F.col("source").alias("issn"),
            F.when(d % 11 == 0, None).otherwise(F.split("text", "\n")[0]).alias("title"),
            F.col("text").alias("abstr"),
            F.array(author("a", d % 37), author("b", d * 7 % 41)).alias("au"),
            F.array("lang", F.concat(F.lit("A"), (d % 5).cast("string"))).alias("subjareas"),
            F.struct(*[
                source.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPER_SOURCE.fields
            ]).alias("source"),
        )

    def full_raw_papers(self) -> DataFrame:
        """``raw_papers`` with all columns of the source, those that are not known null."""
        partial = self.raw_papers()
        return partial.select(*[
            F.col(f.name) if f.name in partial.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_PAPER.fields
        ])

    def raw_hindex_snapshots(self) -> list[DataFrame]:
        """(auid, hindex) of the authors of the raw papers; the newer snapshot holds those of even number."""
        authors = self.raw_papers().select(F.explode("au.auid").alias("auid")).distinct()
        number = F.substring("auid", 2, 10).cast("long")
        return [authors.select("auid", (number * 3 % 17).alias("hindex")),
                authors.where(number % 2 == 0).select("auid", (number % 11).alias("hindex"))]

    def papers(self) -> DataFrame:
        """All documents as clean papers."""
        d = F.col("doc_id")
        return self.documents().select(
            d.cast("string").alias("eid"), F.col("source").alias("issn"),
            F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstr"),
            F.array("lang", F.concat(F.lit("A"), (d % 5).cast("string"))).alias("subjareas"),
            F.concat(F.lit("Journal "), F.col("source")).alias("sourcetitle"),
            (2015 + F.floor(d / 20) % 5).cast("short").alias("year"), (1 + d % 12).cast("short").alias("month"),
        )

    def dated_authors(self) -> DataFrame:
        d = F.col("doc_id")
        auids = F.array(
            F.concat(F.lit("a"), (d % 37).cast("string")), F.concat(F.lit("b"), (d * 7 % 41).cast("string"))
        )
        return self.documents().select(
            d.cast("string").alias("eid"), F.col("source").alias("issn"),
            (2015 + F.floor(d / 20) % 5).cast("short").alias("year"), (1 + d % 12).cast("short").alias("month"),
            F.explode(auids).alias("auid"),
        )

    def vectors(self) -> DataFrame:
        return self.given("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")
        )

    def word_vectors(self) -> DataFrame:
        """All tokens but those of one character have a vector; the latter are the unknown words."""
        word = F.col("word")
        words = (
            self.documents().select(computed_once(F.array_distinct(tokens(F.col("text")))).alias("words"))
            .select(F.explode("words").alias("word"))
            .where(F.length("word") > 1).distinct()
        )
        first, last = F.ascii(word), F.ascii(F.reverse(word))
        vector = F.transform(
            F.sequence(F.lit(0), F.lit(WORD_DIMENSION - 1)),
            lambda i: (F.length(word) * (i + 1) + first * (i % 7) + last * (i % 3)) % 17,
        )
        return words.select("word", vector.cast("array<float>").alias("embedding"))

    def paper_authors(self) -> DataFrame:
        """(eid, issn, auid): suppliers as authors of orders, customer groups as journals."""
        orders = self.given("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.concat(F.lit("J"), (F.col("o_custkey") % 50).cast("string")).alias("issn"),
        )
        return self.given("lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(
            F.col("l_orderkey").cast("string").alias("eid"), "issn", F.col("l_suppkey").cast("string").alias("auid")
        )

    def author_names(self) -> DataFrame:
        """(auid, indexed_name): one to four names per supplier."""
        name = F.col("l_partkey") % (1 + F.col("l_suppkey") % 4)
        return self.given("lineitem").select(
            F.col("l_suppkey").cast("string").alias("auid"), F.concat(F.lit("N"), name.cast("string")).alias("indexed_name")
        )

    def hindex_snapshots(self) -> list[DataFrame]:
        by_balance = self.given("customer").select(
            F.col("c_custkey").cast("string").alias("auid"), F.floor(F.col("c_acctbal") / 100).alias("hindex")
        )
        by_orders = self.given("orders").groupBy("o_custkey").agg(F.count("*").alias("hindex"))
        return [
            by_balance,
            *[by_orders.where(F.col("o_custkey") % n == 0)
              .select(F.col("o_custkey").cast("string").alias("auid"), "hindex") for n in (2, 3)],
        ]

    def journal_authors(self) -> DataFrame:
        """(issn, auid): customers as authors of their market segment."""
        return self.given("customer").select(
            F.col("c_mktsegment").alias("issn"), F.col("c_custkey").cast("string").alias("auid")
        )

    def authority_requests(self) -> DataFrame:
        """(issn, auid): lines ask for authors up to twice the customers' numbers, so half are unknown."""
        segments = self.given("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("issn"))
        orders = self.given("orders").select("o_custkey", F.col("o_orderkey") % 2 + 1).toDF("o_custkey", "times")
        return orders.join(segments, "o_custkey").select(
            "issn", (F.col("o_custkey") * F.col("times")).cast("string").alias("auid"))

    def citations(self) -> DataFrame:
        orders = self.given("orders").select(
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.concat(F.lit("J"), (F.col("o_custkey") % 50).cast("string")), "o_orderkey",
        ).toDF("datesort", "issn", "l_orderkey")
        return self.given("lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").select(
            "datesort", "issn", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
        )

    def submissions(self) -> DataFrame:
        """(query_id, text, target_issn, year): benchmark items sent to a journal in 2018 or 2019."""
        i = F.col("item_id")
        return self.given("benchmark").select(
            i.cast("string").alias("query_id"), "text", F.concat(F.lit("src"), (i % 20).cast("string")).alias("target_issn"),
            (2018 + i % 2).cast("short").alias("year"),
        )
