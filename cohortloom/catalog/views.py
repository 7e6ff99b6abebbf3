"""The test tables in the shape of the record files. Every view reads its tables whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _records(self) -> DataFrame:
        # Parts come first: a filter on codes or descriptions then holds before the lines meet the orders.
        line = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return line.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def conditions(self) -> DataFrame:
        return self._records().select(
            F.col("o_custkey").alias("PATIENT"),
            F.col("l_shipdate").cast("date").alias("START"),
            F.col("l_partkey").cast("string").alias("CODE"),
            F.col("p_name").alias("DESCRIPTION"),
            F.col("l_orderkey").alias("ENCOUNTER"),
        )

    def encounters(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("PATIENT"),
            F.col("o_orderkey").alias("Id"),
            F.col("o_orderdate").cast("date").alias("START"),
            F.col("o_orderpriority").alias("DESCRIPTION"),
        )

    def observations(self) -> DataFrame:
        status = F.get(
            F.array(*[F.lit(s) for s in ("Current smoker", " former smoker ", "never smoker")]),
            F.col("l_linenumber") - 1,
        )
        value = (
            F.when(F.col("p_brand") == "Brand#9", F.coalesce(status, F.lit("unknown")))
            .when(F.col("l_discount") == 0.1, "not done")
            .otherwise(F.col("l_quantity").cast("string"))
        )
        return self._records().select(
            F.col("o_custkey").alias("PATIENT"),
            F.col("l_shipdate").cast("date").alias("DATE"),
            F.col("p_brand").alias("CODE"),
            F.lower("p_brand").alias("DESCRIPTION"),
            value.alias("VALUE"),
        )

    def feature_choice(self) -> DataFrame:
        """All brands but those whose number ends in 5."""
        return self.table("part").select(
            F.lower("p_brand").alias("DESCRIPTION"),
            F.when(F.col("p_brand").endswith("5"), "N").otherwise("Y").alias("keep."),
        ).distinct()

    def patients(self) -> DataFrame:
        race = F.get(
            F.array(*[F.lit(r) for r in ("white", "black", "asian", "other", "native")]),
            F.array_position(
                F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]),
                F.col("c_mktsegment"),
            ).cast("int") - 1,
        )
        birth = F.date_add(F.lit("1930-01-01").cast("date"), ((F.col("c_custkey") * 37) % 20000).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").alias("Id"),
            F.split_part("c_name", F.lit("#"), F.lit(1)).alias("FIRST"),
            F.split_part("c_name", F.lit("#"), F.lit(2)).alias("LAST"),
            birth.alias("BIRTHDATE"),
            F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("GENDER"),
            race.alias("RACE"),
        )

    def genotyped(self) -> DataFrame:
        """Patients with genotype files: two of the five market segments."""
        chosen = self.table("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
        return chosen.select(F.col("c_custkey").alias("PATIENT"))

    def codes_a(self) -> DataFrame:
        listed = self.table("part").filter((F.col("p_size") == 1) & F.col("p_type").isin("PROMO", "LARGE", "SMALL"))
        return listed.select(F.col("p_partkey").cast("string").alias("code"))

    def codes_b(self) -> DataFrame:
        listed = self.table("part").filter((F.col("p_size") == 1) & F.col("p_type").isin("PROMO", "MEDIUM"))
        return listed.select(F.col("p_partkey").cast("string").alias("id"))

    @staticmethod
    def _site() -> tuple[Column, Column]:
        b = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
        kinds = F.array(*[F.lit(k) for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
        t = F.array_position(kinds, F.col("p_type")).cast("int") - 1
        return b, t

    @staticmethod
    def _letter(letters: str, b: Column, t: Column) -> Column:
        return F.substr(F.lit(letters), (b + t) % 4 + 1, F.lit(1))

    def calls(self) -> DataFrame:
        """Genotype calls: a site for each brand and type of part."""
        b, t = self._site()
        ancestral, variant = self._letter("ACGT", b, t), self._letter("CGTA", b, t)
        second = F.when(t == 0, F.concat(F.lit(", "), self._letter("GTAC", b, t))).otherwise("")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        allele = (
            F.when((flag == "R") & (status == "F"), F.concat(F.lit(" "), variant))
            .when(flag != "A", F.concat(ancestral, F.lit(">"), variant))
            .otherwise(ancestral)
        )
        return self._records().select(
            F.col("o_custkey").alias("PATIENT_ID"),
            (F.lit(1) + (b - 1) % 22).cast("string").alias("CHROMOSOME"),
            (F.lit(1000) + b * 100 + t * 10).alias("LOCATION"),
            ancestral.alias("ANCESTRAL_ALLELE"),
            F.concat(F.lit('"'), variant, second, F.lit('"')).alias("VARIANT_ALLELE_LIST"),
            allele.alias("ALLELE"),
            F.when(flag == "R", "True").when(flag == "A", "1").otherwise("false").alias("VARIANT"),
        )

    def sumstats(self) -> DataFrame:
        """One row per site; at some sites the alleles differ from the calls, at some the effect is unknown."""
        b, t = self._site()
        sites = (
            self.table("part")
            .groupBy(b.alias("b"), t.alias("t"))
            .agg(F.sum("p_size").alias("s"), F.count(F.lit(1)).alias("n"))
        )
        b, t = F.col("b"), F.col("t")
        rank = (F.col("n") % 4).cast("int")
        p_values = F.array(*[F.lit(p) for p in (0.5, 0.01, 0.000001, 0.000000001)])
        return sites.select(
            (F.lit(1) + (b - 1) % 22).cast("string").alias("chromosome"),
            F.concat((F.lit(1000) + b * 100 + t * 10).cast("string"), F.lit(".0")).alias("base_pair_location"),
            self._letter("ACGT", b, t).alias("effect_allele"),
            F.when((b + t) % 7 == 0, "N").otherwise(self._letter("CGTA", b, t)).alias("other_allele"),
            F.when((b * 6 + t) % 11 != 0, F.round((F.col("s") / F.col("n") - 25) / 100, 4)).alias("beta"),
            F.get(p_values, rank).alias("p_value"),
        )

    def blocks(self) -> DataFrame:
        """Coordinate blocks around the sites; some miss theirs."""
        b, t = self._site()
        sites = self.table("part").select(b.alias("b"), t.alias("t")).distinct()
        b, t = F.col("b"), F.col("t")
        middle = F.lit(1000) + b * 100 + t * 10
        shift = F.when((b + t) % 9 == 0, 4).otherwise(0)
        return sites.select(
            (F.lit(1) + (b - 1) % 22).cast("string").alias("chrom"),
            (middle - 2 + shift).alias("lo"),
            (middle + 2 + shift).alias("hi"),
            (F.lit(5000) + b).alias("off"),
        )

    def edges(self) -> DataFrame:
        """A binary tree over the parts; part 0 is its own parent, a cycle."""
        return self.table("part").select(
            F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent"), F.col("p_partkey").alias("child")
        )

    def scores(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y"),
            (((F.col("doc_id") * 37) % 101) / F.lit(100.0)).alias("p"),
            F.when(F.col("toxic") == 1, "X_agg_earlyfusion").otherwise("X_temp_flat").alias("run"),
        )

    def ml(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.when(F.col("label") < 3, 1).otherwise(0).alias("y"), "embedding"
        )
