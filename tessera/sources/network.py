"""A life-cycle network derived from the supplied order tables (see FIXTURES.md).

Suppliers are processes, brands are product flows, a supplier's main brand is its reference, the other brands are
residual demands; return flag and line status name elementary flows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import weight
from ..operators import linear, linking
from .tables import table, written

#: Elementary flows in order, and characterisation factors (impact, flow, value); the last flow has none.
FLOWS = ("AF", "AO", "NF", "NO", "RF", "RO")
FACTORS = ((0, 0, 1.5), (0, 2, 0.7), (0, 3, 0.25), (1, 0, 0.1), (1, 4, 2.0), (2, 2, 0.05), (2, 3, 1.0), (2, 4, 0.5))

#: The tables that the network is derived from.
TABLES = ("nation", "supplier", "part", "lineitem")


class Network:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def n(self) -> int:
        return self.table("supplier").count()

    @cached_property
    def state(self) -> str:
        """Tells states of the tables apart by their files' names, sizes and times; contents are not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{self.dir}/{t}.parquet" for t in TABLES])
        line = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        return str(files.agg(F.count("*").alias("n"), F.sum(line).alias("h")).first())

    @cached_property
    def processes(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("location"))
        s = self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").cast("int").alias("process_idx"), F.col("s_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("region"), "location", weight(F.col("s_acctbal")).alias("volume"), (~F.coalesce(F.col("s_acctbal") > 0, F.lit(False))).alias("volume_fallback"))

    @cached_property
    def ranked(self) -> DataFrame:
        qty = self.table("lineitem").join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").cast("int").alias("process_idx"), F.col("p_brand").alias("flow")).agg(F.sum("l_quantity").alias("qty"))
        mine = W.partitionBy("process_idx")
        return written(qty.withColumn("rn", F.row_number().over(mine.orderBy(F.desc("qty"), "flow"))).withColumn("total", F.sum("qty").over(mine)))

    @cached_property
    def ports(self) -> DataFrame:
        return self.ranked.where("rn = 1").select("process_idx", "flow", F.lit(1.0).alias("coefficient"))

    @cached_property
    def residuals(self) -> DataFrame:
        return self.ranked.where("rn > 1").select("process_idx", "flow", (-0.5 * F.col("qty") / F.col("total")).alias("coefficient"))

    @cached_property
    def candidates(self) -> DataFrame:
        return linking.candidates(self.residuals, self.ports, self.processes)

    def _places(self, rows: DataFrame) -> DataFrame:
        """Adds the places of a process: its nation, its region, everywhere."""
        near = self.processes.select("process_idx", "nation", "region", "volume", "volume_fallback")
        place = lambda tier, c: F.struct(F.lit(tier).alias("tier"), c.cast("string").alias("place"))
        places = F.array(place(1, F.col("nation")), place(2, F.col("region")), place(3, F.lit("*")))
        return rows.join(near, "process_idx").withColumn("places", places).drop("nation", "region")

    @cached_property
    def offers(self) -> DataFrame:
        return written(linking.offers(self._places(self.ports).select(F.col("process_idx").alias("provider"), "flow", F.col("coefficient").alias("pivot"), "volume", "volume_fallback", "places")))

    @cached_property
    def nearest(self) -> DataFrame:
        return written(linking.nearest(self._places(self.residuals).select(F.col("process_idx").alias("consumer"), "flow", F.col("coefficient").alias("residual"), "places"), self.offers))

    @cached_property
    def demands(self) -> DataFrame:
        return self.residuals.select(F.col("process_idx").alias("consumer"), "flow", F.col("coefficient").alias("residual"))

    @cached_property
    def everywhere(self) -> DataFrame:
        """Offers with a row for each port."""
        return self.offers.where("tier = 3")

    def ruled(self, rule: str) -> linking.Factored:
        """A by a rule, as factors."""
        return linking.by_volume(self.nearest, self.offers) if rule == "split_by_process_volume" else linking.by_rule(self.demands, self.everywhere, rule)

    @cached_property
    def weighted(self) -> DataFrame:
        return linking.routed(self.nearest, self.offers)

    @cached_property
    def a(self) -> DataFrame:
        """A process has one port, and one demand of a flow, so each pair is an entry and none has to be summed."""
        return linking.activities(self.weighted)

    @cached_property
    def product(self) -> linear.Product:
        """A as a product: what ports take of places, and what demands ask of these."""
        return linking.product(self.ruled("split_by_process_volume"))

    def m(self, eps: float = 1e-15) -> DataFrame:
        """M = I - A without entries within eps of zero."""
        return linear.identity_minus(self.a, self.n, eps, self.product.diagonal())

    @cached_property
    def b(self) -> DataFrame:
        flow = F.create_map(*[x for i, f in enumerate(FLOWS) for x in (F.lit(f), F.lit(i))])
        return self.table("lineitem").groupBy(flow[F.concat("l_returnflag", "l_linestatus")].alias("row_idx"), F.col("l_suppkey").cast("int").alias("col_idx")).agg((F.sum("l_extendedprice") * 1e-6).alias("value")).where("row_idx is not null")

    @cached_property
    def c(self) -> DataFrame:
        return self.spark.createDataFrame(list(FACTORS), "row_idx int, col_idx int, value double")
