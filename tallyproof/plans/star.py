"""The order tables seen as entities with attributes.

An order is an entity. Its customer plays the sponsor, its priority the phases, its line items the
interventions and, through the supplier's nation, the countries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.operators.dimensions import Dimension, listed_order
from tallyproof.functions.text import single

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

PRIORITY = Dimension(
    "priority",
    "No priority",
    lambda: single(F.col("o_orderpriority")),
    order=listed_order(PRIORITIES),
    closed=True,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"))


def nations_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``(entity_id, key)``: supplier nations, one row per line item."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_id"), "l_suppkey")
    supplied = lines.join(
        table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"),
        F.col("l_suppkey") == F.col("s_suppkey"),
    )
    return supplied.join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("entity_id", F.col("n_name").alias("key"))


def parts_of_orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """``(entity_id, pos, columns...)``: part attributes, one row per line item."""
    parts = table(spark, sf, "part").select("p_partkey", *columns)
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_orderkey").alias("entity_id"),
            F.col("l_linenumber").alias("pos"),
            "l_partkey",
            "l_returnflag",
        )
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("entity_id", "pos", "l_returnflag", *columns)
    )


def part_keys(spark: SparkSession, sf: str) -> DataFrame:
    """``(entity_id, key)``: distinct parts of an order."""
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("key"))
        .distinct()
    )


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """``(entity_id, key, label)``: distinct part names of an order."""
    return (
        parts_of_orders(spark, sf, "p_name")
        .select("entity_id", F.col("p_name").alias("key"))
        .distinct()
        .withColumn("label", F.col("key"))
    )


#: Customer, date and status of an order in SQL, as :func:`studies` builds them.
STUDIES_SQL = """
studies as (
  select o_orderkey, c_name, c_mktsegment, o_orderpriority, o_totalprice,
         nullif(o_orderstatus, 'P') as status,
         case o_orderstatus when 'F' then strftime(o_orderdate, '%Y')
              when 'O' then strftime(o_orderdate, '%Y-%m') end as start_date,
         case o_orderpriority when '1-URGENT' then ['EARLY_PHASE1']
              when '2-HIGH' then ['PHASE1', 'PHASE2'] when '3-MEDIUM' then ['PHASE3']
              when '5-LOW' then ['NA'] end as phases,
         cast(floor(o_totalprice / 250) as bigint) as enrolled,
         rtrim('Order ' || o_orderkey || ' of ' || c_name || ': '
               || repeat(o_orderpriority || '  ', 11)) as title
  from orders join customer on o_custkey = c_custkey
)"""


def _absent(module: str) -> Column:
    """A module of the study record with nothing in it."""
    fields = S.STUDY["protocolSection"].dataType[module].dataType.fields
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).alias(module)


def studies(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the shape of study records: one row per order, scalar modules and phases.

    Attributes with one row per line item stay in tables of pairs, because an order may have any
    number of them.
    """
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(F.col("o_orderstatus") == "F", F.substring(day, 1, 4)).when(
        F.col("o_orderstatus") == "O", F.substring(day, 1, 7)
    )
    priority = F.col("o_orderpriority")

    def listed(*values):
        return F.array(*[F.lit(v) for v in values])

    phases = (
        F.when(priority == "1-URGENT", listed("EARLY_PHASE1"))
        .when(priority == "2-HIGH", listed("PHASE1", "PHASE2"))
        .when(priority == "3-MEDIUM", listed("PHASE3"))
        .when(priority == "5-LOW", listed("NA"))
    )
    title = F.rtrim(
        F.concat(
            F.lit("Order "),
            F.col("o_orderkey").cast("string"),
            F.lit(" of "),
            F.col("c_name"),
            F.lit(": "),
            F.repeat(F.concat(priority, F.lit("  ")), F.lit(11)),
        )
    )
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    # Leaf by leaf: a cast of the whole record would be evaluated whole for every field that is read.
    section = F.struct(
        F.struct(F.format_string("NCT%08d", F.col("o_orderkey")).alias("nctId"), title.alias("briefTitle")).alias("identificationModule"),
        F.struct(
            F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("overallStatus"), F.struct(date.alias("date")).alias("startDateStruct")
        ).alias("statusModule"),
        F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("class")).alias("leadSponsor")).alias(
            "sponsorCollaboratorsModule"
        ),
        F.struct(
            phases.alias("phases"), F.struct(F.floor(F.col("o_totalprice") / 250).cast("long").alias("count")).alias("enrollmentInfo")
        ).alias("designModule"),
        *[_absent(name) for name in ("armsInterventionsModule", "contactsLocationsModule", "conditionsModule")],
    )
    return orders.select("o_orderkey", section.alias("protocolSection"))


def agent_name() -> Column:
    """The name that a part has as an intervention: one for each part, of a single agent."""
    return F.concat(F.substring_index("p_name", " ", -1), F.col("p_partkey").cast("string"))


#: The lists of :func:`full_studies` in SQL, one row per line item.
LISTS_SQL = """
listed as (
  select 'NCT' || lpad(cast(l_orderkey as varchar), 8, '0') as entity_id, l_linenumber as pos,
         case when p_type = 'PROMO' then 'PROCEDURE' else 'DRUG' end as kind,
         split_part(p_name, ' ', 2) || p_partkey as key, n_name as nation,
         case when l_returnflag = 'A' then upper(split_part(p_name, ' ', 2) || p_partkey)
              else split_part(p_name, ' ', 2) || p_partkey end as spelled
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
),
agents as (
  select entity_id, key,
         first_value(spelled) over (partition by entity_id, key order by pos, spelled) as label
  from listed where kind = 'DRUG'
)
"""


def full_studies(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`studies` with interventions and locations: one of each for every line item.

    The lists are those of one order; a range of orders with very many lines stays one row each, as
    a landed record is.
    """
    lines = parts_of_orders(spark, sf, "p_partkey", "p_name", "p_type")
    named = agent_name()
    spelled = F.when(F.col("l_returnflag") == "A", F.upper(named)).otherwise(named)
    kind = F.when(F.col("p_type") == "PROMO", F.lit("PROCEDURE")).otherwise(F.lit("DRUG"))
    interventions = lines.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", spelled.alias("name"), kind.alias("type")))).alias("_i")
    )
    locations = nations_of_orders(spark, sf).groupBy("entity_id").agg(F.collect_list("key").alias("_l"))
    whole = (
        studies(spark, sf)
        .join(interventions, F.col("o_orderkey") == interventions.entity_id, "left")
        .drop("entity_id")
        .join(locations, F.col("o_orderkey") == locations.entity_id, "left")
    )
    shape = S.STUDY["protocolSection"].dataType
    fields = {f.name: F.col(f"protocolSection.{f.name}") for f in shape.fields}
    agents = F.transform("_i", lambda i: F.struct(i["type"].alias("type"), i["name"].alias("name")))
    fields["armsInterventionsModule"] = F.struct(agents.alias("interventions"))
    fields["contactsLocationsModule"] = F.struct(
        F.transform("_l", lambda c: F.struct(c.alias("country"))).alias("locations")
    )
    section = F.struct(*[c.alias(n) for n, c in fields.items()])
    return whole.select("o_orderkey", section.alias("protocolSection"))
