"""A household-panel export derived from the driver's order tables.

Family = customer, wave = two-year period of the order date (capped at 3),
territory = nation.  One wide row per customer, every cell a string, with
the four kinds of missing answer (null, 'NA', all-'NA' list, unmapped
profile value) produced by fixed key rules.  Built with one aggregate of
``orders`` on the customer key; nation/region are dimension lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

WAVES = (0, 1, 2, 3)
STATUSES = ("F", "O", "P")
KEY = "id_family"
TERRITORY = "territory"


def _per_wave(template: str) -> str:
    """The template once per wave, comma-joined ({w}: the wave)."""
    return ",\n       ".join(template.replace("{w}", str(w)) for w in WAVES)


# One aggregate of the orders on the customer key gives everything the export
# needs (one shuffle).  The latest order of a wave, by date then key, gives
# its status and priority.
_HAS = ",\n       ".join(f"bool_or(wave = {{w}} and o_orderstatus = '{s}' and o_totalprice > 250000) as has_{s}_{{w}}"
                         for s in STATUSES)
_PER_CUSTOMER = f"""
select o_custkey as c_custkey,
       {_per_wave("max(if(wave = {w}, struct(o_orderdate, o_orderkey, o_orderstatus, o_orderpriority), null)) as latest_{w}")},
       {_per_wave("sum(if(wave = {w}, cast(o_totalprice as decimal(18,2)), null)) as income_{w}")},
       {_per_wave(_HAS)},
       count_if(wave = 0) as orders_0, bool_or(o_totalprice > 450000) as any_big,
       bool_or(o_orderstatus = 'P' and o_orderpriority = '1-URGENT') as any_urgent_p,
       bool_or(o_totalprice < 20000) as any_small
from (select *, cast(least(3, floor((year(o_orderdate) - 1995) / 2)) as int) as wave from {{orders}})
group by o_custkey"""


def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with everything the export needs."""
    return spark.sql(_PER_CUSTOMER, orders=table(spark, sf_dir, "orders"))


def _sim_nao(flag: str) -> str:
    return f"if(coalesce({flag}, false), 'sim', 'nao')"


_ITEMS = ", ".join(f"if(coalesce(has_{s}_{{w}}, false), '{s}', 'NA')" for s in STATUSES)
# The cells by export column.  One SQL text builds the whole plan: a call to
# the JVM for every expression took longer than the query.
_EXPORT = f"""
select cast(c.c_custkey as string) as {KEY}, n_name as {TERRITORY}, r_name as region, c_mktsegment as segment,
       case when c.c_custkey % 17 = 0 then 'NA' when c.c_custkey % 13 = 0 then 'talvez'
            else {_sim_nao("any_big")} end as flag_a,
       if(c.c_custkey % 19 = 0, 'NA', {_sim_nao("any_urgent_p")}) as flag_b,
       {_sim_nao("any_small")} as flag_c,
       {_sim_nao("c_acctbal < 0")} as flag_d,
       {_per_wave("coalesce(latest_{w}.o_orderstatus, 'NA') as Status_T{w}")},
       {_per_wave("if((c.c_custkey * 7 + {w}) % 11 = 0, 'NA', coalesce(latest_{w}.o_orderpriority, 'NA')) as Priority_T{w}")},
       {_per_wave("if(c.c_custkey % 31 = 0 and {w} >= 2, 'NA', coalesce(cast(income_{w} as string), 'NA')) as Income_T{w}")},
       {_per_wave(f"case when c.c_custkey % 29 = 0 then null when c.c_custkey % 23 = 0 then 'NA' "
                  f"else concat_ws(';', {_ITEMS}) end as Items_T{{w}}")},
       if(orders_0 > 0, cast(orders_0 as string), 'NA') as HowMany_T0, 'noise' as Noise_T0, 'extra' as Extra
from {{customer}} c
left join {{per}} p on c.c_custkey = p.c_custkey
left join {{nation}} on c_nationkey = n_nationkey
left join {{region}} on n_regionkey = r_regionkey"""


def panel_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide export: id_family, territory, region, segment, flag_a..flag_d,
    Status/Priority/Income/Items_T0..T3, HowMany_T0, and two unmapped columns."""
    return spark.sql(_EXPORT, customer=table(spark, sf_dir, "customer"), per=orders_per_customer(spark, sf_dir),
                     nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


NEW_EXPORT_COLUMNS = [KEY, TERRITORY, "region", "segment"] + [f"Status_T{w}" for w in WAVES] \
    + [f"Priority_T{w}" for w in WAVES] + ["Noise_T0"]
OLD_EXPORT_COLUMNS = [KEY, TERRITORY, "flag_a", "flag_b", "flag_c", "flag_d"] \
    + [f"Income_T{w}" for w in WAVES] + [f"Items_T{w}" for w in WAVES] + ["HowMany_T0", "Extra"]


def export_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The export split into a 'new' and an 'old' file sharing key and
    territory (the old file's territory is stale and must lose), for B1."""
    wide = panel_export(spark, sf_dir)
    new = wide.select(*NEW_EXPORT_COLUMNS)
    old = (wide.select(*OLD_EXPORT_COLUMNS)
           .withColumn(TERRITORY, F.concat(F.lit("old "), F.col(TERRITORY))))
    return new, old
