"""Two CSV exports written from the customer table, as they reach analysts.

The new export's files have two headers: the same columns in another order,
one without the phone.  Notes hold commas, quotes and a line break; every
tenth segment is ' NA' (not 'NA').  Every 37th family occurs twice, every
74th with another segment the second time.  Every 41st family is followed by
a record with too few cells, every 43rd by one with too many.  The old export
lacks every 23rd family and has a stale territory.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import delete_at_exit
from ..session import checkpoint_dir
from .readers import table

KEY = "id_family"
#: Files of each header.
PIECES = 4

_HEADERS = {"new/a": "id_family,territory,segment,note_T0,phone_T0", "new/b": "note_T0,segment,id_family,territory",
            "old/c": "id_family,territory,balance_T0"}

_ROWS = """
  select c_custkey as k, cast(c_custkey as string) as id, n_name as territory, cast(c_acctbal as decimal(18,2)) as balance,
         case when c_custkey % 10 = 0 then ' NA' else c_mktsegment end as segment,
         concat('"Family ""', c_custkey, '"", \n second line"') as note
  from {customer} left join {nation} on c_nationkey = n_nationkey
"""

_SEEN = f"""
with c as ({_ROWS}),
seen as (
  select *, 1 as turn from c
  union all
  select k, id, territory, balance, if(k % 74 = 0, 'ZZZ', segment), note, 2 from c where k % 37 = 0)
"""

_LINES = _SEEN + f"""
select if(k % 2 = 0, 'new/a', 'new/b') as kind, cast(k div 2 % {PIECES} as int) as piece, k, turn,
       if(k % 2 = 0, concat(id, ',', territory, ',', segment, ',', note, ',+55 ', id),
                     concat(note, ',', segment, ',', id, ',', territory)) as value from seen
union all
select if(k % 2 = 0, 'new/a', 'new/b'), cast(k div 2 % {PIECES} as int), k, 3, concat('few ', id, ',x') from c where k % 41 = 0
union all
select if(k % 2 = 0, 'new/a', 'new/b'), cast(k div 2 % {PIECES} as int), k, 4, concat('many ', id, ',x,x,x,x,x,x') from c where k % 43 = 0
union all
select 'old/c', cast(k div 2 % {PIECES} as int), k, 1, concat(id, ',"old, ', territory, '",', balance) from c where k % 23 <> 0
union all
select kind, piece, null, 0, header from (values {{headers}}) h(kind, header) lateral view explode(sequence(0, {PIECES - 1})) p as piece
"""


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the new export's files (id_family, territory, segment)."""
    return spark.sql(f"{_SEEN} select id as {KEY}, territory, segment from seen",
                     customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


def seen_twice(export: DataFrame) -> DataFrame:
    """The rows of a wide export (id_family, segment, ...) with every 37th
    family twice, every 74th with another segment the second time."""
    k = F.expr(f"try_cast({KEY} as bigint)")
    second = F.when(k % 74 == 0, F.lit("ZZZ")).otherwise(F.col("segment"))
    turns = F.when(k % 37 == 0, F.array("segment", second)).otherwise(F.array("segment"))
    return export.withColumn("segment", F.explode(turns))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, piece, k, turn, value): the lines of the files in their order."""
    headers = ", ".join(f"('{kind}', '{header}')" for kind, header in _HEADERS.items())
    return spark.sql(_LINES.replace("{headers}", headers), customer=table(spark, sf_dir, "customer"),
                     nation=table(spark, sf_dir, "nation"))


def write_exports(spark: SparkSession, sf_dir: str) -> str:
    """Write the files under the shared folder; returns the path with new/ and old/."""
    path = os.path.join(checkpoint_dir(spark), "exports", uuid.uuid4().hex)
    delete_at_exit(spark, path)
    kinds = lines(spark, sf_dir)
    for side in ("new", "old"):
        own = kinds.filter(f"kind like '{side}/%'")
        (own.repartition("kind", "piece").sortWithinPartitions("kind", "piece", "k", "turn")
         .select("kind", "piece", "value").write.partitionBy("kind", "piece").text(os.path.join(path, side)))
    return path
