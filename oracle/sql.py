"""DuckDB oracle for the registered queries.

Written independently of the Spark plans: the panel is built from a
(family x wave x question) grid with window-ranked latest orders, the
explode is the three-branch union (split / all-NA / NA), first/last wave
come from GROUP BY ... HAVING, shares from CTE totals joined back, and
Cramér's V from the full contingency table including empty cells.
"""

NONE_LABEL = "Nenhuma opção"

ID_COLS = "family, territory, region, segment, flag_a, flag_b, flag_c, flag_d"
CELL_COLS = f'{ID_COLS}, time, question, "column", original_column'


def _flag(expr_true: str) -> str:
    return f"CASE WHEN coalesce({expr_true}, false) THEN 'sim' ELSE 'nao' END"


def _yes_no(raw: str) -> str:
    return (f"CASE {raw} WHEN 'sim' THEN 'Sim' WHEN 'nao' THEN 'Não' WHEN 'NA' THEN 'NA' "
            f"WHEN 'talvez' THEN 'Sim' END")


BASE = f"""
o AS (
  SELECT o_custkey AS ck, o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice,
         CAST(least(3, floor((year(o_orderdate) - 1995) / 2)) AS INTEGER) AS wave
  FROM orders),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ck, wave ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM o),
cw AS (
  SELECT ck, wave,
         max(CASE WHEN rn = 1 THEN o_orderstatus END) AS st,
         max(CASE WHEN rn = 1 THEN o_orderpriority END) AS pr,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS inc,
         count(*) AS n,
         bool_or(o_orderstatus = 'F' AND o_totalprice > 250000) AS hf,
         bool_or(o_orderstatus = 'O' AND o_totalprice > 250000) AS ho,
         bool_or(o_orderstatus = 'P' AND o_totalprice > 250000) AS hp
  FROM ranked GROUP BY ck, wave),
cf AS (
  SELECT ck, bool_or(o_totalprice > 450000) AS big,
         bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS urg,
         bool_or(o_totalprice < 20000) AS small
  FROM o GROUP BY ck),
fam_raw AS (
  SELECT c.c_custkey AS ck, CAST(c.c_custkey AS VARCHAR) AS family, n.n_name AS territory,
         r.r_name AS region, c.c_mktsegment AS segment,
         CASE WHEN c.c_custkey % 17 = 0 THEN 'NA' WHEN c.c_custkey % 13 = 0 THEN 'talvez'
              ELSE {_flag('cf.big')} END AS raw_a,
         CASE WHEN c.c_custkey % 19 = 0 THEN 'NA' ELSE {_flag('cf.urg')} END AS raw_b,
         {_flag('cf.small')} AS raw_c,
         {_flag('c.c_acctbal < 0')} AS raw_d
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN cf ON cf.ck = c.c_custkey),
fam AS (
  SELECT ck, family, territory, region, segment,
         {_yes_no('raw_a')} AS flag_a, {_yes_no('raw_b')} AS flag_b,
         {_yes_no('raw_c')} AS flag_c, {_yes_no('raw_d')} AS flag_d
  FROM fam_raw),
grid AS (
  SELECT f.*, w.wave AS time, q.question, cw.st, cw.pr, cw.inc, cw.n, cw.hf, cw.ho, cw.hp
  FROM fam f
  CROSS JOIN (VALUES (0), (1), (2), (3)) w(wave)
  CROSS JOIN (VALUES ('Status'), ('Priority'), ('Income'), ('Items')) q(question)
  LEFT JOIN cw ON cw.ck = f.ck AND cw.wave = w.wave
  UNION ALL
  SELECT f.*, 0 AS time, 'HowMany' AS question, cw.st, cw.pr, cw.inc, cw.n, cw.hf, cw.ho, cw.hp
  FROM fam f LEFT JOIN cw ON cw.ck = f.ck AND cw.wave = 0),
cells AS (
  SELECT {ID_COLS}, CAST(time AS INTEGER) AS time, question,
         question || '_T' || CAST(time AS VARCHAR) AS "column",
         question || '_T' || CAST(time AS VARCHAR) AS original_column,
         CASE question
           WHEN 'Status' THEN coalesce(st, 'NA')
           WHEN 'Priority' THEN CASE WHEN (ck * 7 + time) % 11 = 0 THEN 'NA' ELSE coalesce(pr, 'NA') END
           WHEN 'Income' THEN CASE WHEN ck % 31 = 0 AND time >= 2 THEN 'NA'
                                   ELSE coalesce(CAST(inc AS VARCHAR), 'NA') END
           WHEN 'Items' THEN CASE WHEN ck % 29 = 0 THEN NULL WHEN ck % 23 = 0 THEN 'NA'
                                  ELSE concat_ws(';', CASE WHEN coalesce(hf, false) THEN 'F' ELSE 'NA' END,
                                                      CASE WHEN coalesce(ho, false) THEN 'O' ELSE 'NA' END,
                                                      CASE WHEN coalesce(hp, false) THEN 'P' ELSE 'NA' END) END
           WHEN 'HowMany' THEN CASE WHEN coalesce(n, 0) > 0 THEN CAST(n AS VARCHAR) ELSE 'NA' END
         END AS answer
  FROM grid),
split AS (
  SELECT {CELL_COLS}, unnest(string_split(answer, ';')) AS answer FROM cells WHERE answer <> 'NA'),
lx AS (
  SELECT {CELL_COLS}, answer FROM split WHERE answer <> 'NA'
  UNION ALL
  SELECT {CELL_COLS}, '{NONE_LABEL}' AS answer FROM cells WHERE regexp_full_match(answer, '(NA;)+NA')
  UNION ALL
  SELECT {CELL_COLS}, answer FROM cells WHERE answer = 'NA'),
bounds AS (
  SELECT family, min(time) AS time_first, max(time) AS time_last
  FROM lx WHERE question = 'Status' AND answer <> 'NA'
  GROUP BY family HAVING max(time) - min(time) > 1),
periods AS (
  SELECT lx.*, b.time_first, b.time_last FROM lx JOIN bounds b USING (family)),
panel AS (
  SELECT {ID_COLS}, question, answer, "column", original_column, time_first, time_last,
         time AS wave, 'FIRST' AS time
  FROM periods WHERE time = time_first
  UNION ALL
  SELECT {ID_COLS}, question, answer, "column", original_column, time_first, time_last,
         time AS wave, 'LAST' AS time
  FROM periods WHERE time = time_last)
"""


def q(body: str) -> str:
    return "WITH " + BASE + body
