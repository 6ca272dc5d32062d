"""Oracle SQL (DuckDB) for each registered query; see oracle.sql for the panel."""

from .sql import NONE_LABEL, q

PRIO = ("CASE answer WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' "
        "WHEN '4-NOT SPECIFIED' THEN 'LOW' WHEN '5-LOW' THEN 'LOW' ELSE answer END")
RECODE_V0 = f"CASE WHEN question = 'Priority' THEN {PRIO} ELSE answer END"
SURVEY_MULTI = ("'BathroomQualit', 'HousingProblems', 'CommFacilities', 'Garbage', 'HealthGenKidsNames', "
                "'HealthGenNames', 'Internet', 'Documents', 'IncomeDesc', 'JobSatisfaction'")
ORDER_V0 = (f"('Status', 'NA', 0), ('Status', 'F', 1), ('Status', 'O', 2), ('Status', 'P', 3), "
            f"('Priority', 'NA', 0), ('Priority', 'LOW', 1), ('Priority', 'MEDIUM', 2), ('Priority', 'HIGH', 3), "
            f"('Items', 'NA', 0), ('Items', '{NONE_LABEL}', 1), ('Items', 'F', 2), ('Items', 'O', 3), "
            f"('Items', 'P', 4)")
LABELS = ("('Status', 'Status of the latest order'), ('Priority', 'Priority of the latest order'), "
          "('Income', 'Total ordered in the period'), ('Items', 'Statuses with a large order'), "
          "('HowMany', 'Orders in the first period')")
CELL_NAMES = ([f"Status_T{w}" for w in range(4)] + [f"Priority_T{w}" for w in range(4)]
              + [f"Income_T{w}" for w in range(4)] + [f"Items_T{w}" for w in range(4)] + ["HowMany_T0"])


def pct(n: str, tot: str) -> str:
    return f"(CAST({n} AS DOUBLE) * 100.0 / CAST({tot} AS DOUBLE))"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def freq(src: str, extra=(), denom=(), multi=SURVEY_MULTI, variant="0") -> str:
    kx = "".join(f", {k}" for k in extra)
    ckx = "".join(f", c.{k}" for k in extra)
    dx = "".join(f", {k}" for k in denom)
    dj = "".join(f" AND t.{k} = c.{k}" for k in denom)
    return f""",
c AS (SELECT question, {variant} AS variant, time{kx}, answer, count(*) AS n FROM {src} GROUP BY ALL),
t AS (SELECT question, variant, time{dx}, sum(n) AS tot, sum(CASE WHEN answer <> 'NA' THEN n END) AS totv
      FROM c GROUP BY ALL)
SELECT c.question, c.variant, c.time{ckx}, c.answer, c.n,
       {r6(pct('c.n', 't.tot'))} AS pct,
       CASE WHEN c.answer <> 'NA' THEN {r6(pct('c.n', 't.totv'))} END AS pct_valid,
       c.answer <> 'NA' AS included,
       CASE WHEN c.question IN ({multi}) THEN 'responses' ELSE 'families' END AS unit
FROM c JOIN t ON t.question = c.question AND t.variant = c.variant AND t.time = c.time{dj}
"""


def cramers_sql(src: str, a: str, b: str, name_a: str, name_b: str) -> str:
    """Full-table chi-square (every cell of the r x c table, empty ones too)."""
    return f"""(
WITH cl AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {src}
            WHERE {a} IS NOT NULL AND {a} <> 'NA' AND {b} IS NOT NULL AND {b} <> 'NA' GROUP BY ALL),
ra AS (SELECT a, sum(o) AS r FROM cl GROUP BY a),
cb AS (SELECT b, sum(o) AS c FROM cl GROUP BY b),
tot AS (SELECT coalesce(sum(o), 0) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM cl),
ft AS (SELECT ra.a, cb.b, coalesce(cl.o, 0) AS o, CAST(ra.r AS DOUBLE) * cb.c / tot.n AS e
       FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cl ON cl.a = ra.a AND cl.b = cb.b),
x AS (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM ft)
SELECT '{name_a}' AS var1, '{name_b}' AS var2, CAST(tot.n AS BIGINT) AS n,
       {r6("CASE WHEN tot.n < 2 THEN 0.0 WHEN least(ka, kb) - 1 <= 0 THEN NULL "
           "ELSE sqrt(x.chi2 / (tot.n * (least(ka, kb) - 1))) END")} AS cramers_v
FROM tot, x)"""


def describe_sql(src: str, value: str, by: list[str]) -> str:
    g = ", ".join(by)
    stats = [("count", f"CAST(count({value}) AS DOUBLE)"),
             ("null_count", f"CAST(count(*) - count({value}) AS DOUBLE)"),
             ("mean", f"avg({value})"), ("std", f"stddev_samp({value})"),
             ("min", f"min({value})"), ("max", f"max({value})"),
             ("25%", f"quantile_cont({value}, 0.25)"), ("50%", f"quantile_cont({value}, 0.5)"),
             ("75%", f"quantile_cont({value}, 0.75)")]
    parts = [f"SELECT {g}, '{s}' AS statistic, {r6(e)} AS value FROM {src} GROUP BY {g}" for s, e in stats]
    return "\nUNION ALL\n".join(parts)


def _load_wide() -> str:
    cols = ",\n       ".join(f"max(CASE WHEN c.original_column = '{n}' THEN c.answer END) AS \"{n}\""
                            for n in CELL_NAMES)
    return q(f"""
SELECT f.family AS id_family, f.territory, f.region, f.segment,
       f.raw_a AS flag_a, f.raw_b AS flag_b, f.raw_c AS flag_c, f.raw_d AS flag_d,
       {cols},
       'noise' AS Noise_T0, 'extra' AS Extra
FROM fam_raw f JOIN cells c ON c.family = f.family
GROUP BY f.family, f.territory, f.region, f.segment, f.raw_a, f.raw_b, f.raw_c, f.raw_d""")


def _association() -> str:
    base = ("(SELECT DISTINCT d.doc_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality, "
            "CAST(l.toxic AS VARCHAR) AS toxic FROM documents d JOIN labels l USING (doc_id))")
    cols = ["lang", "source", "quality", "toxic"]
    parts = []
    for a in cols:
        for b in cols:
            if a != b:
                parts.append(f"SELECT * FROM {cramers_sql(base, a, b, a, b)}")
        parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CAST(count(*) AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS cramers_v "
                     f"FROM {base} WHERE {a} IS NOT NULL AND {a} <> 'NA'")
    return "\nUNION ALL\n".join(parts)


def _association_flags() -> str:
    base = "(SELECT DISTINCT family, flag_a, flag_b, flag_c, flag_d FROM periods)"
    cols = ["flag_a", "flag_b", "flag_c", "flag_d"]
    parts = []
    for a in cols:
        for b in cols:
            if a != b:
                parts.append(f"SELECT * FROM {cramers_sql(base, a, b, a, b)}")
        parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CAST(count(*) AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS cramers_v "
                     f"FROM {base} WHERE {a} IS NOT NULL AND {a} <> 'NA'")
    return q("\n" + "\nUNION ALL\n".join(parts))


def _hist_equal_width(bins: int = 10) -> str:
    return f"""
WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)),
b AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / CAST({bins} AS DOUBLE) AS w FROM v),
x AS (SELECT CASE WHEN w = 0 THEN 1 ELSE CAST(least(greatest(ceil((v - lo) / w), 1), {bins}) AS INTEGER) END AS bin
      FROM v, b),
cnt AS (SELECT bin, count(*) AS c FROM x GROUP BY bin),
s AS (SELECT CAST(bin AS INTEGER) AS bin FROM generate_series(1, {bins}) t(bin)),
j AS (SELECT s.bin, coalesce(cnt.c, 0) AS count FROM s LEFT JOIN cnt USING (bin)),
tot AS (SELECT sum(count) AS total FROM j)
SELECT j.bin, {r6(f"CASE WHEN j.bin = {bins} THEN b.hi ELSE b.lo + j.bin * b.w END")} AS breakpoint,
       CAST(j.count AS BIGINT) AS count, {r6(pct('j.count', 'tot.total'))} AS percentage,
       CAST(sum(j.count) OVER (ORDER BY j.bin) AS BIGINT) AS cum_count,
       {r6(pct('sum(j.count) OVER (ORDER BY j.bin)', 'tot.total'))} AS cum_pct
FROM j, b, tot"""


def _hist_fixed(table: str, value: str, width: float, start: float, end: float, by: list[str]) -> str:
    g = "".join(f"{c}, " for c in by)
    return f"""
SELECT {g}{r6(f"{start} + i * {width}")} AS bin_start, {r6(f"{start} + (i + 1) * {width}")} AS bin_end,
       count(*) AS count
FROM (SELECT {g}floor((CAST({value} AS DOUBLE) - {start}) / {width}) AS i FROM {table}
      WHERE {value} >= {start} AND {value} < {end})
GROUP BY {g}i"""


PER_CAPITA = """,
sz AS (SELECT family, TRY_CAST(answer AS DOUBLE) AS household_size FROM lx WHERE question = 'HowMany' AND answer <> 'NA'),
inc AS (SELECT family, time, flag_a, flag_b, flag_c, flag_d, TRY_CAST(answer AS DOUBLE) AS income
        FROM panel WHERE question = 'Income' AND answer <> 'NA'),
pc AS (SELECT inc.*, sz.household_size,
              CASE WHEN sz.household_size = 0 THEN NULL ELSE inc.income / sz.household_size END AS per_capita
       FROM inc JOIN sz USING (family))"""

PAIRS_INCOME = """,
f AS (SELECT family, answer AS a FROM panel WHERE question = 'Income' AND time = 'FIRST'),
l AS (SELECT family, answer AS b FROM panel WHERE question = 'Income' AND time = 'LAST'),
ps AS (SELECT f.family, TRY_CAST(a AS DOUBLE) AS answer_first, TRY_CAST(b AS DOUBLE) AS answer_last,
              CAST(1 AS BIGINT) AS n_first, CAST(CASE WHEN l.family IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_last
       FROM f LEFT JOIN l USING (family) WHERE a <> 'NA')"""

BOTH_AB = ("CASE WHEN flag_a = 'Sim' AND flag_b = 'Sim' THEN 'Sim' "
           "WHEN NOT (flag_a = 'Sim' AND flag_b = 'Sim') THEN 'Não' END")


def _frequency_by_flag() -> str:
    sel = [f"SELECT question, time, '{f}' AS flag, {f} AS level, {RECODE_V0} AS answer FROM panel "
           f"WHERE question = 'Priority'" for f in ["flag_a", "flag_b", "flag_c", "flag_d"]]
    sel.append("SELECT question, time, 'flag_a&flag_b' AS flag, CASE WHEN flag_a = 'Sim' AND flag_b = 'Sim' "
               "THEN 'Sim' WHEN flag_a = 'Não' AND flag_b = 'Não' THEN 'Não' END AS level, "
               f"{RECODE_V0} AS answer FROM panel WHERE question = 'Priority'")
    src = "\nUNION ALL\n".join(sel)
    return q(f""",
fb AS ({src}),
fbf AS (SELECT * FROM fb WHERE level IS NOT NULL AND level <> 'NA')""" + freq(
        "fbf", extra=["flag", "level"], denom=["flag", "level"], multi="'Items'"))


FILES = """WITH c AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, n_name AS territory, CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
         CASE WHEN c_custkey % 10 = 0 THEN ' NA' ELSE c_mktsegment END AS segment,
         'Family "' || c_custkey || '", ' || chr(10) || ' second line' AS note
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
"""


def _hist_by_group(bins: int, limit: float) -> str:
    """Each group's bounds and bins, empty bins from a generated spine."""
    return q(f""",
v AS (SELECT time, flag_a, TRY_CAST(answer AS DOUBLE) AS v FROM panel
      WHERE question = 'Income' AND TRY_CAST(answer AS DOUBLE) <= {limit}),
b AS (SELECT time, flag_a, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / CAST({bins} AS DOUBLE) AS w FROM v GROUP BY ALL),
x AS (SELECT v.time, v.flag_a,
             CASE WHEN w = 0 THEN 1 ELSE CAST(least(greatest(ceil((v - lo) / w), 1), {bins}) AS INTEGER) END AS bin
      FROM v JOIN b ON b.time = v.time AND b.flag_a IS NOT DISTINCT FROM v.flag_a),
cnt AS (SELECT time, flag_a, bin, count(*) AS c FROM x GROUP BY ALL),
j AS (SELECT b.*, CAST(s.bin AS INTEGER) AS bin, coalesce(cnt.c, 0) AS count
      FROM b CROSS JOIN generate_series(1, {bins}) s(bin)
      LEFT JOIN cnt ON cnt.time = b.time AND cnt.flag_a IS NOT DISTINCT FROM b.flag_a AND cnt.bin = s.bin),
r AS (SELECT *, sum(count) OVER (PARTITION BY time, flag_a ORDER BY bin) AS run,
             sum(count) OVER (PARTITION BY time, flag_a) AS total FROM j)
SELECT time, flag_a, bin, {r6(f"CASE WHEN bin = {bins} THEN hi ELSE lo + bin * w END")} AS breakpoint,
       CAST(count AS BIGINT) AS count, {r6(pct('count', 'total'))} AS percentage, CAST(run AS BIGINT) AS cum_count,
       {r6(pct('run', 'total'))} AS cum_pct
FROM r""")


def _transitions(question: str, order: str, recode: bool, dim: str | None) -> str:
    ans = RECODE_V0 if recode else "answer"
    seg = ("CASE WHEN segment IN ('HOUSEHOLD', 'BUILDING', 'FURNITURE') THEN 'HOME' ELSE 'INDUSTRY' END"
           if dim else "NULL")
    dsel = ", f.segment" if dim else ""
    dgrp = ", segment" if dim else ""
    return q(f""",
g AS (SELECT family, question, time, {ans} AS answer, {seg} AS segment FROM panel WHERE question = '{question}'),
f AS (SELECT family, question, segment, answer AS first_answer, count(*) OVER (PARTITION BY family) AS nf
      FROM g WHERE time = 'FIRST'),
l AS (SELECT family, question, answer AS last_answer, count(*) OVER (PARTITION BY family) AS nl
      FROM g WHERE time = 'LAST'),
p AS (SELECT f.question{dsel}, f.first_answer, l.last_answer, nf, nl FROM f LEFT JOIN l USING (family, question)
      WHERE l.last_answer IN ({order})),
m AS (SELECT question{dgrp}, first_answer, last_answer, count(*) AS n,
             count(*) FILTER (WHERE nf > 1 OR nl > 1) AS n_conflicts FROM p GROUP BY ALL)
SELECT m.*, {r6(pct('n', f'sum(n) OVER (PARTITION BY question{dgrp}, first_answer)'))} AS row_pct FROM m""")


ORACLE = {
    "load_wide_join": _load_wide(),
    "load_wide_files": FILES + """
SELECT id AS id_family, territory, segment, note AS note_T0, CASE WHEN k % 2 = 0 THEN '+55 ' || id END AS phone_T0,
       CAST(balance AS VARCHAR) AS balance_T0
FROM c WHERE k % 23 <> 0""",
    "bad_records": FILES + """
SELECT 'few ' || id || ',x' AS record FROM c WHERE k % 41 = 0
UNION ALL SELECT 'many ' || id || ',x,x,x,x,x,x' FROM c WHERE k % 43 = 0""",
    "export_key_report": FILES + """
SELECT CAST(count(*) + count(*) FILTER (WHERE k % 37 = 0) AS BIGINT) AS n_rows, count(*) AS n_keys,
       count(*) FILTER (WHERE k % 37 = 0) AS n_duplicate_keys, count(*) FILTER (WHERE k % 74 = 0) AS n_conflicting_keys
FROM c""",
    "duplicate_keys": FILES + "SELECT id AS id_family, CAST(2 AS BIGINT) AS count FROM c WHERE k % 37 = 0",
    "comma_answers": q("SELECT * FROM lx"),
    "first_last_wave_colocated": q("SELECT * FROM periods"),
    "incremental_panel": q("SELECT * FROM panel"),
    "transition_flows": q(f""",
f AS (SELECT DISTINCT family, question, answer AS first_answer FROM panel
      WHERE question = 'Items' AND time = 'FIRST' AND answer IN ('NA', '{NONE_LABEL}', 'F', 'O', 'P')),
l AS (SELECT DISTINCT family, question, answer AS last_answer FROM panel
      WHERE question = 'Items' AND time = 'LAST' AND answer IN ('NA', '{NONE_LABEL}', 'F', 'O', 'P')),
m AS (SELECT question, first_answer, last_answer, count(*) AS n FROM f JOIN l USING (family, question) GROUP BY ALL)
SELECT m.*, {r6(pct('n', 'sum(n) OVER (PARTITION BY question, first_answer)'))} AS row_pct FROM m"""),
    "transitions_excluding": q(f""",
g AS (SELECT family, question, time, {RECODE_V0} AS answer,
             CASE flag_a WHEN 'Sim' THEN 'yes' WHEN 'Não' THEN 'no' ELSE 'open' END AS flag_a
      FROM panel WHERE question = 'Priority'),
k AS (SELECT * FROM g WHERE flag_a <> 'no'),
m AS (SELECT f.question, f.flag_a, f.answer AS first_answer, l.answer AS last_answer, count(*) AS n
      FROM k f JOIN k l ON l.family = f.family AND f.time = 'FIRST' AND l.time = 'LAST'
      WHERE l.answer IN ('NA', 'LOW', 'MEDIUM', 'HIGH') GROUP BY ALL)
SELECT m.*, {r6(pct('n', 'sum(n) OVER (PARTITION BY question, flag_a, first_answer)'))} AS row_pct,
       CAST(0 AS BIGINT) AS n_conflicts FROM m"""),
    "paired_scores_conflicts": f"""
WITH o AS (SELECT o_custkey AS family, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders
           WHERE year(o_orderdate) IN (1995, 1998))
SELECT family, {r6("CAST(min(v) FILTER (WHERE y = 1995) AS DOUBLE)")} AS answer_first,
       {r6("CAST(min(v) FILTER (WHERE y = 1998) AS DOUBLE)")} AS answer_last,
       count(*) FILTER (WHERE y = 1995) AS n_first, count(*) FILTER (WHERE y = 1998) AS n_last
FROM o GROUP BY family HAVING count(*) FILTER (WHERE y = 1995) > 0""",
    "hist_income_by_wave_flag": _hist_by_group(8, 900000.0),
    "hist_income_fixed_by_wave": q("""
SELECT time, flag_a, floor(v / 100000) * 100000.0 AS bin_start, (floor(v / 100000) + 1) * 100000.0 AS bin_end, count(*) AS count
FROM (SELECT time, flag_a, TRY_CAST(answer AS DOUBLE) AS v FROM panel WHERE question = 'Income')
WHERE v >= 0 AND v < 1000000 GROUP BY ALL"""),
    "frequency_in_category_order": q(f""",
r AS (SELECT time, question, {RECODE_V0} AS answer FROM panel WHERE question IN ('Priority', 'Status')),
ord(question, answer, rank) AS (VALUES {ORDER_V0})
SELECT r.question, r.time, r.answer, CAST(o.rank AS INTEGER) AS rank, count(*) AS n
FROM r LEFT JOIN ord o ON o.question = r.question AND o.answer = r.answer GROUP BY ALL"""),
    "to_long": q("SELECT * FROM cells"),
    "profile_map": q("SELECT family AS id_family, flag_a, flag_b, flag_c, flag_d FROM fam"),
    "normalize_values": q("""
SELECT family, CASE WHEN territory = 'NATION_1' THEN 'NATION_ONE' ELSE territory END AS territory, time, question,
       CASE WHEN question = 'Items' THEN replace(answer, ';', '|') ELSE answer END AS answer
FROM cells"""),
    "explode_assertions": q("SELECT * FROM lx"),
    "long_parquet_roundtrip": q("SELECT * FROM lx"),
    "csv_export_roundtrip": q("SELECT * FROM cells"),
    "recode_answers": q(f"""
SELECT family, time, question, 0 AS variant, {RECODE_V0} AS answer FROM lx
UNION ALL
SELECT family, time, question, 1 AS variant, CASE WHEN answer IN ('F', 'O', 'P') THEN 'Some' ELSE answer END AS answer
FROM lx WHERE question = 'Items'"""),
    "ordered_answers": q(f""",
r AS (SELECT family, time, question, {RECODE_V0} AS answer FROM panel),
ord(question, answer, rank) AS (VALUES {ORDER_V0})
SELECT r.family, r.time, r.question, r.answer,
       CAST(CASE WHEN o.rank IS NOT NULL THEN o.rank
                 WHEN r.question NOT IN ('Status', 'Priority', 'Items') AND r.answer = 'NA' THEN 0 END AS INTEGER) AS rank
FROM r LEFT JOIN ord o ON o.question = r.question AND o.answer = r.answer"""),
    "first_last_wave": q("SELECT * FROM periods"),
    "periods_from_export": q("SELECT * FROM periods"),
    "panel_rows": q("SELECT * FROM panel"),
    "panel_from_long": q("SELECT * FROM panel"),
    "period_distribution": q(f""",
d AS (SELECT time_first, time_last, count(DISTINCT family) AS count FROM periods GROUP BY ALL)
SELECT time_first, time_last, count, {r6(f"round({pct('count', '(SELECT sum(count) FROM d)')}, 2)")} AS percentage
FROM d"""),
    "respondents_by_territory": q("SELECT territory, count(DISTINCT family) AS n_families FROM panel GROUP BY territory"),
    "respondents_by_territory_wave": q(
        "SELECT territory, time, count(DISTINCT family) AS n_families FROM panel GROUP BY territory, time"),
    "frequency_compare_by": q(f""",
rp AS (SELECT * REPLACE ({RECODE_V0} AS answer) FROM panel WHERE question = 'Priority')""" + freq(
        "rp", extra=["segment"], multi="'Items'")),
    "frequency_all_questions": q(f""",
rp AS (SELECT * REPLACE ({RECODE_V0} AS answer) FROM panel)""" + freq("rp", multi="'Items'")),
    "frequency_by_territory": q(f""",
rp AS (SELECT * REPLACE ({RECODE_V0} AS answer) FROM panel)""" + freq("rp", extra=["territory"], multi="'Items'")),
    "frequency_item_variants": q(f""",
iv AS (SELECT question, 0 AS variant, time, answer FROM panel
       WHERE question = 'Items' AND answer IN ('NA', '{NONE_LABEL}', 'F', 'O', 'P')
       UNION ALL
       SELECT question, 1 AS variant, time, CASE WHEN answer IN ('F', 'O', 'P') THEN 'Some' ELSE answer END AS answer
       FROM panel WHERE question = 'Items')""" + freq("iv", multi="'Items'", variant="variant")),
    "frequency_family_share": q(f""",
c AS (SELECT question, 0 AS variant, time, answer, count(*) AS n, count(DISTINCT family) AS n_families
      FROM panel WHERE question = 'Items' GROUP BY ALL),
t AS (SELECT question, variant, time, sum(n) AS tot, sum(CASE WHEN answer <> 'NA' THEN n END) AS totv
      FROM c GROUP BY ALL),
f AS (SELECT question, time, count(DISTINCT family) AS fams FROM panel WHERE question = 'Items' GROUP BY ALL)
SELECT c.question, c.variant, c.time, c.answer, c.n,
       {r6(pct('c.n', 't.tot'))} AS pct,
       CASE WHEN c.answer <> 'NA' THEN {r6(pct('c.n', 't.totv'))} END AS pct_valid,
       c.answer <> 'NA' AS included, 'responses' AS unit,
       c.n_families, {r6(pct('c.n_families', 'f.fams'))} AS pct_families
FROM c JOIN t ON t.question = c.question AND t.variant = c.variant AND t.time = c.time
JOIN f ON f.question = c.question AND f.time = c.time"""),
    "frequency_lineitem_flags": q(""",
lf AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS time, 'returnflag' AS question, l_returnflag AS answer FROM lineitem
       UNION ALL
       SELECT CAST(year(l_shipdate) AS INTEGER) AS time, 'linestatus' AS question, l_linestatus AS answer FROM lineitem)"""
                                  + freq("lf")),
    "missing_table": q(f""",
agg AS (SELECT question,
               sum(CASE WHEN time = 'FIRST' AND answer = 'NA' THEN 1 ELSE 0 END) AS cf,
               sum(CASE WHEN time = 'FIRST' THEN 1 ELSE 0 END) AS tf,
               sum(CASE WHEN time = 'LAST' AND answer = 'NA' THEN 1 ELSE 0 END) AS cl,
               sum(CASE WHEN time = 'LAST' THEN 1 ELSE 0 END) AS tl
        FROM panel GROUP BY question),
ql(question, label) AS (VALUES {LABELS}),
res AS (SELECT ql.question, ql.label, CAST(coalesce(cf, 0) AS BIGINT) AS count_first,
               coalesce(CASE WHEN tf > 0 THEN {pct('cf', 'tf')} END, 0.0) AS pf,
               CAST(coalesce(cl, 0) AS BIGINT) AS count_last,
               coalesce(CASE WHEN tl > 0 THEN {pct('cl', 'tl')} END, 0.0) AS pl
        FROM ql LEFT JOIN agg USING (question))
SELECT question, label, count_first, {r6('pf')} AS pct_first, count_last, {r6('pl')} AS pct_last,
       (pf > 50 OR pl > 50) AS over_threshold
FROM res"""),
    "transition_matrix": _transitions("Status", "'NA', 'F', 'O', 'P'", False, None),
    "transitions_by_group": _transitions("Priority", "'NA', 'LOW', 'MEDIUM', 'HIGH'", True, "segment"),
    "paired_scores": q(PAIRS_INCOME + f"""
SELECT family, {r6('answer_first')} AS answer_first, {r6('answer_last')} AS answer_last, n_first, n_last FROM ps"""),
    "paired_scores_summary": q(PAIRS_INCOME + f"""
SELECT count(*) AS n, {r6('avg(answer_first)')} AS mean_first, {r6('avg(answer_last)')} AS mean_last,
       {r6('avg(CASE WHEN answer_first IS NOT NULL AND answer_last IS NOT NULL THEN answer_last - answer_first END)')} AS mean_delta,
       CAST(sum(CASE WHEN answer_first IS NOT NULL AND answer_last IS NOT NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid,
       count(*) FILTER (WHERE n_first > 1 OR n_last > 1) AS n_conflicts
FROM ps"""),
    "cramers_v_pair": "SELECT * FROM " + cramers_sql("lineitem", "l_returnflag", "l_linestatus",
                                                     "l_returnflag", "l_linestatus"),
    "contingency_table": """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_returnflag <> 'NA' AND l_linestatus IS NOT NULL AND l_linestatus <> 'NA'
GROUP BY l_returnflag""",
    "association_matrix": _association(),
    "association_flags": _association_flags(),
    "profile_conflicts": q("""
, seen AS (
  SELECT family, segment, flag_a, flag_b, flag_c, flag_d FROM lx
  UNION ALL
  SELECT family, CASE WHEN CAST(family AS BIGINT) % 74 = 0 THEN 'ZZZ' ELSE segment END, flag_a, flag_b, flag_c, flag_d
  FROM lx WHERE CAST(family AS BIGINT) % 37 = 0)
SELECT family AS id_family, count(DISTINCT (segment, flag_a, flag_b, flag_c, flag_d)) AS n_profiles FROM seen
GROUP BY family HAVING count(DISTINCT (segment, flag_a, flag_b, flag_c, flag_d)) > 1"""),
    "hist_equal_width": _hist_equal_width(10),
    "hist_fixed_width": _hist_fixed("events", "value", 50.0, 0.0, 500.0, ["event_type"]),
    "hist_fixed_width_orders": _hist_fixed("orders", "o_totalprice", 50000.0, 0.0, 500000.0, []),
    "income_per_capita": q(PER_CAPITA + f"""
SELECT family, time, flag_a, flag_b, flag_c, flag_d, {r6('income')} AS income,
       {r6('household_size')} AS household_size, {r6('per_capita')} AS per_capita FROM pc"""),
    "income_per_capita_from_long": q(PER_CAPITA + f"""
SELECT family, time, flag_a, flag_b, flag_c, flag_d, {r6('income')} AS income,
       {r6('household_size')} AS household_size, {r6('per_capita')} AS per_capita FROM pc"""),
    "composite_flags": q(f"SELECT family AS id_family, flag_a, flag_b, {BOTH_AB} AS both_ab FROM fam"),
    "group_describe": describe_sql("orders", "o_totalprice", ["o_orderpriority"]),
    "income_describe": q(PER_CAPITA + f""",
pcb AS (SELECT *, {BOTH_AB} AS both_ab FROM pc)
SELECT * FROM (""" + describe_sql("pcb", "per_capita",
                                  ["time", "both_ab"]) + ")"),
    "frequency_by_flag": _frequency_by_flag(),
    "descriptive_table": q(f""",
d AS (SELECT {RECODE_V0} AS answer, segment AS dim, time FROM panel WHERE question = 'Priority'),
d2 AS (SELECT * FROM d WHERE dim <> 'NA' AND answer <> 'NA'),
fc AS (SELECT answer, dim, count(*) AS c FROM d2 WHERE time = 'FIRST' GROUP BY ALL),
lc AS (SELECT answer, dim, count(*) AS c FROM d2 WHERE time = 'LAST' GROUP BY ALL),
ft AS (SELECT dim, count(*) AS t FROM d2 WHERE time = 'FIRST' GROUP BY dim),
lt AS (SELECT dim, count(*) AS t FROM d2 WHERE time = 'LAST' GROUP BY dim),
j AS (SELECT coalesce(fc.answer, lc.answer) AS answer, coalesce(fc.dim, lc.dim) AS dim,
             coalesce(fc.c, 0) AS count_first, coalesce(lc.c, 0) AS count_last
      FROM fc FULL JOIN lc ON fc.answer = lc.answer AND fc.dim = lc.dim),
k AS (SELECT j.*, coalesce(ft.t, 0) AS group_total_first, coalesce(lt.t, 0) AS group_total_last
      FROM j LEFT JOIN ft USING (dim) LEFT JOIN lt USING (dim)),
p AS (SELECT k.*, coalesce(CAST(count_first AS DOUBLE) / nullif(group_total_first, 0), 0.0) AS pf,
             coalesce(CAST(count_last AS DOUBLE) / nullif(group_total_last, 0), 0.0) AS pl FROM k)
SELECT answer, dim, CAST(count_first AS BIGINT) AS count_first, CAST(group_total_first AS BIGINT) AS group_total_first,
       {r6('pf')} AS pct_first, CAST(count_last AS BIGINT) AS count_last,
       CAST(group_total_last AS BIGINT) AS group_total_last, {r6('pl')} AS pct_last,
       CAST(count_last - count_first AS BIGINT) AS delta_count, {r6('pl - pf')} AS delta_pct
FROM p"""),
    "one_answer_per_family": q("""
SELECT family, question, time, min(answer) AS answer, count(DISTINCT answer) AS n_answers
FROM panel WHERE question = 'Items' GROUP BY ALL"""),
    "answer_conflicts": q("""
SELECT family, question, time, min(answer) AS answer, count(DISTINCT answer) AS n_answers
FROM panel WHERE question = 'Items' GROUP BY ALL HAVING count(DISTINCT answer) > 1"""),
    "assertion_counts": q(""",
s AS (SELECT family, question, time, answer FROM panel WHERE question IN ('Items')),
a(question, answer, polarity) AS (VALUES ('Items', 'F', 'positive'), ('Items', 'O', 'negative'), ('Items', 'P', 'negative')),
m AS (SELECT s.family, s.question, s.time, a.polarity FROM s LEFT JOIN a USING (question, answer)),
k AS (SELECT DISTINCT family, question, time FROM s),
pol(polarity) AS (VALUES ('positive'), ('negative'))
SELECT k.family, k.question, k.time, pol.polarity, CAST(count(m.polarity) AS BIGINT) AS n
FROM k CROSS JOIN pol
LEFT JOIN m ON m.family = k.family AND m.question = k.question AND m.time = k.time AND m.polarity = pol.polarity
GROUP BY ALL"""),
    "find_values": "SELECT DISTINCT p_name AS value FROM part WHERE contains(p_name, 'ring')",
    "find_columns": q("SELECT DISTINCT original_column AS value FROM lx WHERE contains(original_column, '_T0')"),
    "unrecoded_report": q(f""",
ord(question, answer, rank) AS (VALUES {ORDER_V0})
SELECT question, 0 AS variant, time, answer, count(*) AS n FROM lx
WHERE question IN ('Status', 'Priority', 'Items')
  AND NOT EXISTS (SELECT 1 FROM ord WHERE ord.question = lx.question AND ord.answer = lx.answer)
GROUP BY ALL"""),
}
