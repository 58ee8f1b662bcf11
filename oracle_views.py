"""DuckDB restatement of the domain adapters in ``berthwise.sources.testdata``.

Each entry is the body of a CTE; ``with_views(sql, *names)`` prefixes a query
with the CTEs it needs.  Only the oracle uses these; the Spark side never does.
"""

from __future__ import annotations

_PT = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"

VIEWS: dict[str, str] = {}

VIEWS["v_calls_raw"] = """
SELECT o_orderkey AS call_id,
  'V' || CAST(o_custkey AS VARCHAR) AS "Navire",
  CASE o_orderkey % 5 WHEN 0 THEN 'PORTE_CONTENEUR' WHEN 1 THEN 'VRAQUIER'
       WHEN 2 THEN 'CARGO_GENERAL' WHEN 3 THEN 'ROULIER' END AS "Type Navire",
  CAST(5000 + (o_orderkey * 13) % 70000 AS VARCHAR) AS "Jauge Brute",
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(100 + (o_orderkey * 3) % 200 AS VARCHAR) END AS "Longueur",
  CAST(6 + o_orderkey % 8 AS VARCHAR) || '.' || CAST((o_orderkey * 7) % 10 AS VARCHAR) AS "Tirant Eau",
  CASE WHEN o_orderkey % 50 = 0 THEN 'nan' ELSE strftime(arr, '%d/%m/%Y') END AS "Date Entrée au Port",
  strftime(arr, '%H:%M') AS "Heure Entrée au Port",
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE strftime(arr, '%d/%m/%Y') END AS "Date Entree Mouillage",
  strftime(brt, '%d/%m/%Y') AS "Date Accostage",
  strftime(brt, '%H:%M') AS "Heure Accostage",
  strftime(brt + to_hours(CAST((o_orderkey * 31) % 800 - 20 AS BIGINT)), '%d/%m/%Y') AS "Date App Quai",
  strftime(brt + to_hours(CAST((o_orderkey * 31) % 800 - 20 AS BIGINT)), '%H:%M') AS "Heure App Quai",
  ' ' || CAST(o_custkey % 49 AS VARCHAR) || ' ' AS "Poste Accostage",
  CASE WHEN o_orderkey % 37 = 0 THEN 'n/a'
       ELSE CAST((o_orderkey % 40) // 8 AS VARCHAR) || ',' || lpad(CAST((o_orderkey % 8) * 125 AS VARCHAR), 3, '0')
  END AS "Sejour Quai (Jours)",
  CASE o_orderkey % 6 WHEN 0 THEN 'Containers' WHEN 1 THEN 'Grains' WHEN 2 THEN 'Coal'
       WHEN 3 THEN 'nan' WHEN 4 THEN 'General Cargo' END AS "Marchandise DAP Import",
  CASE o_orderkey % 4 WHEN 0 THEN 'Phosphates' WHEN 1 THEN '' END AS "Marchandise DAP Export",
  CAST((o_orderkey * 11) % 30000 AS VARCHAR) AS "Tonnage DAP Import",
  '0' AS "Tonnage DAP Export",
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 4 AS VARCHAR) END AS "Nbr Remorque Accostage"
FROM (
  SELECT o_orderkey, o_custkey, arr,
         arr + to_hours(CAST((o_orderkey * 7919) % 97 - 8 AS BIGINT)) AS brt
  FROM (SELECT o_orderkey, o_custkey,
               CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS arr
        FROM orders) a
) b
"""

# Cleaned calls (C1) restated: parse, derive, filter, trim.
VIEWS["v_clean"] = """
SELECT * FROM (
  SELECT *,
    CASE WHEN svc0 IS NULL OR svc0 = 0 THEN svc_days ELSE svc0 END AS service_time_hours
  FROM (
    SELECT call_id, trim("Poste Accostage") AS berth_id, "Navire" AS vessel_name,
      "Type Navire", "Jauge Brute", "Longueur", "Tirant Eau", "Marchandise DAP Import",
      "Marchandise DAP Export", "Tonnage DAP Import", "Tonnage DAP Export", "Nbr Remorque Accostage",
      arr_dt AS arrival_datetime, brt_dt AS berthing_datetime, unb_dt AS unberthing_datetime,
      CASE WHEN arr_dt IS NULL OR brt_dt IS NULL THEN NULL
           ELSE CAST(greatest(epoch_us(brt_dt) - epoch_us(arr_dt), 0) AS DOUBLE) / 3600000000.0 END AS waiting_time_hours,
      CASE WHEN brt_dt IS NULL OR unb_dt IS NULL THEN NULL
           ELSE CAST(greatest(epoch_us(unb_dt) - epoch_us(brt_dt), 0) AS DOUBLE) / 3600000000.0 END AS svc0,
      coalesce(TRY_CAST(trim(replace("Sejour Quai (Jours)", ',', '.')) AS DOUBLE) * 24.0, 0.0) AS svc_days,
      CAST("Date Entree Mouillage" IS NOT NULL AS INTEGER) AS anchored_before_berthing,
      month(arr_dt) AS arrival_month, isodow(arr_dt) - 1 AS arrival_day_of_week
    FROM (
      SELECT *,
        try_strptime("Date Entrée au Port" || ' ' || "Heure Entrée au Port", '%d/%m/%Y %H:%M') AS arr_dt,
        try_strptime("Date Accostage" || ' ' || "Heure Accostage", '%d/%m/%Y %H:%M') AS brt_dt,
        try_strptime("Date App Quai" || ' ' || "Heure App Quai", '%d/%m/%Y %H:%M') AS unb_dt
      FROM v_calls_raw) p
  ) d
) s
WHERE arrival_datetime IS NOT NULL AND berthing_datetime IS NOT NULL AND unberthing_datetime IS NOT NULL
  AND service_time_hours BETWEEN 0.5 AND 720.0
"""

VIEWS["v_typed"] = """
SELECT 'P0' AS port_id, call_id, vessel_name AS name,
  coalesce(trim("Type Navire"), 'CARGO_GENERAL') AS vessel_type,
  CAST(trunc(coalesce(TRY_CAST(trim("Jauge Brute") AS DOUBLE), 0)) AS INTEGER) AS gross_tonnage,
  coalesce(TRY_CAST(trim("Longueur") AS DOUBLE), 150.0) AS length_m,
  coalesce(TRY_CAST(trim("Tirant Eau") AS DOUBLE), 8.0) AS draft_m,
  coalesce(trim("Marchandise DAP Import"), 'General Cargo') AS cargo_import,
  coalesce(trim("Marchandise DAP Export"), '') AS cargo_export,
  coalesce(TRY_CAST(trim("Tonnage DAP Import") AS DOUBLE), 0.0) AS tonnage_import,
  coalesce(TRY_CAST(trim("Tonnage DAP Export") AS DOUBLE), 0.0) AS tonnage_export,
  CAST(trunc(coalesce(TRY_CAST(trim("Nbr Remorque Accostage") AS DOUBLE), 1)) AS INTEGER) AS tugs_at_berthing,
  arrival_month, arrival_day_of_week AS arrival_dow, arrival_datetime AS eta
FROM v_clean
"""

VIEWS["v_profiles"] = """
SELECT * FROM (VALUES
  ('PORTE_CONTENEUR', 'Containers', 'Containers', 150.0, 300.0, 9.5, 13.0, 15000, 80000, 2, 4),
  ('VRAQUIER', 'Grains', '', 150.0, 220.0, 8.5, 12.0, 20000, 60000, 2, 3),
  ('VRAQUIER', 'Coal', '', 140.0, 200.0, 8.0, 11.0, 15000, 45000, 2, 3),
  ('VRAQUIER', '', 'Phosphates', 170.0, 240.0, 9.0, 12.5, 25000, 55000, 2, 4),
  ('CARGO_GENERAL', 'General Cargo', '', 100.0, 180.0, 7.0, 10.0, 5000, 25000, 1, 2),
  ('ROULIER', 'Ro-Ro', 'Ro-Ro', 140.0, 200.0, 6.5, 9.0, 10000, 30000, 1, 2)
) t(p_type, p_import, p_export, len_lo, len_hi, draft_lo, draft_hi, gross_lo, gross_hi, tugs_lo, tugs_hi)
"""

VIEWS["v_vessels"] = f"""
SELECT 'P' || CAST(p_partkey % 5 AS VARCHAR) AS port_id,
  p_partkey AS call_id,
  'VSL' || CAST(p_partkey AS VARCHAR) AS name,
  p_brand AS vessel_type,
  CAST(100 + p_partkey % 250 AS DOUBLE) AS length_m,
  6 + p_size / 8.0 AS draft_m,
  p_type AS cargo_import,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'nan' ELSE {_PT}[p_partkey % 6 + 1] END AS cargo_export,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST((p_partkey * 7919) % 3153600 AS BIGINT)) AS eta,
  (1 + p_partkey % 10) * 3600000000 AS svc_us
FROM part
"""

VIEWS["v_berths"] = f"""
SELECT 'P' || CAST(s_nationkey % 5 AS VARCHAR) AS port_id,
  CAST(s_suppkey AS VARCHAR) AS berth_id,
  'T' || CAST(s_nationkey AS VARCHAR) AS terminal_name,
  CAST(s_suppkey AS INTEGER) AS ordinal,
  CAST(150 + (s_suppkey * 37) % 300 AS DOUBLE) AS quay_length_m,
  CAST(7 + (s_suppkey % 11) * 0.5 AS DOUBLE) AS depth_m,
  CASE WHEN s_suppkey % 4 = 0 THEN []::VARCHAR[]
       ELSE [{_PT}[s_suppkey % 6 + 1], {_PT}[(s_suppkey + 2) % 6 + 1]] END AS allowed_cargos,
  CASE WHEN s_suppkey % 5 < 2 THEN []::VARCHAR[]
       ELSE [ 'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || '1',
              'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || '2',
              'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || '3',
              'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || '4',
              'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || '5'] END AS allowed_types
FROM supplier
"""

# Vessel cargo set without the "no cargo" spellings.
VIEWS["v_vcargo"] = """
SELECT port_id, call_id, vessel_type, length_m, draft_m,
  list_distinct(list_filter([CASE WHEN trim(cargo_import) IN ('', 'nan', 'NaN') THEN NULL ELSE trim(cargo_import) END,
                             CASE WHEN trim(cargo_export) IN ('', 'nan', 'NaN') THEN NULL ELSE trim(cargo_export) END],
                            lambda x: x IS NOT NULL)) AS cargos
FROM v_vessels
"""

VIEWS["v_elig"] = """
SELECT v.port_id, v.call_id, b.berth_id, b.terminal_name, b.ordinal
FROM v_vcargo v JOIN v_berths b ON v.port_id = b.port_id
WHERE b.depth_m >= v.draft_m AND b.quay_length_m >= v.length_m
  AND (len(b.allowed_cargos) = 0 OR len(v.cargos) = 0 OR len(list_intersect(b.allowed_cargos, v.cargos)) > 0)
  AND (len(b.allowed_types) = 0 OR list_contains(b.allowed_types, v.vessel_type))
"""

VIEWS["v_res"] = """
SELECT o_orderkey AS call_id, 'V' || CAST(o_custkey AS VARCHAR) AS vessel_name,
  CAST(o_custkey % 50 AS VARCHAR) AS berth_id,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS start_time,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 40 AS BIGINT)) AS end_time
FROM orders
"""

VIEWS["v_queue"] = """
SELECT event_type AS pool, event_id AS call_id, 'E' || CAST(event_id AS VARCHAR) AS name,
  date_trunc('second', ts) AS eta,
  CAST(round(value * 36.0) AS BIGINT) * 1000000 AS svc_us
FROM events
"""

VIEWS["v_pool_k"] = """
SELECT * FROM (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 2), ('view', 3)) t(pool, k)
"""

VIEWS["v_plans"] = """
SELECT event_id % 20 AS plan_id, event_id AS pos, event_id AS call_id,
  CAST(user_id % 7 AS VARCHAR) AS berth_id,
  date_trunc('second', ts) AS eta,
  date_trunc('second', ts) + to_hours(CAST(event_id % 13 - 2 AS BIGINT)) AS scheduled_start,
  date_trunc('second', ts) + to_hours(CAST(event_id % 13 - 2 AS BIGINT))
    + to_microseconds(CAST(round(value * 36.0) AS BIGINT) * 1000000) AS predicted_end
FROM events
"""

VIEWS["v_actual"] = """
SELECT call_id, scheduled_start + to_minutes(CAST((call_id * 17) % 181 - 90 AS BIGINT)) AS actual_time
FROM v_plans WHERE call_id % 6 <> 0
"""


VIEWS["v_islands"] = """
SELECT berth_id, min(s) AS isl_s, max(e) AS isl_e, count(*) AS n
FROM (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm + 60000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY berth_id ORDER BY s, e, call_id ROWS UNBOUNDED PRECEDING) AS isl
      FROM (SELECT berth_id, call_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e,
                   max(epoch_us(end_time)) OVER (PARTITION BY berth_id ORDER BY epoch_us(start_time), epoch_us(end_time), call_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
            FROM v_res) f) g
GROUP BY berth_id, isl
"""

VIEWS["v_islands0"] = """
SELECT berth_id, min(s) AS isl_s, max(e) AS isl_e
FROM (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END)
                  OVER (PARTITION BY berth_id ORDER BY s, e, call_id ROWS UNBOUNDED PRECEDING) AS isl
      FROM (SELECT berth_id, call_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e,
                   max(epoch_us(end_time)) OVER (PARTITION BY berth_id ORDER BY epoch_us(start_time), epoch_us(end_time), call_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
            FROM v_res) f) g
GROUP BY berth_id, isl
"""

VIEWS["v_probes"] = """
SELECT o_orderkey AS probe_id, CAST((o_custkey + 7) % 50 AS VARCHAR) AS berth_id,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST((o_orderkey * 5) % 48 AS BIGINT)) AS t
FROM orders
"""

VIEWS["v_instants"] = """
SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR AS t FROM orders
"""

VIEWS["v_proposals"] = """
SELECT o_orderkey AS call_id, CAST((o_custkey + 1) % 50 AS VARCHAR) AS berth_id,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST((o_orderkey * 3) % 24 AS BIGINT)) AS prop_start,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST((o_orderkey * 3) % 24 + 1 + o_orderkey % 12 AS BIGINT)) AS prop_end
FROM orders
"""

VIEWS["v_pw"] = """
SELECT *, greatest(epoch_us(scheduled_start) - epoch_us(eta), 0) AS wait_us,
  epoch_us(predicted_end) - epoch_us(scheduled_start) AS service_us
FROM v_plans
"""


VIEWS["v_ais"] = """
SELECT event_id AS msg_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'U' || CAST(user_id AS VARCHAR) END AS name,
  date_trunc('second', ts) AS eta,
  6 + (event_id % 80) / 10.0 AS draft_m,
  CASE WHEN event_id % 4 = 0 THEN 'ROULIER' END AS vessel_type
FROM events
"""


VIEWS["v_long"] = """
SELECT call_id, berth_id, start_time, start_time + to_minutes(CAST(m AS BIGINT)) AS end_time
FROM (SELECT o_orderkey AS call_id, CAST(o_orderkey % 3000 AS VARCHAR) AS berth_id,
  CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS start_time,
  CASE WHEN o_orderkey % 997 = 0 THEN 15768000 ELSE (1 << CAST(o_orderkey % 20 AS INTEGER)) + o_orderkey % 7 END AS m FROM orders) a
"""

VIEWS["v_upkeep"] = """
SELECT berth_id, min(s) AS isl_s, max(e) AS isl_e
FROM (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY berth_id ORDER BY s, e, k ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT *, max(e) OVER (PARTITION BY berth_id ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
    FROM (SELECT *, s + (1 + k % 6) * 3600000000 AS e FROM (
      SELECT event_id AS k, CAST(user_id % 7 AS VARCHAR) AS berth_id, epoch_us(date_trunc('second', ts)) + (event_id % 5) * 3600000000 AS s
      FROM events WHERE event_id % 37 = 0) a) b) c) d
GROUP BY berth_id, isl
"""

VIEWS["v_timeline"] = """
SELECT berth_id, 4 * k AS seq, asked AS t, CASE WHEN k % 97 = 0 THEN 'moved' ELSE 'assign' END AS kind, k AS call_id, s, CASE WHEN k % 89 <> 0 THEN e END AS e
FROM (SELECT *, CASE WHEN k % 101 = 0 THEN e + 960 * 3600000000 ELSE s - (k % 72) * 3600000000 END AS asked
      FROM (SELECT call_id AS k, berth_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e FROM v_res) a) a
UNION ALL
SELECT berth_id, 4 * call_id + 1, epoch_us(start_time) - (call_id % 10) * 3600000000, 'offline', NULL,
  epoch_us(end_time) + 3600000000, epoch_us(end_time) + 5 * 3600000000 FROM v_res WHERE call_id % 13 = 0
UNION ALL
SELECT berth_id, 4 * k + 2, asked + (k % 30) * 3600000000, 'release', k, NULL, NULL
FROM (SELECT *, CASE WHEN k % 101 = 0 THEN e + 960 * 3600000000 ELSE s - (k % 72) * 3600000000 END AS asked
      FROM (SELECT call_id AS k, berth_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e FROM v_res) a) a WHERE k % 3 = 0
"""


def _deps(sql: str, names: list[str]) -> list[str]:
    order = list(VIEWS)
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for m in order:
            if m != n and m in VIEWS[n]:
                visit(m)

    for n in names:
        visit(n)
    for m in order:
        if m in sql:
            visit(m)
    return [n for n in order if n in need]


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it (transitively) references."""
    names_needed = _deps(sql, list(names))
    if not names_needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names_needed)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
