"""The registered queries once more, as SQL for an independent engine on the same tables."""

from __future__ import annotations

RH = """
rh AS (
  SELECT c_custkey AS employee_id, n_name AS bu,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Marche/running' WHEN 'BUILDING' THEN 'Vélo/Trottinette/Autres'
      WHEN 'HOUSEHOLD' THEN NULL ELSE 'Transports en commun' END AS moyen_dep,
    30000.0e0 + c_acctbal AS salaire_brut_annuel,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 400 AS DOUBLE) / 10.0e0 END AS distance_km,
    CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'siège'
      ELSE CAST(c_custkey // 3 AS VARCHAR) || ' chemin du Moulin' END AS address
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""

ACT = """
act AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey = 303 THEN 0 WHEN o_orderkey % 97 = 0 THEN 999999999 ELSE o_custkey END AS employee_id,
    o_orderdate AS date_debut,
    CASE WHEN o_orderkey = 303 THEN 'BACKFILL_COMPLETE' WHEN o_orderkey % 50 = 7 THEN 'natation'
      ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'course à pied' WHEN '2-HIGH' THEN 'vélo'
        WHEN '3-MEDIUM' THEN 'marche' WHEN '4-NOT SPECIFIED' THEN 'randonnée' ELSE 'escalade' END
      END AS type_activite,
    o_totalprice / 20.0e0 AS distance_m, CAST((o_orderkey * 37) % 9000 AS INT) AS duree_s,
    'Commande "' || o_orderpriority || '"' AS commentaire,
    CASE o_orderkey % 10 WHEN 0 THEN 'u' WHEN 1 THEN 'd' WHEN 2 THEN 'r' ELSE 'c' END AS op
  FROM orders)"""

PRIME = """
prime AS (
  SELECT employee_id, bu, salaire_brut_annuel, distance_km,
    coalesce((moyen_dep = 'Marche/running' AND distance_km <= 15)
      OR (moyen_dep = 'Vélo/Trottinette/Autres' AND distance_km <= 25), false) AS prime_sportive
  FROM rh)"""

COMMUTE = """
SELECT employee_id, bu, prime_sportive,
  CASE WHEN prime_sportive THEN salaire_brut_annuel * 0.05e0 ELSE 0.0e0 END AS montant_prime_euros,
  distance_km, prime_sportive AS declaration_correcte
FROM prime"""


def _well(source: str, key: str = "employee_id", where: str = "true") -> str:
    return f"""
well AS (
  SELECT {key} AS employee_id, count(*) AS nb_activites, count(*) >= 15 AS jours_bien_etre
  FROM {source} WHERE {where} GROUP BY 1)"""


WELL = _well("act", where="op <> 'd'")

GOLD = """
SELECT prime.employee_id, bu, prime_sportive,
  CASE WHEN prime_sportive THEN salaire_brut_annuel * 0.05e0 ELSE 0.0e0 END AS montant_prime_euros,
  distance_km, coalesce(nb_activites, 0) AS nb_activites,
  coalesce(jours_bien_etre, false) AS jours_bien_etre, prime_sportive AS declaration_correcte
FROM prime LEFT JOIN well ON well.employee_id = prime.employee_id"""

MEASURES = """count(*) AS employees, CAST(count(*) FILTER (WHERE prime_sportive) AS BIGINT) AS primes,
  CAST(sum(CAST(montant_prime_euros AS DECIMAL(18, 4))) AS DOUBLE) AS total_primes_euros,
  CAST(count(*) FILTER (WHERE jours_bien_etre) AS BIGINT) AS bien_etre,
  CAST(sum(nb_activites) AS BIGINT) AS activites"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts[:-1]) + parts[-1]


def _decoded(kept: str, id_kept: str = "true", source: str = "act") -> str:
    def keep(column: str, name: str, condition: str = kept) -> str:
        return f"CASE WHEN {condition} THEN {column} END AS {name}"
    columns = [
        keep("CAST(id AS INT)", "id", f"({kept}) AND ({id_kept})"),
        keep("CAST(employee_id AS INT)", "employee_id"),
        keep("epoch_us(date_debut)", "date_debut"), keep("type_activite", "type_activite"),
        keep("distance_m", "distance_m"), keep("duree_s", "duree_s"), keep("commentaire", "commentaire"),
        keep("date_debut", "date_debut_ts"),
    ]
    return f"\nSELECT {', '.join(columns)} FROM {source}"


NOTIFICATIONS = """
SELECT CAST(0 AS INT) AS "partition", id AS "offset", CAST(id AS INT) AS id,
  '*Nouvelle activité sportive !* :runner:' || chr(10) ||
  '> *Employé* : `' || employee_id || '`' || chr(10) ||
  '> *Type*    : *' || type_activite || '*' || chr(10) ||
  '> *Distance*: ' || CAST(distance_m AS VARCHAR) || ' m' || chr(10) ||
  '> *Durée*   : ' || duree_s || ' s' || chr(10) ||
  '> *Date*    : ' || strftime(date_debut, '%Y-%m-%d %H:%M') AS text
FROM act
WHERE op = 'c' AND type_activite <> 'BACKFILL_COMPLETE'
  AND id > (SELECT min(id) FROM act WHERE op = 'c' AND type_activite = 'BACKFILL_COMPLETE')"""

# (number, expectation, column, violation); the reference rule looks the id up in customer.
_RULES = (
    (0, "expect_column_values_to_not_be_null", "employee_id", "employee_id IS NULL"),
    (1, "expect_column_values_to_be_in_set", "employee_id",
     "employee_id IS NOT NULL AND employee_id NOT IN (SELECT c_custkey FROM customer)"),
    (2, "expect_column_values_to_be_between", "distance_m", "distance_m < 0 OR distance_m > 20000"),
    (3, "expect_column_values_to_be_between", "duree_s", "duree_s < 600 OR duree_s > 7200"),
    (4, "expect_column_values_to_be_between", "date_debut",
     "date_debut < TIMESTAMP '2000-08-01 00:00:00' OR date_debut > TIMESTAMP '2001-08-01 01:00:00'"),
    (5, "expect_column_values_to_be_in_set", "type_activite",
     "type_activite NOT IN ('course à pied', 'vélo', 'marche', 'randonnée', 'escalade')"),
)

CHECKED = "\nchecked AS (SELECT * FROM act WHERE type_activite IS DISTINCT FROM 'BACKFILL_COMPLETE')"
STATISTICS = "\nstatistics AS (" + " UNION ALL ".join(f"""
  SELECT (SELECT count(*) FROM act) AS rows_read, (SELECT count(*) FROM checked) AS rows_checked,
    CAST({number} AS INT) AS rule_no, '{kind}' AS expectation, '{column}' AS column_name,
    count(*) AS unexpected_count, count(*) = 0 AS success
  FROM checked WHERE {violation}""" for number, kind, column, violation in _RULES) + ")"
VIOLATIONS = " UNION ALL ".join(f"""
  SELECT id, CAST({number} AS INT) AS rule_no, '{kind}' AS expectation, '{column}' AS column_name,
    CAST({column} AS VARCHAR) AS value
  FROM checked WHERE {violation}""" for number, kind, column, violation in _RULES)

# Metres of an address follow from its lowest customer key, unless the answer is unusable.
ROUTES = """
routes AS (
  SELECT address, CASE WHEN k % 7 = 0 OR k % 17 = 0 OR k % 23 = 0 OR k % 11 = 0 OR k % 19 = 0 THEN NULL
      ELSE CAST(printf('%.2f', ((k * 7919) % 60000) / 1000.0e0) AS DOUBLE) END AS distance_km
  FROM (SELECT address, min(employee_id) AS k FROM rh WHERE address IS NOT NULL GROUP BY address))"""


def _declared(mode: str, distance: str) -> str:
    return (f"CASE WHEN {mode} = 'Marche/running' AND {distance} > 15 THEN false"
            f" WHEN {mode} = 'Vélo/Trottinette/Autres' AND {distance} > 25 THEN false ELSE true END")


def _draw(digest: str, piece: int, lowest: int, highest: int) -> str:
    number = f"CAST('0x' || substr({digest}, {8 * piece + 1}, 8) AS BIGINT)"
    return f"({lowest} + {number} % {highest - lowest + 1})"


GENERATED = f"""
numbered AS (
  SELECT c_custkey AS employee_id,
    unnest(range(1, 1 + {_draw("md5('42|' || c_custkey)", 0, 10, 25)})) AS k
  FROM customer),
hashed AS (SELECT employee_id, md5('42|' || employee_id || '|' || k) AS h FROM numbered),
drawn AS (
  SELECT employee_id, TIMESTAMP '2001-08-01 00:00:00' - to_days(CAST({_draw('h', 0, 0, 364)} AS INT)) AS date_debut,
    ['course à pied', 'vélo', 'marche', 'randonnée', 'escalade'][1 + {_draw('h', 1, 0, 4)}] AS type_activite,
    {_draw('h', 2, 80000, 2000000)} / 100.0e0 AS distance_m, CAST({_draw('h', 3, 600, 7200)} AS INT) AS duree_s
  FROM hashed)
SELECT *, 'Session de ' || type_activite || ' de ' || CAST(distance_m AS VARCHAR) || ' m, durée ' || duree_s || ' s.'
  AS commentaire FROM drawn
UNION ALL SELECT 999999999, TIMESTAMP '2001-08-01 00:00:00', 'course à pied', 5000.0e0, 1800, 'Session de test unique'
UNION ALL SELECT 0, TIMESTAMP '2001-08-01 00:00:00', 'BACKFILL_COMPLETE', 0.0e0, 0, '--- FIN DU BACKFILL POC ---'"""

STEPS = """
valued AS (
  SELECT user_id, ts, CAST(value AS DECIMAL(18, 4)) AS v,
    lag(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events),
steps AS (SELECT user_id, ts, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS grown FROM valued)"""

RATE = """
rate AS (
  SELECT user_id % 2 AS app, date_trunc('hour', ts) AS window_start, count(*) AS events,
    count(*) / 3600.0e0 AS per_second
  FROM events GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "hr_reference": _with(RH, """
SELECT employee_id, bu, moyen_dep, CASE WHEN employee_id % 101 <> 0 THEN salaire_brut_annuel END
  AS salaire_brut_annuel, distance_km FROM rh"""),
    "commute_bonus": _with(RH, PRIME, COMMUTE),
    "wellness_days": _with(ACT, WELL, "\nSELECT * FROM well"),
    "wellness_trailing": _with(
        ACT, _well("act", where="op <> 'd' AND date_debut BETWEEN TIMESTAMP '2000-08-01' AND TIMESTAMP '2001-08-01'"),
        "\nSELECT * FROM well"),
    "wellness_daily": _with(
        ACT, _well("act", where="op <> 'd' AND date_debut BETWEEN TIMESTAMP '2000-08-01' AND TIMESTAMP '2001-08-01'"),
        "\nSELECT * FROM well"),
    "gold_trailing_stream": _with(
        RH, ACT, PRIME, _well("act", where="op <> 'd' AND date_debut BETWEEN TIMESTAMP '2000-08-01' AND TIMESTAMP '2001-08-01'"), GOLD),
    "gold_eligibility": _with(RH, ACT, PRIME, WELL, GOLD),
    "gold_sparse": _with(RH, PRIME, _well("events", "user_id"), GOLD),
    "gold_sql_kpi": _with(RH, ACT, PRIME, WELL, f"\nSELECT bu, {MEASURES} FROM ({GOLD}) GROUP BY bu"),
    "gold_sql_total": _with(RH, ACT, PRIME, WELL, f"\nSELECT {MEASURES} FROM ({GOLD})"),
    "cdc_decode": _with(ACT, _decoded("op <> 'd'")),
    "cdc_decode_damaged": _with(ACT, _decoded("op <> 'd' AND id % 8 IN (6, 7)", "id % 8 <> 6")),
    "bronze_stream": _with(ACT, _decoded("op <> 'd'")),
    "gold_stream": _with(RH, ACT, PRIME, WELL, GOLD),
    "gold_stream_rebuild": _with(RH, ACT, PRIME, WELL, GOLD),
    "notifications": _with(ACT, NOTIFICATIONS),
    "notifications_stream": _with(ACT, NOTIFICATIONS),
    "dq_statistics": _with(ACT, CHECKED, STATISTICS, "\nSELECT * FROM statistics"),
    "dq_summary": _with(ACT, CHECKED, STATISTICS, """
SELECT max(rows_read) AS rows_read, max(rows_checked) AS rows_checked, count(*) AS evaluated,
  count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS unsuccessful,
  count(*) FILTER (WHERE success) * 100.0e0 / count(*) AS success_percent, bool_and(success) AS success
FROM statistics"""),
    "dq_violations": _with(ACT, CHECKED, VIOLATIONS),
    "invalid_employee_ids": _with(ACT, CHECKED, """
SELECT DISTINCT employee_id FROM checked
WHERE employee_id IS NOT NULL AND employee_id NOT IN (SELECT c_custkey FROM customer)"""),
    "distance_parse": _with(RH, ROUTES, "\nSELECT * FROM routes"),
    "distinct_addresses": _with(RH, "\nSELECT DISTINCT address FROM rh WHERE address IS NOT NULL"),
    "distance_enrich": _with(RH, ROUTES, """
SELECT employee_id, bu, moyen_dep, salaire_brut_annuel, routes.distance_km, rh.address
FROM rh LEFT JOIN routes ON routes.address = rh.address"""),
    "declaration_check": _with(
        RH, f"\nSELECT * EXCLUDE (address), {_declared('moyen_dep', 'distance_km')} AS declaration_correcte FROM rh"),
    "hr_writeback": _with(RH, ROUTES, f"""
SELECT CAST(employee_id AS VARCHAR) AS "ID salarié", bu AS "BU", moyen_dep,
  CASE WHEN employee_id % 101 = 0 THEN 'n/a' ELSE CAST(salaire_brut_annuel AS VARCHAR) END AS "Salaire brut",
  rh.address AS "Adresse du domicile", routes.distance_km,
  {_declared('moyen_dep', 'routes.distance_km')} AS declaration_correcte
FROM rh LEFT JOIN routes ON routes.address = rh.address"""),
    "activities_by_date": _with(ACT, "\nSELECT * FROM act ORDER BY date_debut, id"),
    "activity_generator": "WITH" + GENERATED,
    "activity_load": "WITH" + GENERATED,
    "stream_liveness": """
SELECT CAST(user_id AS VARCHAR) AS stream, max(ts) AS last_seen,
  CAST(max(ts) >= TIMESTAMP '2024-01-30 12:00:00' AS INT) AS up
FROM events GROUP BY 1""",
    "batch_rate": _with(RATE, "\nSELECT * FROM rate"),
    "threshold_status": _with(RATE, """
SELECT app, window_start, events, CASE WHEN events >= 80 THEN 'red' ELSE 'green' END AS colour FROM rate"""),
    "counter_increase": _with(STEPS, """
SELECT user_id, date_trunc('hour', ts) AS window_start, CAST(sum(grown) AS DOUBLE) AS increase, count(*) AS samples
FROM steps GROUP BY 1, 2"""),
    "counter_rate": _with(STEPS, """
SELECT user_id % 2 AS app, date_trunc('hour', ts) AS window_start,
  CAST(CAST(round(sum(grown) * 10000 / 3600, 0) AS BIGINT) AS DOUBLE) / 10000 AS per_second
FROM steps GROUP BY 1, 2"""),
    "cdc_lag": """
WITH lagged AS (
  SELECT user_id, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS arrived,
    (epoch_us(ts) % 1000 + CAST(round(value * 1000000) AS BIGINT)) // 1000 AS lag_ms  -- commit time in whole ms
  FROM events)
SELECT user_id, date_trunc('hour', arrived) AS window_start, max({'at': arrived, 'lag': lag_ms}).lag AS last_lag_ms,
  max(lag_ms) AS max_lag_ms
FROM lagged GROUP BY 1, 2""",
    "sessions_by_state": """
SELECT event_type AS state, count(*) AS sessions FROM events
WHERE event_id % 5 <> 0 AND user_id % 3 <> 0 GROUP BY 1""",
}

_OTHER_RULES = (("<= 15)", "<= 10)"), ("<= 25)", "<= 20)"), (">= 15 AS", ">= 12 AS"), ("* 0.05e0", "* 0.08e0"))


def _other_rules(sql: str) -> str:
    """The same statement under the second rules file of gold_stream_rules."""
    for one, other in _OTHER_RULES:
        sql = sql.replace(one, other)
    return sql


ORACLES["gold_stream_sql"] = ORACLES["gold_sql_kpi"]
ORACLES["dq_table"] = ORACLES["dq_statistics"]
ORACLES["gold_stream_rules"] = _other_rules(ORACLES["gold_stream"]).replace("coalesce(nb_activites, 0) AS nb_activites,", """coalesce(nb_activites, 0) AS nb_activites,
  md5('{"prime_sportive": {"percent": 0.08}, "bien_etre": {"min_activities": 12}, "distance": {"max_walk_km": 10, "max_bike_km": 20}}'
      || chr(10)) AS fingerprint,""")
ORACLES["stream_progress"] = "SELECT 'bronze' AS stream, CAST(4 AS BIGINT) AS batches, count(*) AS input_rows FROM orders"
ORACLES["unreadable_messages"] = """
SELECT count(*) AS input_rows, count(*) FILTER (o_orderkey % 8 IN (0, 3, 6)) AS unreadable,
  count(*) FILTER (o_orderkey % 8 IN (1, 2, 4, 5)) AS empty, count(*) FILTER (o_orderkey % 8 IN (0, 3, 6)) AS kept,
  max(o_orderkey) FILTER (o_orderkey % 8 IN (0, 3, 6)) AS last_kept
FROM orders"""
ORACLES["stream_heartbeats"] = """
SELECT stream, CAST(up AS INTEGER) AS up, (SELECT count(*) FROM orders) AS input_rows
FROM (VALUES ('bronze', 0), ('quarantine', 1)) AS t(stream, up)"""
ORACLES["batch_rate_stream"] = ORACLES["batch_rate"]
ORACLES["counter_increase_stream"] = ORACLES["counter_increase"]
ORACLES["notifications_topic"] = _with(ACT.replace("WHEN o_orderkey = 303 THEN 'BACKFILL_COMPLETE'", "WHEN o_orderkey IN (303, 304) THEN 'BACKFILL_COMPLETE'"), """
gates AS (SELECT id % 3 AS part, min(id) AS barrier FROM act WHERE op = 'c' AND type_activite = 'BACKFILL_COMPLETE' GROUP BY 1)""",
    NOTIFICATIONS.replace("CAST(0 AS INT)", "CAST(part AS INT)").replace("FROM act\n", "FROM act JOIN gates ON part = id % 3\n").replace(
        "(SELECT min(id) FROM act WHERE op = 'c' AND type_activite = 'BACKFILL_COMPLETE')", "barrier"))
CURRENT = """
latest AS (SELECT * REPLACE (id // 4 AS id), id AS "offset" FROM act QUALIFY row_number() OVER (PARTITION BY id // 4 ORDER BY id DESC) = 1),
present AS (SELECT * FROM latest WHERE op <> 'd')"""
ORACLES["current_activities"] = _with(ACT, CURRENT, """
SELECT "offset", op, CAST(id AS INT) AS id, CAST(employee_id AS INT) AS employee_id, epoch_us(date_debut) AS date_debut, type_activite,
  distance_m, duree_s, commentaire, date_debut AS date_debut_ts FROM present""")
ORACLES["gold_current_stream"] = _with(RH, ACT, CURRENT, PRIME, _well("present"), GOLD)
ORACLES["dq_loads"] = ORACLES["dq_statistics"]
ORACLES["notifications_folded"] = ORACLES["notifications"]
ORACLES["bronze_folded"] = ORACLES["bronze_stream"]
