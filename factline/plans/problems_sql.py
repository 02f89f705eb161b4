"""DuckDB SQL for the queries of the general problems."""

INSTANT = "coalesce(try_cast({0} AS TIMESTAMPTZ), CASE WHEN regexp_full_match({0}, '-?[0-9]{{9,15}}') THEN to_timestamp(CAST({0} AS BIGINT) / 1000.0) END)"
DATE = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr({0}, 1, 10) WHEN regexp_matches({0}, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') THEN substr({0}, 7, 4) || '-' || substr({0}, 4, 2) || '-' || substr({0}, 1, 2) END"
NAME = "nullif(upper(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '')"

P1_FOUND = f"""
WITH s AS (
  SELECT body.organisasjonsnummer AS org, snapshot_date AS snap, arg_max(body, retrieved_at) AS b
  FROM register_entity WHERE status = 200 AND body.organisasjonsnummer IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2
), f AS (
  SELECT org, snap, {NAME.format("e.navn")} AS name, {DATE.format("e.fraDato")} AS fra, {DATE.format("e.tilDato")} AS til
  FROM (SELECT org, snap, unnest(b.historiskeNavn) AS e FROM s)
), ev AS (
  SELECT org, CAST(snap AS VARCHAR) AS day, 1 AS kind, {NAME.format("b.navn")} AS name, snap FROM s
  UNION ALL SELECT org, til, 0, name, min(snap) FROM f WHERE til IS NOT NULL GROUP BY ALL
  UNION ALL SELECT org, fra, 2, name, min(snap) FROM f WHERE fra IS NOT NULL GROUP BY ALL
  UNION ALL SELECT org, CAST(min(snap) AS VARCHAR), -1, name, min(snap) FROM f WHERE fra IS NULL AND til IS NULL GROUP BY org, name
), n AS (
  SELECT *, CASE WHEN lag(name) OVER w IS DISTINCT FROM name THEN 1 ELSE 0 END AS fresh FROM ev WHERE name IS NOT NULL WINDOW w AS (PARTITION BY org ORDER BY day, kind, snap, name)
), p AS (
  SELECT *, sum(fresh) OVER (PARTITION BY org ORDER BY day, kind, snap, name ROWS UNBOUNDED PRECEDING) AS no FROM n
), g AS (
  SELECT org, no, min(name) AS navn, min(day) AS d1, max(day) AS d2, min(day) FILTER (WHERE kind = 2) AS fra, max(day) FILTER (WHERE kind = 0) AS til, CAST(min(snap) AS VARCHAR) AS shown FROM p GROUP BY ALL
), r AS (
  SELECT org, min({DATE.format("b.registreringsdatoEnhetsregisteret")}) AS reg FROM s WHERE {NAME.format("b.navn")} IS NOT NULL GROUP BY 1
), h AS (
  SELECT org, no, navn, shown, CASE WHEN fra <= d1 THEN fra END AS fra, CASE WHEN til >= d2 THEN til END AS til FROM g
), v AS (
  SELECT h.org, h.no, navn, CASE WHEN h.no = 1 THEN coalesce(fra, reg, shown) ELSE coalesce(lag(til) OVER w, fra, shown) END AS valid_from
  FROM h LEFT JOIN r ON h.org = r.org WINDOW w AS (PARTITION BY h.org ORDER BY h.no)
)
SELECT org AS organisasjonsnummer, navn, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY org ORDER BY no), '') AS valid_to FROM v
"""

P1_VERSIONS = """
WITH s AS (
  SELECT body.organisasjonsnummer AS org, snapshot_date AS snap, arg_max(body, retrieved_at) AS b
  FROM register_entity WHERE status = 200 AND body.organisasjonsnummer IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2
), a AS (
  SELECT org, snap, b.postadresse.postnummer AS postcode, b.naeringskode1.kode AS industry, b.antallAnsatte AS employees, b.konkurs AS bankrupt FROM s
), c AS (
  SELECT *, row_number() OVER w = 1 OR postcode IS DISTINCT FROM lag(postcode) OVER w OR industry IS DISTINCT FROM lag(industry) OVER w
    OR employees IS DISTINCT FROM lag(employees) OVER w OR bankrupt IS DISTINCT FROM lag(bankrupt) OVER w AS fresh
  FROM a WINDOW w AS (PARTITION BY org ORDER BY snap)
)
SELECT org AS organisation_number, postcode, industry, employees, bankrupt, CAST(snap AS VARCHAR) AS valid_from,
  CAST(lead(snap) OVER (PARTITION BY org ORDER BY snap) AS VARCHAR) AS valid_to
FROM c WHERE fresh
"""

ADS = f"""
WITH cur AS (
  SELECT CAST(substr(key, 7) AS INT) AS feed_slice, arg_max({INSTANT.format("value")}, run_id) AS c FROM nav_feed_cursor
  WHERE run_status = 'success' AND regexp_full_match(key, 'slice-[0-9]+') AND value IS NOT NULL GROUP BY 1
), v AS (
  SELECT uuid, epoch_ms({INSTANT.format("sist_endret")}) AS ms, {INSTANT.format("updated_at")} AS ts, feed_slice FROM active_ads
  WHERE uuid IS NOT NULL AND sist_endret IS NOT NULL AND updated_at IS NOT NULL
), g AS (
  SELECT uuid, ms AS sist_endret_ms, bool_or(c IS NULL OR ts > c) AS late, bool_or(c IS NOT NULL AND ts <= c) AS held
  FROM v LEFT JOIN cur ON v.feed_slice = cur.feed_slice GROUP BY 1, 2
)
"""

P2_FOUND = ADS + "SELECT uuid, sist_endret_ms FROM g WHERE late AND NOT held"

P2_AFTER = (
    ADS
    + "SELECT count(*) AS versions, count(DISTINCT uuid) AS ads, 'held' AS part FROM g UNION ALL SELECT count(*), count(DISTINCT uuid), 'left over' FROM g WHERE NOT late AND NOT held"
)

P4_FOUND = """
WITH a AS (
  SELECT organisation_number AS k, arg_max(body, retrieved_at) AS b FROM register_accounts WHERE status = 200 AND body IS NOT NULL GROUP BY 1
), r AS (
  SELECT organisation_number AS k, arg_max(body, retrieved_at) AS b FROM register_roles WHERE status = 200 AND body IS NOT NULL GROUP BY 1
), f AS (
  SELECT uuid AS k, arg_max(CAST(ad_content AS JSON), retrieved_at) AS b FROM feed_entry WHERE ad_content IS NOT NULL GROUP BY 1
), w AS (
  SELECT k, json_type(b, '$.workLocations') AS t, json_extract(b, '$.workLocations') AS x FROM f
), g AS (
  SELECT k, i, b.rollegrupper[i] AS g FROM (SELECT k, b, unnest(range(1, len(b.rollegrupper) + 1)) AS i FROM r)
), c AS (
  SELECT k, i, json_extract_string(x, '$[' || i || '].city') AS city FROM (SELECT k, x, unnest(range(0, CAST(json_array_length(x) AS BIGINT))) AS i FROM w WHERE t = 'ARRAY')
  UNION ALL SELECT k, 0, json_extract_string(x, '$.city') FROM w WHERE t = 'OBJECT'
)
SELECT 'account' AS child, k AS parent_key, CAST(i - 1 AS INT) AS pos_1, -1 AS pos_2
FROM (SELECT k, b, unnest(range(1, len(b) + 1)) AS i FROM a) WHERE b[i].egenkapitalGjeld.sumEgenkapitalGjeld IS NOT NULL
UNION ALL
SELECT 'role', k, CAST(i - 1 AS INT), CAST(j - 1 AS INT) FROM (SELECT k, i, g, unnest(range(1, len(g.roller) + 1)) AS j FROM g WHERE g.sistEndret IS NOT NULL) WHERE g.roller[j] IS NOT NULL
UNION ALL
SELECT 'work_location', k, CAST(i AS INT), -1 FROM c WHERE regexp_replace(city, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]', '', 'g') <> ''
"""

P5_FOUND = """
WITH j AS (
  SELECT snapshot_no AS s, organisation_number AS o, family AS f, field AS d, coalesce(value_key, '') AS k, last_observed_at AS ts,
    CASE WHEN json_type(value) = 'OBJECT' THEN (
      SELECT string_agg(m || ':' || CAST(json_extract(value, '$."' || m || '"') AS VARCHAR), ',' ORDER BY m) FROM unnest(list_filter(json_keys(value), lambda x: x <> 'checked_at')) AS u(m)
    ) ELSE CAST(CAST(value AS JSON) AS VARCHAR) END AS v,
    reporting_period AS p, effective_date AS e, availability AS a, status AS t
  FROM claims
), l AS (
  SELECT s, o, f, d, k, arg_max({'v': v, 'p': p, 'e': e, 'a': a, 't': t}, ts) AS r FROM j GROUP BY ALL
), n AS (
  SELECT s, lead(s) OVER (ORDER BY s) AS after FROM (SELECT DISTINCT s FROM l)
), before AS (
  SELECT n.after AS s, o, f, d, k, r FROM l JOIN n ON l.s = n.s WHERE n.after IS NOT NULL
), now AS (
  SELECT l.* FROM l WHERE s > (SELECT min(s) FROM l)
)
SELECT coalesce(x.s, y.s) AS snapshot_no, coalesce(x.o, y.o) AS organisation_number, coalesce(x.f, y.f) AS family, coalesce(x.d, y.d) AS field, coalesce(x.k, y.k) AS value_key,
  CASE WHEN y.r IS NULL THEN 'added' WHEN x.r IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now x FULL OUTER JOIN before y ON x.s = y.s AND x.o = y.o AND x.f = y.f AND x.d = y.d AND x.k = y.k
WHERE x.r IS DISTINCT FROM y.r
"""

SQL = {"p1_found": P1_FOUND, "p1_attribute_versions": P1_VERSIONS, "p2_found": P2_FOUND, "p2_after_run": P2_AFTER, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
