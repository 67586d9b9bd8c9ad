"""The same queries as plain SQL, written independently of the Spark plans."""

from __future__ import annotations

from hashgrove.sources.views import view_sql


def _sql(views: list[str], select: str, **ctes: str) -> str:
    parts = [f"{v} AS ({view_sql(v)})" for v in views]
    parts += [f"{name} AS ({body})" for name, body in ctes.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


def _classes(windows: str, iphone: str, x11: str, android: str, default: str) -> str:
    """Classes of the view's agents, written by hand."""
    return f"""CASE WHEN user_agent LIKE 'Mozilla/5.0 (Windows NT%' THEN '{windows}'
      WHEN user_agent LIKE 'Mozilla/5.0 (iPhone;%' THEN '{iphone}' WHEN user_agent LIKE 'Mozilla/5.0 (X11;%' THEN '{x11}'
      WHEN user_agent LIKE 'Mozilla/5.0 (Linux; Android%' THEN '{android}' ELSE '{default}' END"""


DEVICE = _classes("Personal computer", "Smartphone", "Personal computer", "Smartphone", "UNKNOWN-DEVICETYPE")
OS = _classes("Windows", "iOS", "Linux", "Android", "UNKNOWN-OS")
BROWSER = _classes("Chrome", "Safari", "Firefox", "Chrome", "UNKNOWN-BROWSER")
PRICING = "coalesce(nullif(pricing_type, ''), 'UNKNOWN-PRICINGTYPE')"
SOURCE = "coalesce(nullif(buyeruid_source, ''), 'UNKNOWN-UIDSOURCE')"
PROFIT = (
    "coalesce(actual_dsp_fee, 0) + coalesce(actual_pgm_fee, 0)"
    " + coalesce(actual_ssp_fee, 0) + coalesce(thirdparty_margin, 0)"
)

DEDUPED = """
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (
    PARTITION BY coalesce(decision_id, ''), coalesce(redecision_attempt, -1)
    ORDER BY ts, impression_id) AS rk
  FROM impressions WHERE is_first_impression) WHERE rk = 1"""
DROP_KEY = (
    "coalesce(nullif(md5, ''), nullif(sh1, ''), nullif(sh2, ''), '') AS hash,"
    " coalesce(template_id, -1) AS template_id, placement_id"
)
# the groups of each row, as they are defined
PAIRS = """
SELECT impression_id, 'ALL' AS bidder,
  CASE WHEN email_hash IS NULL THEN 'NO-HASH' ELSE 'OUTSIDE-GROUPS' END AS grp FROM deduped
UNION ALL
SELECT impression_id, 'ALL-RTB',
  CASE WHEN email_hash IS NULL THEN 'NO-HASH' ELSE 'OUTSIDE-GROUPS' END
FROM deduped WHERE bidder_id IS NOT NULL
UNION ALL
SELECT impression_id, CAST(bidder_id AS varchar), 'NO-HASH'
FROM deduped WHERE bidder_id IS NOT NULL AND email_hash IS NULL
UNION ALL
SELECT impression_id, CAST(bidder_id AS varchar), 'UNKNOWN-BIDDER'
FROM deduped WHERE bidder_id IS NOT NULL"""
KEYS = "SELECT * FROM pairs UNION SELECT impression_id, bidder, 'ALL' FROM pairs"
FAN = "SELECT k.bidder, k.grp, d.* FROM keys k JOIN deduped d USING (impression_id)"
MEASURES = f"""
SELECT bidder, grp, 'spend' AS measure, coalesce(advertiser_spent, 0) AS v FROM fan
UNION ALL SELECT bidder, grp, 'clearingPrice', coalesce(clearing_price, 0) FROM fan
UNION ALL SELECT bidder, grp, 'expProfit', {PROFIT} FROM fan"""
MOMENTS = """
SELECT bidder, grp, measure, count(*) AS n, avg(v) AS mean, var_pop(v) AS var
FROM measures GROUP BY ALL"""
VALUES = f"""
SELECT bidder, grp, 'pricingTypes' AS measure, {PRICING} AS value FROM fan
UNION ALL SELECT bidder, grp, 'deviceTypes', {DEVICE} FROM fan
UNION ALL SELECT bidder, grp, 'oss', {OS} FROM fan
UNION ALL SELECT bidder, grp, 'browsers', {BROWSER} FROM fan
UNION ALL SELECT bidder, grp, 'sourcesImp', {SOURCE} FROM fan"""
FREQUENCIES = """
SELECT *, row_number() OVER (PARTITION BY bidder, grp, measure ORDER BY n DESC, value) AS rk
FROM (SELECT bidder, grp, measure, value, count(*) AS n FROM vals GROUP BY ALL)"""

_FAN = {"deduped": DEDUPED, "pairs": PAIRS, "keys": KEYS, "fan": FAN}
_MOMENTS = {**_FAN, "measures": MEASURES, "moments": MOMENTS}
_VALUES = {**_FAN, "vals": VALUES, "freq": FREQUENCIES}


def _impressions(select: str, **ctes: str) -> str:
    return _sql(["impressions"], select, **ctes)


_TOTALS = ("identifiers", "opens", "clicks", "conversions")
# one row per (identifier, partner)
OWNED = """
SELECT DISTINCT identifier, CASE WHEN license LIKE 'AudienceAcuity%' THEN 'Audience Accuity'
  WHEN license = 'LiveRampPelFile' THEN 'LiveRamp' ELSE license END AS partner
FROM license_info WHERE license <> 'UnknownFile'"""
CHOICES = """
SELECT * FROM (VALUES ('Audience Accuity', ['Audience Accuity']), ('LiveRamp', ['LiveRamp']),
  ('TowerData', ['TowerData']), ('Audience Accuity+LiveRamp', ['Audience Accuity', 'LiveRamp']),
  ('Audience Accuity+TowerData', ['Audience Accuity', 'TowerData']),
  ('LiveRamp+TowerData', ['LiveRamp', 'TowerData']),
  ('Audience Accuity+LiveRamp+TowerData', ['Audience Accuity', 'LiveRamp', 'TowerData'])
) AS c(subset, partners)"""
COVERED = """
SELECT DISTINCT subset, identifier FROM choices c JOIN owned o ON list_contains(c.partners, o.partner)"""
COVERAGE = """
SELECT subset, count(*) AS identifiers, CAST(sum(opens) AS bigint) AS opens,
  CAST(sum(clicks) AS bigint) AS clicks, CAST(sum(conversions) AS bigint) AS conversions
FROM covered JOIN identifier_info USING (identifier) GROUP BY subset"""
_COVERAGE = {"owned": OWNED, "choices": CHOICES, "covered": COVERED, "coverage": COVERAGE}
_SUMS = ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in _TOTALS[1:])


def _licensing(select: str, **ctes: str) -> str:
    return _sql(["identifier_info", "license_info"], select, **ctes)


def _lacking(select: str, **ctes: str) -> str:
    return _sql(["identifier_info"], select, license_info=view_sql("license_info_lacking"), **ctes)


# bytes of a text: header and two bytes per UTF-16 unit
def _text(column: str) -> str:
    beyond = f"regexp_replace({column}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')"
    return f"(8 + coalesce(2 * (length({column}) + length({beyond})), 0))"


_DOC_SIZE = f"(5 * 8 + 8 + {_text('text')} + {_text('lang')} + {_text('source')} + 8)"

_CLOSURE = (
    "RECURSIVE edges AS ({edges}), reach AS (SELECT DISTINCT src, dst FROM edges"
    " UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"
)


def _closure(select: str, view: str = "dependency_edges", **ctes: str) -> str:
    parts = [_CLOSURE.format(edges=view_sql(view)), *[f"{k} AS ({v})" for k, v in ctes.items()]]
    return f"WITH {', '.join(parts)} {select}"


_DELTA = """
SELECT seq, email_hash, trim(v) AS idl, pos FROM (
  SELECT seq, email_hash, unnest(string_split(idls, ';')) AS v,
    generate_subscripts(string_split(idls, ';'), 1) AS pos
  FROM id_delta_raw) WHERE trim(v) <> ''"""
_REDUCED = "SELECT email_hash, arg_max(idl, seq * 1000 + pos) AS idl FROM delta GROUP BY email_hash"
_MERGED = """
SELECT coalesce(c.email_hash, d.email_hash, o.email_hash) AS email_hash,
  coalesce(d.idl, c.idl) AS idl, coalesce(nullif(o.oracle_id, ''), c.oracle_id) AS oracle_id,
  concat_ws('+', CASE WHEN c.side THEN 'current' END, CASE WHEN d.side THEN 'delta' END,
    CASE WHEN o.side THEN 'oracle' END) AS presence
FROM (SELECT *, true AS side FROM id_current) c
FULL JOIN (SELECT *, true AS side FROM reduced) d ON c.email_hash = d.email_hash
FULL JOIN (SELECT *, true AS side FROM id_oracle) o ON coalesce(c.email_hash, d.email_hash) = o.email_hash"""
_ID_VIEWS = ["id_current", "id_delta_raw", "id_oracle"]
_ID = {"delta": _DELTA, "reduced": _REDUCED, "merged": _MERGED}

_SHARD = "CASE WHEN regexp_matches({0}, '^[0-9a-f]') THEN substring({0}, 1, 1) ELSE 's' END"
_VOLUME = {
    "volume": """SELECT event_type AS entity, CAST(ts AS date)
  + CASE WHEN event_type = 'error' AND CAST(ts AS date) = DATE '2024-01-10' THEN 1 ELSE 0 END AS day,
  count(*) AS n FROM events GROUP BY ALL"""
}
_CALENDAR = _VOLUME | {
    "spine": """SELECT entity, CAST(unnest(generate_series(CAST(min(day) AS timestamp),
  CAST((SELECT max(day) FROM volume) AS timestamp), INTERVAL 1 DAY)) AS date) AS day FROM volume GROUP BY entity""",
    "daily": "SELECT entity, day, coalesce(n, 0) AS n FROM spine LEFT JOIN volume USING (entity, day)",
}
_DAYS = {
    "days": """
SELECT person_id, CAST(ts AS date) AS day, count(*) AS readings,
  avg(body_temperature) AS t, avg(heart_rate) AS h, avg(blood_oxygen) AS o,
  max(body_temperature) AS t_max FROM vitals GROUP BY ALL""",
    "medians": """
SELECT quantile_disc(body_temperature, 0.5) AS t, quantile_disc(heart_rate, 0.5) AS h,
  quantile_disc(blood_oxygen, 0.5) AS o FROM vitals""",
}

_BOTH = "first_party_id <> '' AND third_party_id <> ''"
_NO_ALL = "bidder NOT IN ('ALL', 'ALL-RTB')"


def _frequency(measure: str) -> str:
    where = f"FROM freq f WHERE f.bidder = g.bidder AND f.grp = g.grp AND f.measure = '{measure}'"
    return (
        f'(SELECT count(*) {where}) AS "{measure}_values",'
        f' (SELECT CAST(sum(n) AS bigint) {where}) AS "{measure}_rows"'
    )


def _moment(measure: str, column: str) -> str:
    is_it = f"FILTER (WHERE measure = '{measure}')"
    return (
        f"max(n) {is_it} AS {column}_n, round(max(mean) {is_it}, 4) AS {column}_mean,"
        f" round(sqrt(max(var) {is_it}), 4) AS {column}_stddev"
    )


_EVENT_FILES = """SELECT substring(md5(CAST(user_id AS varchar)), 1, 1) AS shard, strftime(ts, '%Y%m%d') AS day, event_id % 3 AS part,
    event_id, event_type FROM events"""

_WIDE_VALUES = """SELECT l_returnflag AS flag, CASE WHEN l_quantity <= 10 THEN concat('q', CAST(l_quantity AS int))
    ELSE concat('o', l_orderkey) END AS value FROM lineitem"""

_LATTICE = """WITH m AS (SELECT l_partkey AS identifier, bit_or(1 << CAST((l_suppkey + l_partkey % 3) % 12 AS int)) AS mask FROM lineitem WHERE l_quantity <= 9 GROUP BY l_partkey),
    c AS (SELECT mask, count(*) AS identifiers, CAST(sum(p_size) AS bigint) AS opens, count(*) AS clicks FROM part JOIN m ON p_partkey = identifier GROUP BY mask),
    s AS (SELECT range AS s, list_aggregate(list_transform(list_filter(range(12), lambda i: (range >> i) & 1 = 1), lambda i: 'P' || lpad(CAST(i AS varchar), 2, '0')), 'string_agg', '+') AS subset
        FROM range(1, 4096))
    SELECT subset, CAST(coalesce(sum(identifiers), 0) AS bigint) AS identifiers, CAST(coalesce(sum(opens), 0) AS bigint) AS opens,
        CAST(coalesce(sum(clicks), 0) AS bigint) AS clicks, CAST(0 AS bigint) AS conversions FROM s LEFT JOIN c ON s & mask <> 0 GROUP BY subset"""

ORACLES: dict[str, str] = {
    "remove_scrapers": _sql(
        ["tracking_events"],
        f"""SELECT event_id, first_party_id, third_party_id FROM tracking_events t
        WHERE NOT EXISTS (SELECT 1 FROM scrapers s WHERE s.first_party_id = t.first_party_id)""",
        scrapers=f"""SELECT first_party_id FROM tracking_events WHERE {_BOTH}
        GROUP BY first_party_id HAVING count(DISTINCT third_party_id) > 1""",
    ),
    "scraper_ids": _sql(
        ["tracking_events"],
        f"""SELECT first_party_id, count(DISTINCT third_party_id) AS n_ids FROM tracking_events
        WHERE {_BOTH} GROUP BY first_party_id HAVING count(DISTINCT third_party_id) > 1""",
    ),
    "id_delta_expand": _sql(["id_delta_raw"], "SELECT seq, email_hash, idl FROM delta", delta=_DELTA),
    "id_delta_reduce": _sql(
        ["id_delta_raw"], "SELECT * FROM reduced", delta=_DELTA, reduced=_REDUCED
    ),
    "id_merge": _sql(_ID_VIEWS, "SELECT * FROM merged", **_ID),
    "id_presence_counts": _sql(
        _ID_VIEWS, "SELECT presence, count(*) AS n FROM merged GROUP BY presence", **_ID
    ),
    "dedupe_impressions": _impressions("SELECT * EXCLUDE (ts) FROM deduped", deduped=DEDUPED),
    "broken_drop_keys": _impressions(
        f"SELECT DISTINCT {DROP_KEY} FROM deduped WHERE is_broken_drop", deduped=DEDUPED
    ),
    "flag_broken_drops": _impressions(
        """SELECT impression_id, is_broken_drop OR EXISTS (SELECT 1 FROM broken b
          WHERE b.hash = k.hash AND b.template_id = k.template_id
          AND b.placement_id IS NOT DISTINCT FROM k.placement_id) AS is_broken_drop FROM keyed k""",
        deduped=DEDUPED,
        keyed=f"SELECT impression_id, is_broken_drop, {DROP_KEY} FROM deduped",
        broken="SELECT DISTINCT hash, template_id, placement_id FROM keyed WHERE is_broken_drop",
    ),
    "ua_classes": _impressions(
        f"SELECT impression_id, {DEVICE} AS device, {OS} AS os, {BROWSER} AS browser FROM impressions"
    ),
    "expected_profit": _impressions(
        f"SELECT impression_id, round({PROFIT}, 8) AS exp_profit FROM impressions"
    ),
    "category_defaults": _impressions(
        f"SELECT impression_id, {PRICING} AS pricing, {SOURCE} AS source FROM impressions"
    ),
    "group_fanout": _impressions(
        "SELECT bidder, grp, count(*) AS n FROM keys GROUP BY ALL",
        deduped=DEDUPED, pairs=PAIRS, keys=KEYS,
    ),
    "group_fanout_literal": _impressions(
        """SELECT bidder, grp, count(*) AS n FROM (SELECT bidder, grp FROM pairs
          UNION ALL SELECT bidder, 'ALL' FROM pairs) GROUP BY ALL""",
        deduped=DEDUPED, pairs=PAIRS,
    ),
    "group_fanout_no_all": _impressions(
        f"SELECT bidder, grp, count(*) AS n FROM keys WHERE {_NO_ALL} GROUP BY ALL",
        deduped=DEDUPED, pairs=PAIRS, keys=KEYS,
    ),
    "group_moments": _impressions(
        """SELECT bidder, grp, measure, n, round(mean, 4) AS mean, round(sqrt(var), 4) AS stddev
        FROM moments""",
        **_MOMENTS,
    ),
    "group_sums": _impressions(
        """SELECT bidder, grp, 'isRtb' AS measure, count(*) AS total FROM fan
        WHERE bidder_id IS NOT NULL GROUP BY ALL""",
        **_FAN,
    ),
    "group_proportions": _impressions(
        """SELECT bidder, grp, 'isRtb' AS measure, count(bidder_id) AS hits, count(*) AS total
        FROM fan GROUP BY ALL
        UNION ALL SELECT bidder, grp, 'clicks', CAST(0 AS bigint), count(*) FROM fan GROUP BY ALL""",
        **_FAN,
    ),
    "group_categories": _impressions(
        "SELECT bidder, grp, measure, value, n FROM freq WHERE rk <= 50", **_VALUES
    ),
    "group_categories_approx": _impressions(
        "SELECT bidder, grp, measure, value, n FROM freq WHERE rk <= 50", **_VALUES
    ),
    "category_estimates": f"SELECT flag, value, count(*) AS n, TRUE AS within FROM ({_WIDE_VALUES}) GROUP BY flag, value",
    "category_hitters": f"""SELECT flag, value, n, TRUE AS above FROM (SELECT flag, value, count(*) AS n,
        row_number() OVER (PARTITION BY flag ORDER BY count(*) DESC, value) AS rk FROM ({_WIDE_VALUES}) GROUP BY flag, value) WHERE rk <= 10""",
    "group_wide_categories": _impressions(
        """SELECT bidder, grp, 'users' AS measure, value, n FROM (SELECT *, row_number() OVER (PARTITION BY bidder, grp ORDER BY n DESC, value) AS rk
        FROM (SELECT bidder, grp, concat_ws('-', template_id, placement_id, bidder_id) AS value, count(*) AS n FROM fan GROUP BY ALL)) WHERE rk <= 50""",
        **_FAN,
    ),
    "group_category_statistic": _impressions(
        """SELECT bidder, grp, measure, value, n, total FROM freq JOIN
        (SELECT bidder, grp, count(*) AS total FROM fan GROUP BY ALL) USING (bidder, grp)
        WHERE measure = 'deviceTypes' AND rk <= 50""",
        **_VALUES,
    ),
    "group_pairs": _impressions(
        """SELECT a.bidder, a.grp AS grp_a, b.grp AS grp_b, a.measure,
          round(a.mean - b.mean, 4) + 0.0 AS diff,
          round((a.mean - b.mean) / nullif(sqrt(a.var / a.n + b.var / b.n), 0), 4) + 0.0 AS z
        FROM moments a JOIN moments b ON a.bidder = b.bidder AND a.measure = b.measure
          AND a.grp <> b.grp""",
        **_MOMENTS,
    ),
    "group_vs_rest": _impressions(
        """SELECT bidder, grp, measure, round(mean - mean_rest, 4) + 0.0 AS diff,
          round((mean - mean_rest) / nullif(sqrt(var / n + var_rest / n_rest), 0), 4) + 0.0 AS z
        FROM (SELECT g.bidder, g.grp, g.measure, g.n, g.mean, g.var, count(*) AS n_rest,
            avg(m.v) AS mean_rest, var_pop(m.v) AS var_rest
          FROM moments g JOIN numbered m ON g.bidder = m.bidder AND g.measure = m.measure
            AND m.grp = 'ALL'
          WHERE g.grp <> 'ALL' AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.bidder = g.bidder
            AND k.grp = g.grp AND k.impression_id = m.impression_id)
          GROUP BY ALL)""",
        **_MOMENTS,
        # the rest row by row, not by subtraction
        numbered=f"""
SELECT impression_id, bidder, grp, 'spend' AS measure, coalesce(advertiser_spent, 0) AS v FROM fan
UNION ALL SELECT impression_id, bidder, grp, 'clearingPrice', coalesce(clearing_price, 0) FROM fan
UNION ALL SELECT impression_id, bidder, grp, 'expProfit', {PROFIT} FROM fan""",
    ),
    "group_report": _impressions(
        f"""SELECT '2024-01-30' AS date, g.bidder, g.grp, 'NO-LABEL' AS label,
          'NO-DESCRIPTION' AS description, g.* EXCLUDE (bidder, grp),
          t.rtb AS "rtbWins_count", t.total AS "rtbWins_total",
          CAST(0 AS bigint) AS clicks_count, t.total AS clicks_total,
          CASE WHEN g.bidder = 'ALL' THEN s.n_values END AS sources_values,
          CASE WHEN g.bidder = 'ALL' THEN s.n_rows END AS sources_rows,
          {_frequency('pricingTypes')}, {_frequency('oss')}, {_frequency('browsers')}
        FROM wide g JOIN totals t USING (bidder, grp) JOIN sources s USING (bidder, grp)""",
        **_MOMENTS,
        vals=VALUES,
        freq=FREQUENCIES,
        wide=f"""SELECT bidder, grp, {_moment('spend', 'spend')},
          {_moment('clearingPrice', 'clearingPrice')}, {_moment('expProfit', 'expectedProfit')}
          FROM moments GROUP BY bidder, grp""",
        totals="""SELECT bidder, grp, count(bidder_id) AS rtb, count(*) AS total
          FROM fan GROUP BY ALL""",
        sources="""SELECT bidder, grp, count(*) AS n_values, CAST(sum(n) AS bigint) AS n_rows
          FROM freq WHERE measure = 'sourcesImp' GROUP BY ALL""",
    ),
    "partner_totals": _licensing(
        f"""SELECT partner, count(*) AS identifiers, {_SUMS}
        FROM owned JOIN identifier_info USING (identifier) GROUP BY partner""",
        owned=OWNED,
    ),
    "partner_overlap": _licensing(
        f"""SELECT partners, count(*) AS identifiers, {_SUMS} FROM (
          SELECT i.*, coalesce(string_agg(partner, '+' ORDER BY partner), '') AS partners
          FROM identifier_info i LEFT JOIN owned USING (identifier) GROUP BY ALL) GROUP BY partners""",
        owned=OWNED,
    ),
    "partner_lattice": _LATTICE,
    "partner_overlap_approx": _lacking("SELECT subset, identifiers, TRUE AS within FROM coverage", **_COVERAGE),
    "partner_coverage": _licensing("SELECT * FROM coverage", **_COVERAGE),
    "partner_lift": _licensing(
        f"""SELECT c.subset,
        {', '.join(f'c.{t} - b.{t} AS {t}_change' for t in _TOTALS)},
        {', '.join(f'round(c.{t} / a.{t}, 4) AS {t}_share' for t in _TOTALS)}
        FROM coverage c JOIN coverage b ON b.subset = 'LiveRamp' JOIN everything a ON true""",
        **_COVERAGE,
        everything=f"SELECT count(*) AS identifiers, {_SUMS} FROM identifier_info",
    ),
    "unlicensed": _lacking(
        """SELECT identifier FROM identifier_info i WHERE NOT EXISTS
        (SELECT 1 FROM license_info l WHERE l.identifier = i.identifier)"""
    ),
    "unmapped_codes": _sql(
        ["license_info"],
        """SELECT license, count(*) AS n FROM license_info WHERE license NOT IN
        ('AudienceAcuityMain', 'AudienceAcuityPair', 'LiveRampPelFile', 'TowerData') GROUP BY license""",
    ),
    "shard_completeness": _sql(
        ["marker_files"],
        """SELECT s.path_shard, count(part_no) AS files, coalesce(sum(bytes), 0) AS bytes,
        count(DISTINCT part_no) AS parts, 400 - count(DISTINCT part_no) AS missing,
        count(DISTINCT part_no) = 400 AS complete
        FROM range(18) AS s(path_shard) LEFT JOIN marker_files f ON f.path_shard = s.path_shard GROUP BY ALL""",
    ),
    "missing_parts": _sql(
        ["marker_files"],
        """SELECT path_shard, CAST(part_no AS int) AS part_no
        FROM range(18) AS s(path_shard), range(400) AS r(part_no)
        EXCEPT SELECT path_shard, part_no FROM marker_files""",
    ),
    "cross_shard_commits": _sql(
        ["marker_files"],
        """SELECT committed_by, path_shard, count(*) AS files FROM marker_files
        WHERE committed_by <> path_shard GROUP BY ALL""",
    ),
    "job_id_collisions": _sql(
        ["marker_files"],
        """SELECT job_id, count(DISTINCT committed_by) AS shards FROM marker_files
        GROUP BY job_id HAVING count(DISTINCT committed_by) > 1""",
    ),
    "overlapping_windows": _sql(
        ["commit_spans"],
        """SELECT job_id, count(*) AS overlaps FROM spans s WHERE EXISTS (
          SELECT 1 FROM spans t WHERE t.job_id = s.job_id AND t.finished > s.started
          AND (t.started, t.committed_by) < (s.started, s.committed_by)) GROUP BY job_id""",
        spans="""SELECT job_id, committed_by, min(started) AS started, max(finished) AS finished
        FROM commit_spans GROUP BY ALL""",
    ),
    "declared_against_listed": _sql(
        [],
        """SELECT concat(o_custkey % 17, '/', strftime(o_orderdate, '%Y%m%d')) AS committed_by,
        count(*) + CASE WHEN o_custkey % 17 = 6 THEN 1 ELSE 0 END AS declared, count(*) AS listed,
        CAST(sum(floor(o_totalprice)) AS bigint) AS bytes FROM orders
        GROUP BY o_custkey % 17, o_orderdate HAVING o_custkey % 17 = 6 OR count(*) <> 4""",
    ),
    "file_names": """SELECT o_orderkey AS id,
        substring('0123456789abcdefs', CAST(o_custkey % 17 + 1 AS int), 1) AS path_shard,
        strftime(o_orderdate, '%Y%m%d') AS path_day, CAST(o_orderkey % 5000 AS int) AS part_no,
        concat('job_', strftime(o_orderdate, '%Y%m%d'), '020013_0000') AS job_id, 'gz' AS codec
        FROM orders""",
    "commit_windows": """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS bigint) AS elapsed_s
        FROM orders""",
    "metric_spread": """SELECT metric, count(*) AS n, min(v) AS least, max(v) AS greatest,
        round(avg(v), 4) AS mean FROM (
          SELECT 'files quantity (n)' AS metric, CAST(floor(l_quantity) AS bigint) AS v FROM lineitem
          UNION ALL SELECT 'bytes price (n)', CAST(floor(l_extendedprice) AS bigint) FROM lineitem)
        GROUP BY metric""",
    "retention_plan": """SELECT CAST(day AS varchar) AS day,
        day <= DATE '2001-08-01' AND (day > DATE '2001-08-01' - 7
          OR (day(day) = 1 AND day >= DATE '2000-09-01')) AS keep
        FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS day FROM orders)""",
    "daily_volume": _sql(
        [], "SELECT entity, CAST(day AS varchar) AS day, n FROM volume", **_VOLUME
    ),
    "volume_drop": _sql(
        [],
        """SELECT entity, CAST(day AS varchar) AS day, n, round(n / nullif(before, 0), 4) AS ratio,
        coalesce(n / nullif(before, 0) < 0.9, false) AS dropped FROM (
          SELECT *, lag(n) OVER (PARTITION BY entity ORDER BY day) AS before FROM daily)""",
        **_CALENDAR,
    ),
    "daily_anomaly": _sql(
        [],
        """SELECT entity, CAST(day AS varchar) AS day, n,
        CASE WHEN k >= 3 THEN round((n - m) / nullif(s, 0), 4) END AS z FROM (
          SELECT *, count(*) OVER w AS k, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s FROM daily
          WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
        **_CALENDAR,
    ),
    "input_readiness": _sql(
        ["required_inputs", "listed_markers"],
        """SELECT job, count(*) FILTER (WHERE NOT present) = 0 AS ready,
        count(*) FILTER (WHERE NOT present) AS missing FROM (
          SELECT job, EXISTS (SELECT 1 FROM listed_markers l WHERE l.input = r.input AND l.day = r.day)
            AS present FROM required_inputs r) GROUP BY job""",
    ),
    "running_tasks": _sql(
        ["task_instance"],
        """SELECT dag_id, execution_date, count(*) AS n FROM task_instance
        WHERE state IN ('running', 'queued') AND operator <> 'S3KeySensor'
          AND task_id <> 'Check_running_tasks' GROUP BY ALL""",
    ),
    "dated_read": """SELECT event_id, user_id, CAST(CAST(ts AS date) AS varchar) AS day FROM events
        WHERE CAST(ts AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""",
    "text_sink": "SELECT concat_ws('|', o_orderkey, o_custkey, o_orderpriority) AS value FROM orders",
    "keyed_sink": "SELECT o_orderstatus, CAST(o_orderkey AS varchar) AS value FROM orders",
    "sharded_write": f"""SELECT {_SHARD.format('md5(CAST(user_id AS varchar))')} AS shard,
        CAST(CAST(date_trunc('week', ts) AS date) AS varchar) AS day, count(*) AS n,
        CAST(sum(event_id) AS bigint) AS id_sum
        FROM events GROUP BY ALL""",
    "shard_layout": f"""SELECT {_SHARD.format('key')} AS shard, count(*) AS n FROM (
          SELECT CASE WHEN c_acctbal < 0 THEN concat('x', c_name)
            ELSE md5(CAST(c_custkey AS varchar)) END AS key FROM customer) GROUP BY ALL""",
    "map_merge": """SELECT user_id, event_type AS map_key,
        CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE a - b END AS value FROM (
          SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS a,
            count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY ALL)""",
    "map_merge_agg": """SELECT user_id, map_key,
        CAST(sum(CAST(json_extract_string(props, map_key) AS bigint)) AS bigint) AS value
        FROM (SELECT user_id, props, unnest(json_keys(props)) AS map_key FROM events) GROUP BY ALL""",
    "json_maps": """SELECT event_id, map_key,
        CAST(json_extract_string(props, map_key) AS bigint) AS value
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS map_key FROM events)""",
    "map_union_strict": """SELECT event_id, map_key,
        CAST(json_extract_string(props, map_key) AS bigint) AS value
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS map_key FROM events)
        UNION ALL SELECT event_id, 'user', user_id FROM events""",
    "size_estimate": f"SELECT doc_id, {_DOC_SIZE} AS bytes FROM documents",
    "size_estimate_arrays": """SELECT vec_id, 16 + 16 + 8 + 8 + 16 * len(embedding) AS bytes
        FROM embeddings""",
    "size_by_column": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(sum({s}) AS bigint) AS bytes,"
        f" CAST(max({s}) AS bigint) AS most FROM documents"
        for c, s in [
            ("doc_id", "8"), ("text", _text("text")), ("lang", _text("lang")),
            ("source", _text("source")), ("n_chars", "8"),
        ]
    ),
    "size_outliers": _sql(
        [],
        """SELECT lang, doc_id, bytes, round(bound, 4) AS bound, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bytes DESC, doc_id) AS rank
          FROM sizes JOIN bounds USING (lang) WHERE bytes > bound) WHERE rank <= 20""",
        sizes=f"SELECT doc_id, lang, {_DOC_SIZE} AS bytes FROM documents",
        bounds="""SELECT lang, q3 + 1.5 * (q3 - q1) AS bound FROM (
          SELECT lang, quantile_disc(bytes, 0.25) AS q1, quantile_disc(bytes, 0.75) AS q3
          FROM sizes GROUP BY lang)""",
    ),
    "edge_build": _sql(
        ["declarations"],
        """SELECT DISTINCT a.task AS src, b.task AS dst, 'not_ok' AS mode FROM declarations a
          JOIN declarations b ON a.decl_id = b.decl_id AND a.side = 'from' AND b.side = 'to'
        UNION ALL SELECT 'create_cluster', task, 'not_ok' FROM lines
        UNION ALL SELECT task, 'check_running', 'ok' FROM lines
        UNION ALL SELECT task, 'terminate_cluster', 'ok' FROM lines""",
        lines="SELECT DISTINCT task FROM declarations WHERE side = 'from'",
    ),
    "set_ops": _sql(
        ["dependency_edges"],
        """SELECT 'bag' AS op, src, dst, count(*) AS n FROM dependency_edges GROUP BY src, dst
        UNION ALL SELECT 'union', src, dst, 1 FROM (SELECT * FROM ok UNION SELECT * FROM no)
        UNION ALL SELECT 'intersection', src, dst, 1 FROM (SELECT * FROM ok INTERSECT SELECT * FROM no)
        UNION ALL SELECT 'difference', src, dst, 1 FROM (SELECT * FROM ok EXCEPT SELECT * FROM no)""",
        ok="SELECT src, dst FROM dependency_edges WHERE mode = 'ok'",
        no="SELECT src, dst FROM dependency_edges WHERE mode = 'not_ok'",
    ),
    "closure": _closure("SELECT src, dst FROM reach"),
    "reduction": _closure(
        """SELECT DISTINCT src, dst FROM edges e WHERE NOT EXISTS (
          SELECT 1 FROM edges f JOIN reach r ON f.dst = r.src WHERE f.src = e.src AND r.dst = e.dst)"""
    ),
    "cycles": _closure(
        "SELECT a.src AS task, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src", view="cyclic_edges"
    ),
    "trigger_rules": _sql(
        ["dependency_edges"],
        """SELECT dst, CASE WHEN count(*) FILTER (WHERE mode = 'ok') > 0 THEN 'all_done'
        ELSE 'all_success' END AS rule FROM dependency_edges GROUP BY dst""",
    ),
    "trigger_conflicts": _sql(
        ["dependency_edges"],
        """SELECT dst, count(*) FILTER (WHERE mode = 'ok') AS n_ok,
        count(*) FILTER (WHERE mode = 'not_ok') AS n_not_ok FROM dependency_edges GROUP BY dst
        HAVING n_ok > 0 AND n_not_ok > 0""",
    ),
    "label_spread": _sql(
        ["line_declarations", "label_seeds"],
        """SELECT DISTINCT task, task AS reason FROM label_seeds
        UNION SELECT t.task, f.task FROM pairs fired JOIN labelled l ON l.task = fired.src
          JOIN line_declarations t ON t.decl_id = fired.decl_id AND t.side = 'to'
          JOIN line_declarations f ON f.decl_id = fired.decl_id AND f.side = 'from'""",
        pairs="""SELECT a.decl_id, a.task AS src, b.task AS dst FROM line_declarations a
          JOIN line_declarations b ON a.decl_id = b.decl_id WHERE a.side = 'from' AND b.side = 'to'""",
        labelled="""SELECT DISTINCT task FROM label_seeds
          UNION SELECT p.dst FROM labelled l JOIN pairs p ON p.src = l.task""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "ready_tasks": _sql(
        ["dependency_edges", "done_tasks"],
        """SELECT dst, count(*) FILTER (WHERE NOT done) = 0 AS ready,
        count(*) FILTER (WHERE NOT done) AS blocking FROM (
          SELECT src, dst, src IN (SELECT task FROM done_tasks) AS done
          FROM (SELECT DISTINCT src, dst FROM dependency_edges)) GROUP BY dst""",
    ),
    "clean_names": """SELECT c_custkey AS id, regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g') AS name
        FROM customer""",
    "dotted_tail": "SELECT page_id AS id, string_split(url, '.')[-1] AS tail FROM pages",
    "path_labels": """SELECT page_id AS id, concat(
        CASE WHEN page_id % 2 = 0 THEN 'Yesterday ' ELSE 'Today ' END,
        replace(replace(lower(rtrim(replace(string_split(concat(url, '/'), '//')[2], 'blog.', ''), '/')),
          '/', '-'), ' ', '_'), ' available') AS label FROM pages""",
    "person_day": _sql(
        ["vitals"],
        """SELECT person_id, CAST(day AS varchar) AS day, readings,
        round(coalesce(d.t, m.t), 10) AS body_temperature_mean,
        round(coalesce(d.h, m.h), 10) AS heart_rate_mean,
        round(coalesce(d.o, m.o), 10) AS blood_oxygen_mean,
        d.t IS NULL AS body_temperature_missing, d.h IS NULL AS heart_rate_missing,
        d.o IS NULL AS blood_oxygen_missing, round(t_max, 10) AS body_temperature_max
        FROM days d JOIN medians m ON true""",
        **_DAYS,
    ),
    "baseline_deviation": _sql(
        ["vitals"],
        """SELECT person_id, CAST(day AS varchar) AS day, round(t, 10) AS temperature,
        round(t - avg(t) OVER (PARTITION BY person_id ORDER BY day
          ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 10) AS deviation FROM days""",
        **_DAYS,
    ),
    "confirmed_classifier": _sql(
        ["vitals"],
        """SELECT person_id, CAST(bool_or(confirmed) AS int) AS label,
        CAST(concat('0x', substring(md5(CAST(person_id AS varchar)), 1, 2)) AS int) * 100 < 256 * 80 AS train,
        true AS scored, round(avg(coalesce(t, mt)), 8) AS body_temperature,
        round(avg(coalesce(h, mh)), 8) AS heart_rate, round(avg(coalesce(o, mo)), 8) AS blood_oxygen
        FROM (SELECT d.*, m.t AS mt, m.h AS mh, m.o AS mo FROM days d JOIN medians m ON true)
        JOIN (SELECT person_id, bool_or(confirmed) AS confirmed FROM vitals GROUP BY person_id) USING (person_id)
        GROUP BY person_id""",
        **_DAYS,
    ),
    "snapshot_cycle": _sql(_ID_VIEWS, "SELECT email_hash, idl, oracle_id FROM merged", **_ID),
    "snapshot_buckets": _sql(_ID_VIEWS, "SELECT email_hash, idl, oracle_id FROM merged", **_ID),
    "scrapers_by_day": _sql(
        ["tracking_events"],
        f"""SELECT event_id, first_party_id, third_party_id FROM tracking_events t
        WHERE NOT EXISTS (SELECT 1 FROM scrapers s WHERE s.first_party_id = t.first_party_id)""",
        scrapers=f"""SELECT first_party_id FROM tracking_events WHERE {_BOTH}
        GROUP BY first_party_id HAVING count(DISTINCT third_party_id) > 1""",
    ),
    "marker_cycle": """SELECT event_type AS job, count(*) FILTER (WHERE day(day) % 7 = 0) = 0 AS ready,
        count(*) FILTER (WHERE day(day) % 7 = 0) AS missing
        FROM (SELECT DISTINCT event_type, CAST(ts AS date) AS day FROM events) GROUP BY event_type""",
    "manifest_write": """SELECT shard, day, count(DISTINCT part) AS declared, count(DISTINCT part) AS listed, count(*) AS records,
        CAST(sum(length(concat_ws('|', event_id, event_type)) + 1) AS bigint) AS raw_bytes FROM (%s) WHERE day <> '20240110' GROUP BY shard, day""" % _EVENT_FILES,
    "manifest_audit": """WITH e AS (%s), f AS (SELECT DISTINCT shard || '/' || day AS place, part FROM e WHERE day <> '20240110'),
        p AS (SELECT DISTINCT shard || '/' || day AS place FROM e), t AS (SELECT place, count(part) AS n FROM p LEFT JOIN f USING (place) GROUP BY place)
        SELECT 'missing part' AS what, place, 3 - n AS n FROM t WHERE n < 3 UNION ALL SELECT 'uneven', place, n FROM t WHERE n BETWEEN 1 AND 2
        UNION ALL SELECT 'shared job', 'all', count(DISTINCT place) FROM f""" % _EVENT_FILES,
    "manifest_scan": """SELECT shard, day, count(*) AS records FROM (%s) WHERE day BETWEEN '20240105' AND '20240109' AND shard IN ('0', '7', 'a', 's')
        GROUP BY shard, day""" % _EVENT_FILES,
    "manifest_replace": """SELECT shard, day, event_id, CASE WHEN day = '20240109' THEN 'again' ELSE event_type END AS event_type
        FROM (%s) WHERE day <> '20240110'""" % _EVENT_FILES,
    "single_file": "SELECT concat_ws('|', event_type, count(*)) AS value, 1 AS files FROM events GROUP BY event_type",
    "nonempty_groups": _impressions(
        """SELECT buyeruid_source AS "group", count(*) AS n FROM impressions
        WHERE buyeruid_source <> '' GROUP BY buyeruid_source"""
    ),
    "sorted_edges": _sql(["dependency_edges"], "SELECT DISTINCT src, dst FROM dependency_edges ORDER BY ALL"),
    "first_listed_day": """SELECT CAST(min(CAST(ts AS date)) AS varchar) AS day FROM events
        WHERE CAST(ts AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""",
    "location_rate": _sql(
        ["vitals"],
        """SELECT location, CAST(CAST(ts AS date) AS varchar) AS day,
        count(DISTINCT person_id) AS persons,
        round(count(DISTINCT person_id) FILTER (WHERE confirmed) / count(DISTINCT person_id), 4) AS rate
        FROM vitals GROUP BY ALL""",
    ),
}
