"""Views that give the library's tables from a generic star schema and an event table.

Each is one SQL text valid in Spark and in other engines; ``{name}`` stands for an input table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hashgrove.sources.tables import read_table

VIEWS = {
    "impressions": """
SELECT event_id AS impression_id, ts,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN ''
       ELSE concat('d', CAST(CAST(floor(event_id / 4) AS bigint) AS string)) END AS decision_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -1
       ELSE CAST(event_id % 2 AS int) END AS redecision_attempt,
  (event_type <> 'error') AS is_first_impression,
  (event_id % 97 = 0) AS is_broken_drop,
  CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN ''
       ELSE md5(CAST(user_id AS string)) END AS md5,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE md5(concat('sh1-', CAST(user_id AS string))) END AS sh1,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE md5(concat('sh2-', CAST(user_id AS string))) END AS sh2,
  CASE WHEN user_id % 9 = 0 THEN NULL ELSE CAST(user_id % 9 AS int) END AS template_id,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE event_id % 7 END AS placement_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS int) END AS bidder_id,
  CASE WHEN user_id % 8 = 0 THEN NULL ELSE md5(CAST(user_id AS string)) END AS email_hash,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS advertiser_spent,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 2 END AS clearing_price,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE value / 4 END AS actual_dsp_fee,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 8 END AS actual_pgm_fee,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 16 END AS actual_ssp_fee,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 32 END AS thirdparty_margin,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ''
       WHEN event_id % 2 = 0 THEN 'CPM' ELSE 'CPC' END AS pricing_type,
  CASE event_id % 6
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/96.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 15_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/15.1 Mobile/15E148 Safari/604.1'
    WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:94.0) Gecko/20100101 Firefox/94.0'
    WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 12; Pixel 6) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/96.0 Mobile Safari/537.36'
    WHEN 4 THEN 'curl' ELSE NULL END AS user_agent,
  CASE WHEN event_id % 12 = 0 THEN '' WHEN event_id % 12 < 6 THEN 'cookie'
       ELSE 'emailhash' END AS buyeruid_source
FROM {events}""",
    "tracking_events": """
SELECT event_id, ts,
  CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL
       ELSE concat('f', CAST(user_id AS string), '-', CAST(event_id % 100 AS string)) END
    AS first_party_id,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 19 = 0 THEN NULL
       WHEN event_id % 100 < 20 THEN concat('l', CAST(event_id % 3 AS string))
       ELSE concat('l', CAST(user_id AS string)) END AS third_party_id
FROM {events}""",
    "id_current": """
SELECT CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE md5(CASE WHEN c_mktsegment = 'MACHINERY'
    THEN concat('c', CAST(c_custkey AS string)) ELSE CAST(c_custkey AS string) END) END AS email_hash,
  concat('I', CAST(c_custkey AS string)) AS idl,
  CASE WHEN c_acctbal < 3000 THEN concat('O', CAST(c_custkey AS string)) END AS oracle_id
FROM {customer}""",
    # raw partner rows: a separated list of values, at times without any usable one
    "id_delta_raw": """
SELECT o_orderkey AS seq,
  md5(CASE WHEN o_orderkey % 9 = 0 THEN concat('d', CAST(o_orderkey AS string)) ELSE CAST(o_custkey AS string) END)
    AS email_hash,
  CASE WHEN o_custkey % 5 = 0 AND o_orderstatus = 'F' THEN NULL WHEN o_custkey % 5 = 0 THEN ' ; '
       WHEN o_orderpriority = '1-URGENT' THEN concat('N', CAST(o_orderkey AS string))
       ELSE concat(' N', CAST(o_orderkey AS string), ';;M', CAST(o_orderkey AS string), ' ') END AS idls
FROM {orders}""",
    "id_oracle": """
SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN md5(concat('o', CAST(o_orderkey AS string)))
       ELSE md5(CAST(o_custkey AS string)) END AS email_hash,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('P', CAST(o_orderkey AS string)) END AS oracle_id
FROM {orders}""",
    "identifier_info": """
SELECT md5(CAST(user_id AS string)) AS identifier,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS bigint) AS opens,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS bigint) AS clicks,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bigint) AS conversions
FROM {events} GROUP BY user_id""",
    "license_info": """
SELECT md5(CAST(user_id AS string)) AS identifier,
  CASE (user_id + event_id % 2) % 10 WHEN 0 THEN 'LiveRampPelFile' WHEN 1 THEN 'AudienceAcuityMain'
       WHEN 2 THEN 'AudienceAcuityPair' WHEN 3 THEN 'TowerData' WHEN 5 THEN 'LiveRampPelFile'
       WHEN 6 THEN 'TowerData' WHEN 9 THEN 'AudienceAcuityMain' ELSE 'UnknownFile' END AS license
FROM {events}""",
    "marker_files": """
SELECT CAST(o_custkey % 17 AS int) AS committed_by,
  CAST(CASE WHEN o_custkey % 17 = 2 AND o_orderstatus = 'F' THEN 6 ELSE o_custkey % 17 END AS int)
    AS path_shard,
  CAST(o_orderkey % 400 AS int) AS part_no,
  concat('job_', CAST(CASE WHEN o_custkey % 17 = 6 THEN 2 ELSE o_custkey % 17 END AS string)) AS job_id,
  CAST(floor(o_totalprice) AS bigint) AS bytes
FROM {orders}""",
    "commit_spans": """
SELECT concat('job_', CAST(CASE WHEN o_custkey % 17 = 6 THEN 2 ELSE o_custkey % 17 END AS string), '_',
    replace(CAST(CAST(o_orderdate AS date) AS string), '-', '')) AS job_id,
  CAST(o_custkey % 17 AS int) AS committed_by, o_orderkey % 86400 AS started,
  o_orderkey % 86400 + CAST(floor(o_totalprice / 10) AS bigint) AS finished
FROM {orders}""",
    "file_names": """
SELECT o_orderkey AS id,
  concat('/daily-output/', substring('0123456789abcdefs', CAST(o_custkey % 17 + 1 AS int), 1), '/',
    replace(CAST(CAST(o_orderdate AS date) AS string), '-', ''), '/part-r-',
    lpad(CAST(o_orderkey % 5000 AS string), 5, '0'), '-job_',
    replace(CAST(CAST(o_orderdate AS date) AS string), '-', ''), '020013_0000.gz') AS filename
FROM {orders}""",
    # each line of an order depends on lines before it
    "dependency_edges": """
SELECT l_orderkey * 10 + l_linenumber - 1 AS src, l_orderkey * 10 + l_linenumber AS dst, 'not_ok' AS mode
FROM {lineitem} WHERE l_linenumber > 1
UNION
SELECT l_orderkey * 10 + l_linenumber - 3, l_orderkey * 10 + l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE 'not_ok' END
FROM {lineitem} WHERE l_linenumber > 3
UNION
SELECT l_orderkey * 10 + l_linenumber - 4, l_orderkey * 10 + l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE 'not_ok' END
FROM {lineitem} WHERE l_linenumber > 4""",
    "cyclic_edges": """
SELECT l_orderkey * 10 + l_linenumber - 1 AS src, l_orderkey * 10 + l_linenumber AS dst
FROM {lineitem} WHERE l_linenumber > 1
UNION
SELECT l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber - 2
FROM {lineitem} WHERE l_linenumber > 2 AND l_returnflag = 'A'""",
    # each line is triggered by the line before it, and from the fourth on by the one three before as well
    "line_declarations": """
SELECT l_orderkey * 10 + l_linenumber AS decl_id, 'to' AS side, l_orderkey * 10 + l_linenumber AS task FROM {lineitem}
UNION ALL
SELECT l_orderkey * 10 + l_linenumber, 'from', l_orderkey * 10 + l_linenumber - 1 FROM {lineitem}
UNION ALL
SELECT l_orderkey * 10 + l_linenumber, 'from', l_orderkey * 10 + l_linenumber - 3 FROM {lineitem} WHERE l_linenumber > 3""",
    "label_seeds": """
SELECT l_orderkey * 10 + l_linenumber AS task FROM {lineitem}
WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 25""",
    # the files and metrics of one marker per shard and day; some declare a file more than they list
    "marker_documents": """
SELECT concat(CAST(o_custkey % 17 AS string), '/', replace(CAST(CAST(o_orderdate AS date) AS string), '-', '')) AS shard,
  CAST(count(*) + CASE WHEN o_custkey % 17 = 6 THEN 1 ELSE 0 END AS bigint) AS declared,
  CAST(sum(floor(o_totalprice)) AS bigint) AS bytes, CAST(count(*) AS bigint) AS listed
FROM {orders} GROUP BY o_custkey % 17, CAST(o_orderdate AS date)""",
    "done_tasks": """
SELECT l_orderkey * 10 + l_linenumber AS task FROM {lineitem} WHERE l_quantity > 5""",
    # per order: its lines precede its two closing tasks
    "declarations": """
SELECT l_orderkey AS decl_id, 'from' AS side,
  concat('line-', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS task,
  'not_ok' AS mode
FROM {lineitem}
UNION ALL
SELECT o_orderkey, 'to', concat('pack-', CAST(o_orderkey AS string)), 'not_ok' FROM {orders}
UNION ALL
SELECT o_orderkey, 'to', concat('bill-', CAST(o_orderkey AS string)), 'not_ok' FROM {orders}""",
    "task_instance": """
SELECT o_orderkey AS id, concat('dag', CAST(o_custkey % 5 AS string)) AS dag_id,
  CAST(CAST(o_orderdate AS date) AS string) AS execution_date,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'success' END AS state,
  CASE WHEN o_orderkey % 6 = 0 THEN 'S3KeySensor' ELSE 'SparkOperator' END AS operator,
  CASE WHEN o_orderkey % 50 = 0 THEN 'Check_running_tasks'
       ELSE concat('t', CAST(o_orderkey % 40 AS string)) END AS task_id
FROM {orders}""",
    # each order is a job that needs its lines' parts as inputs of the day
    "required_inputs": """
SELECT l_orderkey AS job, concat('part-', CAST(l_partkey AS string)) AS input,
  CAST(CAST(l_shipdate AS date) AS string) AS day
FROM {lineitem}""",
    "listed_markers": """
SELECT concat('part-', CAST(l_partkey AS string)) AS input,
  CAST(CAST(l_shipdate AS date) AS string) AS day
FROM {lineitem} WHERE l_quantity > 10""",
    "vitals": """
SELECT event_id, user_id AS person_id, ts,
  CASE WHEN event_type = 'error' THEN NULL ELSE 36.0 + value / 100 END AS body_temperature,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 60 + CAST(event_id % 40 AS int) END AS heart_rate,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 90 + CAST(event_id % 10 AS int) END AS blood_oxygen,
  CAST(20 + user_id % 60 AS int) AS age, CAST(user_id % 25 AS int) AS location,
  (user_id % 10 = 0) AS confirmed
FROM {events}""",
    "path_templates": """
SELECT page_id, concat(url, '/{{{{ ', CASE WHEN page_id % 2 = 0 THEN 'yesterday_ds_nodash'
  ELSE 'ds_nodash' END, ' }}}}/_SUCCESS') AS template
FROM {pages}""",
}
# the same rows without those of some identifiers, which have no licence then
VIEWS["license_info_lacking"] = VIEWS["license_info"] + " WHERE user_id % 23 <> 0"


def inputs_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])))


def read_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables = {t: read_table(spark, folder, t) for t in inputs_of(name)}
    return spark.sql(VIEWS[name], **tables)


def view_sql(name: str) -> str:
    """The view's text over tables of the inputs' names."""
    return VIEWS[name].format(**{t: t for t in inputs_of(name)}).strip()
