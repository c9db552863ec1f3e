"""Stand-in tables for the driver's data. Each view is one SQL text that Spark and DuckDB both read, so both start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.text import extract_skills
from tallyboard.operators.blocks import shared_folder  # noqa: F401  queries take it from here

#: Terms that do occur in the invented prose.
SKILL_WORDS = ["ai", "data", "go", "tech", "ui", "ux"]

#: View -> (tables, SQL). Later views may use earlier ones.
VIEWS: dict[str, tuple[list[str], str]] = {
    "postings": (["documents"], r"""
SELECT *, md5(title || '|' || description || '|' || location) AS content_hash,
  CASE WHEN contains(lower(title || ' ' || description), 'intern') THEN 'Internship' WHEN contains(lower(title || ' ' || description), 'tech') THEN 'Contract' ELSE 'Full-time' END AS job_type,
  CASE WHEN doc_id % 4 = 0 THEN 'Remote' WHEN doc_id % 4 = 1 THEN 'Hybrid' ELSE 'On-site' END AS remote_type
FROM (SELECT doc_id, 'doc_' || CAST(doc_id AS STRING) AS job_id, trim(regexp_extract(text, '^[^.\n]*', 0)) AS title, source AS company, lang AS location, upper(lang) AS company_location,
  text AS description, CAST('2024-01-01' AS TIMESTAMP) + CAST(doc_id % 90 AS INT) * INTERVAL '1' DAY AS posted_date, doc_id % 10 <> 0 AS is_active,
  'https://jobs.example.com/' || CAST(doc_id AS STRING) AS source_url FROM documents)"""),
    "companies": (["customer", "nation", "orders"], r"""
SELECT c_custkey AS company_id, c_name AS name, 'c' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '.io' END AS domain,
  CASE c_custkey % 8 WHEN 0 THEN 'https://boards.greenhouse.io/c' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://jobs.lever.co/c' || CAST(c_custkey AS STRING)
    WHEN 2 THEN 'https://jobs.ashbyhq.com/c' || CAST(c_custkey AS STRING) WHEN 3 THEN 'https://apply.workable.com/c' || CAST(c_custkey AS STRING) || '/'
    WHEN 4 THEN 'https://c' || CAST(c_custkey AS STRING) || '.wd5.myworkdayjobs.com/Site' ELSE NULL END AS ats_url,
  CASE c_custkey % 8 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' WHEN 4 THEN 'workday' WHEN 5 THEN 'custom' WHEN 6 THEN 'unknown' ELSE NULL END AS ats_type,
  nullif(c_mktsegment, 'HOUSEHOLD') AS size, n_name AS location, 'seg_' || lower(c_mktsegment) AS added_by, c_acctbal > 0 AS is_active, k.n AS active_jobs
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) k ON o_custkey = c_custkey"""),
    "visits": (["events"], "SELECT event_id, ts AS timestamp, CAST(user_id AS STRING) AS ip_address, nullif(event_type, 'error') AS referrer FROM events"),
    "requests": (["orders", "customer"], r"""
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN lower(c_name) ELSE 'New Venture ' || CAST(o_orderkey % 20011 AS STRING) END AS name, 'https://v' || CAST(o_orderkey AS STRING) || '.com/jobs' AS careers_url,
  'u' || CAST(o_custkey AS STRING) || '@example.com' AS user_email, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "searches": (["benchmark"], r"""
SELECT item_id AS search_id, 'u' || CAST(item_id % 7 AS STRING) || '@example.com' AS user_email, CASE WHEN item_id % 5 = 4 THEN NULL ELSE lower(regexp_extract(text, '[A-Za-z]+', 0)) END AS q,
  CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'remote' WHEN 2 THEN NULL ELSE 'fr|de' END AS location, CASE WHEN item_id % 6 = 5 THEN 'tech' ELSE NULL END AS category, item_id % 3 <> 2 AS email_alert,
  CASE WHEN item_id % 3 = 0 THEN CAST('2024-02-01' AS TIMESTAMP) + CAST(item_id % 40 AS INT) * INTERVAL '1' DAY ELSE NULL END AS last_emailed_at FROM benchmark"""),
    "favorites": (["events"], r"""
SELECT user_email, company_name, max(is_monitor) AS is_monitor, max(ts) AS last_checked_at FROM (SELECT 'u' || CAST(user_id % 50 AS STRING) || '@example.com' AS user_email,
  'Customer#' || lpad(CAST(event_id % 200 AS STRING), 9, '0') AS company_name, CASE WHEN value > 10 THEN 1 ELSE 0 END AS is_monitor, ts FROM events) GROUP BY user_email, company_name"""),
    "subscribers": (["customer"], r"""
SELECT 'u' || CAST(c_custkey AS STRING) || '@example.com' AS user_email, CASE c_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'off' END AS frequency, c_acctbal > 0 AS is_active,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST('2024-03-01' AS TIMESTAMP) + CAST(c_custkey % 15 AS INT) * INTERVAL '1' DAY + CAST(c_custkey % 24 AS INT) * INTERVAL '1' HOUR END AS last_sent_at FROM customer"""),
    "stored": (["postings"], r"""
SELECT job_id, CASE WHEN doc_id % 5 = 0 THEN title || ' (old)' ELSE title END AS title, company, location, 'kept ' || location AS benefits, posted_date, CASE WHEN doc_id % 5 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash,
  CAST('2024-04-01' AS TIMESTAMP) AS last_seen_at, doc_id % 7 <> 0 AS is_active FROM postings WHERE doc_id % 3 <> 0"""),
    "incoming": (["postings"], r"""
SELECT job_id, title, company, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE location END AS location, posted_date, content_hash, CAST('2024-05-01' AS TIMESTAMP) AS last_seen_at, TRUE AS is_active FROM postings WHERE doc_id % 4 <> 1"""),
    "lines": (["documents"], r"""
SELECT doc_id AS line_no, CASE WHEN doc_id % 6 = 5 THEN source ELSE CAST(doc_id AS STRING) || ') ' || CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || CASE WHEN doc_id % 9 = 0 THEN ' Inc.' ELSE '' END ||
  CASE WHEN doc_id % 4 = 0 THEN ' – ' ELSE ' - ' END || lang || ' board (' || lang || ' town)' END AS value FROM documents"""),
    "logs": (["lineitem"], r"""
SELECT 'supplier_' || CAST(l_suppkey % 20 AS STRING) AS source, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status, CAST(l_quantity AS INT) AS jobs_found, CAST(floor(l_quantity * l_discount + 0.0001) AS INT) AS jobs_new, l_shipdate AS completed_at FROM lineitem"""),
    "snapshots": (["orders"], r"""
SELECT 'job_' || CAST(o_custkey AS STRING) AS job_id, 'text_' || CAST(o_custkey % 400 AS STRING) AS content_key, CAST(floor(min(o_totalprice)) AS BIGINT) AS salary_min, CAST(o_orderdate AS DATE) AS seen_at FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)"""),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_needs([t for t in VIEWS[n][0] if t in VIEWS]), n]:
            if x not in out:
                out.append(x)
    return out


def oracle(views: str, body: str) -> str:
    """DuckDB SQL: the named views as common table expressions, then the body (its own ones start with a comma)."""
    names = _needs(views.split())
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    return f"WITH {ctes}\n{body}" if names else body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame, lazily over the driver's Parquet."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, sql = VIEWS[name]
    for t in sorted(tables, key=len, reverse=True):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    df = spark.sql(sql, **{t: view(spark, sf_dir, t) for t in tables})
    return df.withColumn("skills", extract_skills(F.col("description"), SKILL_WORDS)) if name == "postings" else df


#: The skills of a posting in DuckDB.
SKILLS_SQL = "list_filter(['Ai', 'Data', 'Go', 'Tech', 'Ui', 'Ux'], lambda v: contains(lower(description), lower(v)))"
