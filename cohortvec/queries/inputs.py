"""Input views over the given tables, in SQL that Spark and DuckDB both run.

The tables hold no medical data, so orders stand in for persons, brands and
parts for features and compounds, sizes for diseases.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "embeddings", "events", "lineitem", "nation", "orders", "part", "supplier")

_LINES = "orders JOIN lineitem ON o_orderkey = l_orderkey"

VIEWS = {
    "interactions_brand": f"""
        SELECT o_custkey AS person_id, p_brand AS feature_name
        FROM {_LINES} JOIN part ON l_partkey = p_partkey""",
    "interactions_part": f"""
        SELECT o_custkey AS person_id, concat('P', CAST(l_partkey AS STRING)) AS feature_name
        FROM {_LINES}""",
    "interactions_events": """
        SELECT user_id AS person_id, event_type AS feature_name FROM events""",
    "ratings_true": f"""
        SELECT o_custkey AS userID, l_partkey AS itemID, AVG(l_quantity) AS rating, MAX(l_shipdate) AS timestamp
        FROM {_LINES} GROUP BY o_custkey, l_partkey""",
    "ratings_pred": f"""
        SELECT o_custkey AS userID, l_partkey AS itemID,
               AVG(l_quantity * (1 - l_discount)) AS prediction, MAX(l_shipdate) AS timestamp
        FROM {_LINES} GROUP BY o_custkey, l_partkey""",
    # items a person kept: the truth against which recommendations are judged
    "ratings_kept": f"""
        SELECT o_custkey AS userID, l_partkey AS itemID, AVG(l_quantity) AS rating
        FROM {_LINES} WHERE l_returnflag <> 'R' GROUP BY o_custkey, l_partkey""",
    # finished lines are the history, open lines the recommendations
    "history": f"""
        SELECT DISTINCT o_custkey AS userID, l_suppkey AS itemID FROM {_LINES} WHERE l_linestatus = 'F'""",
    "candidates": f"""
        SELECT DISTINCT o_custkey AS userID, l_suppkey AS itemID FROM {_LINES} WHERE l_linestatus = 'O'""",
    "reco": """
        SELECT c.userID, c.itemID, CAST(1 + c.itemID AS DOUBLE) / (2 + c.itemID) AS relevance
        FROM candidates c LEFT JOIN history h ON c.userID = h.userID AND c.itemID = h.itemID
        WHERE h.userID IS NULL""",
    "feature_vectors": """
        SELECT vec_id AS item, concat('V', CAST(vec_id AS STRING)) AS feature_name, embedding FROM embeddings""",
    "composites": """
        SELECT concat('label_', CAST(label AS STRING)) AS referential_name,
               concat('V', CAST(vec_id AS STRING)) AS feature_name,
               CAST(1 AS DOUBLE) / (1 + vec_id % 3) AS weight
        FROM embeddings""",
    # every vector under two names
    "feature_twins": """
        SELECT concat(t.twin, CAST(vec_id AS STRING)) AS feature_name, embedding
        FROM embeddings CROSS JOIN (SELECT 'V' AS twin UNION ALL SELECT 'W' AS twin) t""",
    # a person's suppliers line by line, repeats included
    "supplier_lines": f"""
        SELECT o_custkey AS userID, l_suppkey AS itemID FROM {_LINES}""",
    "first_of_label": """
        SELECT e.label, e.vec_id AS first_id, e.embedding AS first_embedding
        FROM embeddings e JOIN (SELECT label, MIN(vec_id) AS m FROM embeddings GROUP BY label) f
        ON e.vec_id = f.m""",
    # sizes are diseases, parts are compounds; each part has an earlier and a
    # later row, some diseases are coded in another vocabulary only, and some
    # ranges count with ten digits
    "concepts": """
        SELECT 1000000000 + k AS line_no, concat('D', CAST(k AS STRING)) AS CUI, 'ENG' AS LAT, 'MSH' AS SAB,
               concat('disease ', CAST(k AS STRING)) AS STR, concat('M', CAST(k AS STRING)) AS SCUI,
               CAST(NULL AS STRING) AS CODE
        FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS k FROM part) a
        UNION ALL
        SELECT 2000000000 + k, concat('D', CAST(k AS STRING)), 'ENG',
               CASE WHEN k % 7 = 0 THEN 'ICD9CM' ELSE 'ICD10CM' END,
               concat('icd ', CAST(k AS STRING)), CAST(NULL AS STRING),
               CASE WHEN k % 5 = 0 THEN concat('C', lpad(CAST(k AS STRING), 2, '0'), '-C', lpad(CAST(k + 3 AS STRING), 2, '0'))
                    WHEN k % 11 = 0 THEN concat('C', CAST(1000000000 + k AS STRING), '-C', CAST(1000000002 + k AS STRING))
                    ELSE concat('C', lpad(CAST(k AS STRING), 2, '0'), '.', CAST(k % 10 AS STRING)) END
        FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS k FROM part) b
        UNION ALL
        SELECT p_partkey, concat('R', CAST(p_partkey AS STRING)),
               CASE WHEN p_type = 'PROMO' THEN 'FRE' ELSE 'ENG' END, 'RXNORM',
               p_name, concat('X', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
        FROM part
        UNION ALL
        SELECT 3000000000 + p_partkey, concat('R', CAST(p_partkey AS STRING)), 'ENG', 'RXNORM',
               concat(p_name, ' later row'), concat('Z', CAST(p_partkey AS STRING)), CAST(NULL AS STRING)
        FROM part""",
    # parts of one brand and size form a chain of linked forms
    "form_chain": """
        SELECT p_partkey, p_brand, p_size,
               lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS next_part
        FROM part""",
    "relationships": """
        SELECT 1000000000 + p_partkey AS line_no, concat('D', CAST(p_size AS STRING)) AS CUI1,
               concat('R', CAST(p_partkey AS STRING)) AS CUI2, 'may_treat' AS RELA, 'MED-RT' AS SAB
        FROM part
        UNION ALL
        SELECT p_partkey, concat('R', CAST(p_partkey AS STRING)), concat('R', CAST(next_part AS STRING)),
               'has_form', 'RXNORM'
        FROM form_chain WHERE next_part IS NOT NULL""",
    # a person's brands by number of lines; the brand they spent most on is
    # looked for once the first and last brand by name are taken out
    "brand_spend": f"""
        SELECT o_custkey AS point_id, p_brand AS feature_name, COUNT(*) AS n,
               SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS spend
        FROM {_LINES} JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand""",
    "recall_lists": """
        SELECT point_id, feature_name,
               CAST(row_number() OVER (PARTITION BY point_id ORDER BY n DESC, feature_name) - 1 AS BIGINT) AS position
        FROM brand_spend""",
    "recall_targets": """
        SELECT b.point_id, b.query, a.feature_name AS target
        FROM (SELECT point_id, feature_name,
                     row_number() OVER (PARTITION BY point_id ORDER BY spend DESC, feature_name) AS r
              FROM brand_spend) a
        JOIN (SELECT point_id, array(MIN(feature_name), MAX(feature_name)) AS query
              FROM brand_spend GROUP BY point_id) b
        ON a.point_id = b.point_id WHERE a.r = 1""",
}

# Views each view is built on.
_NEEDS = {
    "reco": ("history", "candidates"),
    "relationships": ("form_chain",),
    "recall_lists": ("brand_spend",),
    "recall_targets": ("brand_spend",),
}


def with_needs(names: tuple[str, ...]) -> list[str]:
    """The named views and what they are built on, in order of definition."""
    wanted = set(names)
    for name in names:
        wanted.update(_NEEDS.get(name, ()))
    return [v for v in VIEWS if v in wanted]


def view(spark: SparkSession, folder: str, name: str, **given: DataFrame) -> DataFrame:
    """One input view as a DataFrame over the parquet tables of ``folder``.

    ``given`` replaces views it is built on.  Nothing is registered or kept, so
    folders and threads cannot see each other's views.
    """
    needs = [n for n in with_needs((name,)) if n not in given]
    words = set(re.findall(r"\w+", " ".join(VIEWS[n] for n in needs)))
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if t in words} | given
    parts = [f"{n} AS (SELECT * FROM {{{n}}})" for n in frames] + [f"{n} AS ({VIEWS[n]})" for n in needs]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}", **frames)


def oracle(names: tuple[str, ...] | str, select: str) -> str:
    """DuckDB text: the needed views as common table expressions plus ``select``."""
    names = (names,) if isinstance(names, str) else names
    parts = [f"{v} AS ({VIEWS[v]})" for v in with_needs(names)]
    text = ",\n".join(parts).replace("array(MIN(feature_name), MAX(feature_name))", "[MIN(feature_name), MAX(feature_name)]")
    return f"WITH {text}\n{select}"
