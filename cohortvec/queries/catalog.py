"""Registered queries and their DuckDB counterparts.

Each query takes ``(spark, folder)`` and reads the whole tables of the folder.
Doubles are rounded to six digits on both sides, because sums of doubles
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import clean_code, expand_code_ranges, matches_disease
from ..functions.text import matches_any
from ..functions.vectors import cosine_similarity, euclidean_similarity
from ..operators import components, cooccurrence, factorization, firsts, indexing, pairing, ratings, similarity
from ..operators.evaluation import diversity, ranking, rating, recall
from ..plans import curation, training
from ..session import apply_settings, new_path, store
from ..sources import rrf, sinks
from ..sources.events import scan_interactions, synthetic_events
from .inputs import oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
DISEASES = ["C1", "C25"]
NAME_PATTERNS = ["red", "[a-h].* (bolt|ring)"]


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, DIGITS).alias(c) if c in doubles else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)
            return rounded(build(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- event logs and ratings -------------------------------------------------


@query("scan_interactions", oracle("interactions_events", "SELECT person_id, feature_name FROM interactions_events"))
def _(spark, folder):
    return scan_interactions(spark, f"{folder}/events.parquet", person="user_id", feature="event_type")


@query(
    "synthetic_events",
    """WITH drawn AS (
  SELECT CAST(floor(('0x' || substr(md5('42:person' || CAST(i AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0
              * (SELECT COUNT(*) FROM customer)) AS BIGINT) AS person_id,
         CAST(floor(('0x' || substr(md5('42:feature' || CAST(i AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0
              * (SELECT COUNT(DISTINCT p_brand) FROM part)) AS BIGINT) AS item
  FROM (SELECT unnest(generate_series(0, 20 * (SELECT COUNT(*) FROM customer) - 1)) AS i) n),
f AS (SELECT p_brand AS feature_name, row_number() OVER (ORDER BY p_brand) - 1 AS item
      FROM (SELECT DISTINCT p_brand FROM part) d)
SELECT person_id, feature_name FROM drawn JOIN f ON drawn.item = f.item""",
)
def _(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet").count()
    brands = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_brand").alias("feature_name"))
    return synthetic_events(spark, brands, customers, 20)


_INDEXED_BRAND = """,
p AS (SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS "user"
      FROM (SELECT DISTINCT person_id FROM interactions_brand) d),
f AS (SELECT feature_name, row_number() OVER (ORDER BY feature_name) - 1 AS item
      FROM (SELECT DISTINCT feature_name FROM interactions_brand) d)
"""


@query(
    "dense_index",
    oracle(
        "interactions_part",
        """SELECT feature_name, CAST(row_number() OVER (ORDER BY feature_name) - 1 AS BIGINT) AS item
FROM (SELECT DISTINCT feature_name FROM interactions_part) d""",
    ),
)
def _(spark, folder):
    return indexing.dense_index(view(spark, folder, "interactions_part"), "feature_name", "item")


@query(
    "sparse_ratings",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND
    + """SELECT CAST("user" AS BIGINT) AS "user", CAST(item AS BIGINT) AS item, CAST(1 AS BIGINT) AS rating
FROM interactions_brand i JOIN p ON i.person_id = p.person_id JOIN f ON i.feature_name = f.feature_name""",
)
def _(spark, folder):
    return ratings.sparse_ratings(view(spark, folder, "interactions_brand")).ratings


@query(
    "sparse_ratings_agg",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND
    + """SELECT CAST("user" AS BIGINT) AS "user", CAST(item AS BIGINT) AS item, CAST(COUNT(*) AS BIGINT) AS rating
FROM interactions_brand i JOIN p ON i.person_id = p.person_id JOIN f ON i.feature_name = f.feature_name
GROUP BY 1, 2""",
)
def _(spark, folder):
    return ratings.sum_duplicates(ratings.sparse_ratings(view(spark, folder, "interactions_brand")).ratings)


_GRID = """,
g AS (SELECT p.person_id, p."user", f.feature_name, f.item FROM p CROSS JOIN f),
c AS (SELECT person_id, feature_name, COUNT(*) AS n FROM interactions_brand GROUP BY 1, 2)
"""


@query(
    "full_narrow_master",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND.rstrip()
    + _GRID
    + """SELECT g.person_id, g.feature_name, CAST(coalesce(n, 0) AS BIGINT) AS active
FROM g LEFT JOIN c ON g.person_id = c.person_id AND g.feature_name = c.feature_name""",
)
def _(spark, folder):
    return ratings.full_narrow_master(view(spark, folder, "interactions_brand"))


@query(
    "dense_ratings",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND.rstrip()
    + _GRID
    + """SELECT CAST(g."user" AS BIGINT) AS "user", CAST(g.item AS BIGINT) AS item, CAST(coalesce(n, 0) AS BIGINT) AS rating
FROM g LEFT JOIN c ON g.person_id = c.person_id AND g.feature_name = c.feature_name""",
)
def _(spark, folder):
    return ratings.dense_ratings(view(spark, folder, "interactions_brand")).ratings


_PAIR_COUNTS = """SELECT a.feature_name, b.feature_name AS feature_name_other, COUNT(*) AS n
FROM {log} a JOIN {log} b ON a.person_id = b.person_id GROUP BY 1, 2"""


@query(
    "cooccurrence",
    oracle(
        "interactions_part",
        f"""SELECT feature_name, feature_name_other, CAST(n AS BIGINT) AS combination_count
FROM ({_PAIR_COUNTS.format(log="interactions_part")}) x""",
    ),
)
def _(spark, folder):
    return cooccurrence.cooccurrence(view(spark, folder, "interactions_part"))


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "cooccurrence_wide",
    oracle(
        "interactions_events",
        "SELECT feature_name, "
        + ", ".join(
            f"CAST(SUM(CASE WHEN feature_name_other = '{t}' THEN n ELSE 0 END) AS BIGINT) AS \"{t}\"" for t in _EVENT_TYPES
        )
        + f" FROM ({_PAIR_COUNTS.format(log='interactions_events')}) x GROUP BY feature_name",
    ),
)
def _(spark, folder):
    return cooccurrence.cooccurrence_wide(cooccurrence.cooccurrence(view(spark, folder, "interactions_events")))


@query(
    "cooccurrence_ratings",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND
    + f"""SELECT CAST(x1.item AS BIGINT) AS "user", CAST(x2.item AS BIGINT) AS item, CAST(n AS BIGINT) AS rating
FROM ({_PAIR_COUNTS.format(log="interactions_brand")}) x
JOIN f x1 ON x.feature_name = x1.feature_name JOIN f x2 ON x.feature_name_other = x2.feature_name""",
)
def _(spark, folder):
    counts = cooccurrence.cooccurrence(view(spark, folder, "interactions_brand"))
    return cooccurrence.cooccurrence_ratings(counts).ratings


_FRACTION = "CAST(('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "split_by_person",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND.rstrip()
    + f""",
s AS (SELECT person_id, CASE WHEN {_FRACTION.format(key="person_id")} < 0.9 THEN 'train' ELSE 'test' END AS split FROM p),
n AS (SELECT person_id, split, row_number() OVER (PARTITION BY split ORDER BY person_id) - 1 AS "user" FROM s)
SELECT split, CAST("user" AS BIGINT) AS "user", CAST(item AS BIGINT) AS item, CAST(COUNT(*) AS BIGINT) AS rating
FROM interactions_brand i JOIN n ON i.person_id = n.person_id JOIN f ON i.feature_name = f.feature_name
GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    train, test = ratings.split_by_person(indexed.ratings, indexed.persons, 0.9)
    sides = [side.select(F.lit(name).alias("split"), "*") for name, side in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


@query(
    "cohort_sample",
    oracle(
        "interactions_brand",
        f"""SELECT person_id, feature_name FROM interactions_brand
WHERE {_FRACTION.format(key="person_id")} < 0.01""",
    ),
)
def _(spark, folder):
    return ratings.cohort_sample(view(spark, folder, "interactions_brand"))


# --- delimited tables and sinks ---------------------------------------------

_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _part_as_delimited(spark, folder) -> str:
    """The part table as a delimited table with its metadata, in a new folder."""
    place = new_path(spark, "delimited")
    part = spark.read.parquet(f"{folder}/part.parquet")
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _PART_COLUMNS], F.lit(""))
    part.select(line).write.text(f"{place}/PART.RRF")
    described = part.select(F.explode(F.array(*[F.lit(c) for c in _PART_COLUMNS])).alias("c")).groupBy("c").count()
    described.select(F.concat_ws("|", "c", F.col("count").cast("string"), F.lit("PART.RRF"), F.lit(""))).write.text(
        f"{place}/{rrf.COLUMNS_TABLE}"
    )
    listed = [("PART.RRF", ",".join(_PART_COLUMNS)), (rrf.COLUMNS_TABLE, "COL,DES,FIL")]
    metadata = spark.createDataFrame([(f"{name}|a table|{columns}|",) for name, columns in listed], "line string")
    metadata.write.text(f"{place}/{rrf.FILES_TABLE}")
    return place


@query("rrf_scan", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _PART_COLUMNS) + " FROM part WHERE p_size > 9")
def _(spark, folder):
    return rrf.read_table(spark, _part_as_delimited(spark, folder), "PART.RRF", where="length(p_size) > 1")


@query(
    "rrf_columns",
    "SELECT c AS COL, CAST((SELECT COUNT(*) FROM part) AS VARCHAR) AS DES, 'PART.RRF' AS FIL FROM (VALUES "
    + ", ".join(f"('{c}')" for c in _PART_COLUMNS)
    + ") t(c)",
)
def _(spark, folder):
    return rrf.column_descriptions(spark, _part_as_delimited(spark, folder), "PART.RRF")


@query(
    "sink_roundtrip",
    oracle(
        "feature_vectors",
        """SELECT CAST(item AS BIGINT) AS item, feature_name, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
round(CAST(embedding[64] AS DOUBLE), 6) AS last, CAST(len(embedding) AS BIGINT) AS dimensions FROM feature_vectors""",
    ),
)
def _(spark, folder):
    vectors = view(spark, folder, "feature_vectors")
    place = new_path(spark, "sinks")
    # as doubles, which CSV text gives back exactly
    embeddings = vectors.select("item", F.col("embedding").cast("array<double>").alias("embedding"))
    sinks.write_embeddings(embeddings, f"{place}/csv", "csv")
    sinks.write_embeddings(embeddings, f"{place}/parquet")
    sinks.write_index(vectors.select("feature_name", "item"), f"{place}/index")
    wide = spark.read.option("header", "true").csv(f"{place}/csv")
    long = spark.read.parquet(f"{place}/parquet")
    ends = wide.select(
        F.col("item").cast("bigint"), F.col("emb_vec_0").cast("double").alias("first"), F.col("emb_vec_63").cast("double").alias("last")
    )
    sized = long.select("item", F.size("embedding").cast("bigint").alias("dimensions"))
    return spark.read.parquet(f"{place}/index").join(ends, "item").join(sized, "item")


# --- curation ---------------------------------------------------------------

_CLEAN = "lower(replace({c}, '.', ''))"


@query(
    "clean_code",
    oracle("concepts", f"SELECT line_no, CODE, {_CLEAN.format(c='CODE')} AS clean FROM concepts"),
)
def _(spark, folder):
    return view(spark, folder, "concepts").select("line_no", "CODE", clean_code(F.col("CODE")).alias("clean"))


_SELECTED = "coalesce(" + " OR ".join(
    f"contains({_CLEAN.format(c='{c}')}, '{d.lower()}')" for d in DISEASES
) + ", FALSE)"


@query(
    "disease_selection",
    oracle("concepts", f"SELECT line_no, CODE, {_SELECTED.format(c='CODE')} AS selected FROM concepts"),
)
def _(spark, folder):
    return view(spark, folder, "concepts").select(
        "line_no", "CODE", matches_disease(F.col("CODE"), DISEASES).alias("selected")
    )


@query(
    "regex_filter",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(?:"
    + "|".join(f"(?:{p})" for p in NAME_PATTERNS)
    + ")')",
)
def _(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.filter(matches_any(F.col("p_name"), NAME_PATTERNS)).select("p_partkey", "p_name")


_FIRSTS = """,
english AS (SELECT * FROM concepts WHERE LAT = 'ENG'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SAB, CUI ORDER BY line_no) AS rn FROM english) x
           WHERE rn = 1)
"""


@query(
    "first_per_key",
    oracle(
        "concepts",
        """SELECT CUI, SAB, STR, SCUI, line_no FROM
(SELECT *, row_number() OVER (PARTITION BY CUI ORDER BY line_no) AS rn FROM concepts) x WHERE rn = 1""",
    ),
)
def _(spark, folder):
    rows = view(spark, folder, "concepts").select("CUI", "SAB", "STR", "SCUI", "line_no")
    return firsts.first_per_key(rows, "CUI", "line_no")


@query(
    "concept_join",
    oracle(("concepts", "relationships"), "").rstrip()
    + _FIRSTS
    + """SELECT r.CUI1, r.CUI2, r.RELA, r.line_no, c.STR AS label, c.SCUI AS source_code
FROM relationships r LEFT JOIN firsts c ON c.SAB = 'RXNORM' AND c.CUI = r.CUI2""",
)
def _(spark, folder):
    concepts = view(spark, folder, "concepts").filter("LAT = 'ENG'")
    relations = view(spark, folder, "relationships").select("CUI1", "CUI2", "RELA", "line_no")
    return curation.attach_concept(relations, concepts, "RXNORM", "CUI2", {"STR": "label", "SCUI": "source_code"})


_TREAT = """,
treat AS (
  SELECT r.CUI1 AS Indication_CUI, r.CUI2 AS Compound_CUI, m.STR AS Indication_MeSH_Label, m.SCUI AS Indication_MeSH_SCUI,
         x.STR AS Compound_RXNORM_Label, x.SCUI AS Compound_RXNORM_SCUI,
         v.LAT AS ICD10CM_LAT, v.SAB AS ICD10CM_SAB, v.STR AS ICD10CM_STR, v.SCUI AS ICD10CM_SCUI, v.CODE AS ICD10CM_CODE
  FROM relationships r
  LEFT JOIN firsts m ON m.SAB = 'MSH' AND m.CUI = r.CUI1
  LEFT JOIN firsts x ON x.SAB = 'RXNORM' AND x.CUI = r.CUI2
  LEFT JOIN firsts v ON v.SAB = 'ICD10CM' AND v.CUI = r.CUI1
  WHERE r.SAB = 'MED-RT' AND r.RELA = 'may_treat')
"""


@query("may_treat", oracle(("concepts", "relationships"), "").rstrip() + _FIRSTS.rstrip() + _TREAT + "SELECT * FROM treat")
def _(spark, folder):
    concepts = view(spark, folder, "concepts").filter("LAT = 'ENG'")
    return curation.may_treat(concepts, view(spark, folder, "relationships"), "ICD10CM")


_BOUND = "CAST(substr(split_part(clean, '-', {n}), 2) AS BIGINT)"
_EXPANDED = f"""SELECT {{columns}}, CASE WHEN contains(clean, '-')
       THEN concat('c', CASE WHEN n < 10 THEN '0' ELSE '' END, CAST(n AS VARCHAR)) ELSE clean END AS clean
FROM (SELECT *, CASE WHEN contains(clean, '-') THEN {_BOUND.format(n=1)} ELSE 0 END AS low,
             CASE WHEN contains(clean, '-') THEN {_BOUND.format(n=2)} ELSE 0 END AS high FROM {{table}}) e,
     LATERAL unnest(generate_series(low, high)) AS t(n)"""


@query(
    "expand_code_range",
    oracle("concepts", "").rstrip()
    + f""",
cleaned AS (SELECT line_no, {_CLEAN.format(c='CODE')} AS clean FROM concepts)
"""
    + _EXPANDED.format(columns="line_no", table="cleaned"),
)
def _(spark, folder):
    cleaned = view(spark, folder, "concepts").select("line_no", clean_code(F.col("CODE")).alias("clean"))
    return expand_code_ranges(cleaned, "clean")


_MEMBERS = """
members AS (SELECT concat('R', CAST(p_partkey AS VARCHAR)) AS node, p_partkey, p_brand, p_size,
                   COUNT(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part),
grouped AS (SELECT node, p_partkey, MIN(node) OVER (PARTITION BY p_brand, p_size) AS "group" FROM members WHERE n > 1)
"""


@query("connected_groups", f"WITH {_MEMBERS} SELECT node, \"group\" FROM grouped")
def _(spark, folder):
    return components.connected_groups(curation.form_pairs(view(spark, folder, "relationships")))


@query(
    "group_representative",
    f"WITH {_MEMBERS} SELECT \"group\", arg_min(node, p_partkey) AS representative FROM grouped GROUP BY \"group\"",
)
def _(spark, folder):
    forms = store(curation.form_pairs(view(spark, folder, "relationships")), "forms").df
    return components.group_representatives(forms, components.connected_groups(forms))


@query(
    "expand_selected",
    oracle(("concepts", "relationships"), "").rstrip()
    + _FIRSTS.rstrip()
    + _TREAT
    + f"""SELECT Indication_CUI, Compound_CUI, Compound_RXNORM_SCUI, ICD10CM_CODE FROM treat t
WHERE EXISTS (SELECT 1 FROM treat s WHERE {_SELECTED.format(c='s.ICD10CM_CODE')}
              AND s.Compound_RXNORM_SCUI IS NOT DISTINCT FROM t.Compound_RXNORM_SCUI)""",
)
def _(spark, folder):
    concepts = view(spark, folder, "concepts").filter("LAT = 'ENG'")
    treat = store(curation.may_treat(concepts, view(spark, folder, "relationships"), "ICD10CM"), "treat").df
    chosen = treat.filter(matches_disease(F.col("ICD10CM_CODE"), DISEASES))
    return curation.all_rows_of(treat, chosen, "Compound_RXNORM_SCUI").select(
        "Indication_CUI", "Compound_CUI", "Compound_RXNORM_SCUI", "ICD10CM_CODE"
    )


@query(
    "form_fanout",
    oracle(
        "relationships",
        """SELECT r.CUI1 AS Indication_CUI, f.CUI2 AS Compound_CUI FROM relationships r
JOIN relationships f ON f.RELA = 'has_form' AND f.SAB = 'RXNORM' AND f.CUI1 = r.CUI2
WHERE r.RELA = 'may_treat'""",
    ),
)
def _(spark, folder):
    relations = view(spark, folder, "relationships")
    treated = relations.filter("RELA = 'may_treat'").select(
        F.col("CUI1").alias("Indication_CUI"), F.col("CUI2").alias("Compound_CUI")
    )
    return curation.fan_out_to_forms(treated, curation.form_pairs(relations))


@query(
    "curated_dataset",
    oracle(("concepts", "relationships"), "").rstrip()
    + _FIRSTS.rstrip()
    + _TREAT.rstrip()
    + ","
    + _MEMBERS.rstrip()
    + f""",
chosen AS (SELECT arg_min(node, p_partkey) AS cui FROM grouped GROUP BY "group"),
trimmed AS (SELECT Compound_RXNORM_Label, Compound_RXNORM_SCUI, ICD10CM_CODE, ICD10CM_STR, Compound_CUI,
                   {_SELECTED.format(c='ICD10CM_CODE')} AS selected_diseases_indication,
                   {_CLEAN.format(c='ICD10CM_CODE')} AS clean
            FROM treat WHERE ICD10CM_STR IS NOT NULL),
kept AS (SELECT t.* FROM trimmed t JOIN chosen ON Compound_CUI = cui WHERE selected_diseases_indication),
widened AS (SELECT * FROM trimmed t WHERE EXISTS
            (SELECT 1 FROM kept k WHERE k.Compound_RXNORM_SCUI IS NOT DISTINCT FROM t.Compound_RXNORM_SCUI)),
expanded AS ({_EXPANDED.format(
    columns="Compound_RXNORM_Label, Compound_RXNORM_SCUI, ICD10CM_CODE, ICD10CM_STR, Compound_CUI, selected_diseases_indication",
    table="widened")})
SELECT Compound_RXNORM_Label, Compound_RXNORM_SCUI, ICD10CM_CODE, ICD10CM_STR, f.CUI2 AS Compound_CUI,
       selected_diseases_indication, clean AS CLEAN_ICD10CM_CODE
FROM expanded e JOIN relationships f ON f.RELA = 'has_form' AND f.SAB = 'RXNORM' AND f.CUI1 = e.Compound_CUI""",
)
def _(spark, folder):
    return curation.curated_dataset(
        view(spark, folder, "concepts"), view(spark, folder, "relationships"), DISEASES
    )


# --- similarity and ranking -------------------------------------------------

_PAIR_OF_VECTORS = "CAST(e.embedding AS DOUBLE[]), CAST(f.first_embedding AS DOUBLE[])"


@query(
    "cosine_similarity",
    oracle(
        "first_of_label",
        f"""SELECT e.vec_id, f.first_id, round(list_cosine_similarity({_PAIR_OF_VECTORS}), 6) AS sim
FROM embeddings e JOIN first_of_label f ON e.label = f.label""",
    ),
)
def _(spark, folder):
    firsts_ = view(spark, folder, "first_of_label")
    pairs = spark.read.parquet(f"{folder}/embeddings.parquet").join(firsts_, "label")
    return pairs.select("vec_id", "first_id", cosine_similarity(F.col("embedding"), F.col("first_embedding")).alias("sim"))


@query(
    "euclidean_similarity",
    oracle(
        "first_of_label",
        f"""SELECT e.vec_id, f.first_id, round(1 / (1 + list_distance({_PAIR_OF_VECTORS})), 6) AS sim
FROM embeddings e JOIN first_of_label f ON e.label = f.label""",
    ),
)
def _(spark, folder):
    firsts_ = view(spark, folder, "first_of_label")
    pairs = spark.read.parquet(f"{folder}/embeddings.parquet").join(firsts_, "label")
    return pairs.select("vec_id", "first_id", euclidean_similarity(F.col("embedding"), F.col("first_embedding")).alias("sim"))


_MEMBER_ROWS = """,
members AS (
  SELECT feature_name AS referential, feature_name, CAST(1 AS DOUBLE) AS weight FROM feature_vectors
  UNION ALL
  SELECT referential_name, feature_name, weight FROM composites)
"""
_SCORES = """,
sims AS (SELECT v.feature_name, m.referential, SUM(m.weight * {sim}) / SUM(m.weight) AS score
         FROM feature_vectors v CROSS JOIN members m JOIN feature_vectors r ON m.feature_name = r.feature_name
         GROUP BY 1, 2)
"""
_VECTORS = "CAST(v.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])"
_COSINE_SCORES = (
    oracle(("feature_vectors", "composites"), "").rstrip()
    + _MEMBER_ROWS.rstrip()
    + _SCORES.format(sim=f"list_cosine_similarity({_VECTORS})")
)


def _similarity_inputs(spark, folder):
    return view(spark, folder, "feature_vectors").select("feature_name", "embedding"), view(spark, folder, "composites")


@query(
    "referentials",
    oracle(("feature_vectors", "composites"), "").rstrip()
    + _MEMBER_ROWS
    + "SELECT referential, feature_name, round(weight, 6) AS weight FROM members",
)
def _(spark, folder):
    vectors, composites = _similarity_inputs(spark, folder)
    return similarity.referentials(vectors, composites)


@query("score_features", _COSINE_SCORES + "SELECT feature_name, referential, round(score, 6) AS score FROM sims")
def _(spark, folder):
    return similarity.score_features(*_similarity_inputs(spark, folder))


@query(
    "score_features_euclidean",
    oracle(("feature_vectors", "composites"), "").rstrip()
    + _MEMBER_ROWS.rstrip()
    + _SCORES.format(sim=f"(1 / (1 + list_distance({_VECTORS})))")
    + "SELECT feature_name, referential, round(score, 6) AS score FROM sims",
)
def _(spark, folder):
    return similarity.score_features(*_similarity_inputs(spark, folder), measure="euclidean")


_RANKED = """,
ranked AS (SELECT feature_name, referential, score,
                  CAST(rank() OVER (PARTITION BY referential ORDER BY score DESC) AS BIGINT) AS rank FROM sims)
"""


@query(
    "feature_ranks",
    _COSINE_SCORES.rstrip() + _RANKED + "SELECT feature_name, referential, round(score, 6) AS score, rank FROM ranked",
)
def _(spark, folder):
    vectors, composites = _similarity_inputs(spark, folder)
    return similarity.ranked_scores(similarity.score_features(vectors, composites, ranked=True), vectors.count())


@query(
    "rank_features",
    _COSINE_SCORES.rstrip()
    + _RANKED
    + """SELECT feature_name, round(AVG(score), 6) AS mean_score, round(median(score), 6) AS median_score,
round(AVG(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank,
CAST(SUM(CASE WHEN rank <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS number_in_top_30
FROM ranked GROUP BY feature_name""",
)
def _(spark, folder):
    return similarity.rank_features(*_similarity_inputs(spark, folder))


@query(
    "feature_ranks_twins",
    oracle("feature_twins", "").rstrip()
    + """,
members AS (SELECT concat('label_', CAST(label AS VARCHAR)) AS referential, embedding,
                   CAST(1 AS DOUBLE) / (1 + vec_id % 3) AS weight FROM embeddings),
sims AS (SELECT v.feature_name, m.referential,
                SUM(m.weight * list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])))
                / SUM(m.weight) AS score
         FROM feature_twins v CROSS JOIN members m GROUP BY 1, 2)
SELECT feature_name, referential, round(score, 6) AS score,
       CAST(rank() OVER (PARTITION BY referential ORDER BY round(score, 12) DESC) AS BIGINT) AS rank FROM sims""",
)
def _(spark, folder):
    twins = view(spark, folder, "feature_twins")
    composites = view(spark, folder, "composites")
    scores = similarity.score_features(twins, composites, referential_patterns=["label_"])
    return similarity.ranked_scores(scores, twins.count())


_LABELS = range(10)


@query(
    "ranked_list",
    _COSINE_SCORES.rstrip()
    + _RANKED
    + "SELECT feature_name, "
    + ", ".join(
        f"round(MAX(CASE WHEN referential = 'label_{k}' THEN score END), 6) AS label_{k}_score, "
        f"MAX(CASE WHEN referential = 'label_{k}' THEN rank END) AS label_{k}_rank"
        for k in _LABELS
    )
    + """, round(AVG(score), 6) AS mean_score, round(median(score), 6) AS median_score,
round(AVG(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank,
CAST(SUM(CASE WHEN rank <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS number_in_top_30
FROM ranked WHERE starts_with(referential, 'label_') GROUP BY feature_name""",
)
def _(spark, folder):
    vectors = view(spark, folder, "feature_vectors")
    return similarity.embedding_ranked_list(
        vectors.select("item", "embedding"),
        vectors.select("item", "feature_name"),
        composites=view(spark, folder, "composites"),
        referential_patterns=["label_"],
    )


@query(
    "similarity_variance",
    oracle(
        "feature_vectors",
        f"""SELECT round(var_pop(list_cosine_similarity({_VECTORS})), 6) AS similarity_variance
FROM feature_vectors v CROSS JOIN feature_vectors r""",
    ),
)
def _(spark, folder):
    value = factorization.similarity_variance(view(spark, folder, "feature_vectors"))
    return spark.createDataFrame([(value,)], "similarity_variance double")


# --- evaluation -------------------------------------------------------------


@query(
    "rating_metrics",
    oracle(
        ("ratings_true", "ratings_pred"),
        """SELECT round(sqrt(AVG((rating - prediction) * (rating - prediction))), 6) AS rmse,
round(AVG(abs(rating - prediction)), 6) AS mae,
round(1 - SUM((rating - prediction) * (rating - prediction)) / (var_pop(rating) * COUNT(*)), 6) AS rsquared,
round(1 - var_samp(rating - prediction) / var_samp(rating), 6) AS exp_var
FROM ratings_true t JOIN ratings_pred p ON t.userID = p.userID AND t.itemID = p.itemID""",
    ),
)
def _(spark, folder):
    return rating.rating_metrics(view(spark, folder, "ratings_true"), view(spark, folder, "ratings_pred"))


def _listed(table: str, order: str, where: str = "TRUE") -> str:
    return f"""(SELECT userID, itemID, CAST(rank AS BIGINT) AS rank FROM
(SELECT userID, itemID, row_number() OVER (PARTITION BY userID ORDER BY {order}) AS rank FROM {table} WHERE {where}) x)"""


@query("top_k_items", oracle("ratings_pred", f"SELECT * FROM {_listed('ratings_pred', 'prediction DESC, itemID')} l WHERE rank <= 10"))
def _(spark, folder):
    return ranking.top_k_items(view(spark, folder, "ratings_pred"), 10, score="prediction")


@query("latest_k_items", oracle("ratings_true", f"SELECT * FROM {_listed('ratings_true', 'timestamp DESC, itemID')} l WHERE rank <= 10"))
def _(spark, folder):
    return ranking.latest_k_items(view(spark, folder, "ratings_true"), 10)


@query("threshold_items", oracle("ratings_pred", f"SELECT * FROM {_listed('ratings_pred', 'prediction DESC, itemID', 'prediction >= 25')} l"))
def _(spark, folder):
    predicted = store(view(spark, folder, "ratings_pred"), "predicted").df
    return ranking.threshold_items(predicted, 25, score="prediction")


def _ranking_oracle(order: str, where: str, cut: str, k: int) -> str:
    return oracle(("ratings_kept", "ratings_pred"), "").rstrip() + f""",
listed AS (SELECT * FROM {_listed('ratings_pred', order, where)} l WHERE {cut}),
truth AS (SELECT userID, COUNT(*) AS n_true FROM ratings_kept GROUP BY userID),
hits AS (SELECT l.userID, l.rank, row_number() OVER (PARTITION BY l.userID ORDER BY l.rank) AS nth
         FROM listed l JOIN ratings_kept t ON l.userID = t.userID AND l.itemID = t.itemID),
per_user AS (
  SELECT u.userID, n_true, COUNT(h.rank) AS hits, SUM(CASE WHEN h.rank <= {k} THEN 1 ELSE 0 END) AS hits_k,
         coalesce(SUM(CASE WHEN h.rank <= {k} THEN 1 / ln(h.rank + 1) END), 0) AS dcg,
         coalesce(SUM(h.nth / h.rank), 0) AS precisions
  FROM (SELECT DISTINCT l.userID, n_true FROM listed l JOIN truth t ON l.userID = t.userID) u
  LEFT JOIN hits h ON u.userID = h.userID GROUP BY 1, 2),
ideal AS (SELECT n.n, SUM(1 / ln(i.i + 1)) AS gain FROM generate_series(1, {k}) n(n), generate_series(1, {k}) i(i)
          WHERE i.i <= n.n GROUP BY 1)
SELECT round(AVG(hits_k / {k}), 6) AS precision_at_k, round(AVG(hits / n_true), 6) AS recall_at_k,
       round(AVG(dcg / gain), 6) AS ndcg_at_k, round(AVG(precisions / n_true), 6) AS map_at_k
FROM per_user JOIN ideal ON ideal.n = least(n_true, {k})"""


@query("ranking_metrics", _ranking_oracle("prediction DESC, itemID", "TRUE", "rank <= 10", 10))
def _(spark, folder):
    return ranking.ranking_metrics(view(spark, folder, "ratings_kept"), view(spark, folder, "ratings_pred"))


@query("ranking_metrics_by_time_stamp", _ranking_oracle("timestamp DESC, itemID", "TRUE", "rank <= 10", 10))
def _(spark, folder):
    return ranking.ranking_metrics(
        view(spark, folder, "ratings_kept"),
        view(spark, folder, "ratings_pred"),
        method="by_time_stamp",
        prediction="timestamp",
    )


@query("ranking_metrics_by_threshold", _ranking_oracle("prediction DESC, itemID", "prediction >= 25", "TRUE", 10))
def _(spark, folder):
    kept = store(view(spark, folder, "ratings_kept"), "kept").df
    predicted = store(view(spark, folder, "ratings_pred"), "predicted").df
    return ranking.ranking_metrics(kept, predicted, method="by_threshold", threshold=25)


@query(
    "recall_curve",
    oracle(("recall_lists", "recall_targets"), "").rstrip()
    + """,
found AS (SELECT t.point_id, t.query, l.position AS pos FROM recall_targets t
          JOIN recall_lists l ON l.point_id = t.point_id AND l.feature_name = t.target
          WHERE NOT list_contains(t.query, t.target)),
ranked AS (SELECT f.point_id, f.pos - COUNT(q.position) AS rank FROM found f
           LEFT JOIN recall_lists q ON q.point_id = f.point_id AND list_contains(f.query, q.feature_name) AND q.position < f.pos
           GROUP BY f.point_id, f.pos),
longest AS (SELECT MAX(n) AS n FROM (SELECT COUNT(*) AS n FROM recall_lists GROUP BY point_id) x)
SELECT CAST(k AS BIGINT) AS k,
       round(CAST(COUNT(r.rank) AS DOUBLE) / (SELECT COUNT(*) FROM recall_targets), 6) AS recall
FROM (SELECT unnest(generate_series(0, (SELECT n FROM longest))) AS k) c LEFT JOIN ranked r ON r.rank < c.k
GROUP BY k""",
)
def _(spark, folder):
    lists = store(view(spark, folder, "recall_lists"), "lists").df
    return recall.recall_curve(lists, store(view(spark, folder, "recall_targets"), "targets").df)


# --- diversity --------------------------------------------------------------


@query(
    "pairwise_items",
    oracle(
        "reco",
        """SELECT a.userID, a.itemID AS i1, b.itemID AS i2
FROM reco a JOIN reco b ON a.userID = b.userID AND a.itemID <= b.itemID""",
    ),
)
def _(spark, folder):
    return pairing.pairs_within(view(spark, folder, "reco"), "userID", "itemID")


@query(
    "train_reco_overlap",
    oracle(
        ("history", "candidates"),
        "SELECT userID, itemID FROM history INTERSECT SELECT userID, itemID FROM candidates",
    ),
)
def _(spark, folder):
    return diversity.train_reco_overlap(view(spark, folder, "history"), view(spark, folder, "candidates"))


_SIM = """,
cnt AS (SELECT itemID, COUNT(*) AS c FROM history GROUP BY itemID),
pairs AS (SELECT a.itemID AS i1, b.itemID AS i2, COUNT(*) AS n FROM history a
          JOIN history b ON a.userID = b.userID AND a.itemID <= b.itemID GROUP BY 1, 2),
sim AS (SELECT i1, i2, n / (sqrt(x.c) * sqrt(y.c)) AS sim FROM pairs
        JOIN cnt x ON i1 = x.itemID JOIN cnt y ON i2 = y.itemID)
"""
_INTRALIST = _SIM.rstrip() + """,
inner_sim AS (SELECT a.userID, AVG(coalesce(sim, 0)) AS avg_il_sim FROM reco a
              JOIN reco b ON a.userID = b.userID AND a.itemID < b.itemID
              LEFT JOIN sim ON i1 = a.itemID AND i2 = b.itemID GROUP BY a.userID)
"""
_SERENDIPITY = _SIM.rstrip() + """,
per_item AS (SELECT r.userID, r.itemID, (1 - AVG(coalesce(sim, 0))) * MAX(r.relevance) AS user_item_serendipity
             FROM reco r JOIN history h ON r.userID = h.userID
             LEFT JOIN sim ON i1 = least(r.itemID, h.itemID) AND i2 = greatest(r.itemID, h.itemID) GROUP BY 1, 2),
per_user AS (SELECT userID, AVG(user_item_serendipity) AS user_serendipity FROM per_item GROUP BY userID)
"""
_HISTORY, _BOTH = oracle("history", "").rstrip(), oracle(("history", "reco"), "").rstrip()


def _history_and_reco(spark, folder):
    """Both tables written once; recommendations are derived from the written history."""
    history = store(view(spark, folder, "history"), "history").df
    return history, store(view(spark, folder, "reco", history=history), "reco").df


def _reco_and_similarity(spark, folder):
    history, reco = _history_and_reco(spark, folder)
    return reco, diversity.cooccurrence_similarity(history)


@query("cooccurrence_similarity", _HISTORY + _SIM + "SELECT i1, i2, round(sim, 6) AS sim FROM sim")
def _(spark, folder):
    return diversity.cooccurrence_similarity(store(view(spark, folder, "history"), "history").df)


_LINE_SIM = """,
rows_of AS (SELECT userID, itemID, COUNT(*) AS n FROM supplier_lines GROUP BY 1, 2),
cnt AS (SELECT itemID, SUM(n) AS c FROM rows_of GROUP BY itemID),
pairs AS (SELECT a.itemID AS i1, b.itemID AS i2, SUM(a.n * b.n) AS n FROM rows_of a
          JOIN rows_of b ON a.userID = b.userID AND a.itemID <= b.itemID GROUP BY 1, 2)
SELECT i1, i2, round(n / (sqrt(x.c) * sqrt(y.c)), 6) AS sim FROM pairs
JOIN cnt x ON i1 = x.itemID JOIN cnt y ON i2 = y.itemID
"""


@query("cooccurrence_similarity_log", oracle("supplier_lines", "").rstrip() + _LINE_SIM)
def _(spark, folder):
    return diversity.cooccurrence_similarity(view(spark, folder, "supplier_lines"))


@query(
    "item_feature_similarity",
    """SELECT v.vec_id AS i1, r.vec_id AS i2,
round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS sim
FROM embeddings v JOIN embeddings r ON v.vec_id <= r.vec_id""",
)
def _(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return diversity.item_feature_similarity(vectors, item="vec_id", features="embedding")


@query("intralist_similarity", _BOTH + _INTRALIST + "SELECT userID, round(avg_il_sim, 6) AS avg_il_sim FROM inner_sim")
def _(spark, folder):
    return diversity.intralist_similarity(*_reco_and_similarity(spark, folder))


@query("user_diversity", _BOTH + _INTRALIST + "SELECT userID, round(1 - avg_il_sim, 6) AS user_diversity FROM inner_sim")
def _(spark, folder):
    return diversity.user_diversity(*_reco_and_similarity(spark, folder))


@query("diversity", _BOTH + _INTRALIST + "SELECT round(AVG(1 - avg_il_sim), 6) AS diversity FROM inner_sim")
def _(spark, folder):
    return diversity.diversity(*_reco_and_similarity(spark, folder))


_NOVELTY = """,
nov AS (SELECT itemID, -log2(COUNT(*) / (SELECT COUNT(*) FROM history)) AS item_novelty FROM history GROUP BY itemID)
"""


@query("item_novelty", _HISTORY + _NOVELTY + "SELECT itemID, round(item_novelty, 6) AS item_novelty FROM nov")
def _(spark, folder):
    return diversity.item_novelty(view(spark, folder, "history"))


@query(
    "novelty",
    _BOTH
    + _NOVELTY
    + """SELECT round(SUM(item_novelty) / (SELECT COUNT(*) FROM reco), 6) AS novelty
FROM reco JOIN nov ON reco.itemID = nov.itemID""",
)
def _(spark, folder):
    return diversity.novelty(*_history_and_reco(spark, folder))


def _per_item(spark, folder):
    history, reco = _history_and_reco(spark, folder)
    similarity_table = diversity.cooccurrence_similarity(history)
    return diversity.user_item_serendipity(history, reco, similarity_table, relevance="relevance")


@query(
    "user_item_serendipity",
    _BOTH + _SERENDIPITY + "SELECT userID, itemID, round(user_item_serendipity, 6) AS user_item_serendipity FROM per_item",
)
def _(spark, folder):
    return _per_item(spark, folder)


@query("user_serendipity", _BOTH + _SERENDIPITY + "SELECT userID, round(user_serendipity, 6) AS user_serendipity FROM per_user")
def _(spark, folder):
    return diversity.user_serendipity(_per_item(spark, folder))


@query("serendipity", _BOTH + _SERENDIPITY + "SELECT round(AVG(user_serendipity), 6) AS serendipity FROM per_user")
def _(spark, folder):
    return diversity.serendipity(_per_item(spark, folder))


@query(
    "catalog_coverage",
    _BOTH
    + """ SELECT round(CAST((SELECT COUNT(DISTINCT itemID) FROM reco) AS DOUBLE)
/ (SELECT COUNT(DISTINCT itemID) FROM history), 6) AS catalog_coverage""",
)
def _(spark, folder):
    return diversity.catalog_coverage(*_history_and_reco(spark, folder))


@query(
    "distributional_coverage",
    _BOTH
    + """,
shares AS (SELECT COUNT(*) / (SELECT COUNT(*) FROM reco) AS p FROM reco GROUP BY itemID)
SELECT round(-SUM(p * log2(p)), 6) AS distributional_coverage FROM shares""",
)
def _(spark, folder):
    return diversity.distributional_coverage(view(spark, folder, "reco"))


# --- factorization ----------------------------------------------------------

_W = ('("user" % 7) / 7', '("user" % 3) / 3', '1 / (1 + "user" % 5)')
_H = ("(item % 4) / 4", "1 / (1 + item % 6)", "(item % 2) / 2 + 0.25")


@query(
    "nmf_metrics",
    oracle("interactions_brand", "").rstrip()
    + _INDEXED_BRAND.rstrip()
    + _GRID.rstrip()
    + f""",
cells AS (SELECT CAST(coalesce(n, 0) AS DOUBLE) AS x, {" + ".join(f"({w}) * ({h})" for w, h in zip(_W, _H))} AS y
          FROM g LEFT JOIN c ON g.person_id = c.person_id AND g.feature_name = c.feature_name),
unit AS (SELECT item, [{", ".join(f"CAST({h} AS DOUBLE)" for h in _H)}] AS h FROM f),
s AS (SELECT AVG(abs(x - y)) AS mae, AVG((x - y) * (x - y)) AS mse,
             AVG(CASE WHEN x <> 0 THEN abs(x - y) END) AS mae_a, AVG(CASE WHEN x <> 0 THEN (x - y) * (x - y) END) AS mse_a,
             AVG(CASE WHEN x = 0 THEN abs(x - y) END) AS mae_i, AVG(CASE WHEN x = 0 THEN (x - y) * (x - y) END) AS mse_i,
             CAST(SUM(CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n_a,
             CAST(SUM(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n_i FROM cells),
v AS (SELECT var_pop(list_cosine_similarity(a.h, b.h)) AS variance FROM unit a CROSS JOIN unit b)
SELECT metric, round(value, 6) AS value, 'test' AS dataset FROM (
  SELECT 'MAE' AS metric, mae AS value FROM s UNION ALL SELECT 'MAE_active', mae_a FROM s
  UNION ALL SELECT 'MAE_inactive', mae_i FROM s UNION ALL SELECT 'MSE', mse FROM s
  UNION ALL SELECT 'MSE_active', mse_a FROM s UNION ALL SELECT 'MSE_inactive', mse_i FROM s
  UNION ALL SELECT 'active_features', n_a FROM s UNION ALL SELECT 'inactive_features', n_i FROM s
  UNION ALL SELECT 'similarity_variance', variance FROM v) m""",
)
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    as_vector = lambda parts: F.array(*[F.expr(p.replace('"', "`")).cast("double") for p in parts])
    users = indexed.persons.select("user", as_vector(_W).alias("embedding"))
    items = indexed.features.select("item", as_vector(_H).alias("embedding"))
    return factorization.factor_metrics(indexed.ratings, users, items)


def _unnested(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("dimension", "value"))


def _brand_cells(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    return factorization.RatingCells(indexed.ratings, indexed.features.count(), unique_cells=True)


# One dimension from a given start: each half round is one division per row, so
# a few rounds can be written down in SQL.  Higher ranks have queries without SQL.
_ALPHA, _ROUNDS = 0.001, 3
_START_SQL = "CAST(1 AS DOUBLE) / (1 + item % 6)"


def _start(item):
    return F.array(1 / (1 + item % 6))


def _solver() -> dict:
    return {"start": _start, "tol": -1.0}


_LOG_CELLS = """,
cells AS (SELECT "user", item, CAST(COUNT(*) AS DOUBLE) AS x FROM interactions_brand i
          JOIN p ON i.person_id = p.person_id JOIN f ON i.feature_name = f.feature_name GROUP BY 1, 2)"""
_BRAND = oracle("interactions_brand", "").rstrip() + _INDEXED_BRAND.rstrip()


def _rounds(rounds: int = _ROUNDS, alpha: float = _ALPHA, cells: str = "cells", name: str = "t") -> str:
    """Common table expressions up to ``{name}_h{rounds}``, the item vectors."""
    parts = [f"{name}_h0 AS (SELECT item, {_START_SQL} AS h FROM f)"]
    for r in range(1, rounds + 1):
        h, w = f"{name}_h{r - 1}", f"{name}_w{r}"
        parts.append(f"""{w} AS (SELECT "user", SUM(x * h) / ((SELECT SUM(h * h) FROM {h}) + {alpha} * (SELECT COUNT(*) FROM f)) AS w
FROM {cells} c JOIN {h} h ON c.item = h.item GROUP BY "user")""")
        parts.append(f"""{name}_h{r} AS (SELECT f.item, coalesce(SUM(x * w), 0)
/ ((SELECT SUM(w * w) FROM {w}) + {alpha} * (SELECT COUNT(*) FROM {w})) AS h
FROM f LEFT JOIN (SELECT c.item, x, w FROM {cells} c JOIN {w} w ON c."user" = w."user") s ON f.item = s.item GROUP BY f.item)""")
    return ",\n" + ",\n".join(parts)


_ITEM_VECTORS = f"""
SELECT CAST(item AS BIGINT) AS item, CAST(0 AS INTEGER) AS dimension, round(h, 6) AS value FROM t_h{_ROUNDS}"""
_NAMED_VECTORS = f"""
SELECT CAST(h.item AS BIGINT) AS item, feature_name, CAST(0 AS INTEGER) AS dimension, round(h, 6) AS value
FROM t_h{_ROUNDS} h JOIN f ON h.item = f.item"""


def _fitted(spark, folder, **options):
    data = _brand_cells(spark, folder)
    return _unnested(factorization.fit(data, 1, _ALPHA, _ROUNDS, **_solver(), **options).items, "item")


@query("nmf_embeddings", _BRAND + _LOG_CELLS + _rounds() + _ITEM_VECTORS)
def _(spark, folder):
    return _fitted(spark, folder)


@query("nmf_embeddings_joined", _BRAND + _LOG_CELLS + _rounds() + _ITEM_VECTORS)
def _(spark, folder):
    return _fitted(spark, folder, model_bytes=0)


# vectors with one dimension of three set, so that each is solved by itself
_FIXED = [f"CASE WHEN item % 3 = {j} THEN {_START_SQL} ELSE 0 END" for j in range(3)]


@query(
    "nmf_fold_in",
    _BRAND
    + _LOG_CELLS
    + f""",
norms AS (SELECT item % 3 AS dimension, SUM(({_START_SQL}) * ({_START_SQL})) AS hh FROM f GROUP BY 1)
SELECT CAST(u."user" AS BIGINT) AS "user", CAST(n.dimension AS INTEGER) AS dimension,
       round(coalesce(SUM(x * {_START_SQL.replace('item', 'c.item')}), 0) / (MAX(hh) + {_ALPHA} * (SELECT COUNT(*) FROM f)), 6) AS value
FROM (SELECT DISTINCT "user" FROM cells) u CROSS JOIN norms n
LEFT JOIN cells c ON c."user" = u."user" AND c.item % 3 = n.dimension GROUP BY 1, 2""",
)
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    data = factorization.RatingCells(indexed.ratings, indexed.features.count(), unique_cells=True)
    vectors = F.array(*[F.expr(v).cast("double") for v in _FIXED])
    return _unnested(factorization.fold_in(data, indexed.features.select("item", vectors.alias("embedding")), _ALPHA), "user")


_GRID_ALPHAS = (0.0, 0.001)


def _grid_oracle() -> str:
    """Score of each setting: rounds on the train side, fold-in and error on the test side."""
    text = _BRAND + f""",
s AS (SELECT *, CASE WHEN {_FRACTION.format(key="person_id")} < 0.9 THEN 0 ELSE 1 END AS side FROM p),
sided AS (SELECT s."user", item, side, CAST(COUNT(*) AS DOUBLE) AS x FROM interactions_brand i
          JOIN s ON i.person_id = s.person_id JOIN f ON i.feature_name = f.feature_name GROUP BY 1, 2, 3),
train AS (SELECT * FROM sided WHERE side = 0),
test AS (SELECT * FROM sided WHERE side = 1)"""
    scores = []
    for k, alpha in enumerate(_GRID_ALPHAS):
        h = f"g{k}_h2"
        text += _rounds(2, alpha, "train", f"g{k}") + f""",
g{k}_w AS (SELECT "user", SUM(x * h) / ((SELECT SUM(h * h) FROM {h}) + {alpha} * (SELECT COUNT(*) FROM f)) AS w
           FROM test c JOIN {h} h ON c.item = h.item GROUP BY "user"),
g{k}_e AS (SELECT (SUM(x * x) - 2 * SUM(x * w * h) + (SELECT SUM(w * w) FROM g{k}_w) * (SELECT SUM(h * h) FROM {h}))
                  / ((SELECT COUNT(*) FROM g{k}_w) * (SELECT COUNT(*) FROM f)) AS mse
           FROM test c JOIN {h} h ON c.item = h.item JOIN g{k}_w w ON c."user" = w."user")"""
        scores.append(
            f"SELECT CAST(1 AS INTEGER) AS embedding_size, CAST({alpha} AS DOUBLE) AS regularization, "
            f"CAST(2 AS INTEGER) AS max_iterations, round(1 / (1 + mse), 6) AS score FROM g{k}_e"
        )
    return text + "\n" + "\nUNION ALL\n".join(scores)


@query("nmf_grid_search", _grid_oracle())
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    train, test = ratings.split_by_person(indexed.ratings, indexed.persons, 0.9)
    found = factorization.grid_search(
        train, test, indexed.features.count(), [1], list(_GRID_ALPHAS), [2], "MSE", workers=2, unique_cells=True, **_solver()
    )
    return found.scores


_TRAINING = (1,), (_ALPHA,), (_ROUNDS,)


@query(
    "nmf_ranked_list",
    _BRAND
    + _LOG_CELLS
    + _rounds()
    + f""",
named AS (SELECT feature_name, h FROM t_h{_ROUNDS} h JOIN f ON h.item = f.item),
sims AS (SELECT a.feature_name, b.feature_name AS referential, 1 / (1 + abs(a.h - b.h)) AS score FROM named a CROSS JOIN named b)"""
    + _RANKED
    + """SELECT feature_name, round(AVG(score), 6) AS mean_score, round(median(score), 6) AS median_score,
round(AVG(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank,
CAST(SUM(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS number_in_top_5
FROM ranked GROUP BY feature_name""",
)
def _(spark, folder):
    log = view(spark, folder, "interactions_brand")
    trained = training.train_embeddings(log, *_TRAINING, measure="MSE", **_solver())
    return similarity.embedding_ranked_list(
        trained.embeddings.drop("feature_name"), trained.features, wide=False, measure="euclidean", top_k=5
    )


@query("train_embeddings", _BRAND + _LOG_CELLS + _rounds() + _NAMED_VECTORS)
def _(spark, folder):
    log = view(spark, folder, "interactions_brand")
    trained = training.train_embeddings(log, *_TRAINING, measure="MSE", **_solver())
    return _unnested(trained.embeddings, "item", "feature_name")


@query(
    "train_embeddings_cooc",
    _BRAND
    + f""",
cells AS (SELECT a.item AS "user", b.item, CAST(n AS DOUBLE) AS x FROM ({_PAIR_COUNTS.format(log="interactions_brand")}) x
          JOIN f a ON x.feature_name = a.feature_name JOIN f b ON x.feature_name_other = b.feature_name)"""
    + _rounds()
    + _NAMED_VECTORS,
)
def _(spark, folder):
    log = view(spark, folder, "interactions_brand")
    trained = training.train_cooccurrence_embeddings(log, *_TRAINING, ratio=0.9, measure="MSE", **_solver())
    return _unnested(trained.embeddings, "item", "feature_name")


# the ranks and rounds of the first round, over the whole tables; no SQL
@query("nmf_embeddings_rank6")
def _(spark, folder):
    return _unnested(factorization.fit(_brand_cells(spark, folder), 6, 0.0, 30).items, "item")


@query("train_embeddings_ranks")
def _(spark, folder):
    trained = training.train_embeddings(view(spark, folder, "interactions_brand"), (4, 8), (0.0,), (20,), workers=2)
    return _unnested(trained.embeddings, "item", "feature_name")


@query("nmf_grid_search_ranks")
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_brand"), mode="sum")
    train, test = ratings.split_by_person(indexed.ratings, indexed.persons, 0.9)
    found = factorization.grid_search(
        train, test, indexed.features.count(), [4, 8], [0.0, 0.001], [10], "MSE", workers=4, unique_cells=True
    )
    return found.scores


@query("nmf_ranked_list_cosine")
def _(spark, folder):
    trained = training.train_embeddings(view(spark, folder, "interactions_brand"), (6,), (0.0,), (20,))
    return similarity.embedding_ranked_list(trained.embeddings.drop("feature_name"), trained.features)


@query("train_embeddings_cooc_rank6")
def _(spark, folder):
    log = view(spark, folder, "interactions_brand")
    trained = training.train_cooccurrence_embeddings(log, (6,), (0.0,), (20,), ratio=0.9)
    return _unnested(trained.embeddings, "item", "feature_name")


# the default size and regularization, over many items, with both factors as tables
@query("nmf_embeddings_rank50")
def _(spark, folder):
    indexed = ratings.sparse_ratings(view(spark, folder, "interactions_part"), mode="sum")
    data = factorization.RatingCells(indexed.ratings, indexed.features.count(), unique_cells=True)
    return _unnested(factorization.fit(data, 50, 0.05, 2, model_bytes=0).items, "item")


# what a training has committed, read back
@query("training_roundtrip", _BRAND + _LOG_CELLS + _rounds() + _NAMED_VECTORS)
def _(spark, folder):
    log = view(spark, folder, "interactions_brand")
    place = new_path(spark, "model")
    training.save_training(training.train_embeddings(log, *_TRAINING, measure="MSE", **_solver()), place)
    return _unnested(training.read_training(spark, place).embeddings, "item", "feature_name")


@query("metrics_roundtrip", ORACLES["nmf_metrics"])
def _(spark, folder):
    place = new_path(spark, "metrics")
    sinks.write_metrics(QUERIES["nmf_metrics"](spark, folder), place)
    return spark.read.schema(factorization.METRIC_SCHEMA).json(place)
