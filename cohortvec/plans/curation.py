"""From concept and relationship tables to compound-indication pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import clean_code, expand_code_ranges, matches_disease
from ..operators.components import connected_groups, group_representatives
from ..operators.firsts import first_per_key
from ..session import store

# Source vocabularies and relation names of the input tables.
INDICATION_VOCABULARY = "MSH"
COMPOUND_VOCABULARY = "RXNORM"
TREATMENT_SOURCE, TREATMENT_RELATION = "MED-RT", "may_treat"
FORM_SOURCE, FORM_RELATION = "RXNORM", "has_form"
LANGUAGE = "ENG"


def first_concepts(concepts: DataFrame, vocabulary: str, order: str = "line_no") -> DataFrame:
    """First concept row of each CUI in one vocabulary."""
    return first_per_key(concepts.filter(F.col("SAB") == vocabulary), "CUI", order)


def attach_concept(
    relations: DataFrame, concepts: DataFrame, vocabulary: str, key: str, names: dict[str, str], order: str = "line_no"
) -> DataFrame:
    """Left join of ``key`` with the first concept of a vocabulary; ``names`` maps columns.

    The concepts are written first: Spark then broadcasts them if their true
    size allows, and otherwise can split a code with very many relations at
    run time, which it does only when both join sides are plain shuffles.
    """
    first = first_concepts(concepts.select("CUI", "SAB", order, *names), vocabulary, order)
    named = first.select(F.col("CUI").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    return relations.join(store(named, "concepts").df, key, "left")


def may_treat(concepts: DataFrame, relationships: DataFrame, vocabulary: str, order: str = "line_no") -> DataFrame:
    """Treatment relations with indication, compound and converted code.

    Three left joins on concept tables with one row per CUI; columns of the
    converted vocabulary carry its name as prefix.
    """
    relations = relationships.filter(
        (F.col("SAB") == TREATMENT_SOURCE) & (F.col("RELA") == TREATMENT_RELATION)
    ).select(F.col("CUI1").alias("Indication_CUI"), F.col("CUI2").alias("Compound_CUI"))
    labelled = attach_concept(
        relations,
        concepts,
        INDICATION_VOCABULARY,
        "Indication_CUI",
        {"STR": "Indication_MeSH_Label", "SCUI": "Indication_MeSH_SCUI"},
        order,
    )
    labelled = attach_concept(
        labelled,
        concepts,
        COMPOUND_VOCABULARY,
        "Compound_CUI",
        {"STR": "Compound_RXNORM_Label", "SCUI": "Compound_RXNORM_SCUI"},
        order,
    )
    others = [c for c in concepts.columns if c not in ("CUI", "SAB", order)]
    converted = attach_concept(
        labelled, concepts, vocabulary, "Indication_CUI", {c: f"{vocabulary}_{c}" for c in others}, order
    )
    # the vocabulary of a converted concept is the one asked for
    known = F.when(F.col(f"{vocabulary}_STR").isNotNull(), F.lit(vocabulary))
    return converted.withColumn(f"{vocabulary}_SAB", known)


def form_pairs(relationships: DataFrame) -> DataFrame:
    """Pairs of compounds that are forms of each other."""
    return relationships.filter((F.col("RELA") == FORM_RELATION) & (F.col("SAB") == FORM_SOURCE))


def fan_out_to_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Replace each compound by every form listed for it (inner join)."""
    links = forms.select(F.col("CUI1").alias("Compound_CUI"), F.col("CUI2").alias("_form"))
    return rows.join(links, "Compound_CUI").drop("Compound_CUI").withColumnRenamed("_form", "Compound_CUI")


def all_rows_of(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in ``chosen``; a missing key matches a missing key."""
    keys = store(chosen.select(F.col(key).alias("_key")).distinct(), "chosen").df
    return rows.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def curated_dataset(
    concepts: DataFrame,
    relationships: DataFrame,
    diseases: list[str],
    vocabulary: str = "ICD10CM",
    order: str = "line_no",
    match_mode: str = "contains",
    keep_unpaired: bool = False,
    legacy_ranges: bool = False,
) -> DataFrame:
    """Compounds that treat a selected disease, with all their indications.

    One compound per group of forms decides whether the group is kept: the
    first code of the group's earliest form pair.  Compounds in no form pair
    are left out of that choice unless ``keep_unpaired``.  At the end each
    compound is replaced by its listed forms, so a compound that is nobody's
    second code does not appear.  Runs jobs for the connected groups.
    """
    code, label, cleaned = f"{vocabulary}_CODE", f"{vocabulary}_STR", f"CLEAN_{vocabulary}_CODE"
    english = concepts.filter(F.col("LAT") == LANGUAGE)
    treated = (
        may_treat(english, relationships, vocabulary, order)
        .filter(F.col(label).isNotNull())
        .select(
            "Compound_RXNORM_Label",
            "Compound_RXNORM_SCUI",
            code,
            label,
            "Compound_CUI",
            matches_disease(F.col(code), diseases, match_mode).alias("selected_diseases_indication"),
            clean_code(F.col(code)).alias(cleaned),
        )
    )
    rows = store(treated, "treatments").df
    forms = store(form_pairs(relationships).select(order, "CUI1", "CUI2"), "form-pairs").df
    groups = connected_groups(forms)
    representatives = group_representatives(forms, groups, order=order)
    chosen = store(representatives.select(F.col("representative").alias("Compound_CUI")), "representatives").df
    selected = rows.filter("selected_diseases_indication")
    kept = selected.join(chosen, "Compound_CUI", "left_semi")
    if keep_unpaired:
        paired = groups.select(F.col("node").alias("Compound_CUI"))
        kept = kept.unionByName(selected.join(paired, "Compound_CUI", "left_anti"))
    widened = expand_code_ranges(all_rows_of(rows, kept, "Compound_RXNORM_SCUI"), cleaned, legacy_ranges)
    return fan_out_to_forms(widened, forms)
