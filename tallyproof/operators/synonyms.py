"""Synonyms: from cleaned names to a shared identity, through two lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions.text import finite_score, is_single_agent, normalize_name, strip
from tallyproof.operators.network import MERGED_PREFIX


def surface_forms(raw: DataFrame) -> DataFrame:
    """``(entity_id, type, name)`` -> distinct ``(name, surface)`` worth looking up.

    Rows rather than sets, so a name with very many spellings is not one row. Only exact control
    phrases are removed here.
    """
    spelled = raw.where(F.col("type").isin(V.RESOLVABLE_TYPES)).select("name").distinct()
    return (
        spelled.where(F.coalesce(strip(F.col("name")), F.lit("")) != "")
        .select(normalize_name(F.col("name")).alias("name"), strip(F.col("name")).alias("surface"))
        .where((F.col("name") != "") & ~F.col("name").isin(V.CONTROL_NAMES))
        .distinct()
    )


def study_surface_forms(studies: DataFrame) -> DataFrame:
    return surface_forms(
        studies.select(F.explode(S.INTERVENTIONS_PATH).alias("i")).select("i.type", "i.name")
    )


def best_candidates(candidates: DataFrame, min_score: float = V.MIN_MATCH_SCORE) -> DataFrame:
    """First-ranked candidate per name, if its score is finite and high enough.

    A better score further down the ranking does not count. ``min`` over a struct is combined
    map-side, so a name with very many candidates costs one row per task.
    """
    first = candidates.groupBy("name").agg(
        F.min(F.struct(F.col("rank"), F.col("rxcui"), F.col("score"))).alias("_best")
    )
    score = finite_score(F.col("_best.score"))
    return first.select("name", F.col("_best.rxcui").alias("rxcui"), score.alias("score")).where(
        (F.coalesce("rxcui", F.lit("")) != "") & (F.col("score") >= min_score)
    )


def single_ingredients(ingredients: DataFrame) -> DataFrame:
    """Concepts with exactly one different usable ingredient, however often its row was landed."""
    usable = (F.coalesce("ingredient_rxcui", F.lit("")) != "") & (
        F.coalesce("ingredient_name", F.lit("")) != ""
    )
    return (
        ingredients.where(usable)
        .groupBy("rxcui")
        .agg(
            F.min("ingredient_rxcui").alias("ingredient_rxcui"),
            F.max("ingredient_rxcui").alias("_last"),
            F.min("ingredient_name").alias("canonical_name"),
        )
        .where(F.col("ingredient_rxcui") == F.col("_last"))
        .drop("_last")
    )


def resolve_names(
    names: DataFrame,
    candidates: DataFrame,
    ingredients: DataFrame,
    min_score: float = V.MIN_MATCH_SCORE,
    pool: DataFrame | None = None,
) -> DataFrame:
    """``crosswalk(name, rxcui, canonical_name, score)`` of the names that resolve.

    ``pool`` optionally limits the lookup to a ``(name)`` table. Every join is an equi-join on a
    column that is unique on at least one side.
    """
    asked = names.select("name").distinct().where(is_single_agent(F.col("name")))
    if pool is not None:
        asked = asked.join(pool.select("name"), "name", "left_semi")
    return (
        asked.join(best_candidates(candidates, min_score), "name")
        .join(single_ingredients(ingredients), "rxcui")
        .select("name", F.col("ingredient_rxcui").alias("rxcui"), "canonical_name", "score")
    )


def merge_sources(forms: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """``(key, surface, sources)``: what was folded into each merged key, one row per name.

    Only keys with more than one source name, and only names that occur in the data analysed.
    """
    key = F.concat(F.lit(MERGED_PREFIX), F.col("rxcui")).alias("key")
    rows = forms.join(crosswalk.select("name", key), "name").select("key", "surface").distinct()
    many = rows.groupBy("key").agg(F.count("*").alias("sources")).where(F.col("sources") > 1)
    return rows.join(many, "key").select("key", "surface", "sources")


def resolution_totals(names: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row: distinct names asked, resolved, unresolved, and identities with several names."""
    seen = names.select("name").distinct().join(
        crosswalk.select("name", "rxcui"), "name", "left"
    )
    per_identity = seen.groupBy("rxcui").agg(F.count("*").alias("n"))
    known = F.col("rxcui").isNotNull()

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return per_identity.agg(
        total(F.lit(True)).alias("names"),
        total(known).alias("resolved"),
        total(~known).alias("unresolved"),
        F.count_if(known & (F.col("n") > 1)).alias("merged"),
    )
