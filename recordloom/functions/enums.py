"""Enumerations of the records, and what is outside of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how a page was got, what a page is, what a title is, and how far its extraction came
MODES = ["direct_html", "alternate_first_party_html", "browser_rendered_dom", "challenge_page", "invalid_content", "network_failure"]
PAGE_KINDS = ["catalogue_home", "catalogue_list", "programs_index", "program_page"]
CLASSES = [
    "included", "excluded_masters", "excluded_doctoral", "excluded_professional_graduate", "excluded_graduate_certificate", "excluded_joint_degree", "excluded_dual_degree", "excluded_combined_ug_grad",
    "excluded_progressive_degree", "excluded_minor", "excluded_not_minor", "excluded_certificate", "excluded_non_degree", "excluded_out_of_section", "excluded_not_a_program", "manual_review",
]
STATUSES = ["pending", "complete", "failed", "incomplete"]
ENUMERATIONS = {"mode": MODES, "page_kind": PAGE_KINDS, "class": CLASSES, "status": STATUSES}


def outside(value: Column, values: list[str]) -> Column:
    """Whether a value is none of those; null is none."""
    return ~F.coalesce(value.isin(values), F.lit(False))


def violations(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, enumeration, value) of every value that is outside of its enumeration; `columns` names the column of each."""
    each = [F.when(outside(F.col(c), ENUMERATIONS[e]), F.struct(F.lit(e).alias("enumeration"), F.col(c).cast("string").alias("value"))) for e, c in columns.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*each))).alias("v")).select(key, "v.enumeration", "v.value")


def fetch_error(allowed: Column, challenged: Column, missing: Column) -> Column:
    """The error that an attempt ends in, or null: a path that may not be read, no body, or a page that asks for a human."""
    return F.when(~allowed, "robots_disallowed").when(missing, "network_failure").when(challenged, "human_verification_required")
