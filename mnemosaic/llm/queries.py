"""The queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import knn, mixture, neardup, ranking, repetition, splitting, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_ranking": ranking.p1_ranking,
        "p1_agreement": ranking.p1_agreement,
        "p2_found": splitting.p2_found,
        "p2_pieces": splitting.p2_pieces,
        "p2_check": splitting.p2_check,
        "p3_found": neardup.p3_found,
        "p3_groups": neardup.p3_groups,
        "p3_members": neardup.p3_members,
        "p3_links": neardup.p3_links,
        "p5_found": knn.p5_found,
        "p5_knn": knn.p5_knn,
        "p5_recall": knn.p5_recall,
        "p7_ids": tokens.p7_ids,
        "p8_mixture": mixture.p8_mixture,
        "p8_shares": mixture.p8_shares,
        "p8_check": mixture.p8_check,
        "p9_found": repetition.p9_found,
        "p9_repetition": repetition.p9_repetition,
        "p9_lines": repetition.p9_lines,
        "p9_cleaned": repetition.p9_cleaned,
    }


def oracle_sql() -> dict[str, str]:
    return {**ranking.SQL, **splitting.SQL, **neardup.SQL, **knn.SQL, **mixture.SQL, **repetition.SQL}
