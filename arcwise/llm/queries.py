"""The queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .langid import op2_language_id
from .lattice import op8_lattice
from .line_dedup import ORACLE_SQL as LINE_SQL
from .line_dedup import op10_line_dedup
from .media_png import op7_media_png
from .mixing import op5_mixing
from .packing import op1_best_fit_packing
from .simhash import op9_simhash
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op4_token_counts
from .token_orc import op6_token_orc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_language_id, op3_suffix_dedup, op4_token_counts, op5_mixing, op6_token_orc, op7_media_png, op8_lattice, op9_simhash, op10_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": LINE_SQL}
