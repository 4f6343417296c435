"""Row-local masks on a streaming DataFrame.

Noise, generalisation and Laplace release look at one row at a time and draw from the row
id, so a stream is masked like a table, without state. Swapping, perturbation and the hybrid
need facts about the whole table and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.functions.draws import Draws
from veilframe.operators.masks import TableFacts, release
from veilframe.spec import MaskingConfig, MaskSpec

STREAMABLE = ("noise", "generalization", "differential_privacy")


def mask_stream(
    stream: DataFrame, spec: MaskSpec, config: MaskingConfig, draws: Draws
) -> DataFrame:
    """Released columns of every arriving row; the category pair comes from the spec."""
    if config.method not in STREAMABLE:
        raise ValueError(f"{config.method} needs the whole table; a stream allows {', '.join(STREAMABLE)}")
    left, right = spec.category_pair
    return release(stream, spec, config, draws, TableFacts(0, 0.0, 2, left, right))
