"""Mask sensitive tables, measure what masking costs, pick the best setting."""

from veilframe.functions.draws import Draws
from veilframe.spec import MaskingConfig, MaskSpec

__all__ = ["Draws", "MaskSpec", "MaskingConfig"]
