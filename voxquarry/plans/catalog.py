"""All registered queries."""

from . import q_data, q_masks, q_raster, q_reports, q_text, q_voxels  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
