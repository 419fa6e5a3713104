"""All queries of this subpackage."""

import corpus_pipeline  # noqa: F401
from marketlab.llm import decontamination, divergence, extraction, hmm, manifest, mixing, multi_index, neardup, packing, paragraphs, resampling, toxicity, urls  # noqa: F401
from marketlab.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
