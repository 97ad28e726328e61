"""All registered queries; importing the modules registers them."""

from notelens.plans import text_queries  # noqa: F401  isort: skip
from notelens.plans import labelled_queries, mining_queries, scoring_queries, stream_queries  # noqa: F401
from notelens.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Mine examples, split their section counts and score the section baseline per short form."""
    return QUERIES["e11_dominant_section_baseline"](spark, sf_dir)
