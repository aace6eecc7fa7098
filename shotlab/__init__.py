"""shotlab — replicate-parallel few-shot (in-context) evaluation on Spark.

Every step of a few-shot classification experiment — seeded replicate
sampling, label verbalising, demonstration draws, prompt assembly, token
remapping, n-gram features, a grid of regularised linear fits and the
classification metrics — is a DataFrame operator keyed by ``rep`` so that
all replicates run in one job and results do not depend on partitioning.
"""

from shotlab.config import Params

__all__ = ["Params"]
