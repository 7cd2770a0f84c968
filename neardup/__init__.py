"""neardup: exact and near-duplicate detection as Spark DataFrame jobs.

Every public function takes and returns DataFrames and leaves physical planning
to Catalyst and AQE. Start with ``neardup.plans.dataflow.find_duplicates``.
"""

__version__ = "0.1.0"
