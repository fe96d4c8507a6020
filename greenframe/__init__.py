"""greenframe: profile, repair, synthesise and cost tabular data with Spark.

The subpackages are

``sources``    reading, writing and describing collections of tables
``functions``  column expressions (energy, SQL text, prompts, patterns)
``operators``  DataFrame -> DataFrame operators
``plans``      SQL pass-through, workload runs and ready-made table queries
``streaming``  the telemetry operators over an unbounded stream
"""

__version__ = "0.1.0"
