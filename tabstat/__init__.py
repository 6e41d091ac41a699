"""tabstat: cleaning, profiling, normality tests, PCA and linear/logistic
modelling of tabular observations as Spark jobs.

Subpackages: ``sources`` (tables, CSV, sinks), ``functions`` (column
expressions), ``operators`` (aggregates, ranks, Gram matrices, models),
``plans`` (prepare, flows, reports, query registry and oracles),
``streaming`` (the stateless cleaning as a streaming job).
"""

__version__ = "0.1.0"
