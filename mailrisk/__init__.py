"""mailrisk: email risk analytics as Spark jobs over whole tables.

Corpus preparation, TF-IDF spam model building and scoring, rule signals,
risk blending, detection history and dashboards, in batch or from a file
stream.  See README.md for the operator map and the plan design.
"""

__version__ = "0.1.0"
