"""Sheafwork: prepare and score text corpora with Spark DataFrames.

Layers, from small to large:

* ``functions``  - ``Column -> Column`` helpers, all JVM-side expressions
* ``operators``  - ``DataFrame -> DataFrame`` steps built from them
* ``sources``    - catalogs, split-addressed scans, feature tables on disk
* ``plans``      - whole jobs (feature builders, evaluation) and the query registry
* ``streaming``  - the same steps over Structured Streaming inputs
"""
