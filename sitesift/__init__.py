"""sitesift: a crawl archive turned into a clean, labelled content corpus with Spark.

Column functions live in ``sitesift.functions``, table-level operators in
``sitesift.operators``, archive readers and derived inputs in
``sitesift.sources``, end-to-end jobs and the query catalog in
``sitesift.plans``, and the incremental (Structured Streaming) variant in
``sitesift.streaming``.
"""

__version__ = "0.1.0"
