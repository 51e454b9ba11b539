"""quire: structure captured web content (HTML, fragments, grids, TSV) at corpus scale on Spark.

Every operator is a ``DataFrame -> DataFrame`` function meant for ``df.transform``; the document is held as a
relation of tokens (``nodes``) and tables as a relation of cells (``cells``), so the work is joins, windows and
aggregates that Catalyst plans and Tungsten executes.
"""

__version__ = "0.1.0"
