"""tessera: curation of image-prompt and multimodal conversation data on Spark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function
built on public PySpark APIs; Catalyst plans the work.
"""

__version__ = "0.1.0"
