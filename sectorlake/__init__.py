"""sectorlake: file-system structures and document corpora as Spark DataFrames."""
