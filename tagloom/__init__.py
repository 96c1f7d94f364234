"""tagloom: Spark jobs over tagged-file catalogs and training corpora."""
