"""Query registry: name -> callable(spark, sf_dir) and name -> DuckDB SQL."""
