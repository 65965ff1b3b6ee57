"""PySpark-native analytics over drug-label data: sources, relational views, risk statistics, dashboards."""
