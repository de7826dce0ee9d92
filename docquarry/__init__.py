"""docquarry: a PySpark-native document retrieval, grounded question answering and corpus-preparation engine."""
