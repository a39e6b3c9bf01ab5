"""proseloom: a Spark-native engine for document quality and text curation."""
