"""Part of weft, a Spark-native engine for analysing crawled web corpora."""
