"""Timeline-mining analytics on PySpark: DataFrame-to-DataFrame operators and the queries built from them."""
