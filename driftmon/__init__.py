"""driftmon: drift monitoring of text classifiers as Spark DataFrame operators."""
