"""Spark-native text-quality analytics: rules, derivations, corpus statistics and reports as DataFrame plans."""
