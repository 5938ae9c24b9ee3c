"""A Spark-native relational query engine with a fluent interface over declared entities."""
