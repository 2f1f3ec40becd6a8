"""Gradloom: exam-question analytics and text pipelines as Spark DataFrame operators."""
