"""Operators that turn raw web text into training data, each one a Spark job."""
