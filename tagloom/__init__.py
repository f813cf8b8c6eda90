"""Sensor-data analytics as Spark DataFrame operators.

Conventions shared by every operator:

* functions take and return DataFrames and run no action, except where a bounded
  piece of metadata (a row count, quantiles, categories, coefficients) has to be
  known to build the plan;
* Spark rows have no order, so order-dependent operators take ``order_by`` (ending
  in a unique tie-breaker) and an optional ``partition_by``;
* NULL means missing; ``sources`` turns NaN into NULL on ingestion;
* the session runs in UTC with ANSI mode on (see ``session.configure``).
"""
