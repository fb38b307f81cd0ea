"""Tidemill: prepare, profile, split and model tables on Spark.

Everything here is a function over DataFrames. Work that needs a fitted value
(a median, a bound, a class list) runs one aggregate and then continues as a
plain projection, so the plan that touches the data stays inside Catalyst.
"""

__version__ = "0.1.0"
