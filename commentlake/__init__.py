"""commentlake — review-discussion analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from the public
"""

__all__ = ["session", "schemas"]
