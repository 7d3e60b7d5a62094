"""factloom: a grounded fact layer as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; see README.md.
"""
