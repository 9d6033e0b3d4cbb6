"""Operations for building language-model training data on Spark.

Nothing else in the package imports this subpackage.  ``queries.py`` registers the
``opN_<name>`` queries; every other module holds one operator with its own interface.
"""
