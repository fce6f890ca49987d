"""Operations of a training-data pipeline: ten operators, their queries and SQL.

Nothing else in the package imports this subpackage, and it imports nothing
from the rest of the package, so that either can be used without the other.
"""
